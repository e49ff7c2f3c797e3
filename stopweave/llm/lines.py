"""Line dedup by a deletion-neighbourhood join: of lines at most one edit apart, the earliest is kept.

Lines are compared as they are. A line is dropped if an earlier one, by (doc_id, line number), equals it or,
for lines of ``LEAST`` characters and more, is one character's insertion, deletion or substitution away.

Equal lines are found by a 128-bit hash. For the others every line would emit one variant per character, so
two exact conditions go first, each with fewer keys. Let L be the length of the shorter line:

* an edit lies in one half, so the other half is equal: two keys for L and two for L - 1;
* cut into stretches of ``STRETCH`` characters, all before and all after the edit's stretch is equal.

Lines that share a stretch's surroundings emit the stretch's deletion variants as hashed keys: substitution
joins equal variants of equal position, insertion joins a variant with the shorter line's whole stretch.
A group of one key needs no pairs: its earliest line is within one edit of all the others, so each gets that
one as partner. Partners are verified by edit distance on the lines themselves.

All is SQL functions. Texts are read twice and never shuffled: the second time, lines are looked up in a
bitmap (``store.let_through``), 1 MB at any size, and only those it lets through are joined.

Nulls and ties: null and empty texts have no lines, empty lines do not count. Rows without doc_id come first;
of rows that share a doc_id, or have none, the one whose text has the smaller hash comes first. Rows that repeat
doc_id and text are one document, and what is kept in one of them is kept in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopweave.llm.store import let_through, stored

LEAST = 8
STRETCH = 64


def _lines(docs: DataFrame) -> DataFrame:
    """place (doc_id, hash of the text, line number), line, and the line's hash h1, h2."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line")
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), lines)
    return rows.filter(F.col("line") != "").select(
        F.struct("doc_id", "k", "line_no").alias("place"),
        "line",
        F.xxhash64(F.lit(1), "line").alias("h1"),
        F.xxhash64(F.lit(2), "line").alias("h2"),
    )


def _half_keys() -> Column:
    """Keys of both halves as the shorter, or as long, line (L = n) and as the longer one (L = n - 1)."""
    keys = []
    for less in (0, 1):
        size = F.col("n") - less
        half = F.floor(size / 2).cast("int")
        keys.append(F.xxhash64(F.lit(3), size, F.substring("line", F.lit(1), half)))
        keys.append(F.xxhash64(F.lit(4), size, F.substring("line", F.col("n") - (size - half) + 1, size - half)))
    return F.when(F.col("n") >= LEAST, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key other rows have, too."""
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    return rows.join(often, key)


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (h1, h2, first) with the line itself, read where it is first."""
    near = let_through(_lines(docs), "h1", wanted, "h1")
    near = near.select("h1", "h2", F.col("place").alias("first"), "line")
    found = near.join(wanted.select("h1", "h2", "first"), ["h1", "h2", "first"])
    return found.dropDuplicates(["h1", "h2"])


def _stretches() -> Column:
    """For L = n and L = n - 1, every stretch: L, where it begins, its length in this line, hash of its surroundings."""

    def cut(less: int) -> Column:
        size = F.col("n") - less
        count = F.ceil(size / STRETCH).cast("int")

        def stretch(s: Column) -> Column:
            begin = F.floor(s * size / count).cast("int")
            after = size - F.floor((s + 1) * size / count).cast("int")
            return F.struct(
                size.alias("l"),
                (begin + 1).alias("at"),
                (F.col("n") - begin - after).alias("w"),
                F.xxhash64(
                    size, s, F.substring("line", F.lit(1), begin), F.substring("line", F.col("n") - after + 1, after)
                ).alias("key"),
            )

        return F.transform(F.sequence(F.lit(0), count - 1), stretch)

    return F.concat(cut(0), cut(1))


def _variants() -> Column:
    """Keys of a stretch's deletion variants, and which part the line plays in the group of the key."""
    part = F.substring("line", F.col("at"), F.col("w"))
    without = lambda i: F.concat(F.substring(part, F.lit(1), i), F.substring(part, i + 2, F.col("w")))
    key = lambda kind, i, text: F.xxhash64(F.col("key"), F.lit(kind), i, text)
    places = F.sequence(F.lit(0), F.col("w") - 1)
    entry = lambda k, role: F.struct(k.alias("k"), F.lit(role).alias("role"))
    as_long = F.concat(
        F.transform(places, lambda i: entry(key("s", i, without(i)), "same")),
        F.array(entry(key("i", F.lit(0), part), "short")),
    )
    longer = F.transform(places, lambda i: entry(key("i", F.lit(0), without(i)), "long"))
    return F.when(F.col("l") == F.col("n"), as_long).otherwise(F.array_distinct(longer))


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that an earlier line is one edit away from, and that line's place, ``partner``."""
    keyed = distinct.select("h1", "h2", F.explode("halves").alias("half"))
    halves = _shared(keyed, "half").select("h1", "h2").distinct()
    wanted = distinct.select("h1", "h2", "first").join(halves, ["h1", "h2"])
    text = stored(_with_text(docs, wanted).withColumn("n", F.char_length("line")), "lines")
    cuts = text.select("h1", "h2", F.explode(_stretches()).alias("c")).select("h1", "h2", "c.*")
    around = _shared(cuts, "key")
    members = around.join(text, ["h1", "h2"]).withColumn("v", F.explode(_variants()))
    members = stored(members.select("h1", "h2", "first", F.col("v.k").alias("k"), F.col("v.role").alias("role")), "variants")
    who = F.struct("first", "h1", "h2")
    groups = members.groupBy("k").agg(
        F.min(F.when(F.col("role") != "long", who)).alias("_a"),
        F.min(F.when(F.col("role") == "long", who)).alias("_b"),
        F.min(who).alias("_lo"),
        F.max(who).alias("_hi"),
    )
    groups = groups.filter("_lo <> _hi").select("k", "_a", "_b")
    met = members.join(groups, "k").withColumn("_with", F.when(F.col("role") == "short", F.col("_b")).otherwise(F.col("_a")))
    pairs = met.filter(F.col("_with.first") < F.col("first")).select("h1", "h2", "_with").distinct()
    other = text.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    both = pairs.join(text.select("h1", "h2", "line"), ["h1", "h2"]).join(
        other, (F.col("_with.h1") == F.col("g1")) & (F.col("_with.h2") == F.col("g2"))
    )
    close = both.filter(F.levenshtein("line", "other", 1) == 1)
    return close.groupBy("h1", "h2").agg(F.min("_with.first").alias("partner"))


def judged_lines(docs: DataFrame) -> DataFrame:
    """place (doc_id, hash k of the text, line_no), kind (``kept``, ``equal`` or ``near``) and partner, the earlier line's
    place, of every line."""
    lines = _lines(docs).withColumn("n", F.char_length("line")).withColumn("halves", _half_keys())
    distinct = lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("halves").alias("halves"))
    distinct = stored(distinct, "distinct")
    near = near_lines(docs, distinct)
    known = distinct.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    rows = _lines(docs).select("place", "h1", "h2").join(known, ["h1", "h2"])
    again = ~F.col("place").eqNullSafe(F.col("first"))
    kind = F.when(again, "equal").when(F.col("partner").isNotNull(), "near").otherwise("kept")
    return rows.select("place", kind.alias("kind"), F.when(again, F.col("first")).otherwise(F.col("partner")).alias("partner"))


def _applied(docs: DataFrame) -> DataFrame:
    """doc_id, text without the lines that are dropped, and n_equal and n_near, how many these are, of every row.

    Only texts that, by the bitmap, may lose lines are joined with what they lose.
    """
    gone = judged_lines(docs).filter("kind <> 'kept'").withColumn("_id", F.xxhash64("place.doc_id", "place.k"))
    gone = gone.groupBy("_id", F.col("place.doc_id").alias("_doc"), F.col("place.k").alias("_k")).agg(
        F.collect_set("place.line_no").alias("_gone"),
        F.count_if(F.col("kind") == "equal").alias("n_equal"),
        F.count_if(F.col("kind") == "near").alias("n_near"),
    )
    gone = stored(gone, "gone")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("k"))
    rows = rows.withColumn("_id", F.xxhash64("doc_id", "k"))
    same = (rows._id == gone._id) & rows.doc_id.eqNullSafe(gone._doc) & (rows.k == gone._k)
    none = F.lit(0).cast("long")
    lost = let_through(rows, "_id", gone, "_id").join(gone, same, "left")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.filter(numbered, lambda s: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), s["i"]))
    text = F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    lost = lost.select("doc_id", text.alias("text"), F.coalesce("n_equal", none).alias("n_equal"), F.coalesce("n_near", none).alias("n_near"))
    whole = let_through(rows, "_id", gone, "_id", others=True).select("doc_id", "text", none.alias("n_equal"), none.alias("n_near"))
    return lost.unionByName(whole)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id and text, without the lines that are dropped, of every row; a null text stays null."""
    return _applied(docs).select("doc_id", "text")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of lines, of those equal to and those near an earlier one, and of those kept, and the SHA-256 of
    the text that is left, of every row."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != "")
    rows = _applied(docs).withColumn("n_kept", F.size(lines).cast("long"))
    total = F.col("n_kept") + F.col("n_equal") + F.col("n_near")
    return rows.select("doc_id", total.alias("n_lines"), "n_equal", "n_near", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents
), real AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, line_no) AS place FROM lines WHERE line <> ''
), firsts AS (
  SELECT line, min(place) AS place, length(line) AS n FROM real GROUP BY line
), keys AS (
  SELECT line, place, n, 'p' AS side, n AS l, substr(line, 1, n // 2) AS k FROM firsts WHERE n >= {LEAST}
  UNION ALL SELECT line, place, n, 's', n, right(line, n - n // 2) FROM firsts WHERE n >= {LEAST}
  UNION ALL SELECT line, place, n, 'p', n - 1, substr(line, 1, (n - 1) // 2) FROM firsts WHERE n >= {LEAST}
  UNION ALL SELECT line, place, n, 's', n - 1, right(line, n - 1 - (n - 1) // 2) FROM firsts WHERE n >= {LEAST}
), pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.n AS na, b.n AS nb
  FROM keys a JOIN keys b ON a.side = b.side AND a.l = b.l AND a.k = b.k AND b.place < a.place
), near AS (
  SELECT DISTINCT a AS line FROM pairs WHERE
    CASE WHEN na = nb THEN len(list_filter(range(1, na + 1), lambda i: a[i] <> b[i])) = 1
         WHEN na > nb THEN len(list_filter(range(1, na + 1), lambda i: substr(a, 1, i - 1) || substr(a, i + 1) = b)) > 0
         ELSE len(list_filter(range(1, nb + 1), lambda i: substr(b, 1, i - 1) || substr(b, i + 1) = a)) > 0 END
), judged AS (
  SELECT r.doc_id, r.line, r.line_no, CASE WHEN r.place <> f.place THEN 'equal' WHEN n.line IS NOT NULL THEN 'near' ELSE 'kept' END AS kind
  FROM real r JOIN firsts f ON r.line = f.line LEFT JOIN near n ON r.line = n.line
  UNION ALL SELECT doc_id, line, line_no, 'empty' FROM lines WHERE line = ''
)
SELECT d.doc_id, count(*) FILTER (kind IN ('equal', 'near', 'kept')) AS n_lines, count(*) FILTER (kind = 'equal') AS n_equal,
  count(*) FILTER (kind = 'near') AS n_near, count(*) FILTER (kind = 'kept') AS n_kept,
  CASE WHEN any_value(d.there) THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (kind IN ('kept', 'empty')), '')) END AS kept_sha256
FROM (SELECT DISTINCT doc_id, text IS NOT NULL AS there FROM documents) d LEFT JOIN judged j ON d.doc_id IS NOT DISTINCT FROM j.doc_id
GROUP BY d.doc_id
"""
