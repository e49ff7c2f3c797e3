"""Transit lines of a map: what relations say about them, which ways they use, which of them a trip resembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopweave.functions import text
from stopweave.operators.rules import Rule, deep_attribute

#: What a trip and a line can have in common.
NAME, FROM, TO = 1, 2, 4
Attributes = Sequence[tuple[str, Rule | None]]


def line_id(name: Column, from_: Column, to: Column) -> Column:
    """A line is its name and its ends; colours do not tell lines apart."""
    return F.xxhash64(F.lit("line"), name, from_, to)


def transit_lines(
    relations: DataFrame, name: Attributes, from_: Attributes, to: Attributes, color: Attributes,
    line_chain: Sequence[tuple[str, str]] = (), station_chain: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """id of the relation, line, short_name, from_str, to_str (normalised, empty: unknown) and color of the relations
    that say something about a line."""
    read = lambda a: F.coalesce(deep_attribute(F.col("tags"), a, F.array(F.col("tags"))), F.lit("")) if a else F.lit("")
    rows = relations.select("id", read(name).alias("n"), read(from_).alias("f"), read(to).alias("t"), text.parse_color(read(color)).alias("color"))
    rows = rows.filter("n <> '' or f <> '' or t <> ''")
    rows = rows.select(
        "id", "color", text.normalise(F.col("n"), line_chain).alias("short_name"),
        text.normalise(F.col("f"), station_chain).alias("from_str"), text.normalise(F.col("t"), station_chain).alias("to_str"),
    )
    return rows.withColumn("line", line_id(F.col("short_name"), F.col("from_str"), F.col("to_str")))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row a line, with the smallest colour that some relation gives it."""
    return lines.groupBy("line", "short_name", "from_str", "to_str").agg(F.min("color").alias("color"))


def way_lines(relations: DataFrame, lines: DataFrame) -> DataFrame:
    """way and lines, the ascending array of lines that relations say use it."""
    parts = relations.select("id", F.explode("members").alias("m")).filter("m.type = 'way'")
    both = parts.join(lines.select("id", "line"), "id").groupBy(F.col("m.ref").alias("way"))
    return both.agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _similar_names(ours: DataFrame, theirs: DataFrame, same) -> DataFrame:
    """name and other: names (n) that are ``same``, found through a word they share or as a whole, each pair once."""

    def words(names: DataFrame, out: str) -> DataFrame:
        own = F.array_distinct(F.concat(text.tokens(F.col("n")), F.array("n")))
        return names.filter("n <> ''").distinct().select(F.col("n").alias(out), F.explode(own).alias("w"))

    pairs = words(ours, "name").join(words(theirs, "other"), "w").select("name", "other").distinct()
    return pairs.filter(same(F.col("other"), F.col("name")))


def resemblance(attrs: DataFrame, lines: DataFrame) -> DataFrame:
    """``key`` of attrs (key, short_name, line_from, line_to; empty: unknown) and like, an array of (line, bits).

    Bits tell whether name, from and to are similar. Names are compared once however many trips and lines have them, and
    only lines that share something with the trip are named; all others have the bits of line 0: what the trip itself
    does not know. A trip that knows nothing has null.
    """
    kinds = (("short_name", "short_name", text.line_similar, NAME), ("line_from", "from_str", text.jaccard_same, FROM), ("line_to", "to_str", text.jaccard_same, TO))
    shared = None
    for ours, theirs, same, bit in kinds:
        pairs = _similar_names(attrs.select(F.col(ours).alias("n")), lines.select(F.col(theirs).alias("n")), same)
        one = attrs.select("key", F.col(ours).alias("name")).join(pairs, "name").join(lines.select("line", F.col(theirs).alias("other")), "other")
        one = one.select("key", "line", F.lit(bit).alias("bit"))
        shared = one if shared is None else shared.unionByName(one)
    unknown = sum((F.when(F.col(c) == "", bit).otherwise(0) for c, _, _, bit in kinds), F.lit(0)).cast("long")
    rows = attrs.withColumn("_base", unknown)
    named = shared.groupBy("key", "line").agg(F.sum("bit").alias("bits"))
    bits = F.collect_list(F.struct("line", "bits"))
    rows = rows.join(named.groupBy("key").agg(F.array_sort(bits).alias("_like")), "key", "left")
    none = F.array().cast("array<struct<line:bigint,bits:bigint>>")
    like = F.transform(F.coalesce("_like", none), lambda x: F.struct(x["line"].alias("line"), (x["bits"] + F.col("_base")).alias("bits")))
    base = F.array(F.struct(F.lit(0).cast("long").alias("line"), F.col("_base").alias("bits")))
    return rows.select("key", F.when(F.col("_base") < NAME + FROM + TO, F.concat(base, like)).alias("like"))


def best_similarity(edge_lines: DataFrame, like: DataFrame) -> DataFrame:
    """key, eid and bits: what the trips of a key have in common with the edge's best line; nothing, where it has none.

    ``edge_lines``: eid and lines; ``like``: of :func:`resemblance`.
    """
    rows = edge_lines.select("eid", F.explode_outer("lines").alias("line"))
    named = like.filter("like is not null")
    pairs = named.select("key", F.explode("like").alias("l")).select("key", F.col("l.line").alias("line"), F.col("l.bits").alias("bits"))
    base = pairs.filter("line = 0").select("key", F.col("bits").alias("_base"))
    exact = rows.join(pairs.filter("line <> 0"), "line").groupBy("key", "eid").agg(
        F.max(F.struct(F.bit_count("bits").alias("n"), (-F.col("bits")).alias("b"))).alias("best")
    )
    return exact.join(base, "key").select(
        "key", "eid", F.when(F.bit_count("_base") > F.col("best.n"), F.col("_base")).otherwise(-F.col("best.b")).alias("bits")
    )
