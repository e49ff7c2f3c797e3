"""DuckDB SQL for the queries that SQL can express, each from the definition of its result and not from its method."""

from __future__ import annotations

from stopweave.llm import decontam, lines, mixing, neardup, substring

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

POSITIONAL_INDEX = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM documents),
items AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w
  FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least({decontam.WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM phrases),
grams AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT rid, i, n, item FROM grams JOIN phrases USING (n, g)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontam.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

COUNT_MIN = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + {substring.WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {substring.WINDOW} + 2)) AS i FROM d)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {substring.WINDOW})) AS p FROM repeated),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (rid) LEFT JOIN kept USING (rid)
"""

SUPER_MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_BLANK}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {neardup.SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {neardup.SHINGLE} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE {neardup.COMMON[0]} * c >= {neardup.COMMON[1]} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)
"""

_WEIGHTS = ", ".join(f"{w}e0" for w in mixing.WEIGHTS)

MIX_SOURCES = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN md5(text) END AS text_md5,
  len(regexp_extract_all(coalesce(text, ''), {_BLANK})) AS size FROM documents),
sums AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, [{_WEIGHTS}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS w,
  source_size * {mixing.REPEATS} AS cap FROM sums),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
final AS (SELECT source, source_size,
  least(cap::double, w * (SELECT level FROM levels WHERE cap / w >= level ORDER BY cap / w, level LIMIT 1)) AS target FROM levels),
placed AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size,
  ('0x' || substr(md5(coalesce(doc_id::varchar, text_md5, 'null') || '/0'), 1, 8))::bigint, doc_id) AS place,
  (('0x' || substr(md5('0/' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 12))::bigint + 0.5e0) / 281474976710656e0 AS shift FROM d)
SELECT doc_id, size, source_size, target,
  (floor(place * (target / nullif(source_size, 0)) + shift) - floor((place - 1) * (target / nullif(source_size, 0)) + shift))::bigint * size AS taken
FROM placed p JOIN final f ON p.source IS NOT DISTINCT FROM f.source
"""

SQL = {
    "op2_deletion_join": lines.SQL,
    "op3_positional_index": POSITIONAL_INDEX,
    "op4_count_min": COUNT_MIN,
    "op6_super_minhash": SUPER_MINHASH,
    "op10_mix_sources": MIX_SOURCES,
}
