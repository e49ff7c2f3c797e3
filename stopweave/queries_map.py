"""Queries on the map side: extracts, graph steps, lines, tracks, sources; each with an oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopweave.functions import costs
from stopweave.operators import extract, graph, lines, rules, spatial
from stopweave.plans.world import view
from stopweave.queries import _hav, _ways, query
from stopweave.sources import exports, gtfs, osm

R = rules.Rule

# --- a map made of the warehouse tables: stops are nodes, trips ways, routes relations ---------------------

_MAP_KEEP = (R("kind", "0"), R("route", "1", rules.FLAT), R("route", "2"), R("stop", "1"))
_MAP_DROP = (R("kind", "3"), R("stop", "2"))


def _map(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    tag = lambda k, c: F.create_map(F.lit(k), c.cast("string"))
    nodes = view(spark, d, "stops").select(F.col("stop_id").alias("id"), "lat", "lon", tag("stop", F.col("stop_id") % 4).alias("tags"))
    ways = _ways(spark, d).withColumn("tags", tag("kind", F.col("id") % 7))
    member = F.struct(F.lit("way").alias("type"), F.col("trip_id").alias("ref"), F.lit("").alias("role"))
    parts = view(spark, d, "trips").groupBy("route_id").agg(F.array_sort(F.collect_list(member)).alias("members"))
    relations = parts.select(F.col("route_id").alias("id"), "members", tag("route", F.col("route_id") % 9).alias("tags"))
    return {"node": nodes, "way": ways, "relation": relations}


def _map_boxes(spark: SparkSession, d: str) -> DataFrame:
    near = view(spark, d, "stops").groupBy(F.col("zone") % 2)
    return near.agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), (F.min("lat") + 0.3).alias("max_lat"), (F.min("lon") + 0.3).alias("max_lon"))


_EXTRACT = """
WITH boxes AS (SELECT min(lat) AS a, min(lon) AS b, min(lat) + 0.3e0 AS c, min(lon) + 0.3e0 AS d FROM {stops} GROUP BY zone % 2),
inside AS (SELECT stop_id FROM {stops} s WHERE EXISTS (SELECT 1 FROM boxes x WHERE s.lat BETWEEN a AND c AND s.lon BETWEEN b AND d)),
rel AS (SELECT DISTINCT route_id, route_id % 9 = 1 AS flat FROM {trips} WHERE route_id % 9 IN (1, 2)),
held AS (SELECT trip_id FROM {trips} t JOIN rel r ON t.route_id = r.route_id WHERE NOT flat),
size AS (SELECT trip_id, count(*) AS n FROM {stop_times} GROUP BY trip_id),
way AS (SELECT trip_id AS id FROM size WHERE n >= 2 AND trip_id % 7 <> 3 AND (trip_id % 7 = 0 OR trip_id IN (SELECT trip_id FROM held))
  AND trip_id IN (SELECT trip_id FROM {stop_times} WHERE stop_id IN (SELECT stop_id FROM inside))),
used AS (SELECT DISTINCT stop_id AS id FROM {stop_times} WHERE trip_id IN (SELECT id FROM way)),
node AS (SELECT id FROM used UNION SELECT stop_id FROM inside WHERE stop_id % 4 = 1),
member AS (SELECT t.route_id AS id, count(*) AS n FROM {trips} t JOIN rel r ON t.route_id = r.route_id WHERE trip_id IN (SELECT id FROM way) GROUP BY t.route_id)
SELECT 'way' AS kind, w.id, s.n AS parts FROM way w JOIN size s ON w.id = s.trip_id
UNION ALL SELECT 'node', id, cast(0 AS bigint) FROM node
UNION ALL SELECT 'relation', id, n FROM member"""


def _entities(tables: dict[str, DataFrame]) -> DataFrame:
    size = {"node": F.lit(0), "way": F.size("nds") if "nds" in tables["way"].columns else F.lit(0), "relation": F.size("members")}
    found = [tables[k].select(F.lit(k).alias("kind"), "id", size[k].cast("long").alias("parts")) for k in ("way", "node", "relation")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(_EXTRACT)
def map_extract(spark: SparkSession, d: str) -> DataFrame:
    """Ways in boxes that are kept by tags or relations, their nodes, and relations of what is left."""
    return _entities(extract.extract(_map(spark, d), _map_boxes(spark, d), _MAP_KEEP, _MAP_DROP))


@query(
    """
WITH boxes AS (SELECT min(lat) AS a, min(lon) AS b, min(lat) + 0.3e0 AS c, min(lon) + 0.3e0 AS d FROM {stops} GROUP BY zone % 2)
SELECT DISTINCT trip_id AS way FROM {stop_times} st JOIN {stops} s ON st.stop_id = s.stop_id
WHERE EXISTS (SELECT 1 FROM boxes x WHERE s.lat BETWEEN a AND c AND s.lon BETWEEN b AND d)"""
)
def way_semijoin_bbox(spark: SparkSession, d: str) -> DataFrame:
    tables = _map(spark, d)
    inside = spatial.in_any_box(tables["node"], _map_boxes(spark, d)).select(F.col("id").alias("n"))
    return tables["way"].select(F.col("id").alias("way"), F.explode("nds").alias("n")).join(inside, "n", "left_semi").select("way").distinct()


@query(
    """
SELECT route_id AS id, route_id % 9 = 1 AS flat, count(*) AS n FROM {trips} WHERE route_id % 9 IN (1, 2) GROUP BY route_id"""
)
def kept_relations(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.kept_relations(_map(spark, d)["relation"], _MAP_KEEP, _MAP_DROP)
    return rows.select("id", "flat", F.size("members").cast("long").alias("n"))


@query("SELECT key, value, cast(flags AS int) AS flags FROM (VALUES ('a', '*', 0), ('a', 'x', 2), ('b', 'y', 0), ('c', '*', 4)) t(key, value, flags)")
def rule_union(spark: SparkSession, d: str) -> DataFrame:
    merged = rules.merged((R("a"), R("b", "y")), (R("a", "x", rules.MULTI), R("b", "y")), (R("c", "*", rules.SKIP_RELATION), R("a")))
    return spark.createDataFrame([(r.key, r.value, r.flags) for r in merged], "key string, value string, flags int")


# --- files: written, and read again -----------------------------------------------------------------------


def _file(spark: SparkSession, name: str) -> str:
    from stopweave.operators.graph import shared_folder

    return f"{shared_folder(spark)}/{name}"


def _read_back(spark: SparkSession, d: str, ending: str) -> DataFrame:
    path = _file(spark, f"map.{ending}")
    (osm.write_pbf if ending == "pbf" else osm.write_xml)(_map(spark, d), path.removeprefix("file:"))
    tables = osm.read(spark, path)
    node = tables["node"].select(F.lit("node").alias("kind"), "id", F.concat_ws(" ", *(F.format_string("%.7f", c) for c in ("lat", "lon"))).alias("body"), "tags")
    way = tables["way"].select(F.lit("way").alias("kind"), "id", F.array_join(F.transform("nds", lambda n: n.cast("string")), " ").alias("body"), "tags")
    member = lambda m: F.concat(m["type"], F.lit("/"), m["ref"].cast("string"), F.lit("/"), m["role"])
    relation = tables["relation"].select(F.lit("relation").alias("kind"), "id", F.array_join(F.transform("members", member), " ").alias("body"), "tags")
    rows = node.unionByName(way).unionByName(relation)
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("kind", "id", F.md5("body").alias("body"), tags.alias("tags"))


_ENTITIES = """
WITH w AS (SELECT trip_id, string_agg(cast(stop_id AS varchar), ' ' ORDER BY seq) AS body FROM {stop_times} GROUP BY trip_id),
r AS (SELECT route_id, string_agg(concat('way/', trip_id, '/'), ' ' ORDER BY trip_id) AS body FROM {trips} GROUP BY route_id)
SELECT 'node' AS kind, stop_id AS id, md5(concat(printf('%.7f', lat), ' ', printf('%.7f', lon))) AS body, concat('stop=', stop_id % 4) AS tags FROM {stops}
UNION ALL SELECT 'way', trip_id, md5(body), concat('kind=', trip_id % 7) FROM w
UNION ALL SELECT 'relation', route_id, md5(body), concat('route=', route_id % 9) FROM r"""


@query(_ENTITIES)
def osm_xml(spark: SparkSession, d: str) -> DataFrame:
    """A map written as XML and read again."""
    return _read_back(spark, d, "osm")


@query(_ENTITIES)
def osm_pbf(spark: SparkSession, d: str) -> DataFrame:
    """A map written in protocol buffers and read again."""
    return _read_back(spark, d, "pbf")


_FEED_SQL = """
WITH used AS (SELECT trip_id, CASE WHEN trip_id % 3 = 0 THEN concat('new', route_id % 50) ELSE concat('old', route_id % 50) END AS shape_id FROM {trips}),
files AS (
  SELECT 'stops' AS file, concat(stop_id, '|', printf('%.6f', lat), '|', printf('%.6f', lon)) AS row FROM {stops}
  UNION ALL SELECT 'trips', concat(t.trip_id, '|', t.route_id, '|', u.shape_id) FROM {trips} t JOIN used u ON t.trip_id = u.trip_id
  UNION ALL SELECT 'stop_times', concat(trip_id, '|', seq, '|', stop_id, '|', printf('%02d:%02d:%02d', dep_s // 3600, dep_s % 3600 // 60, dep_s % 60),
    '|', CASE WHEN trip_id % 3 = 0 THEN cast(seq * 100 AS varchar) ELSE '' END) FROM {stop_times}
  UNION ALL SELECT 'shapes', concat(shape_id, '|1') FROM (SELECT DISTINCT shape_id FROM used WHERE shape_id LIKE 'old%')
  UNION ALL SELECT 'shapes', concat('new', k, '|1') FROM (SELECT DISTINCT route_id % 50 AS k FROM {trips} WHERE trip_id % 3 = 0)
  UNION ALL SELECT 'attributions', 'warehouse|'
  UNION ALL SELECT 'attributions', 'OpenStreetMap contributors|https://www.openstreetmap.org/copyright'
  UNION ALL SELECT 'feed_info', 'publisher|url')
SELECT file, row, count(*) AS n FROM files GROUP BY file, row"""


@query(_FEED_SQL)
def gtfs_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed with new shapes for some trips, written as a zip file and read again."""
    trips, st = view(spark, d, "trips"), view(spark, d, "stop_times")
    text_ = lambda *c: [F.col(x).cast("string").alias(x) for x in c]
    line = lambda rows: rows.select("shape_id", F.lit(47.0).alias("shape_pt_lat"), F.lit(8.0).alias("shape_pt_lon"), F.lit(1).alias("shape_pt_sequence"))
    old = F.concat(F.lit("old"), (F.col("route_id") % 50).cast("string"))
    feed = {
        "stops": view(spark, d, "stops").select(*text_("stop_id"), "stop_name", F.round("lat", 6).alias("stop_lat"), F.round("lon", 6).alias("stop_lon")),
        "routes": view(spark, d, "routes").select(*text_("route_id"), "short_name", F.col("route_type").cast("int").alias("route_type")),
        "trips": trips.select(*text_("trip_id", "route_id"), old.alias("shape_id")),
        "stop_times": st.select(*text_("trip_id", "stop_id"), F.col("seq").cast("int").alias("stop_sequence"), gtfs.clock(F.col("dep_s")).alias("departure_time")),
        "shapes": line(spark.range(60).select(F.concat(F.lit("old"), F.col("id").cast("string")).alias("shape_id"))),
        "attributions": spark.createDataFrame([("warehouse", None)], "organization_name string, attribution_url string"),
        "feed_info": spark.createDataFrame([("publisher", "url"), ("", "url")], "feed_publisher_name string, feed_publisher_url string"),
    }
    part = trips.filter("trip_id % 3 = 0").select(*text_("trip_id"), F.concat(F.lit("new"), (F.col("route_id") % 50).cast("string")).alias("shape_id"))
    dists = st.filter("trip_id % 3 = 0").select(*text_("trip_id"), "seq", (F.col("seq") * 100.0).alias("dist"))
    path = _file(spark, "feed.zip").removeprefix("file:")
    gtfs.write(gtfs.with_shapes(feed, line(part.select("shape_id").distinct()), part, dists), path)
    got = gtfs.read(spark, path, _file(spark, "feed").removeprefix("file:"))
    bare = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = {
        "stops": [F.col("stop_id"), F.format_string("%.6f", "stop_lat"), F.format_string("%.6f", "stop_lon")],
        "trips": [F.col("trip_id"), F.col("route_id"), F.col("shape_id")],
        "stop_times": [F.col("trip_id"), bare("stop_sequence"), F.col("stop_id"), F.col("departure_time"), F.coalesce(F.col("shape_dist_traveled").cast("long").cast("string"), F.lit(""))],
        "shapes": [F.col("shape_id"), bare("shape_pt_sequence")],
        "attributions": [F.col("organization_name"), bare("attribution_url")],
        "feed_info": [F.col("feed_publisher_name"), F.col("feed_publisher_url")],
    }
    out = [got[t].select(F.lit(t).alias("file"), F.concat_ws("|", *c).alias("row")) for t, c in rows.items()]
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_.groupBy("file", "row").agg(F.count(F.lit(1)).alias("n"))


# --- lines of relations -----------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = _map(spark, d)
    routes = view(spark, d, "routes")
    tags = F.map_from_arrays(
        F.array(*map(F.lit, ("ref", "from", "to", "colour"))),
        F.array(F.col("short_name"), F.concat(F.lit("Depot "), (F.col("route_id") % 5).cast("string")), F.lit(""), F.format_string("#%06X", F.col("color"))),
    )
    relations = tables["relation"].drop("tags").join(routes.select(F.col("route_id").alias("id"), tags.alias("tags")), "id")
    one = lambda k: ((k, None),)
    return relations, lines.transit_lines(relations, one("ref"), one("from"), one("to"), one("colour"), [("^mac", "m")])


_LINES = """
WITH named AS (SELECT DISTINCT r.route_id, regexp_replace(lower(short_name), '^mac', 'm') AS short_name, concat('depot ', r.route_id % 5) AS from_str, color
  FROM {routes} r JOIN {trips} t ON r.route_id = t.route_id)
"""


@query(_LINES + "SELECT short_name, from_str, '' AS to_str, cast(min(color) AS int) AS color FROM named GROUP BY short_name, from_str")
def transit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Relations as lines, each once."""
    return lines.distinct_lines(_lines(spark, d)[1]).drop("line")


@query(
    _LINES
    + """SELECT t.trip_id AS way, count(DISTINCT short_name || '/' || from_str) AS n_lines, string_agg(DISTINCT short_name || '/' || from_str, ',' ORDER BY short_name || '/' || from_str) AS names
FROM {trips} t JOIN named n ON t.route_id = n.route_id GROUP BY t.trip_id"""
)
def way_lines(spark: SparkSession, d: str) -> DataFrame:
    relations, found = _lines(spark, d)
    rows = lines.way_lines(relations, found).select("way", F.size("lines").cast("long").alias("n_lines"), F.explode("lines").alias("line"))
    named = lines.distinct_lines(found).select("line", F.concat_ws("/", "short_name", "from_str").alias("name"))
    return rows.join(named, "line").groupBy("way", "n_lines").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


_RESEMBLE = """
WITH named AS (SELECT DISTINCT cast(route_id % 40 AS varchar) AS n, concat('stop ', route_id % 7) AS f, concat('end ', route_id % 3) AS t FROM {routes}),
attrs AS (SELECT route_id AS key, cast(route_id % 60 AS varchar) AS n, concat('stop ', route_id % 11) AS f, CASE WHEN route_id % 4 = 0 THEN '' ELSE concat('end ', route_id % 5) END AS t FROM {routes}),
j AS (SELECT a.key, a.t AS own, l.n || '/' || l.f || '/' || l.t AS line, CASE WHEN a.n = l.n THEN 1 ELSE 0 END AS name_bit, CASE WHEN a.f = l.f THEN 2 ELSE 0 END AS from_bit,
  CASE WHEN a.t = '' OR a.t = l.t THEN 4 ELSE 0 END AS to_bit FROM attrs a JOIN named l ON a.n = l.n OR a.f = l.f OR a.t = l.t)
SELECT key, line, cast(name_bit + from_bit + to_bit AS bigint) AS bits FROM j"""


@query(_RESEMBLE)
def line_resemblance(spark: SparkSession, d: str) -> DataFrame:
    """What trips' names and the lines of the map have in common, found through their words."""
    r = F.col("route_id")
    s = lambda c: c.cast("string")
    routes = view(spark, d, "routes")
    known = routes.select(s(r % 40).alias("short_name"), F.concat(F.lit("stop "), s(r % 7)).alias("from_str"), F.concat(F.lit("end "), s(r % 3)).alias("to_str")).distinct()
    known = known.withColumn("line", lines.line_id(F.col("short_name"), F.col("from_str"), F.col("to_str")))
    attrs = routes.select(
        r.alias("key"), s(r % 60).alias("short_name"), F.concat(F.lit("stop "), s(r % 11)).alias("line_from"),
        F.when(r % 4 == 0, "").otherwise(F.concat(F.lit("end "), s(r % 5))).alias("line_to"),
    )
    pairs = lines.resemblance(attrs, known).select("key", F.explode("like").alias("l")).filter("l.line <> 0 and l.bits & 3 > 0 or l.line <> 0 and l.bits = 4")
    rows = pairs.select("key", F.col("l.line").alias("line"), F.col("l.bits").alias("bits")).join(known, "line")
    base = attrs.select("key", F.col("line_to").alias("own"))
    rows = rows.join(base, "key").filter("bits & 3 > 0 or own <> '' and bits & 4 > 0")
    return rows.select("key", F.concat_ws("/", "short_name", "from_str", "to_str").alias("line"), "bits")


@query(
    """
WITH e AS (SELECT src * 1000000 + dst AS eid, cost, src % 8 AS bits FROM {edges})
SELECT eid, bits, CASE WHEN bits // 4 % 2 = 1 THEN c2 ELSE cast(floor(c2 * 1.1e0 + 0.5e0) AS bigint) END AS cost
FROM (SELECT *, CASE WHEN bits // 2 % 2 = 1 THEN c1 ELSE cast(floor(c1 * 1.05e0 + 0.5e0) AS bigint) END AS c2
  FROM (SELECT *, CASE WHEN bits % 2 = 1 THEN cost ELSE cast(floor(cost * 1.2e0 + 0.5e0) AS bigint) END AS c1 FROM e) x) y"""
)
def line_mismatch_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "edges").select((F.col("src") * 1_000_000 + F.col("dst")).alias("eid"), "cost", (F.col("src") % 8).alias("bits"))
    return rows.select("eid", "bits", costs.line_mismatch(F.col("cost"), F.col("bits"), (1.2, 1.05, 1.1)).cast("long").alias("cost"))


# --- graph steps ------------------------------------------------------------------------------------------

_BOTH = """
WITH one AS (SELECT src, dst, cost FROM {edges} UNION ALL SELECT dst, src, cost FROM {edges}),
e AS (SELECT src * 1000000 + dst AS eid, src, dst, cost, 47e0 + ((src * 7919) % 1009) / 1009e0 AS lat1, 8e0 + ((src * 6271) % 1013) / 1013e0 AS lon1,
  47e0 + ((dst * 7919) % 1009) / 1009e0 AS lat2, 8e0 + ((dst * 6271) % 1013) / 1013e0 AS lon2 FROM one)
"""


def _both(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "edges").select("src", "dst", "cost")
    rows = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    place = lambda n, k: (47 + ((F.col(n) * 7919) % 1009) / F.lit(1009.0)).alias(f"lat{k}")
    across = lambda n, k: (8 + ((F.col(n) * 6271) % 1013) / F.lit(1013.0)).alias(f"lon{k}")
    return rows.select((F.col("src") * 1_000_000 + F.col("dst")).alias("eid"), "src", "dst", "cost", place("src", 1), across("src", 1), place("dst", 2), across("dst", 2))


_TURNS = (
    _BOTH
    + """, ways AS (SELECT src AS via, count(*) AS n FROM e GROUP BY src),
t AS (SELECT a.eid AS from_eid, b.eid AS to_eid, a.src = b.dst AS back, n, a.lon1 - a.lon2 AS ax, a.lat1 - a.lat2 AS ay, b.lon2 - b.lon1 AS bx, b.lat2 - b.lat1 AS b_y
  FROM e a JOIN e b ON a.dst = b.src JOIN ways w ON w.via = a.dst WHERE a.dst % 11 <> 0),
s AS (SELECT *, degrees(acos(greatest(-1e0, least(1e0, (ax * bx + ay * b_y) / sqrt((ax * ax + ay * ay) * (bx * bx + b_y * b_y)))))) AS angle FROM t),
c AS (SELECT from_eid, to_eid, CASE WHEN back OR (n > 2 AND coalesce(angle, 180) < 20) THEN 1200 ELSE 0 END AS full_turn, CASE WHEN from_eid % 13 = 0 AND to_eid % 2 = 0 THEN 30000 ELSE 0 END AS ban FROM s)
"""
)


@query(_TURNS + "SELECT from_eid, to_eid, cast(full_turn + ban AS bigint) AS cost FROM c WHERE full_turn + ban > 0")
def turn_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Full turns, back or by a sharp angle, and forbidden ones, but for turning circles."""
    e = _both(spark, d)
    banned = e.filter("eid % 13 = 0").select(F.col("eid").alias("from_eid"), F.col("dst").alias("via"))
    banned = banned.join(e.filter("eid % 2 = 0").select(F.col("src").alias("via"), F.col("eid").alias("to_eid")), "via").select("from_eid", "to_eid")
    circles = e.select(F.col("src").alias("nid")).distinct().filter("nid % 11 = 0")
    return graph.turn_costs(e, banned, 1200, 20.0, 30000, circles)


@query(
    _BOTH
    + """, r AS (SELECT DISTINCT dst AS via, src % 50 AS from_way, dst % 50 AS to_way FROM e WHERE cost % 7 = 0)
SELECT a.eid AS from_eid, b.eid AS to_eid, least(a.cost + 30000, 4294967295) AS cost
FROM e a JOIN e b ON a.dst = b.src WHERE EXISTS (SELECT 1 FROM r WHERE r.via = a.dst AND from_way = a.src % 50 AND to_way = b.src % 50)"""
)
def restriction_cost(spark: SparkSession, d: str) -> DataFrame:
    """A forbidden turn's cost on top of the edge it leaves.

    Edges go by both of their ends: one number of the two is not unique beyond a million nodes. They are made once, and
    merged, as the tables they come from are too small on disk for sizes to be guessed from.
    """
    one = view(spark, d, "edges").select("src", "dst", "cost")
    both = graph._written(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")), "both")
    e = both.hint("merge").withColumns({"eid": F.struct("src", "dst"), "way": F.col("src") % 50})
    rest = e.filter("cost % 7 = 0").select(F.col("dst").alias("via"), F.col("way").alias("from_way"), (F.col("dst") % 50).alias("to_way"), F.lit(False).alias("positive"))
    extra = graph.turn_costs(e, graph.turn_rules(rest.distinct(), e), 0, 0.0, 30000)
    rows = extra.join(e.select(F.col("eid").alias("from_eid"), F.col("cost").alias("own")), "from_eid")
    number = lambda c: (F.col(f"{c}.src") * 1_000_000 + F.col(f"{c}.dst")).alias(c)
    return rows.select(number("from_eid"), number("to_eid"), costs.added(F.col("own"), F.col("cost")).alias("cost"))


@query("SELECT src, dst, least(least(cost + 4294967000, 4294967295) + 7, 4294967295) AS cost FROM {edges}")
def saturating_costs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "edges").select("src", "dst", costs.added(F.col("cost"), F.lit(4_294_967_000), F.lit(7)).alias("cost"))


#: Smallest label by rounds: what a node's neighbours have, until nothing changes.
_LABELS = """cc(nid, comp) USING KEY (nid) AS (
  SELECT nid, nid FROM nodes
  UNION SELECT l.b, min(c.comp) FROM cc c JOIN links l ON c.nid = l.a JOIN recurring.cc o ON o.nid = l.b WHERE c.comp < o.comp GROUP BY l.b)"""


@query(
    "WITH RECURSIVE links AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}), nodes AS (SELECT DISTINCT a AS nid FROM links), "
    + _LABELS
    + """, best AS (SELECT comp, max(4e0 + cost % 8) AS v FROM {edges} e JOIN cc ON cc.nid = e.src GROUP BY comp)
SELECT comp, round(v / 0.8e0, 6) AS max_speed FROM best"""
)
def component_speed(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "edges").select("src", "dst", (F.col("cost") % 8).cast("int").alias("lvl"))
    rows = graph.component_speeds(e, graph.components(e.select("src", "dst")), [4.0 + n for n in range(8)], 0.8)
    return rows.select("comp", F.round("max_speed", 6).alias("max_speed"))


_SPARSE = "SELECT src, dst, cost, cost % 2 AS kind FROM {edges} WHERE cost % 5 < 2"


@query(
    f"""WITH RECURSIVE base AS ({_SPARSE}), e AS (SELECT *, src * 1000000 + dst AS eid FROM base),
ends AS (SELECT eid, kind, src AS nid FROM e UNION ALL SELECT eid, kind, dst FROM e),
inner_ AS (SELECT nid, min(eid) AS a, max(eid) AS b FROM ends GROUP BY nid HAVING count(*) = 2 AND count(DISTINCT kind) = 1),
links AS (SELECT a, b FROM inner_ UNION SELECT b, a FROM inner_), nodes AS (SELECT eid AS nid FROM e), {_LABELS},
rows_ AS (SELECT e.*, comp FROM e JOIN cc ON cc.nid = e.eid),
tips AS (SELECT comp, min(x.nid) AS src, max(x.nid) AS dst, count(*) AS n FROM ends x JOIN rows_ r ON x.eid = r.eid WHERE x.nid NOT IN (SELECT nid FROM inner_) GROUP BY comp),
whole AS (SELECT comp, sum(cost) AS cost, count(*) AS n_edges, min(kind) AS kind FROM rows_ GROUP BY comp),
done AS (SELECT w.comp, src, dst, kind, cost, n_edges FROM whole w JOIN tips t ON w.comp = t.comp WHERE n = 2 AND src <> dst)
SELECT src, dst, kind, cast(cost AS bigint) AS cost, n_edges FROM done
UNION ALL SELECT src, dst, kind, cost, cast(1 AS bigint) FROM rows_ WHERE comp NOT IN (SELECT comp FROM done)"""
)
def chain_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Runs of edges of one kind through nodes with two neighbours, as one edge each."""
    e = view(spark, d, "edges").filter("cost % 5 < 2").select("src", "dst", "cost", (F.col("cost") % 2).alias("kind"))
    return graph.collapsed_chains(e)


@query(
    f"""WITH RECURSIVE base AS ({_SPARSE}), one AS (SELECT src, dst FROM base UNION ALL SELECT dst, src FROM base), e AS (SELECT src * 1000000 + dst AS eid, src, dst FROM one),
way AS (SELECT src AS via FROM e GROUP BY src HAVING count(*) = 2),
pairs AS (SELECT x.eid AS a, y.eid AS b FROM e x JOIN e y ON x.dst = y.src JOIN way w ON w.via = x.dst WHERE x.src <> y.dst),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), nodes AS (SELECT eid AS nid FROM e), {_LABELS}
SELECT nid AS eid, comp AS chain FROM cc"""
)
def candidate_chains(spark: SparkSession, d: str) -> DataFrame:
    """Directed chains, of which a stop has one candidate."""
    e = view(spark, d, "edges").filter("cost % 5 < 2").select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumns({"eid": F.col("src") * 1_000_000 + F.col("dst"), "oneway": F.lit(0)})
    return graph.directed_chains(both)


_GAP = _hav("x.lat", "x.lon", "y.lat", "y.lon")


@query(
    f"""WITH RECURSIVE base AS ({_SPARSE}), places AS (SELECT nid, 47e0 + ((nid * 7919) % 1009) / 1009e0 AS lat, 8e0 + ((nid * 6271) % 1013) / 1013e0 AS lon
  FROM (SELECT src AS nid FROM base UNION SELECT dst FROM base) u),
ends AS (SELECT src AS nid FROM base UNION ALL SELECT dst FROM base), loose AS (SELECT nid FROM ends GROUP BY nid HAVING count(*) = 1),
p AS (SELECT * FROM places WHERE nid IN (SELECT nid FROM loose)),
pairs AS (SELECT x.nid AS a, y.nid AS b FROM p x JOIN p y ON x.nid <> y.nid AND abs(x.lat - y.lat) < 0.03e0 AND abs(x.lon - y.lon) < 0.05e0 WHERE {_GAP} <= 1500),
links AS (SELECT a, b FROM pairs), nodes AS (SELECT DISTINCT a AS nid FROM pairs), {_LABELS}
SELECT coalesce(s.comp, src) AS src, coalesce(t.comp, dst) AS dst, cost FROM base LEFT JOIN cc s ON s.nid = src LEFT JOIN cc t ON t.nid = dst WHERE coalesce(s.comp, src) <> coalesce(t.comp, dst)"""
)
def gap_join(spark: SparkSession, d: str) -> DataFrame:
    """Loose ends near one another become one node."""
    e = view(spark, d, "edges").filter("cost % 5 < 2").select("src", "dst", "cost")
    n = F.col("nid")
    nodes = e.select(F.col("src").alias("nid")).unionByName(e.select(F.col("dst").alias("nid"))).distinct()
    nodes = nodes.select("nid", (47 + ((n * 7919) % 1009) / F.lit(1009.0)).alias("lat"), (8 + ((n * 6271) % 1013) / F.lit(1013.0)).alias("lon"))
    return graph.joined_gaps(nodes, e, 1500)


@query(
    """
WITH ahead AS (SELECT trip_id AS way, seq - 1 AS pos, stop_id AS src, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS dst FROM {stop_times})
SELECT way, cast(pos AS int) AS pos, CASE WHEN src % 5 = 0 THEN concat(src, '/', way, '/', pos) ELSE cast(src AS varchar) END AS src,
  CASE WHEN dst % 5 = 0 THEN concat(dst, '/', way, '/', pos + 1) ELSE cast(dst AS varchar) END AS dst FROM ahead WHERE dst IS NOT NULL AND src <> dst"""
)
def no_hup_split(spark: SparkSession, d: str) -> DataFrame:
    """Nodes at which ways only cross are another node on each way."""
    nodes = _map(spark, d)["node"].filter(rules.any_rule(F.col("tags"), (R("stop", "0"), R("stop", "1"), R("stop", "2"), R("stop", "3")), "node"))
    return graph.node_keys(graph.way_edges(_ways(spark, d)), nodes.filter("id % 5 = 0").select(F.col("id").alias("nid")))


@query("SELECT stop_id AS id, stop_id % 4 IN (1, 3) AS no_hup FROM {stops}")
def no_hup_nodes(spark: SparkSession, d: str) -> DataFrame:
    no_hup = (R("stop", "1"), R("stop", "2", rules.SKIP_NODE), R("stop", "3"))
    return _map(spark, d)["node"].select("id", rules.any_rule(F.col("tags"), no_hup, "node").alias("no_hup"))


@query(
    """
WITH e AS (SELECT src, dst, CASE WHEN cost % 3 = 0 THEN '' ELSE concat('t', cost % 10) END AS track FROM {edges}),
ends AS (SELECT src AS nid, track FROM e WHERE track <> '' UNION ALL SELECT dst, track FROM e WHERE track <> ''),
near AS (SELECT nid, min(track) AS t FROM ends GROUP BY nid)
SELECT stop_id AS nid, coalesce(CASE WHEN stop_id % 2 = 0 THEN concat('s', stop_id % 4) END, t) AS track FROM {stops} LEFT JOIN near ON nid = stop_id"""
)
def station_tracks(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "edges").select("src", "dst", F.when(F.col("cost") % 3 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("cost") % 10).cast("string"))).alias("track"))
    s = F.col("stop_id")
    own = view(spark, d, "stops").select(s.alias("nid"), F.when(s % 2 == 0, F.concat(F.lit("s"), (s % 4).cast("string"))).otherwise("").alias("track"))
    return graph.station_tracks(own, e)


_SNAP = """
WITH seg AS (SELECT a.stop_id AS eid, a.stop_id % 5 AS lvl, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM {stops} a JOIN {stops} b ON b.stop_id = a.stop_id + 1),
near AS (SELECT s.stop_id AS nid, eid, cos(radians(lat)) * 111194.92664455873e0 AS fx, 111194.92664455873e0 AS fy, lat, lon, lat1, lon1, lat2, lon2 FROM {stops} s
  JOIN seg ON lvl <= 2 AND lat BETWEEN least(lat1, lat2) - 0.01e0 AND greatest(lat1, lat2) + 0.01e0 AND lon BETWEEN least(lon1, lon2) - 0.02e0 AND greatest(lon1, lon2) + 0.02e0),
moved AS (SELECT *, (lon1 - lon) * fx AS ax, (lat1 - lat) * fy AS ay, (lon2 - lon1) * fx AS dx, (lat2 - lat1) * fy AS dy FROM near),
placed AS (SELECT *, greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM moved)
SELECT nid, eid, round(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)), 3) AS dist, round(t, 6) AS progr, t > 0 AND t < 1 AND least(HAV1, HAV2) >= 0.5e0 AS split FROM placed
WHERE sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) <= 400""".replace(
    "HAV1", _hav("lat1", "lon1", "(lat1 + t * (lat2 - lat1))", "(lon1 + t * (lon2 - lon1))")
).replace("HAV2", _hav("lat2", "lon2", "(lat1 + t * (lat2 - lat1))", "(lon1 + t * (lon2 - lon1))"))


@query(_SNAP)
def station_snap(spark: SparkSession, d: str) -> DataFrame:
    """Where stations join the edges around them."""
    s = view(spark, d, "stops").select("stop_id", "lat", "lon", "stop_name")
    a = s.select(F.col("stop_id").alias("eid"), (F.col("stop_id") % 5).alias("lvl"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    segments = a.join(s.select((F.col("stop_id") - 1).alias("eid"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "eid")
    rows = graph.station_snaps(s.select(F.col("stop_id").alias("nid"), "lat", "lon", F.col("stop_name").alias("name")), segments, 400, 2)
    return rows.select("nid", "eid", F.round("dist", 3).alias("dist"), F.round("progr", 6).alias("progr"), "split")


@query("SELECT s_suppkey AS src, s_suppkey AS dst, 4294967295 AS cost FROM {supplier} WHERE s_suppkey % 3 <> 0 AND (SELECT count(*) FROM {part} WHERE p_partkey % 7 = 0 AND p_partkey // 7 = s_suppkey) = 1")
def dead_ends(spark: SparkSession, d: str) -> DataFrame:
    """Stations with one way out get an edge to turn on."""
    edges = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 7 = 0").select((F.col("p_partkey") / 7).cast("long").alias("src"), F.lit(0).alias("dst"))
    stations = spark.read.parquet(f"{d}/supplier.parquet").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("nid"))
    return graph.self_edges(edges, stations)


@query("SELECT cast(s_suppkey AS varchar) AS shape_id FROM {supplier} WHERE s_suppkey % 6 NOT IN (SELECT DISTINCT s_nationkey % 4 FROM {supplier})")
def dropped_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Old shapes that no trip has any more."""
    from stopweave.operators import shapes

    s = spark.read.parquet(f"{d}/supplier.parquet")
    old = s.select((F.col("s_suppkey") % 6).alias("shape_id"), F.col("s_suppkey").cast("string").alias("name"))
    return shapes.unused(old, s.select((F.col("s_nationkey") % 4).alias("shape_id"))).select(F.col("name").alias("shape_id"))


@query(
    """
SELECT concat('{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[', cast(src AS varchar), '.5,', cast(dst AS varchar), '.25],[', cast(dst AS varchar), '.5,', cast(src AS varchar),
  '.25]]}},"properties":{{"eid":', cast(src * 1000000 + dst AS varchar), ',"src":', cast(src AS varchar), ',"dst":', cast(dst AS varchar), ',"cost":', cast(cost AS varchar), '}}}}') AS feature FROM {edges}"""
)
def graph_geojson(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "edges").select((F.col("src") * 1_000_000 + F.col("dst")).alias("eid"), "src", "dst", "cost")
    whole = lambda c, x: (F.col(c) + F.lit(x))
    places = {"lon1": whole("src", 0.5), "lat1": whole("dst", 0.25), "lon2": whole("dst", 0.5), "lat2": whole("src", 0.25)}
    return exports.graph_features(e.withColumns(places))


@query("SELECT id, size % 3 = 0 OR kind = 'LARGE' AS any_value FROM {tags}")
def relation_attributes(spark: SparkSession, d: str) -> DataFrame:
    """An attribute of the entity or of a relation that holds it."""
    t = view(spark, d, "tags")
    tags = F.when(F.col("size") % 3 == 0, F.create_map(F.lit("name"), F.lit("own"))).otherwise(F.create_map(F.lit("name"), F.lit("")))
    holder = F.array(F.create_map(F.lit("kind"), F.col("kind"), F.lit("name"), F.lit("held")))
    read = rules.deep_attribute(F.col("tags"), (("name", None), ("name", R("kind", "LARGE"))), F.col("holder"))
    return t.withColumns({"tags": tags, "holder": holder}).select("id", read.isNotNull().alias("any_value"))

