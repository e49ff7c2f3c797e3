"""Queries on the matching side: names, times, candidates, costs, outputs and scores; each with an oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopweave.functions import costs, geo, text
from stopweave.operators import evaluate, graph, patterns, routing, shapes, spatial
from stopweave.plans import matcher
from stopweave.plans.options import Options
from stopweave.plans.world import view
from stopweave.queries import _HOPS, _NAMED_PAIRS, _NEAR_M, _SCORES, _hav, _scores, query
from stopweave.sources import exports, gtfs

# --- names ------------------------------------------------------------------------------------------------

_EDGE = "(substr({0}, length({1}) + 1, 1) IN (' ', '-', ',', ';', '(', ')', '/', '.') AND starts_with({0}, {1}) OR substr({0}, length({0}) - length({1}), 1) IN (' ', '-', ',', ';', '(', ')', '/', '.') AND ends_with({0}, {1})) AND length({1}) > 0 AND length({0}) > length({1})"


@query(
    f"""
WITH n AS (SELECT DISTINCT lower(substr(p_name, 1, p_partkey % 17)) AS a, lower(p_name) AS b FROM {{part}})
SELECT a, b, a = b OR {_EDGE.format("b", "a")} OR {_EDGE.format("a", "b")} AS same FROM n"""
)
def line_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    rows = p.select(F.lower(F.expr("substr(p_name, 1, p_partkey % 17)")).alias("a"), F.lower("p_name").alias("b")).distinct()
    return rows.withColumn("same", text.line_similar(F.col("a"), F.col("b")))


@query(
    """
WITH n AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_type) AS kind FROM {part}),
p AS (SELECT a.id, b.id AS id_r, a.name AS a1, a.kind AS a2, b.name AS b1, concat(a.kind, CASE WHEN b.id % 2 = 0 THEN ' hall' ELSE 'x' END) AS b2 FROM n a JOIN n b ON b.id = a.id + 1)
SELECT id, id_r, len(list_filter([[a1, b1], [a1, b2], [a2, b1], [a2, b2]], lambda p: p[1] = p[2]
  OR starts_with(p[2], p[1]) AND substr(p[2], length(p[1]) + 1, 1) = ' ' OR starts_with(p[1], p[2]) AND substr(p[1], length(p[2]) + 1, 1) = ' '
  OR ends_with(p[2], p[1]) AND substr(p[2], length(p[2]) - length(p[1]), 1) = ' ' OR ends_with(p[1], p[2]) AND substr(p[1], length(p[1]) - length(p[2]), 1) = ' '
  OR levenshtein(p[1], p[2]) / cast(greatest(length(p[1]), length(p[2])) AS double) < 0.05)) > 0 AS same FROM p"""
)
def any_name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Of two names each, some are similar."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.lower("p_type").alias("kind"))
    o = p.select((F.col("id") - 1).alias("id"), F.col("id").alias("id_r"), F.col("name").alias("name_r"))
    rows = p.join(o, "id").withColumn("b2", F.concat("kind", F.when(F.col("id_r") % 2 == 0, " hall").otherwise("x")))
    return rows.select("id", "id_r", text.any_similar(F.array("name", "kind"), F.array("name_r", "b2")).alias("same"))


#: Pairs of names whose similarities may be broadcast, some 160 bytes each.
_BROADCAST_NAMES = 1_500_000
_RUNS = "list_distinct(flatten(list_transform(range(1, len({0}) + 1), lambda i: list_transform(range(i, len({0}) + 1), lambda j: array_to_string({0}[i:j], ' ')))))"
_BEST = "coalesce(list_max(list_transform({0}, lambda r: 1 - levenshtein(r, {1}) / cast(greatest(length(r), length({1}), 1) AS double))), 0)"


@query(
    _NAMED_PAIRS
    + f""", w AS (SELECT stop_id, stop_id_r, name, name_r, regexp_extract_all(name, '\\w+') AS wa, regexp_extract_all(name_r, '\\w+') AS wb FROM pairs),
r AS (SELECT stop_id, stop_id_r, name, name_r, {_RUNS.format("wa")} AS ra, {_RUNS.format("wb")} AS rb,
  list_min(list_transform(range(0, length(name_r) + 1), lambda i: levenshtein(name, left(name_r, i)))) / cast(length(name) AS double) AS p1,
  list_min(list_transform(range(0, length(name) + 1), lambda i: levenshtein(name_r, left(name, i)))) / cast(length(name_r) AS double) AS p2 FROM w)
SELECT stop_id, stop_id_r, 1 - least(p1, p2) > 0.875 AS prefix, greatest({_BEST.format("ra", "name_r")}, {_BEST.format("rb", "name")}) > 0.85 AS run,
  round(1 - least(p1, p2), 6) AS prefix_simi, round(greatest({_BEST.format("ra", "name_r")}, {_BEST.format("rb", "name")}), 6) AS run_simi FROM r"""
)
def name_similarity_kernels(spark: SparkSession, d: str) -> DataFrame:
    """Prefix edit distance and best run of words, worked out once for each two names that are near one another somewhere."""
    s = view(spark, d, "stops").select("stop_id", F.lower("stop_name").alias("name"), "lat", "lon")
    names = graph._written(s.select("name").distinct().withColumn("n", F.row_number().over(Window.orderBy("name"))), "names")
    places = s.withColumnRenamed("name", "_name").join(names.hint("merge"), F.col("_name").eqNullSafe(F.col("name")))
    places = graph._written(places.select("stop_id", "n", "lat", "lon"), "places").hint("merge")
    near = spatial.within_radius(places, places, _NEAR_M, 50, F.col("stop_id") < F.col("stop_id_r"), 3)
    near = near.select("stop_id", "stop_id_r", F.least("n", "n_r").alias("n"), F.greatest("n", "n_r").alias("n_r"))
    pairs = near.select("n", "n_r").distinct().join(names, "n").join(names.select(F.col("n").alias("n_r"), F.col("name").alias("name_r")), "n_r")
    pairs = pairs.repartition(4 * spark.sparkContext.defaultParallelism, "n", "n_r")
    a, b = F.col("name"), F.col("name_r")
    part = F.least(text.prefix_distance(a, b) / F.length(a), text.prefix_distance(b, a) / F.length(b))
    known = pairs.select("n", "n_r", (1 - part).alias("_p"), text.best_subsequence(a, b).alias("_r"))
    known = known.select(
        "n", "n_r", (F.col("_p") > 0.875).alias("prefix"), (F.col("_r") > 0.85).alias("run"),
        F.round("_p", 6).alias("prefix_simi"), F.round("_r", 6).alias("run_simi"),
    )
    known = graph._written(known, "known")
    known = F.broadcast(known) if known.count() <= _BROADCAST_NAMES else known.hint("merge")
    return near.join(known, ["n", "n_r"]).drop("n", "n_r")


@query("SELECT route_id, lower(regexp_replace(regexp_replace(short_name, '^(line|aut|mac) ?', 'l', 'gi'), '([a-z]+)([0-9]+)', '\\2-\\1', 'gi')) AS name FROM {routes}")
def line_normalize(spark: SparkSession, d: str) -> DataFrame:
    chain = [("^(line|aut|mac) ?", "l"), ("([a-z]+)([0-9]+)", r"\2-\1")]
    return text.normalise_names(view(spark, d, "routes"), "short_name", chain, "name").select("route_id", "name")


@query("SELECT id, lower(regexp_replace(regexp_replace(concat('Track ', size), '(^| )track ', '', 'gi'), '^[0-9]{{2}}$', '', 'g')) AS track FROM {tags}")
def track_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "tags").withColumn("t", F.concat(F.lit("Track "), F.col("size").cast("string")))
    return rows.select("id", text.normalise(F.col("t"), [("(^| )track ", ""), ("^[0-9]{2}$", "")]).alias("track"))


@query(
    """
SELECT trip_id, CASE WHEN short_name <> '' THEN lower(short_name) WHEN trip_id % 2 = 0 THEN concat('run ', trip_id) ELSE lower(long_name) END AS short_name
FROM {trips} t JOIN {routes} r ON t.route_id = r.route_id"""
)
def trip_names(spark: SparkSession, d: str) -> DataFrame:
    """The route's short name, else the trip's, else the route's long one."""
    r, t = view(spark, d, "routes"), view(spark, d, "trips")
    own = F.when(F.col("trip_id") % 2 == 0, F.concat(F.lit("Run "), F.col("trip_id").cast("string")))
    feed = {
        "routes": r.select("route_id", F.col("short_name").alias("route_short_name"), F.col("long_name").alias("route_long_name")),
        "trips": t.select("trip_id", "route_id", own.alias("trip_short_name")),
    }
    return matcher.short_names(feed, Options())


# --- times and patterns -----------------------------------------------------------------------------------

_TIMED = """
WITH s AS (SELECT trip_id, seq - 1 AS pos, dep_s - 30 AS arr_s, dep_s, stop_id % 4 AS k FROM {stop_times}),
p AS (SELECT s.*, r.pattern FROM s JOIN (SELECT trip_id, string_agg(cast(k AS varchar), '>' ORDER BY pos) AS pattern FROM s GROUP BY trip_id) r ON r.trip_id = s.trip_id),
f AS (SELECT *, min(dep_s) OVER (PARTITION BY trip_id) AS start FROM p)
"""


@query(
    _TIMED
    + """SELECT pattern, pos, count(*) AS n_trips, cast(floor(sum(arr_s - start) / cast(count(*) AS double)) AS bigint) AS arr_s,
  cast(floor(sum(dep_s - start) / cast(count(*) AS double)) AS bigint) AS dep_s FROM f GROUP BY pattern, pos"""
)
def pattern_mean_times(spark: SparkSession, d: str) -> DataFrame:
    """Mean arrivals and departures of the trips of a pattern, in whole seconds."""
    st = view(spark, d, "stop_times").select(
        "trip_id", (F.col("seq") - 1).alias("pos"), (F.col("dep_s") - 30).alias("arr_s"), "dep_s", (F.col("stop_id") % 4).cast("string").alias("k")
    )
    names = st.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("at"))
    names = names.select("trip_id", F.array_join(F.transform("at", lambda s: s["k"]), ">").alias("pattern"))
    return patterns.mean_times(st.join(names, "trip_id"))


@query(
    """
WITH ahead AS (SELECT trip_id, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS before, stop_id, trip_id % 3 AS attr FROM {stop_times})
SELECT before, stop_id, attr, count(DISTINCT trip_id) AS n_trips FROM ahead WHERE before IS NOT NULL GROUP BY before, stop_id, attr"""
)
def distinct_hops(spark: SparkSession, d: str) -> DataFrame:
    """What is searched once and shared by all trips with the same attributes."""
    return patterns.distinct_hops(view(spark, d, "stop_times").withColumn("attr", F.col("trip_id") % 3), "attr")


@query("SELECT trip_id, seq, dep_s + n * 30 AS time_s, round(pow(n * 30 / 300e0, 2), 6) AS time_pen FROM {stop_times}, (SELECT unnest([0, 1, 2]) AS n) x")
def time_expansion(spark: SparkSession, d: str) -> DataFrame:
    rows = patterns.time_expanded(view(spark, d, "stop_times").select("trip_id", "seq", F.col("dep_s").alias("time_s")), 2)
    return rows.select("trip_id", "seq", "time_s", F.round("time_pen", 6).alias("time_pen"))


@query(
    """
WITH p AS (SELECT trip_id, seq, string_agg(cast(stop_id AS varchar), '>') OVER (PARTITION BY trip_id ORDER BY seq) AS prefix, stop_id FROM {stop_times})
SELECT concat('"', CASE WHEN seq = 1 THEN '' ELSE left(prefix, length(prefix) - length(cast(stop_id AS varchar)) - 1) END, '" -> "', prefix, '" [label="', count(*), '"];') AS line
FROM p GROUP BY seq, prefix, stop_id"""
)
def trie_dot(spark: SparkSession, d: str) -> DataFrame:
    return exports.trie_dot(patterns.trie(view(spark, d, "stop_times")))


# --- costs ------------------------------------------------------------------------------------------------


@query(
    """
WITH e AS (SELECT src * 1000000 + dst AS eid, src, dst, cost, (src % 10) / 10e0 AS p1, (dst % 7) / 7e0 AS p2 FROM {edges})
SELECT a.eid AS from_eid, b.eid AS to_eid, a.cost - cast(floor(a.cost * a.p1) AS bigint) + cast(floor(b.cost * b.p2) AS bigint) AS cost FROM e a JOIN e b ON a.dst = b.src
UNION ALL SELECT eid, eid, CASE WHEN p1 <= p2 THEN cast(floor(cost * (p2 - p1)) AS bigint) END FROM e"""
)
def progress_cost(spark: SparkSession, d: str) -> DataFrame:
    """Between candidates on consecutive edges, and on one edge."""
    e = view(spark, d, "edges").select((F.col("src") * 1_000_000 + F.col("dst")).alias("eid"), "src", "dst", "cost", (F.col("src") % 10 / 10.0).alias("p1"), (F.col("dst") % 7 / 7.0).alias("p2"))
    a = e.select(F.col("eid").alias("from_eid"), F.col("dst").alias("via"), F.col("cost").alias("c1"), "p1")
    b = e.select(F.col("eid").alias("to_eid"), F.col("src").alias("via"), F.col("cost").alias("c2"), "p2")
    on = e.select(F.col("eid").alias("from_eid"), F.col("eid").alias("to_eid"), F.col("cost").alias("c1"), "p1", F.col("cost").alias("c2"), "p2")
    rows = a.join(b, "via").drop("via").select(*on.columns).unionByName(on)
    c = [F.col(x) for x in ("c1", "c1", "p1", "c2", "p2")]
    return rows.select("from_eid", "to_eid", costs.with_progress(*c, F.col("from_eid") == F.col("to_eid")).alias("cost"))


_FALLBACK = """
WITH RECURSIVE cand AS (SELECT trip_id, seq, k, k = 0 AS none, (stop_id * 7 + k * 13) % 50 AS off, (stop_id * 3 + k * 5) % 20 AS pen, 1 + (stop_id % 5) AS bound
  FROM {stop_times}, (SELECT unnest([0, 1, 2]) AS k) ks),
best AS (SELECT trip_id, seq, k, none, off, cast(pen AS double) AS cost FROM cand WHERE seq = 1
  UNION ALL SELECT trip_id, seq, k, none, off, min(CASE WHEN eff IS NULL THEN last + CASE WHEN none THEN bound * 800 ELSE pen END
      WHEN NOT none AND NOT none0 AND last < 'infinity' AND hop < eff THEN last + hop + pen ELSE 'infinity' END) FROM (
    SELECT *, CASE WHEN low < bound THEN bound WHEN low < bound * 2 THEN bound * 2 WHEN low < bound * 4 THEN bound * 4 WHEN low < bound * 8 THEN bound * 8 END AS eff FROM (
      SELECT *, min(CASE WHEN NOT none AND NOT none0 AND last < 'infinity' THEN hop END) OVER (PARTITION BY trip_id) AS low FROM (
        SELECT c.trip_id, c.seq, c.k, c.none, c.off, c.pen, c.bound, b.none AS none0, b.cost AS last, CASE WHEN (c.off + b.off) % 3 <> 0 THEN abs(c.off - b.off) END AS hop
        FROM best b JOIN cand c ON c.trip_id = b.trip_id AND c.seq = b.seq + 1) x) y) z
  GROUP BY trip_id, seq, k, none, off),
ends AS (SELECT trip_id, max(seq) AS seq FROM {stop_times} GROUP BY trip_id)
SELECT trip_id, min(cost) AS cost FROM best JOIN ends USING (trip_id, seq) GROUP BY trip_id"""


@query(_FALLBACK)
def viterbi_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Bounds that double, straight lines where no hop is below them."""
    s = F.col("stop_id")
    cand = lambda k: F.struct(F.lit(k == 0).alias("none"), ((s * 7 + k * 13) % 50).alias("off"), ((s * 3 + k * 5) % 20).alias("pen"))
    layer = F.struct("seq", (1 + s % 5).alias("bound"), F.array(cand(0), cand(1), cand(2)).alias("c"))
    rows = view(spark, d, "stop_times").groupBy("trip_id").agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    hop = lambda a, b: F.when((a["off"] + b["off"]) % 3 != 0, F.abs(b["off"] - a["off"]))
    return rows.select("trip_id", routing.fold_bounded(F.col("layers"), hop).alias("cost"))


_ROLL = "(('0x' || substr(md5(concat('7/{0}/', stop_id)), 1, 12))::bigint + 0.5e0) / 281474976710656e0"


@query(
    f"""
WITH u AS (SELECT *, sqrt(-2 * ln({_ROLL.format(0)})) * 25 / 111194.92664455873e0 AS far, {_ROLL.format(1)} * 2 * pi() AS way FROM {{stops}})
SELECT stop_id, round(lat + far * sin(way), 6) AS lat, round(lon + far * cos(way) / cos(radians(lat)), 6) AS lon FROM u"""
)
def stop_noise(spark: SparkSession, d: str) -> DataFrame:
    """Stops moved by normal noise of 25 m."""
    rows = matcher.jittered(view(spark, d, "stops").select("stop_id", "lat", "lon"), 25.0, 7)
    return rows.select("stop_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_STATIONS = (
    """
WITH a AS (SELECT stop_id, lower(stop_name) AS name, lat, lon, cast(stop_id % 3 AS varchar) AS platform FROM {stops}),
s AS (SELECT p_partkey AS nid, lower(concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' north' ELSE '' END)) AS name, 47e0 + ((p_partkey * 7919) % 1009) / 1009e0 + 0.002e0 AS lat,
  8e0 + ((p_partkey * 6271) % 1013) / 1013e0 AS lon, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE cast(p_partkey % 3 AS varchar) END AS track FROM {part}),
n AS (SELECT stop_id, nid, a.name, s.name AS name_r, platform, track, """
    + _hav("a.lat", "a.lon", "s.lat", "s.lon")
    + """ AS dist FROM a JOIN s ON abs(a.lat - s.lat) < 0.05e0 AND abs(a.lon - s.lon) < 0.1e0),
t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(name, '[^a-z0-9]+'), lambda x: x <> '')) AS w, list_distinct(list_filter(regexp_split_to_array(name_r, '[^a-z0-9]+'), lambda x: x <> '')) AS w_r FROM n WHERE dist <= 2000),
j AS (SELECT *, len(list_intersect(w, w_r)) / cast(len(list_distinct(list_concat(w, w_r))) AS double) AS j FROM t),
out AS (SELECT src, src * 1000000 + dst AS eid FROM (SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges}) e)
SELECT stop_id, eid, 0e0 AS progr, round(dist * 0.0039e0 + CASE WHEN (exp(-0.0081546727e0 * dist) + j) / 2 > 0.5 THEN 0 ELSE 0.4e0 END
  + CASE WHEN platform <> '' AND track <> '' AND platform <> track THEN 0.1e0 ELSE 0 END, 6) AS pen FROM j JOIN out ON out.src = j.nid"""
)


@query(_STATIONS)
def station_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Edges that leave stations around a stop, dearer where names or tracks differ.

    Stations and edges are merged, as the tables they come from are too small on disk for sizes to be guessed from.
    """
    stops = view(spark, d, "stops").select("stop_id", F.lower("stop_name").alias("name"), "lat", "lon", (F.col("stop_id") % 3).cast("string").alias("platform"))
    p = spark.read.parquet(f"{d}/part.parquet").hint("merge").withColumn("k", F.col("p_partkey"))
    found = p.select(
        F.col("k").alias("nid"), F.lower(F.concat("p_name", F.when(F.col("k") % 2 == 0, " north").otherwise(""))).alias("name"),
        (47 + ((F.col("k") * 7919) % 1009) / F.lit(1009.0) + 0.002).alias("lat"), (8 + ((F.col("k") * 6271) % 1013) / F.lit(1013.0)).alias("lon"),
        F.when(F.col("k") % 4 == 0, "").otherwise((F.col("k") % 3).cast("string")).alias("track"),
    )
    e = view(spark, d, "edges").select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumns({"eid": F.col("src") * 1_000_000 + F.col("dst"), "oneway": F.lit(0)})
    options = Options(station_m=2000.0, station_unmatched_pen=0.4, platform_pen=0.1, max_lat=50)
    pens = matcher.station_pens(stops.hint("merge"), found, both, options)
    return matcher.leaving_edges(pens.withColumn("pen", F.round("pen", 6)))


# --- outputs ----------------------------------------------------------------------------------------------


@query("SELECT n_name AS organization_name, concat('url', n_nationkey) AS attribution_url FROM {nation} UNION ALL SELECT 'Map makers', 'https://map'")
def attributions_append(spark: SparkSession, d: str) -> DataFrame:
    """Appended once, however often it is asked for."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = n.select(F.col("n_name").alias("organization_name"), F.concat(F.lit("url"), F.col("n_nationkey").cast("string")).alias("attribution_url"))
    once = shapes.with_attribution(rows, "Map makers", "https://map")
    return shapes.with_attribution(once, "Map makers", "https://map")


@query(
    """
WITH t AS (SELECT c_custkey AS route_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 8 ELSE c_custkey % 16 * 100 + 5 END AS route_type FROM {customer}),
s AS (SELECT *, CASE WHEN route_type < 100 THEN route_type ELSE CASE route_type // 100 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 3 WHEN 8 THEN 3 WHEN 9 THEN 0
  WHEN 10 THEN 4 WHEN 11 THEN 3 WHEN 12 THEN 4 WHEN 13 THEN 6 WHEN 14 THEN 7 WHEN 15 THEN 3 END END AS basic FROM t)
SELECT route_id, cast(basic AS int) AS basic, coalesce(basic IN (0, 2, 3), false) AS wanted FROM s"""
)
def mode_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Extended route types as basic ones, and which of them are wanted."""
    c = F.col("c_custkey")
    kind = F.when(c % 2 == 0, c % 8).otherwise(c % 16 * 100 + 5).cast("int")
    basic = gtfs.standard_type(kind)
    wanted = sorted(gtfs.modes(["bus", "train"]) | gtfs.modes(["0"]))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(c.alias("route_id"), basic.cast("int").alias("basic"))
    return rows.withColumn("wanted", F.coalesce(F.col("basic").isin(wanted), F.lit(False)))


@query(
    """
WITH f AS (SELECT c_custkey % 20 AS fare_id, c_custkey AS route_id FROM {customer}),
c AS (SELECT DISTINCT route_id, trip_id % 3 AS color FROM {trips}), n AS (SELECT route_id, dense_rank() OVER (PARTITION BY route_id ORDER BY color) - 1 AS n FROM c)
SELECT fare_id, cast(route_id AS varchar) AS route_id FROM f
UNION ALL SELECT fare_id, concat(f.route_id, '::', n) FROM f JOIN n ON n.route_id = f.route_id WHERE n > 0"""
)
def route_fares(spark: SparkSession, d: str) -> DataFrame:
    """Fare rules follow a route that is split by colour."""
    fares = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 20).alias("fare_id"), F.col("c_custkey").alias("route_id"))
    trips = view(spark, d, "trips").select("trip_id", "route_id", (F.col("trip_id") % 3).alias("color"))
    parts = shapes.split_routes(trips).select("trip_id", F.col("route_id").alias("new_id")).join(trips, "trip_id").select("route_id", "new_id")
    return shapes.split_fares(fares, parts)


@query(
    """
WITH p AS (SELECT user_id, string_agg(printf('%.7f %.7f', lon, lat), ',' ORDER BY seq) AS points FROM {fixes} GROUP BY user_id)
SELECT user_id, concat('LINESTRING(', points, ')') AS wkt FROM p"""
)
def line_wkt(spark: SparkSession, d: str) -> DataFrame:
    from stopweave.queries import _traces

    return _traces(spark, d).select("user_id", geo.wkt(F.col("line")).alias("wkt"))


@query(
    """
SELECT (SELECT count(*) FROM {stops}) AS num_stops, (SELECT count(*) FROM {trips}) AS num_trips, (SELECT count(*) FROM {edges}) AS num_edges,
  (SELECT count(*) FROM {stop_times}) AS num_stop_times"""
)
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return exports.run_stats({n: view(spark, d, n) for n in ("stops", "trips", "edges", "stop_times")})


# --- scores -----------------------------------------------------------------------------------------------


@query(
    f"WITH s AS ({_SCORES}), f AS (SELECT feed, count(*) AS n_trips, avg(avg_fd) AS avg_fd, max(avg_fd) AS max_fd, min(avg_fd) AS min_fd, "
    + ", ".join(f"count(*) FILTER (n_wrong / cast(n_segments AS double) <= {s}e0) AS an_{i}" for i, s in enumerate(evaluate.SHARES))
    + " FROM s GROUP BY feed) SELECT count(*) AS n_feeds, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("n_trips", "avg_fd", "max_fd", "min_fd", *(f"an_{i}" for i in range(len(evaluate.SHARES)))))
    + " FROM f"
)
def eval_avg_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The mean of every number over all feeds."""
    out = evaluate.mean_of_feeds(evaluate.summary(_scores(spark, d), ["feed"]))
    return out.select("n_feeds", *(F.round(c, 4).alias(c) for c in out.columns[1:]))


@query(
    """
WITH x AS (SELECT trip_id, max(dep_s) AS len, cast(abs(max(dep_s) - sum(stop_id * 60)) AS bigint) AS diff FROM {stop_times} GROUP BY trip_id)
SELECT trip_id, diff, round(diff / cast(len AS double), 6) AS share FROM x"""
)
def length_difference(spark: SparkSession, d: str) -> DataFrame:
    st = view(spark, d, "stop_times")
    truth = st.groupBy("trip_id").agg(F.max("dep_s").alias("len"))
    test = st.groupBy("trip_id").agg(F.sum(F.col("stop_id") * 60).alias("len"))
    return evaluate.length_differences(truth, test).select("trip_id", "diff", F.round("share", 6).alias("share"))


_PLACED = """
WITH m AS (SELECT user_id, seq, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM {fixes} WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
l AS (SELECT user_id, seq, lat, lon, sum(coalesce(HAV, 0)) OVER (PARTITION BY user_id ORDER BY seq) AS dist FROM m),
a AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(dist) OVER w AS dist2 FROM l WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
s AS (SELECT user_id, n, n * 1777e0 AS place FROM (SELECT DISTINCT user_id FROM {fixes}) u, (SELECT unnest([0, 1, 2, 3, 4]) AS n) k),
f AS (SELECT a.*, n, CASE WHEN dist2 > dist THEN (place - dist) / (dist2 - dist) ELSE 0 END AS part FROM a JOIN s ON a.user_id = s.user_id AND place >= dist AND place < coalesce(dist2, 'infinity'))
SELECT user_id, cast(n AS bigint) AS n, round(coalesce(lat + part * (lat2 - lat), lat), 7) AS lat, round(coalesce(lon + part * (lon2 - lon), lon), 7) AS lon FROM f""".replace(
    "HAV", _hav("plat", "plon", "lat", "lon")
)


@query(_PLACED)
def segmentize(spark: SparkSession, d: str) -> DataFrame:
    """Where a line is at the distances of its stops."""
    points = shapes.measures(view(spark, d, "fixes"), "user_id")
    stops = points.select("user_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    rows = evaluate.placed_stops(points, stops.withColumn("at", F.col("n") * 1777.0), "user_id")
    return rows.select("user_id", "n", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(_HOPS + "SELECT trip_id, seq, stop_id, next_stop_id, seconds FROM hops")
def hop_time(spark: SparkSession, d: str) -> DataFrame:
    return shapes.hops(view(spark, d, "stop_times"), view(spark, d, "stops")).select("trip_id", "seq", "stop_id", "next_stop_id", "seconds")

