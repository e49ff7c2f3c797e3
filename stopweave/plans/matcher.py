"""From a feed and a map to shapes: the whole matching run as one plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopweave.functions import costs, geo, text
from stopweave.operators import extract, graph, lines, patterns, routing, rules, shapes, spatial
from stopweave.operators.rules import any_rule, deep_attribute
from stopweave.plans.options import Options
from stopweave.sources.gtfs import seconds

Tables = Mapping[str, DataFrame]


def road_graph(tables: Tables, options: Options) -> DataFrame:
    """eid, way, src, dst, lat1, lon1, lat2, lon2, len, lvl, oneway, cost: directed edges of all kept ways."""
    t = F.col("tags")
    relations = extract.kept_relations(tables["relation"], options.keep, options.drop).filter("not flat") if "relation" in tables else None
    kept = any_rule(t, options.keep, "way")
    ways = tables["way"]
    if relations is not None:
        held = relations.select(F.explode("members").alias("m")).filter("m.type = 'way'").select(F.col("m.ref").alias("id"))
        ways = ways.join(held.distinct().withColumn("_held", F.lit(True)), "id", "left")
        kept = kept | F.col("_held").isNotNull()
    ways = ways.filter(kept & ~any_rule(t, options.drop, "way")).drop("_held")
    ways = ways.withColumns(
        {"lvl": rules.level(t, options.levels or ((),)), "oneway": rules.oneway(t, options.oneway, options.reverse, options.twoway).cast("int")}
    ).drop("tags")
    nodes = tables["node"].select("id", "lat", "lon")
    edges = graph.way_edges(ways)
    for end, k in (("src", 1), ("dst", 2)):
        edges = edges.join(nodes.select(F.col("id").alias(end), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}")), end)
    edges = edges.withColumn("len", geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    edges = graph.single_edges(graph.edge_costs(edges, list(options.speeds)))
    both = graph.with_reverse(edges)
    for a, b in (("lat1", "lat2"), ("lon1", "lon2")):
        both = both.withColumns({a: F.when(F.col("rev"), F.col(b)).otherwise(F.col(a)), b: F.when(F.col("rev"), F.col(a)).otherwise(F.col(b))})
    cost = graph.wrong_way(F.col("cost"), F.col("oneway"), options.wrong_way_factor, options.wrong_way_entry_s)
    return both.withColumns({"cost": cost, "eid": F.xxhash64("src", "dst")}).drop("pos", "rev")


def with_lines(edges: DataFrame, tables: Tables, options: Options) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` and ``lines``, the transit lines that use each, and the table of the lines; without, a factor on the cost."""
    if "relation" not in tables or not (options.line_name or options.line_from or options.line_to):
        return edges, None
    kept = extract.kept_relations(tables["relation"], options.keep, options.drop)
    found = lines.transit_lines(
        kept, options.line_name, options.line_from, options.line_to, options.line_color, options.line_chain, options.station_chain
    )
    edges = edges.join(lines.way_lines(kept, found), "way", "left")
    if options.no_lines_factor != 1:
        edges = edges.withColumn("cost", graph.no_lines(F.col("cost"), F.col("lines").isNotNull(), options.no_lines_factor))
    return edges, lines.distinct_lines(found)


def turns(edges: DataFrame, tables: Tables, options: Options) -> DataFrame | None:
    """Full and forbidden turns with their costs; None where the options make none dear."""
    banned = None
    if "relation" in tables and options.wrong_way_entry_s and (options.restrict_only or options.restrict_no):
        found = extract.turn_restrictions(tables["relation"], options.restrict_only, options.restrict_no, options.restrict_exempt)
        banned = graph.turn_rules(found, edges)
    if banned is None and not options.full_turn_s:
        return None
    circles = None
    if options.turning_circles:
        circles = tables["node"].filter(any_rule(F.col("tags"), options.turning_circles, "node")).select(F.col("id").alias("nid"))
    angle = options.full_turn_angle if options.full_turn_s else 0.0
    return graph.turn_costs(edges, banned, int(options.full_turn_s * 10), angle, options.restricted, circles)


def stations(tables: Tables, edges: DataFrame, options: Options) -> DataFrame:
    """nid, lat, lon, name (normalised) and track of the nodes that are stations of the graph."""
    t = F.col("tags")
    rows = tables["node"].filter(any_rule(t, options.stations, "node"))
    rows = rows.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    if "relation" in tables:
        parts = tables["relation"].select("tags", F.explode("members").alias("m")).filter("m.type = 'node'")
        around = parts.groupBy(F.col("m.ref").alias("id")).agg(F.collect_list("tags").alias("_in"))
        rows = rows.join(around, "id", "left")
    else:
        rows = rows.withColumn("_in", F.lit(None).cast("array<map<string,string>>"))
    inside = F.coalesce("_in", F.array().cast("array<map<string,string>>"))
    read = lambda a: F.coalesce(deep_attribute(t, a, inside), F.lit("")) if a else F.lit("")
    rows = rows.select(F.col("id").alias("nid"), "lat", "lon", read(options.station_names).alias("_name"), read(options.tracks).alias("_track"))
    rows = rows.withColumn("name", text.normalise(F.col("_name"), options.station_chain))
    return rows.withColumn("track", text.normalise(F.col("_track"), options.track_chain)).drop("_name", "_track")


def name_key(options: Options, name: Column) -> Column:
    """What :func:`similar` compares: the name or, where the chosen method takes them, its tokens, so that each name is cut once."""
    return text.tokens(name) if options.similarity.startswith("jaccard") else name


def similar(options: Options, a: Column, b: Column, metres: Column) -> Column:
    """Names, given by their :func:`name_key`, and places ``metres`` apart, are of one station by the chosen method."""
    return {
        "jaccard": lambda: text.jaccard_of(a, b) > 0.45,
        "jaccard-geodist": lambda: text.tokens_near(a, b, metres),
        "bts": lambda: text.subsequence_same(a, b),
        "ed": lambda: text.edit_same(a, b),
        "ped": lambda: text.prefix_same(a, b),
    }[options.similarity]()


def edge_cands(stops: DataFrame, edges: DataFrame, options: Options) -> DataFrame:
    """stop_id, eid, progr, pen: edges within reach of each stop, never against a one-way street; of a chain the nearest."""
    open_edges = edges.filter((F.col("oneway") != 2) & (F.col("lvl") <= options.max_snap_level))
    near = spatial.near_segments(stops, open_edges.select("eid", "lat1", "lon1", "lat2", "lon2"), options.snap_m, options.max_lat)
    if "src" in edges.columns:
        near = near.join(graph.directed_chains(edges), "eid")
        near = spatial.nearest(near, ["stop_id", "chain"], ["dist", "eid"])
    pen = costs.emission(F.col("dist"), options.emission, options.emission_method) + options.non_station_pen
    return near.select("stop_id", "eid", "progr", pen.alias("pen"))


def station_pens(stops: DataFrame, found: DataFrame, edges: DataFrame, options: Options) -> DataFrame:
    """stop_id, pen and eids, the edges that leave the station: a row for each station around a stop that has such edges.

    The stops are copied to the cells around them, as there are fewer of them.
    """
    leaving = edges.filter("oneway <> 2").groupBy(F.col("src").alias("nid")).agg(F.collect_list("eid").alias("eids"))
    key = name_key(options, F.col("name")).alias("key")
    places = found.select("nid", "lat", "lon", key, "track").join(leaving, "nid")
    around = stops.select("stop_id", "lat", "lon", key, "platform")
    near = spatial.within_radius(places, around, options.station_reach, options.max_lat)
    other_name = F.when(similar(options, F.col("key_r"), F.col("key"), F.col("dist")), 0.0).otherwise(options.station_pen)
    known = (F.coalesce("platform_r", F.lit("")) != "") & (F.col("track") != "")
    same = F.col("platform_r") == F.col("track")
    wrong = known & (same if options.platform_pen_on == "match" else ~same)
    pen = costs.emission(F.col("dist"), options.emission, options.emission_method) + other_name + F.when(wrong, options.platform_pen).otherwise(0.0)
    return near.select(F.col("stop_id_r").alias("stop_id"), "eids", pen.alias("pen"))


def station_cands(stops: DataFrame, found: DataFrame, edges: DataFrame, options: Options) -> DataFrame:
    """stop_id, eid, progr (0), pen: edges that leave the stations around each stop; other names and tracks cost more."""
    return leaving_edges(station_pens(stops, found, edges, options))


def leaving_edges(pens: DataFrame) -> DataFrame:
    return pens.select("stop_id", F.explode("eids").alias("eid"), F.lit(0.0).alias("progr"), "pen")


def stop_candidates(stops: DataFrame, edges: DataFrame, options: Options, found: DataFrame | None = None) -> DataFrame:
    """stop_id, cand, eid, progr, pen of all candidates of each stop, the likeliest first."""
    rows = edge_cands(stops, edges, options)
    if found is not None:
        rows = rows.unionByName(station_cands(stops, found, edges, options))
    rank = F.row_number().over(Window.partitionBy("stop_id").orderBy("pen", "eid", "progr")).cast("long")
    return rows.select("stop_id", rank.alias("cand"), "eid", "progr", "pen")


def jittered(rows: DataFrame, metres: float, seed: int, key: str = "stop_id") -> DataFrame:
    """``rows`` with lat and lon moved by normal noise of that many metres, the same for a key and seed."""
    if not metres:
        return rows
    part = lambda n: (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(f"{seed}/{n}"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)  # noqa: E731, E501
    far, way = F.sqrt(-2 * F.log(part(0))) * metres / geo.M_PER_DEG, part(1) * 2 * F.pi()
    return rows.withColumns({"lat": F.col("lat") + far * F.sin(way), "lon": F.col("lon") + far * F.cos(way) / F.cos(F.radians("lat"))})


def feed_stops(feed: Tables, options: Options) -> DataFrame:
    """stop_id, lat, lon, name (normalised) and platform; entrances are where their stations are."""
    rows = feed["stops"]
    for c in ("stop_name", "platform_code", "parent_station"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    if "location_type" not in rows.columns:
        rows = rows.withColumn("location_type", F.lit(None).cast("int"))
    moved = patterns.entrances_to_parents(rows.select("stop_id", "parent_station", "location_type"))
    places = rows.select(F.col("stop_id").alias("resolved"), "stop_lat", "stop_lon", "stop_name", "platform_code")
    out = moved.join(places, "resolved").select(
        "stop_id", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"),
        text.normalise(F.coalesce("stop_name", F.lit("")), options.station_chain).alias("name"),
        text.normalise(F.col("platform_code"), options.track_chain).alias("platform"),
    )
    return jittered(out, options.noise_m, options.seed)


def _sequences(feed: Tables, options: Options, modes: set[int] | None, trip_id: str | None) -> DataFrame:
    """trip_id, route_id, seq, stop_id, arr_s, dep_s of the trips to be matched."""
    trips = feed["trips"]
    if modes is not None:
        trips = trips.join(feed["routes"].filter(F.col("route_type").isin(sorted(modes))).select("route_id"), "route_id", "left_semi")
    if trip_id is not None:
        trips = trips.filter(F.col("trip_id") == trip_id)
    if not options.drop_shapes and "shape_id" in trips.columns:
        trips = trips.filter("coalesce(shape_id, '') = ''")
    st = feed["stop_times"].select(
        "trip_id", "stop_id", F.col("stop_sequence").cast("long").alias("seq"),
        seconds(F.col("arrival_time")).alias("arr_s") if "arrival_time" in feed["stop_times"].columns else F.lit(None).cast("int").alias("arr_s"),
        seconds(F.col("departure_time")).alias("dep_s"),
    )
    return st.join(patterns.eligible(trips, st).select("trip_id", "route_id"), "trip_id")


def short_names(feed: Tables, options: Options) -> DataFrame:
    """trip_id and its normalised name: the route's short one, else the trip's, else the route's long one."""
    routes, trips = feed["routes"], feed["trips"]
    read = lambda df, c: F.coalesce(F.trim(df[c]), F.lit("")) if c in df.columns else F.lit("")
    named = routes.select("route_id", read(routes, "route_short_name").alias("_s"), read(routes, "route_long_name").alias("_l"))
    rows = trips.select("trip_id", "route_id", read(trips, "trip_short_name").alias("_t")).join(named, "route_id", "left")
    name = F.coalesce(F.nullif("_s", F.lit("")), F.nullif("_t", F.lit("")), F.nullif("_l", F.lit("")), F.lit(""))
    return rows.select("trip_id", text.normalise(name, options.line_chain).alias("short_name"))


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


@dataclass
class Matched:
    """Shapes in the columns of GTFS; trip_id and shape_id; trip_id, seq, dist (metres along the shape) of stop times;
    trip_id, eid, n of edges passed."""

    shapes: DataFrame
    trips: DataFrame
    stop_dists: DataFrame
    paths: DataFrame


def match(feed: Tables, tables: Tables, options: Options | None = None, modes: set[int] | None = None, trip_id: str | None = None) -> Matched:
    """Trips with equal stops and names share a shape. Where stops have no road between them, or none near, the shape is a
    straight line. With ``trip_id``, that trip alone is matched.
    """
    options = options or Options()
    stops = feed_stops(feed, options)
    st = _sequences(feed, options, modes, trip_id).join(short_names(feed, options), "trip_id")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "stop_id", "arr_s", "dep_s")))
    trips = st.groupBy("trip_id", "route_id", "short_name").agg(ordered.alias("at"))
    ids = F.transform("at", lambda s: s["stop_id"])
    trips = trips.withColumn("pattern", F.sha2(F.to_json(F.struct(ids.alias("s"), F.col("short_name").alias("n"))), 256))
    trips = graph._written(trips, "trips")
    times = trips.select("pattern", "trip_id", F.posexplode("at").alias("pos", "s")).select(
        "pattern", "trip_id", F.col("pos").cast("long").alias("pos"), F.col("s.seq").alias("seq"), "s.arr_s", "s.dep_s"
    )
    distinct = trips.groupBy("pattern").agg(F.first(ids).alias("stops"), F.first("short_name").alias("short_name"))
    positions = distinct.select("pattern", F.posexplode("stops").alias("pos", "stop_id"))
    positions = positions.withColumn("pos", F.col("pos").cast("long")).join(stops, "stop_id").join(patterns.mean_times(times), ["pattern", "pos"])
    edges, known = with_lines(road_graph(tables, options), tables, options)
    edges = graph._written(edges, "edges")
    w = Window.partitionBy("pattern").orderBy("pos")
    crow = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    planned = (F.col("arr_s") - F.lag("dep_s").over(w)).cast("double")
    located = positions.withColumns({"_crow": crow, "planned_s": F.coalesce(planned, F.lit(0.0))})
    bound = costs.max_hop_cost(F.greatest("planned_s", F.col("_crow") / options.top_speed), *options.factors)
    located = located.withColumn("bound", F.when(F.col("_crow").isNull(), 0).otherwise(bound).cast("long"))
    located = graph._written(located, "located")
    found = stations(tables, edges, options) if options.use_stations and options.stations else None
    cands = located.join(stop_candidates(stops, edges, options, found), "stop_id")
    none = located.withColumns({"cand": F.lit(0).cast("long"), "eid": F.lit(None).cast("long"), "progr": F.lit(0.0), "pen": F.lit(0.0)})
    columns = ["pattern", "pos", "cand", "eid", "progr", "pen", "bound", "planned_s"]
    cands = cands.select(*columns).unionByName(none.select(*columns))
    if known is not None and options.factors[0] != 1:
        ends = distinct.select(F.col("pattern").alias("key"), "short_name", F.get("stops", 0).alias("_f"), F.element_at("stops", -1).alias("_t"))
        for end, name in (("_f", "line_from"), ("_t", "line_to")):
            ends = ends.join(stops.select(F.col("stop_id").alias(end), F.col("name").alias(name)), end).drop(end)
        like = lines.resemblance(ends, known).withColumnRenamed("key", "pattern")
        cands = cands.join(like, "pattern")
    else:
        edges = edges.drop("lines")
    chosen = routing.match_patterns(
        cands, edges, turns(edges, tables, options), options.transition, top_speed=options.top_speed, factors=options.factors, method=options.transition_method
    )
    chosen = graph._written(chosen, "chosen")
    shapes_, dists = _shapes(chosen, located, edges)
    used = trips.select("trip_id", "pattern", _shape_id(F.col("pattern")).alias("shape_id"))
    at = times.join(dists, ["pattern", "pos"]).select("trip_id", "seq", "dist")
    passed = chosen.select("pattern", "pos", F.posexplode("path").alias("n", "eid")).join(trips.select("pattern", "trip_id"), "pattern")
    return Matched(shapes_, used.drop("pattern"), at, passed.select("trip_id", "pos", "n", "eid"))


def trip_colors(paths: DataFrame, edges: DataFrame, known: DataFrame, share: float = 0.9) -> DataFrame:
    """trip_id and the colour of the lines on more than ``share`` of the trip's way."""
    on = edges.filter("lines is not null").select("eid", "len", F.explode("lines").alias("line"))
    parts = paths.join(on.join(known.filter("color is not null").select("line", "color"), "line").select("eid", "len", "color").distinct(), "eid")
    bare = paths.join(edges.select("eid", "len"), "eid").groupBy("trip_id").agg(F.sum("len").alias("_all"))
    sums = parts.groupBy("trip_id", "color").agg(F.sum("len").alias("_len")).join(bare, "trip_id").filter(F.col("_len") > F.col("_all") * share)
    return sums.groupBy("trip_id").agg(F.max_by("color", F.struct("_len", "color")).alias("color"))


def match_feed(feed: Tables, tables: Tables, options: Options | None = None, modes: set[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Shapes and trips of :func:`match`."""
    out = match(feed, tables, options, modes)
    return out.shapes, out.trips


def _shape_id(pattern: Column) -> Column:
    return F.concat(F.lit("shp_"), F.substring(pattern, 1, 20))


def _shapes(chosen: DataFrame, located: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each position adds the ends of the edges passed since the last one, then its own place on its edge. Also how far
    along each position is."""
    own = edges.select("eid", "lat1", "lon1", "lat2", "lon2")
    at = chosen.join(own, "eid", "left").join(located.select("pattern", "pos", "lat", "lon"), ["pattern", "pos"])
    on = lambda a, b, c: F.coalesce(F.col(a) + F.col("progr") * (F.col(b) - F.col(a)), F.col(c))
    places = at.select("pattern", "pos", F.lit(1 << 30).alias("part"), _point(on("lat1", "lat2", "lat"), on("lon1", "lon2", "lon")).alias("p"))
    passed = chosen.select("pattern", "pos", F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("part", "eid"))
    corners = passed.join(own, "eid").select("pattern", "pos", "part", _point(F.col("lat2"), F.col("lon2")).alias("p"))
    w = Window.partitionBy("pattern").orderBy("pos", "part")
    points = places.unionByName(corners).withColumn("seq", F.row_number().over(w)).select("pattern", "pos", "part", "seq", "p.lat", "p.lon")
    measured = shapes.measures(points, "pattern")
    out = measured.select(
        _shape_id(F.col("pattern")).alias("shape_id"),
        F.col("lat").alias("shape_pt_lat"),
        F.col("lon").alias("shape_pt_lon"),
        F.col("seq").alias("shape_pt_sequence"),
        F.col("dist").alias("shape_dist_traveled"),
    )
    return out, measured.filter(F.col("part") == 1 << 30).select("pattern", "pos", "dist")
