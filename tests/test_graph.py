import pytest
from pyspark.sql import functions as F

from stopweave.functions import text
from stopweave.operators import evaluate, extract, graph, patterns, rules, shapes
from stopweave.operators.rules import Rule
from stopweave.sources import config, exports

CFG = """
# comment
[rail, bus]
osm_filter_keep: highway=bus_stop|no_match_ways
  route=bus|rel_flat,psv=yes|mult_val_match
station_normalize_chain: ' st. ' -> ' saint '; ([a-z])-([a-z]) -> \\1 \\2
  ' # ' -> ' no; '; # a comment
osm_lvl0_avg_speed: 36 # km/h
[bus]
osm_filter_drop: access=private  # not ours
osm_station_name_attrs: [public_transport=stop_area]name name
[coach]
osm_filter_keep: highway=bus_stop|no_match_ways
"""


def test_config():
    parsed = config.parse(CFG, "[coach]\nosm_filter_lvl1: highway=primary\n")
    found = {m.modes: m for m in config.modes(parsed)}
    assert set(found) == {("rail",), ("bus",), ("coach",)}
    bus = found["bus",]
    bus = bus.options
    assert bus.speeds[0] == 36 * 0.2777 and bus.speeds[1] == 70 * 0.2777
    assert Rule("route", "bus", rules.FLAT) in bus.keep and Rule("psv", "yes", rules.MULTI) in bus.keep
    assert bus.station_names == (("name", Rule("public_transport", "stop_area")), ("name", None))
    assert bus.station_chain == ((" st. ", " saint "), ("([a-z])-([a-z])", "\\1 \\2"), (" # ", " no; "))
    assert found["coach",].options.levels[1] == (Rule("highway", "primary"),)
    assert len(config.modes(config.parse("[a, b]\nosm_filter_keep: x=y\n"))) == 1
    with pytest.raises(ValueError, match="osm_filter_kep"):
        config.modes(config.parse("[a]\nosm_filter_kep: x=y\n"))


ALL_KEYS = """
[rail]
osm_filter_keep:
\trailway=rail
\trailway:switch=*|no_match_ways
osm_line_relation_tags:
\tline_name=ref,name
\tfrom_name=from
\tto_name=to
\tline_color=colour
osm_node_negative_restriction: restriction=no_left_turn
osm_node_positive_restriction: restriction=only_left_turn
osm_filter_no_restriction: except=bus|mult_val_match
osm_filter_station: railway=station
osm_max_snap_distance: 200
osm_max_snap_level: 2
osm_max_osm_station_distance: 7, 15
osm_one_way_speed_penalty_fac: 5
osm_one_way_entry_cost: 300
routing_full_turn_penalty: 180
routing_full_turn_angle: 100
routing_line_unmatched_time_penalty_fac: 1.2
routing_line_station_from_unmatched_time_penalty: 1.05
routing_line_station_to_unmatched_time_penalty: 1.1
routing_non_station_penalty: 0.4
routing_platform_unmatched_penalty: 0.1
routing_transition_method: timenorm
station_similarity_classification_method: ed
routing_use_stations: no
"""


def test_all_options():
    o = config.options(config.parse(ALL_KEYS)["rail"])
    assert Rule("railway:switch", "*", rules.SKIP_WAY) in o.keep and o.line_name == (("ref", None), ("name", None))
    assert o.line_from == (("from", None),) and o.line_to == (("to", None),) and o.line_color == (("colour", None),)
    assert o.restrict_no and o.restrict_only and o.restrict_exempt and o.stations == (Rule("railway", "station"),)
    assert (o.snap_m, o.max_snap_level, o.osm_station_m, o.station_reach) == (200, 2, (7, 15), 400)
    assert (o.wrong_way_factor, o.restricted, o.full_turn_s, o.full_turn_angle) == (5, 30_000, 180, 100)
    assert o.factors == (1.2, 1.05, 1.1) and o.station_pen == 0.2 and o.platform_pen == 0.1
    assert (o.transition_method, o.similarity, o.use_stations) == ("timenorm", "ed", False)
    old = config.options(config.parse("[b]\nosm_filter_keep: a=b\nrouting_one_way_meter_punish_fac: 4\nrouting_lvl1_fac: 2\n")["b"])
    assert old.wrong_way_factor == 5 and old.speeds[1] == 42.5 * 0.2777 and old.factors == (1, 1, 1)
    with pytest.raises(ValueError, match="none of"):
        config.options({"routing_emission_method": ["x"]})


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rules_and_names(spark):
    tags = frame(spark, [({"psv": "no; yes", "highway": "x"},), ({"psv": "xyes"},), ({},)], "tags map<string,string>")
    r = (Rule("psv", "yes", rules.MULTI), Rule("highway", "*", rules.SKIP_NODE))
    t = F.col("tags")
    got = tags.select(rules.any_rule(t, r, "node"), rules.any_rule(t, r[1:], "node"), rules.any_rule(t, r[1:], "way")).collect()
    assert [tuple(x) for x in got] == [(True, False, True), (False, False, False), (False, False, False)]
    names = frame(spark, [("#f00",), ("Teal",), ("00ff00",), ("#12",), (None,)], "c string")
    assert [x[0] for x in names.select(text.parse_color(F.col("c"))).collect()] == [0xFF0000, 0x008080, 0x00FF00, None, None]
    pairs = frame(spark, [("main st", "main st, north"), ("main", "maine"), ("abc", "abc")], "a string, b string")
    assert [x[0] for x in pairs.select(text.line_similar(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    kernels = frame(spark, [("haupt", "hauptbahnhof"), ("x", "quite other"), (None, "a")], "a string, b string")
    assert [tuple(r) for r in kernels.select(text.prefix_same("a", "b"), text.subsequence_same("a", "b")).collect()] == [(True, False), (False, False), (None, None)]


def test_gaps_and_chains(spark):
    nodes = frame(spark, [(1, 0.0, 0.0), (2, 0.0, 0.01), (3, 0.0, 0.010001), (4, 0.0, 0.02), (5, 1.0, 1.0)], "nid long, lat double, lon double")
    edges = frame(spark, [(1, 2, 5), (3, 4, 7)], "src long, dst long, cost long")
    assert sorted(map(tuple, graph.joined_gaps(nodes, edges).collect())) == [(1, 2, 5), (2, 4, 7)]
    e = [(1, 2, 1, "a"), (2, 3, 2, "a"), (3, 4, 4, "a"), (4, 5, 8, "b"), (4, 6, 16, "b"), (7, 8, 1, "c"), (8, 9, 1, "c"), (9, 7, 1, "c")]
    frame_ = frame(spark, e, "src long, dst long, cost long, kind string")
    got = sorted(map(tuple, graph.collapsed_chains(frame_).collect()))
    assert got == [(1, 4, "a", 7, 3), (4, 5, "b", 8, 1), (4, 6, "b", 16, 1), (7, 8, "c", 1, 1), (8, 9, "c", 1, 1), (9, 7, "c", 1, 1)]
    stay = frame(spark, [(2,)], "nid long")
    assert (1, 2, "a", 1, 1) in set(map(tuple, graph.collapsed_chains(frame_, stay).collect()))
    long = frame(spark, [(i, i + 1) for i in range(200)] + [(500, 501)], "src long, dst long")
    assert {(r.nid, r.comp) for r in graph.components(long).collect()} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


def test_snaps(spark):
    stations = frame(spark, [(9, 0.0001, 0.0005, "x"), (8, 5.0, 5.0, "far")], "nid long, lat double, lon double, name string")
    segs = frame(spark, [(1, 1, 2, 3, 0, 0.0, 0.0, 0.0, 0.001), (2, 1, 3, 7, 0, 0.0001, 0.0, 0.0001, 0.001)], "eid long, src long, dst long, lvl int, oneway int, lat1 double, lon1 double, lat2 double, lon2 double")
    (r,) = graph.station_snaps(stations, segs, 50, 5).collect()
    assert (r.nid, r.eid, r.split) == (9, 1, True) and abs(r.progr - 0.5) < 1e-6


def test_extract_and_restrictions(spark):
    m = "struct<type:string,ref:long,role:string>"
    tables = {
        "node": frame(spark, [(1, 0.5, 0.5, {}), (2, 9.0, 9.0, {}), (3, 0.5, 0.5, {"stop": "y"}), (4, 0.5, 0.5, {}), (5, 9.0, 9.0, {"stop": "y"})], "id long, lat double, lon double, tags map<string,string>"),
        "way": frame(spark, [(10, [1, 2], {"road": "y"}), (11, [1, 4], {}), (12, [2, 5], {"road": "y"}), (13, [1], {"road": "y"})], "id long, nds array<long>, tags map<string,string>"),
        "relation": frame(spark, [(20, [("way", 11, "x"), ("node", 5, "y")], {"route": "bus"}), (21, [("way", 12, "")], {"route": "bus"}), (22, [("way", 10, "")], {})], f"id long, members array<{m}>, tags map<string,string>"),
    }
    boxes = frame(spark, [(0.0, 0.0, 1.0, 1.0)], "min_lat double, min_lon double, max_lat double, max_lon double")
    out = extract.extract(tables, boxes, (Rule("road"), Rule("stop"), Rule("route", "bus")), ())
    ids = {k: sorted(r.id for r in v.collect()) for k, v in out.items()}
    assert ids == {"node": [1, 2, 3, 4], "way": [10, 11], "relation": [20]}
    assert [tuple(x) for x in out["relation"].first().members] == [("way", 11, "x")]
    turn = [("way", 1, "from"), ("way", 2, "to"), ("node", 7, "via")]
    rel = frame(spark, [(1, turn, {"restriction": "only"}), (2, turn + [("way", 3, "from")], {"restriction": "no"}), (3, turn, {"restriction": "no", "except": "psv"})], f"id long, members array<{m}>, tags map<string,string>")
    got = extract.turn_restrictions(rel, (Rule("restriction", "only"),), (Rule("restriction", "no"),), (Rule("except", "psv"),))
    assert [tuple(r) for r in got.collect()] == [(7, 1, 2, True)]


def test_evaluation(spark):
    s = "trip_id string, shape array<struct<lat:double,lon:double,dist:double>>, stops array<double>"
    line = [(0.0, 0.0, 0.0), (0.0, 0.01, 10.0), (0.0, 0.02, 20.0)]
    bent = [(0.0, 0.0, 0.0), (0.005, 0.005, 5.0), (0.0, 0.01, 10.0), (0.0, 0.02, 20.0)]
    stops = [0.0, 10.0, 20.0]
    truth = frame(spark, [("same", line, stops), ("bent", line, stops), ("gone", line, stops), ("none", line, stops)], s)
    test = frame(spark, [("same", line, stops), ("bent", bent, stops), ("none", [], stops)], s)
    got = {r.trip_id: (r.n_segments, r.n_wrong, r.wrong_m) for r in evaluate.compared(truth, test, 50).collect()}
    assert got == {"same": (2, 0, 0.0), "bent": (2, 1, 10.0)}
    assert [r.trip_id for r in evaluate.missing(truth, test).collect()] == ["gone"]
    total = evaluate.summary(evaluate.compared(truth, test, 50)).first()
    assert (total.n_trips, total.an_0, total.an_5) == (2, 1, 2)
    assert '"n_trips": 2' in exports.score_report(evaluate.summary(evaluate.compared(truth, test, 50)), "json")


def test_outputs(spark, tmp_path):
    assert 'node["a"="b"](1.0000000' in exports.overpass([(1, 2, 3, 4)], [Rule("a", "b", rules.SKIP_WAY)])
    assert "a=b" in exports.osmfilter([Rule("a", "b")], [])
    df = frame(spark, [([(1.0, 2.0), (3.0, 4.0)], "x")], "p array<struct<lat:double,lon:double>>, n string")
    exports.write_geojson(df.select(exports.feature(F.col("p"), F.struct("n"))), str(tmp_path / "a.json"))
    import json

    data = json.loads((tmp_path / "a.json").read_text())
    assert data["features"][0]["geometry"]["coordinates"] == [[2.0, 1.0], [4.0, 3.0]]
    assert exports.run_stats({"a": df, "b": df}).first().asDict() == {"num_a": 1, "num_b": 1}
    own = shapes.with_attribution(frame(spark, [("me", "u")], "organization_name string, attribution_url string"), "osm", "v")
    assert own.count() == 2 and shapes.with_attribution(own, "osm", "v").count() == 2
    st = frame(spark, [(1, 1, 5, 0), (1, 2, 6, 9), (2, 1, 5, 0)], "trip_id long, seq long, stop_id long, dep_s long")
    assert patterns.trie(st).count() == 2


def test_banned_turns_need_no_places(spark):
    """Edges may be told apart by both of their ends, and where full turns are free no angle is asked for."""
    links = [(1, 2), (2, 1), (2, 3), (3, 2), (2, 1_000_005), (1, 1_000_005), (1_000_005, 7), (5, 7)]
    e = spark.createDataFrame(links, "src long, dst long").withColumns({"eid": F.struct("src", "dst"), "way": F.col("src") % 50})
    rules = spark.createDataFrame([(2, 1, 2, False), (1_000_005, 1, 5, False)], "via long, from_way long, to_way long, positive boolean")
    got = graph.turn_costs(e, graph.turn_rules(rules, e), 0, 0.0, 30000).collect()
    want = {((1, 2), (2, b)) for b in (1, 3, 1_000_005)} | {((1, 1_000_005), (1_000_005, 7))}
    assert len(got) == len(want) and {(tuple(r.from_eid), tuple(r.to_eid)) for r in got} == want and {r.cost for r in got} == {30000}
    circles = spark.createDataFrame([(2,)], "nid long")
    assert graph.turn_costs(e, graph.turn_rules(rules, e), 0, 0.0, 30000, circles).count() == 1


def test_restriction_cost_broadcasts_no_edges(spark, sf_dir):
    """However small the tables are on disk: the driver has no room for all edges."""
    from stopweave.queries import QUERIES

    import stopweave.queries_map  # noqa: F401

    plan = QUERIES["restriction_cost"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_station_candidates_broadcast_neither_stops_nor_stations(spark, sf_dir):
    import stopweave.queries_match  # noqa: F401
    from stopweave.queries import QUERIES

    plan = QUERIES["station_candidates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("BroadcastHashJoin") <= 1  # nations


def test_tokens_of_names_that_are_missing(spark):
    rows = spark.createDataFrame([("a b", "b c", 10.0), ("a", "a", None), ("", "", 5.0), (None, "a", 5.0), ("a", None, None)], "a string, b string, m double")
    key = [text.tokens(F.col(c)) for c in ("a", "b")]
    got = rows.select(text.jaccard_of(*key), text.tokens_near(*key, F.col("m"))).collect()
    assert [(round(r[0], 6), r[1]) for r in got] == [(0.333333, True), (1.0, True), (0.0, False), (0.0, False), (0.0, False)]


def test_names_are_compared_once(spark, sf_dir):
    """The rows of stops look up what two names have; finer cells find the same pairs."""
    import stopweave.queries_match  # noqa: F401
    from stopweave.operators import spatial
    from stopweave.queries import QUERIES

    plan = QUERIES["name_similarity_kernels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan
    rows = spark.range(150).select("id", (47 + F.col("id") * 7919 % 1009 / 1009.0).alias("lat"), (8 + F.col("id") * 6271 % 1013 / 1013.0).alias("lon"))
    wide = {(r.id, r.id_r) for r in spatial.within_radius(rows, rows, 9000, 50).filter("id < id_r").collect()}
    fine = [(r.id, r.id_r) for r in spatial.within_radius(rows, rows, 9000, 50, F.col("id") < F.col("id_r"), 3).collect()]
    assert wide and len(fine) == len(wide) and set(fine) == wide
