"""A hand-made map and feed whose shape changes with each cost."""

from dataclasses import replace

import pytest

from stopweave.operators import rules
from stopweave.plans import matcher
from stopweave.plans.options import Options
from stopweave.sources import gtfs

R = rules.Rule
#: Two ways from west to east: the straight one, 1-2-3, and one through the north, 1-4-3; a spur 2-5 to the south.
NODES = {0: (47.0, 7.99), 1: (47.0, 8.0), 2: (47.0, 8.01), 3: (47.0, 8.02), 4: (47.004, 8.01), 5: (46.997, 8.01), 6: (47.0, 8.03), 7: (47.0003, 8.0305)}
WAYS = {10: ([0, 1], {}), 11: ([1, 2], {}), 12: ([2, 3], {}), 13: ([1, 4], {}), 14: ([4, 3], {}), 15: ([2, 5], {}), 16: ([3, 6], {}), 17: ([7, 6], {"service": "yard"})}
STOPS = [("a", "Alpha", 47.0, 7.992, "1"), ("b", "Beta", 47.0, 8.028, "2"), ("c", "Gamma", 46.9975, 8.01, None), ("d", "Beta", 47.0, 8.0301, "2"), ("e", "North", 47.002, 8.005, None)]


@pytest.fixture(scope="module")
def world(spark):
    tags = "map<string,string>"
    station = {7: {"railway": "stop", "name": "Beta", "ref": "2"}, 6: {"railway": "stop", "name": "Other place", "ref": "1"}}
    nodes = spark.createDataFrame([(i, a, o, station.get(i, {})) for i, (a, o) in NODES.items()], f"id long, lat double, lon double, tags {tags}")
    ways = spark.createDataFrame([(i, n, {"railway": "rail", **t}) for i, (n, t) in WAYS.items()], f"id long, nds array<long>, tags {tags}")
    member = lambda kind, ref, role="": (kind, ref, role)
    relations = [
        (100, [member("way", 13), member("way", 14), member("way", 10), member("way", 16)], {"route": "train", "ref": "S1", "colour": "#ff0000"}),
        (101, [member("way", 11, "from"), member("way", 12, "to"), member("node", 2, "via")], {"type": "restriction", "restriction": "no_straight_on"}),
    ]
    schema = f"id long, members array<struct<type:string,ref:long,role:string>>, tags {tags}"
    return {"node": nodes, "way": ways, "relation": spark.createDataFrame(relations, schema)}


def feed(spark, stops=("a", "b"), times=("8:00:00", "8:10:00"), name="S1"):
    text = "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string"
    return {
        "stops": spark.createDataFrame(STOPS, "stop_id string, stop_name string, stop_lat double, stop_lon double, platform_code string"),
        "routes": spark.createDataFrame([("r", name, 2)], "route_id string, route_short_name string, route_type int"),
        "trips": spark.createDataFrame([("t", "r"), ("u", "r")], "trip_id string, route_id string"),
        "stop_times": spark.createDataFrame([(t, s, n, c, c) for t in "tu" for n, (s, c) in enumerate(zip(stops, times, strict=True), 1)], text),
    }


BASE = Options(
    keep=(R("railway", "rail"), R("route", "train", rules.FLAT)), oneway=(), reverse=(), wrong_way_entry_s=0.0, wrong_way_factor=1.0, snap_m=60.0,
    factors=(1.0, 1.0, 1.0), max_lat=50.0,
)


def path(world, feed_, options, **more):
    found = matcher.match(feed_, world, options, **more)
    rows = found.shapes.orderBy("shape_id", "shape_pt_sequence").collect()
    assert len({r.shape_id for r in rows}) == 1
    places = {(round(a, 4), round(o, 4)): n for n, (a, o) in NODES.items()}
    return [places[p] for r in rows if (p := (round(r.shape_pt_lat, 4), round(r.shape_pt_lon, 4))) in places], found


def test_straight_way(spark, world):
    nodes, found = path(world, feed(spark), BASE)
    assert nodes == [1, 2, 3]
    assert {r.trip_id for r in found.trips.collect()} == {"t", "u"} and len({r.shape_id for r in found.trips.collect()}) == 1
    dists = {(r.trip_id, r.seq): r.dist for r in found.stop_dists.collect()}
    assert dists["t", 1] == 0 and 2600 < dists["u", 2] < 2800 and len(dists) == 4


def test_lines(spark, world):
    own = replace(BASE, factors=(3.0, 1.0, 1.0), line_name=(("ref", None),), line_color=(("colour", None),))
    nodes, found = path(world, feed(spark), own)
    assert nodes == [1, 4, 3]
    assert path(world, feed(spark, name="S2"), own)[0] == [1, 2, 3]
    edges, known = matcher.with_lines(matcher.road_graph(world, own), world, own)
    colors = matcher.trip_colors(found.paths, edges, known)
    assert {(r.trip_id, r.color) for r in colors.collect()} == {("t", 0xFF0000), ("u", 0xFF0000)}
    out = gtfs.with_colors(feed(spark), colors)
    assert [(r.route_id, r.route_color, r.route_text_color) for r in out["routes"].collect()] == [("r", "FF0000", "000000")]
    no_lines = replace(BASE, no_lines_factor=3.0, line_name=(("ref", None),))
    assert path(world, feed(spark, name="S2"), no_lines)[0] == [1, 4, 3]


def test_restrictions(spark, world):
    own = replace(BASE, restrict_no=(R("restriction", "no_straight_on"),), wrong_way_entry_s=300.0)
    assert path(world, feed(spark), own)[0] == [1, 4, 3]
    assert path(world, feed(spark), replace(own, restrict_exempt=(R("type", "restriction"),)))[0] == [1, 2, 3]


def test_full_turns(spark, world):
    """To a stop in the north and back: by turning round, or round the block."""
    there = feed(spark, ("a", "e", "a"), ("8:00:00", "8:05:00", "8:20:00"))
    assert path(world, there, BASE)[0] == [1, 4, 1]
    assert path(world, there, replace(BASE, full_turn_s=600.0))[0] in ([1, 4, 3, 2, 1], [1, 2, 3, 4, 1])


def test_stations(spark, world):
    """The stop lies on the track of another station; name and platform draw it to its own."""
    stop = feed(spark, ("a", "d"))
    own = replace(BASE, stations=(R("railway", "stop"),), station_names=(("name", None),), tracks=(("ref", None),), station_chain=(("x", "x"),))
    assert 7 not in path(world, stop, own)[0]
    far = replace(own, non_station_pen=5.0, station_unmatched_pen=5.0, snap_m=60.0)
    assert 7 in path(world, stop, far)[0]
    assert 7 not in path(world, stop, replace(far, use_stations=False))[0]
    cands = lambda o: {(r.eid, round(r.pen, 6)) for r in matcher.station_cands(
        matcher.feed_stops(stop, o).filter("stop_id = 'd'"), matcher.stations(world, matcher.road_graph(world, o), o), matcher.road_graph(world, o), o).collect()}
    plain, dear = cands(own), cands(replace(own, platform_pen=1.0))
    assert len(plain - dear) >= 1 and len(plain & dear) >= 1  # the platform of one station is another
    assert cands(replace(own, platform_pen=1.0, platform_pen_on="match")) not in (plain, dear)


def test_planned_times(spark, world):
    """A slow timetable allows what a fast one does not: the way round takes longer than the bound."""
    cut = replace(BASE, speeds=(1.0,) * 8, restrict_no=(R("restriction", "no_straight_on"),), wrong_way_entry_s=40_000.0)
    slow = path(world, feed(spark, times=("8:00:00", "12:00:00")), cut)[0]
    assert slow == [1, 4, 3]
    norm = replace(BASE, transition_method="timenorm", transition=0.0)
    assert path(world, feed(spark, times=("8:00:00", "8:01:00")), norm)[0] == [1, 2, 3]
    assert path(world, feed(spark, times=("8:00:00", "8:10:00")), norm)[0] != [1, 2, 3]  # ten minutes for two


def test_one_trip_and_kept_shapes(spark, world):
    _, found = path(world, feed(spark), BASE, trip_id="t")
    assert [r.trip_id for r in found.trips.collect()] == ["t"]
    had = feed(spark)
    had["trips"] = had["trips"].selectExpr("*", "if(trip_id = 't', 'old', null) as shape_id")
    _, found = path(world, had, replace(BASE, drop_shapes=False))
    assert [r.trip_id for r in found.trips.collect()] == ["u"]


def test_noise_is_repeatable(spark, world):
    own = replace(BASE, noise_m=30.0, seed=3)
    places = lambda o: [(r.lat, r.lon) for r in matcher.feed_stops(feed(spark), o).orderBy("stop_id").collect()]
    assert places(own) == places(own) != places(replace(own, seed=4))
    assert all(abs(a - b) < 0.003 for x, y in zip(places(own), places(BASE), strict=True) for a, b in zip(x, y, strict=True))
