from stopweave import cli
from stopweave.operators import graph
from stopweave.plans.matcher import Options, match_feed, road_graph, stop_candidates
from stopweave.sources import gtfs, osm

NODES = {1: (47.0, 8.0), 2: (47.0, 8.01), 3: (47.01, 8.01), 4: (47.01, 8.02), 5: (47.02, 8.0)}
WAYS = {10: ([1, 2, 3], "primary", ""), 11: ([3, 4], "primary", "yes"), 12: ([1, 5], "footway", "")}
FEED = {
    "stops": "stop_id,stop_name,stop_lat,stop_lon\na,A,47.0001,8.001\nb,B,47.0099,8.019\nc,C,48.5,9.5\n",
    "routes": "route_id,route_short_name,route_type\nr,1,3\nq,2,2\n",
    "trips": "trip_id,route_id,service_id\nt,r,s\nu,r,s\nv,q,s\nw,r,s\nx,r,s\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    + "".join(f"{t},8:0{k}:00,8:0{k}:00,{s},{k}\n" for t, stops in (("t", "ab"), ("u", "ab"), ("v", "ab"), ("w", "ac"), ("x", "a")) for k, s in enumerate(stops, 1)),
}


def files(tmp_path):
    xml = ["<osm>"]
    xml += [f'<node id="{i}" lat="{a}" lon="{o}"/>' for i, (a, o) in NODES.items()]
    for i, (nds, kind, one) in WAYS.items():
        tags = f'<tag k="highway" v="{kind}"/>' + (f'<tag k="oneway" v="{one}"/>' if one else "")
        xml.append(f'<way id="{i}">' + "".join(f'<nd ref="{n}"/>' for n in nds) + tags + "</way>")
    (tmp_path / "map.osm").write_text("\n".join([*xml, "</osm>"]))
    (tmp_path / "feed").mkdir()
    for name, text in FEED.items():
        (tmp_path / "feed" / f"{name}.txt").write_text(text)
    return str(tmp_path / "feed"), str(tmp_path / "map.osm")


def test_match_and_command_line(spark, tmp_path):
    feed_path, map_path = files(tmp_path)
    feed, tables = gtfs.read(spark, feed_path), osm.read(spark, map_path)
    drive = {(r.src, r.dst): r for r in road_graph(tables, Options()).collect()}
    assert set(drive) == {(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (1, 5), (5, 1)}
    assert drive[4, 3].cost > 5 * drive[3, 4].cost and drive[2, 1].lat1 == 47.0 and drive[2, 1].lon1 == 8.01
    shapes, used = match_feed(feed, tables, Options(), {3})
    ids = {r.trip_id: r.shape_id for r in used.collect()}
    assert set(ids) == {"t", "u", "w"} and ids["t"] == ids["u"] != ids["w"]
    rows = shapes.orderBy("shape_id", "shape_pt_sequence").collect()
    line = [(round(r.shape_pt_lat, 4), round(r.shape_pt_lon, 4)) for r in rows if r.shape_id == ids["t"]]
    assert line == [(47.0, 8.001), (47.0, 8.01), (47.01, 8.01), (47.01, 8.019)]
    dist = [r.shape_dist_traveled for r in rows if r.shape_id == ids["t"]]
    assert dist == sorted(dist) and dist[0] == 0
    straight = [(round(r.shape_pt_lat, 4), round(r.shape_pt_lon, 4)) for r in rows if r.shape_id == ids["w"]]
    assert straight[-1] == (48.5, 9.5)
    out = str(tmp_path / "out.zip")
    assert cli.main(["match", feed_path, map_path, "-o", out, "-m", "bus"]) == 0
    assert gtfs.read(spark, out)["shapes"].count() == len(rows)
    part = str(tmp_path / "part.osm")
    assert cli.main(["extract", feed_path, map_path, "-o", part]) == 0
    assert osm.read(spark, part)["way"].count() == 3


def test_all_edges_within_reach(spark):
    """Twelve pieces of the nearest street, both ways, and the right road behind them."""
    lines = [(i, 47.0, 8.0 + i * 1e-5, 47.0, 8.0 + (i + 1) * 1e-5) for i in range(24)] + [(99, 47.0005, 8.0, 47.0005, 8.001)]
    edges = spark.createDataFrame([(*x, 0, 0) for x in lines], "eid long, lat1 double, lon1 double, lat2 double, lon2 double, oneway int, lvl int")
    stops = spark.createDataFrame([("a", 47.0001, 8.0001)], "stop_id string, lat double, lon double")
    rows = stop_candidates(stops, edges, Options()).orderBy("cand").collect()
    assert [r.cand for r in rows] == list(range(1, 26)) and rows[-1].eid == 99
    ends = edges.withColumns({"src": edges.eid, "dst": edges.eid + 1})
    stations = stops.selectExpr("1L as nid", "lat", "lon", "stop_id as name")
    assert graph.station_snaps(stations, ends, 100, 5).count() == 25
