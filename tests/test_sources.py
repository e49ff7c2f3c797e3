import pytest
from pyspark.sql import functions as F

from stopweave.sources import gtfs, osm

XML = """<?xml version="1.0"?>
<osm><bounds minlat="1.0" minlon="2.0" maxlat="3.0" maxlon="4.0"/>
<node id="1" lat="47.5" lon="8.25"><tag k="highway" v="bus_stop"/><tag k="name" v="A &amp; B"/></node>
<node id="2" lat="-47.1234567" lon="-8.0"/>
<way id="10"><nd ref="1"/><nd ref="2"/><tag k="oneway" v="yes"/></way>
<way id="11"/>
<relation id="20"><member type="way" ref="10" role="from"/><member type="node" ref="1" role=""/><tag k="type" v="restriction"/></relation>
</osm>"""


def rows(tables):
    flat = lambda v: sorted(v.items()) if isinstance(v, dict) else [tuple(x) if hasattr(x, "asDict") else x for x in v] if isinstance(v, list) else v
    return {k: sorted([flat(v) for v in r] for r in df.collect()) for k, df in tables.items()}


def test_osm_round_trips(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    first = osm.read(spark, str(tmp_path / "a.osm"))
    want = rows(first)
    assert want["node"] == [[1, 47.5, 8.25, [("highway", "bus_stop"), ("name", "A & B")]], [2, -47.1234567, -8.0, []]]
    assert want["way"] == [[10, [1, 2], [("oneway", "yes")]], [11, [], []]]
    assert want["relation"] == [[20, [("way", 10, "from"), ("node", 1, "")], [("type", "restriction")]]]
    assert osm.bounds_xml(spark, str(tmp_path / "a.osm")) == (1, 2, 3, 4)
    osm.write_xml(first, str(tmp_path / "b.osm"), (1, 2, 3, 4))
    assert rows(osm.read(spark, str(tmp_path / "b.osm"))) == want
    osm.write_pbf(first, str(tmp_path / "c.osm.pbf"), rows=1)
    assert rows(osm.read(spark, str(tmp_path / "c.osm.pbf"))) == want


def test_osm_errors(spark, tmp_path):
    (tmp_path / "a.osm").write_text("<osm><node id='1' lat='1' lon='1'/></osm>")
    with pytest.raises(ValueError):
        osm.bounds_xml(spark, str(tmp_path / "a.osm"))
    with pytest.raises(ValueError):
        osm.read(spark, "x.o5m")
    with pytest.raises(ValueError):
        osm.unpack(osm._put(4, b"lzma"))


FEED = {
    "agency": "agency_id,agency_name\n1,Agency\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\na,\"Stop, A\",47.0,8.0\nb,B,47.1,8.1\n",
    "routes": "route_id,route_short_name,route_type\nr,1,3\n",
    "trips": "trip_id,route_id,service_id,shape_id\nt,r,s,old\nu,r,s,other\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,25:10:00,25:11:00,a,1\nt,,,b,2\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nold,47.0,8.0,1\nother,47.0,8.0,1\n",
    "feed_info": "feed_publisher_name,feed_publisher_url\n,\n",
}


@pytest.mark.parametrize("ending", ["", ".zip"])
def test_gtfs(spark, tmp_path, ending):
    for name, text in FEED.items():
        (tmp_path / f"{name}.txt").write_text(text)
    feed = gtfs.read(spark, str(tmp_path))
    assert [r.stop_name for r in feed["stops"].orderBy("stop_id").collect()] == ["Stop, A", "B"]
    times = feed["stop_times"].select(gtfs.seconds(F.col("departure_time")).alias("s")).select("s", gtfs.clock(F.col("s"))).collect()
    assert [tuple(r) for r in times] == [(90660, "25:11:00"), (None, None)]
    shapes = spark.createDataFrame([("shp_3_1", 47.0, 8.0, 1)], "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int")
    new = gtfs.with_shapes(feed, shapes, spark.createDataFrame([("t", "shp_3_1")], "trip_id string, shape_id string"))
    gtfs.write(new, str(tmp_path / f"out{ending}"))
    again = gtfs.read(spark, str(tmp_path / f"out{ending}"))
    assert {r.trip_id: r.shape_id for r in again["trips"].collect()} == {"t": "shp_3_1", "u": "other"}
    assert {r.shape_id for r in again["shapes"].collect()} == {"shp_3_1", "other"}
    assert again["feed_info"].count() == 0
    both = gtfs.union({"x": feed, "y": again})
    assert both["trips"].count() == 4 and set(both["stops"].columns) >= {"feed_id", "stop_id"}


def test_modes(spark):
    assert gtfs.modes(["bus", "tram"]) == {0, 3} and gtfs.modes(["7"]) == {7} and 3 in gtfs.modes(["all"])
    with pytest.raises(ValueError):
        gtfs.modes(["x"])
    df = spark.createDataFrame([(3,), (109,), (700,), (1300,)], "t int")
    assert [r[0] for r in df.select(gtfs.standard_type(F.col("t"))).collect()] == [3, 2, 3, 6]
