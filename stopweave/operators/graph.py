"""The routable graph as two tables: ways cut into edges, costs, reverse and self edges, components."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopweave.functions.costs import INFINITE, added, quantized


@functools.cache
def _own() -> str:
    """A folder for sessions without the setting, on one machine."""
    return "file://" + tempfile.mkdtemp(prefix="stopweave-")


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
    return f"{(base or _own()).rstrip('/')}/stopweave/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all nodes see, for files written by the driver; on a cluster it has to be mounted."""
    path = f"{_base(spark)}/files-{uuid.uuid4().hex}"
    os.makedirs(path.removeprefix("file:"), exist_ok=True)
    return path


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all nodes share, and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def way_edges(ways: DataFrame) -> DataFrame:
    """Consecutive nodes of each way (id, nds): way, pos, src, dst; a node twice in a row makes no edge."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("nds") - 2),
        lambda i: F.struct(i.alias("pos"), F.get("nds", i).alias("src"), F.get("nds", i + 1).alias("dst")),
    )
    rows = ways.filter(F.size("nds") >= 2).withColumn("_e", F.explode(pairs))
    return rows.select(F.col("id").alias("way"), *[c for c in ways.columns if c not in ("id", "nds")], "_e.pos", "_e.src", "_e.dst").filter("src <> dst")


def single_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair of nodes: the cheapest, then the first by way."""
    order = Window.partitionBy("src", "dst").orderBy("cost", "way")
    return edges.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def edge_costs(edges: DataFrame, speeds: list[float]) -> DataFrame:
    """cost of edges with ``len`` (metres) and ``lvl``: tenths of a second at the level's speed (m/s)."""
    speed = F.element_at(F.array(*[F.lit(float(s)) for s in speeds]), F.col("lvl") + 1)
    return edges.withColumn("cost", quantized(F.col("len") / speed))


def wrong_way(cost: Column, oneway: Column, factor: float, entry_s: float) -> Column:
    """Cost of an edge that may be used in its direction, or, dearer, against it."""
    return F.when(oneway == 2, quantized((cost * factor + entry_s * 10) / 10)).otherwise(cost)


def no_lines(cost: Column, has_lines: Column, factor: float) -> Column:
    return F.when(has_lines, cost).otherwise(F.least(F.ceil(cost * factor).cast("long"), F.lit(INFINITE)))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges and the reverse of each that has none, with oneway 1 and 2 swapped and ``rev`` set."""
    ahead = edges.withColumn("rev", F.lit(False))
    swapped = F.when(F.col("oneway") == 1, 2).when(F.col("oneway") == 2, 1).otherwise(F.col("oneway"))
    back = edges.withColumns({"_s": F.col("dst"), "_d": F.col("src"), "oneway": swapped, "rev": F.lit(True)})
    back = back.drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"})
    return ahead.unionByName(back.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select(*ahead.columns))


def self_edges(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """An edge of infinite cost at every station (nid) with one way out, so that trips can turn there."""
    ends = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    found = ends.join(stations.select(F.col("nid").alias("src")), "src", "left_semi")
    return found.select("src", F.col("src").alias("dst"), F.lit(INFINITE).alias("cost"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without edges."""
    used = edges.select(F.col("src").alias("nid")).unionByName(edges.select(F.col("dst").alias("nid")))
    return nodes.join(used, "nid", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """nid and comp, the smallest node it is connected with, of all nodes of ``edges`` (src, dst), any direction.

    Large-star and small-star steps alternate until nothing changes: a number of rounds that grows with the
    logarithm of the number of nodes, not with a component's diameter. Nothing is collected.
    """
    edges = _written(edges.select("src", "dst").distinct(), "links")
    nodes = edges.select(F.col("src").alias("nid")).unionByName(edges.select(F.col("dst").alias("nid"))).distinct()
    now = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
    return nodes.join(now.select(F.col("u").alias("nid"), F.col("v").alias("comp")), "nid", "left").select(
        "nid", F.coalesce("comp", "nid").alias("comp")
    )


def hop_costs(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """Least cost from each source (nid) to the nodes within ``hops`` edges: source, nid, cost.

    Bellman-Ford by joins: every round relaxes only what the round before improved.
    """
    best = sources.select(F.col("nid").alias("source"), "nid", F.lit(0).cast("long").alias("cost"))
    front = best
    for i in range(hops):
        step = front.join(edges.select(F.col("src").alias("nid"), F.col("dst"), F.col("cost").alias("_c")), "nid")
        step = step.select("source", F.col("dst").alias("nid"), (F.col("cost") + F.col("_c")).alias("cost"))
        step = step.groupBy("source", "nid").agg(F.min("cost").alias("cost"))
        old = best.select("source", "nid", F.col("cost").alias("_old"))
        front = step.join(old, ["source", "nid"], "left").filter("_old is null or cost < _old").drop("_old")
        best = best.unionByName(front).groupBy("source", "nid").agg(F.min("cost").alias("cost"))
        if i % 4 == 3:
            front, best = _written(front, "front"), _written(best, "best")
    return best


def turn_rules(restrictions: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of edges (from_eid, to_eid) that a restriction forbids at its via node.

    ``restrictions``: via, from_way, to_way, positive. Where a positive rule names the way one comes from, all
    other ways out are forbidden; else negative rules forbid theirs. ``edges``: eid, way, src, dst.
    """
    come = edges.select(F.col("eid").alias("from_eid"), F.col("way").alias("from_way"), F.col("dst").alias("via"))
    go = edges.select(F.col("eid").alias("to_eid"), F.col("way").alias("to_way"), F.col("src").alias("via"))
    turns = come.join(restrictions.select("via", "from_way").distinct(), ["via", "from_way"], "left_semi").join(go, "via")
    judged = turns.join(restrictions.withColumnRenamed("to_way", "_to"), ["via", "from_way"]).groupBy("from_eid", "to_eid").agg(
        F.max("positive").alias("_only"),
        F.max(F.col("positive") & (F.col("_to") == F.col("to_way"))).alias("_named"),
        F.max(~F.col("positive") & (F.col("_to") == F.col("to_way"))).alias("_banned"),
    )
    return judged.filter(F.when(F.col("_only"), ~F.col("_named")).otherwise(F.col("_banned"))).select("from_eid", "to_eid")


def turn_costs(edges: DataFrame, banned: DataFrame | None, full_turn: int, angle: float, restricted: int, circles: DataFrame | None = None) -> DataFrame:
    """Dear turns: from_eid, to_eid, cost. A full turn goes back where one came from or, where more than two ways leave,
    turns by an ``angle`` (degrees between the ways) below the limit; a ban (from_eid, to_eid) costs ``restricted``.

    ``edges``: eid, src, dst, lat1, lon1, lat2, lon2. At turning circles (nid) no turn is dear. Where full turns cost nothing,
    only banned turns are looked at, and the edges need no places.
    """
    from stopweave.functions.geo import turn_angle

    if banned is not None and not full_turn:
        ends = edges.select(F.col("eid").alias("from_eid"), F.col("dst").alias("via"))
        rows = banned.join(ends, "from_eid").join(edges.select(F.col("eid").alias("to_eid"), F.col("src").alias("via")), ["to_eid", "via"])
        if circles is not None:
            rows = rows.join(circles.select(F.col("nid").alias("via")), "via", "left_anti")
        return rows.select("from_eid", "to_eid", F.lit(restricted).cast("long").alias("cost")).filter("cost > 0")
    come = edges.select(F.col("eid").alias("from_eid"), F.col("src").alias("a"), F.col("dst").alias("via"), "lat1", "lon1", "lat2", "lon2")
    ways = edges.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("_ways"))
    go = edges.select(F.col("eid").alias("to_eid"), F.col("src").alias("via"), F.col("dst").alias("b"), F.col("lat2").alias("lat3"), F.col("lon2").alias("lon3"))
    rows = come.join(go, "via").join(ways, "via")
    if circles is not None:
        rows = rows.join(circles.select(F.col("nid").alias("via")), "via", "left_anti")
    sharp = turn_angle(F.col("lon2"), F.col("lat2"), F.col("lon1"), F.col("lat1"), F.col("lon3"), F.col("lat3")) < angle
    full = (F.col("a") == F.col("b")) | ((F.col("_ways") > 2) & F.coalesce(sharp, F.lit(False)))
    rows = rows.withColumn("_turn", F.when(full, F.lit(full_turn)).otherwise(F.lit(0)).cast("long"))
    if banned is None:
        rows = rows.withColumn("_ban", F.lit(0).cast("long"))
    else:
        rows = rows.join(banned.withColumn("_ban", F.lit(restricted).cast("long")), ["from_eid", "to_eid"], "left")
    return rows.select("from_eid", "to_eid", added(F.col("_turn"), F.coalesce("_ban", F.lit(0))).alias("cost")).filter("cost > 0")


def directed_chains(edges: DataFrame) -> DataFrame:
    """eid and chain of every edge (eid, src, dst, oneway): edges that follow one another where two ways leave a node, not
    back where one came from and not against a one-way street, are one chain."""
    ways = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2").select(F.col("src").alias("via"))
    open_ = edges.filter("oneway <> 2")
    first = open_.select(F.col("eid").alias("e1"), F.col("src").alias("a"), F.col("dst").alias("via"))
    second = open_.select(F.col("eid").alias("e2"), F.col("src").alias("via"), F.col("dst").alias("b"))
    links = first.join(second, "via").join(ways, "via", "left_semi").filter("a <> b")
    chains = components(links.select(F.col("e1").alias("src"), F.col("e2").alias("dst"))).withColumnsRenamed({"nid": "eid", "comp": "chain"})
    return edges.select("eid").join(chains, "eid", "left").withColumn("chain", F.coalesce("chain", "eid"))


def node_keys(edges: DataFrame, no_hup: DataFrame) -> DataFrame:
    """way, pos, src, dst as text: nodes (nid) of ``no_hup`` are another node on each way that visits them."""
    out = edges
    for end, step in (("src", 0), ("dst", 1)):
        out = out.join(no_hup.select(F.col("nid").alias(end), F.lit(True).alias("_no")), end, "left")
        own = F.concat_ws("/", F.col(end).cast("string"), F.col("way").cast("string"), (F.col("pos") + step).cast("string"))
        out = out.withColumn(end, F.when(F.col("_no"), own).otherwise(F.col(end).cast("string"))).drop("_no")
    return out.select("way", "pos", "src", "dst")


def station_tracks(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """nid and track of every station (nid, track): its own or, where it is empty, the smallest of its edges' (src, dst, track)."""
    ends = edges.filter("track is not null and track <> ''")
    ends = ends.select(F.col("src").alias("nid"), "track").unionByName(ends.select(F.col("dst").alias("nid"), "track"))
    near = ends.groupBy("nid").agg(F.min("track").alias("_t"))
    own = F.nullif(F.col("track"), F.lit(""))
    return stations.join(near, "nid", "left").select("nid", F.coalesce(own, "_t").alias("track"))


def component_speeds(edges: DataFrame, comps: DataFrame, speeds: list[float], correction: float = 1.0) -> DataFrame:
    """comp and max_speed, the fastest level (lvl of edges: src, dst) in it, over the correction factor."""
    speed = F.element_at(F.array(*[F.lit(float(s)) for s in speeds]), F.col("lvl") + 1)
    rows = edges.join(comps.withColumnRenamed("nid", "src"), "src")
    return rows.groupBy("comp").agg((F.max(speed) / correction).alias("max_speed"))


def net_graph(hops: DataFrame) -> DataFrame:
    """Use of each edge (eid) by trips (trip_id, route): number of trips and the routes' names."""
    return hops.groupBy("eid").agg(F.countDistinct("trip_id").alias("n_trips"), F.array_sort(F.collect_set("route")).alias("routes"))


def joined_gaps(nodes: DataFrame, edges: DataFrame, metres: float = 1.0) -> DataFrame:
    """Edges after nodes with one neighbour that lie within ``metres`` of one another have become one node.

    Groups of such nodes take the smallest id; what becomes a loop is gone. nodes: nid, lat, lon.
    """
    from stopweave.operators.spatial import within_radius

    ends = edges.select(F.col("src").alias("nid")).unionByName(edges.select(F.col("dst").alias("nid")))
    loose = ends.groupBy("nid").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("nid")
    points = nodes.join(loose, "nid", "left_semi").select("nid", "lat", "lon")
    near = within_radius(points, points, metres).filter("nid < nid_r")
    same = components(near.select(F.col("nid").alias("src"), F.col("nid_r").alias("dst")))
    out = edges
    for end in ("src", "dst"):
        out = out.join(same.select(F.col("nid").alias(end), F.col("comp").alias("_c")), end, "left")
        out = out.withColumn(end, F.coalesce("_c", end)).drop("_c")
    return out.filter("src <> dst").select(*edges.columns)


def collapsed_chains(edges: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Runs of edges through nodes with two neighbours as one edge: src, dst, cost (summed), n_edges.

    Edges are undirected (src, dst, cost) and only join where their ``kind`` is equal. ``kept``: nodes (nid) that
    stay, e.g. stations. A chain is a component of the edges around its inner nodes, found like those of the
    graph, in a number of rounds that grows with the logarithm of its length; rings stay as they are.
    """
    e = edges.withColumn("eid", F.xxhash64("src", "dst"))
    ends = e.select("eid", "kind", F.col("src").alias("nid")).unionByName(e.select("eid", "kind", F.col("dst").alias("nid")))
    inner = ends.groupBy("nid").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("kind").alias("_k"), F.min("eid").alias("a"), F.max("eid").alias("b")
    )
    inner = inner.filter("_n = 2 and _k = 1 and a <> b")
    if kept is not None:
        inner = inner.join(kept, "nid", "left_anti")
    chains = components(inner.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("nid", "eid")
    rows = e.join(chains, "eid", "left").withColumn("comp", F.coalesce("comp", "eid"))
    outer = ends.join(inner.select("nid"), "nid", "left_anti").join(rows.select("eid", "comp"), "eid")
    tips = outer.groupBy("comp").agg(F.min("nid").alias("src"), F.max("nid").alias("dst"), F.count(F.lit(1)).alias("_tips"))
    sums = rows.groupBy("comp").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n_edges"), F.first("kind").alias("kind"))
    lines = sums.join(tips.filter("_tips = 2 and src <> dst"), "comp")
    rings = rows.join(lines.select("comp"), "comp", "left_anti").withColumn("n_edges", F.lit(1).cast("long"))
    columns = ["src", "dst", "kind", "cost", "n_edges"]
    return lines.select(*columns).unionByName(rings.select(*columns))


def station_snaps(stations: DataFrame, segments: DataFrame, metres: float, max_level: int) -> DataFrame:
    """Where stations without an edge join the graph: nid, eid, progr, dist, split.

    ``stations``: nid, lat, lon, name; ``segments``: eid, src, dst, lvl, oneway, lat1, lon1, lat2, lon2. All
    edges of level ``max_level`` or lower within reach are taken; an edge whose end is half a metre away is
    used there (``split`` false), any other is cut.
    """
    from stopweave.functions.geo import haversine
    from stopweave.operators.spatial import near_segments

    near = near_segments(stations, segments.filter(F.col("lvl") <= max_level), metres)
    here = lambda end: haversine(F.col(f"lat{end}"), F.col(f"lon{end}"), lat, lon)
    lat = F.col("lat1") + F.col("progr") * (F.col("lat2") - F.col("lat1"))
    lon = F.col("lon1") + F.col("progr") * (F.col("lon2") - F.col("lon1"))
    return near.select("nid", "eid", "progr", "dist", (F.least(here(1), here(2)) >= 0.5).alias("split"))
