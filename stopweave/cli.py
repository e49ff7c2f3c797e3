"""Command line: match a feed, cut out the map a feed needs, score shapes."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopweave.operators import evaluate, extract, spatial
from stopweave.plans import matcher
from stopweave.plans.options import Options
from stopweave.plans.ship import ship
from stopweave.sources import config, exports, gtfs, osm


def _options(path: str | None, mode: str) -> Options:
    if not path:
        return Options()
    with open(path, encoding="utf-8") as f:
        found = config.modes(config.parse(f.read()))
    chosen = [m for m in found if mode in m.modes]
    if not chosen:
        raise SystemExit(f"{path}: no section for {mode}")
    return chosen[0].options


def _truth(feed: dict) -> object:
    """trip_id, shape and the stops' distances, as scores need them."""
    points = F.array_sort(F.collect_list(F.struct("shape_pt_sequence", "shape_pt_lat", "shape_pt_lon", "shape_dist_traveled")))
    lines = feed["shapes"].groupBy("shape_id").agg(points.alias("p"))
    shape = F.transform("p", lambda s: F.struct(s["shape_pt_lat"].alias("lat"), s["shape_pt_lon"].alias("lon"), s["shape_dist_traveled"].alias("dist")))
    stops = F.array_sort(F.collect_list(F.struct("stop_sequence", F.coalesce("shape_dist_traveled", F.lit(0.0)).alias("d"))))
    times = feed["stop_times"].groupBy("trip_id").agg(F.transform(stops, lambda s: s["d"]).alias("stops"))
    trips = feed["trips"].join(lines.select("shape_id", shape.alias("shape")), "shape_id")
    return trips.join(times, "trip_id").select("trip_id", "shape", "stops")


def _match(spark: SparkSession, args: argparse.Namespace) -> None:
    feed, tables = gtfs.read(spark, args.feed), osm.read(spark, args.map)
    options = replace(_options(args.config, args.mode), drop_shapes=args.drop_shapes, noise_m=args.noise)
    modes = None if args.mode == "all" else gtfs.modes(args.mode.split(","))
    found = matcher.match(feed, tables, options, modes, args.trip)
    out = gtfs.with_shapes(feed, found.shapes, found.trips, found.stop_dists)
    edges, lines = matcher.with_lines(matcher.road_graph(tables, options), tables, options)
    if args.write_colors and lines is not None:
        colors = matcher.trip_colors(found.paths, edges, lines)
        out = gtfs.with_colors(out, colors)
    gtfs.write(out, args.output)
    if args.write_graph:
        exports.write_geojson(exports.graph_features(edges), args.write_graph)
    if args.stats:
        with open(args.stats, "w", encoding="utf-8") as f:
            json.dump(exports.run_stats({"edges": edges, "trips": found.trips, "shape_points": found.shapes, "hops": found.stop_dists}).first().asDict(), f)


def _extract(spark: SparkSession, args: argparse.Namespace) -> None:
    options = _options(args.config, args.mode)
    feeds = {str(n): gtfs.read(spark, f) for n, f in enumerate(args.feed)}
    stops = gtfs.union(feeds)["stops"]
    places = stops.select("feed_id", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    boxes = spatial.padded_box(places, ["feed_id"], args.padding)
    if args.kind != "map":
        found = [tuple(r) for r in boxes.select("min_lat", "min_lon", "max_lat", "max_lon").collect()]  # one for each feed
        text = exports.overpass(found, options.keep) if args.kind == "overpass" else exports.osmfilter(options.keep, options.drop)
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
        return
    tables = extract.extract(osm.read(spark, args.map), boxes, options.keep, options.drop)
    (osm.write_pbf if args.output.endswith(".pbf") else osm.write_xml)(tables, args.output)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stopweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    match = commands.add_parser("match", help="shapes for a feed")
    match.add_argument("feed")
    match.add_argument("map")
    match.add_argument("-o", "--output", required=True)
    match.add_argument("-c", "--config")
    match.add_argument("-m", "--mode", default="all")
    match.add_argument("-D", "--drop-shapes", action="store_true", help="match trips that have a shape, too")
    match.add_argument("-T", "--trip", help="match this trip only")
    match.add_argument("--write-colors", action="store_true", help="colours of routes from the map")
    match.add_argument("--write-graph", metavar="FILE", help="the routing graph as GeoJSON")
    match.add_argument("--stats", metavar="FILE", help="sizes of the run as JSON")
    match.add_argument("--noise", type=float, default=0.0, help="metres of normal noise on stops")
    cut = commands.add_parser("extract", help="the part of a map that feeds need")
    cut.add_argument("feed", nargs="+")
    cut.add_argument("map")
    cut.add_argument("-o", "--output", required=True)
    cut.add_argument("-c", "--config")
    cut.add_argument("-m", "--mode", default="bus")
    cut.add_argument("-b", "--padding", type=float, default=20_000)
    cut.add_argument("--as", dest="kind", choices=("map", "overpass", "osmfilter"), default="map", help="the part itself, or a query for it")
    score = commands.add_parser("evaluate", help="scores of a feed's shapes against true ones")
    score.add_argument("truth")
    score.add_argument("feed", nargs="+")
    score.add_argument("--avg", action="store_true", help="the mean over all feeds")
    score.add_argument("--style", choices=("text", "short", "json"), default="text")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("stopweave").getOrCreate()
    ship(spark)
    if args.command == "match":
        _match(spark, args)
    elif args.command == "extract":
        _extract(spark, args)
    else:
        truth = _truth(gtfs.read(spark, args.truth))
        feeds = [evaluate.summary(evaluate.compared(truth, _truth(gtfs.read(spark, f)))) for f in dict.fromkeys(args.feed)]
        if args.avg:
            feeds = [evaluate.mean_of_feeds(reduce(DataFrame.unionByName, feeds))]
        for row in feeds:
            print(exports.score_report(row, args.style))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
