"""GTFS feeds as one DataFrame per file, and back."""

from __future__ import annotations

import csv
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that are written as they were read.
PASSED_ON = ("agency", "stops", "calendar", "calendar_dates", "frequencies", "transfers", "fare_attributes", "fare_rules", "pathways", "levels", "translations")
#: Columns that are numbers; all others are strings.
TYPES = {
    "stop_lat": "double", "stop_lon": "double", "shape_pt_lat": "double", "shape_pt_lon": "double", "shape_pt_sequence": "int",
    "shape_dist_traveled": "double", "stop_sequence": "int", "location_type": "int", "route_type": "int",
}

#: Names of means of transport, the route types each stands for (fixed values of the GTFS reference).
MODES = {
    "tram": {0}, "streetcar": {0}, "subway": {1}, "metro": {1}, "rail": {2}, "train": {2}, "bus": {3}, "ferry": {4}, "boat": {4},
    "ship": {4}, "cablecar": {5}, "gondola": {6}, "funicular": {7}, "coach": {200}, "trolleybus": {11}, "monorail": {12},
}
#: Hundreds of the extended route types, and the basic type of each (fixed values).
EXTENDED = {1: 2, 2: 3, 4: 1, 5: 1, 6: 1, 7: 3, 8: 3, 9: 0, 10: 4, 11: 3, 12: 4, 13: 6, 14: 7, 15: 3}


def modes(names: Iterable[str]) -> set[int]:
    """Route types of names or numbers; ``all`` stands for every one."""
    out: set[int] = set()
    for name in names:
        n = name.strip().lower()
        if n == "all":
            out |= set().union(*MODES.values())
        elif n.isdigit():
            out.add(int(n))
        elif n in MODES:
            out |= MODES[n]
        else:
            raise ValueError(f"unknown mode {name!r}")
    return out


def standard_type(route_type: Column) -> Column:
    """Extended route types as basic ones."""
    table = F.create_map(*[F.lit(x) for pair in EXTENDED.items() for x in pair])
    return F.when(route_type < 100, route_type).otherwise(F.try_element_at(table, F.floor(route_type / 100).cast("int")))


def seconds(text: Column) -> Column:
    """Seconds since the start of service, past 24:00:00 too; null where there is no time."""
    parts = F.split(F.trim(text), ":")
    ok = F.trim(text).rlike("^[0-9]+:[0-5]?[0-9]:[0-5]?[0-9]$")
    return F.when(ok, parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("int"))


def clock(secs: Column) -> Column:
    return F.when(secs.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(secs / 3600), F.floor(secs % 3600 / 60), secs % 60))


def read(spark: SparkSession, path: str, folder: str | None = None) -> dict[str, DataFrame]:
    """All tables of a feed, a directory or a zip file (unpacked to ``folder``, which all executors have to see)."""
    if path.endswith(".zip"):
        from stopweave.operators.graph import shared_folder

        folder = folder or shared_folder(spark).removeprefix("file:")
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                if name.endswith(".txt") and "/" not in name:
                    z.extract(name, folder)
        path = folder
    out = {}
    for name in sorted(os.listdir(path)):
        if name.endswith(".txt"):
            df = spark.read.csv(f"{path}/{name}", header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True)
            df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
            casts = [F.col(c).try_cast(TYPES[c]).alias(c) if c in TYPES else F.col(c) for c in df.columns]
            out[name[:-4]] = df.select(*casts)
    for needed in ("stops", "routes", "trips", "stop_times"):
        if needed not in out:
            raise FileNotFoundError(f"{path}: {needed}.txt is missing")
    return out


def union(feeds: Mapping[str, Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Several feeds as one, with feed_id in every table."""
    names = sorted({t for f in feeds.values() for t in f})
    return {
        t: reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [f[t].withColumn("feed_id", F.lit(k)) for k, f in sorted(feeds.items()) if t in f],
        )
        for t in names
    }


def write(feed: Mapping[str, DataFrame], path: str) -> None:
    """A feed as a directory, or as a zip file by the path's ending; each file is complete or not there.

    The files of a feed are single by the standard, so rows stream to the driver one at a time, unheld.
    """
    folder = tempfile.mkdtemp(prefix="gtfs-") if path.endswith(".zip") else path
    os.makedirs(folder, exist_ok=True)
    for name, df in feed.items():
        part = f"{folder}/.{name}.part"
        with open(part, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(df.columns)
            for row in df.toLocalIterator():
                out.writerow(["" if v is None else v for v in row])
        os.replace(part, f"{folder}/{name}.txt")
    if folder != path:
        with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(os.listdir(folder)):
                z.write(f"{folder}/{name}", name)
        os.replace(f"{path}.part", path)
        shutil.rmtree(folder)


#: Who made the map, as attributions name it (fixed values).
MAP_NAME, MAP_URL = "OpenStreetMap contributors", "https://www.openstreetmap.org/copyright"


def with_shapes(
    feed: Mapping[str, DataFrame], shapes: DataFrame, used: DataFrame, stop_dists: DataFrame | None = None, attribution: bool = True
) -> dict[str, DataFrame]:
    """The feed with new shapes: trips refer to them (``used``: trip_id, shape_id), old ones without a trip are gone.

    ``stop_dists`` (trip_id, seq, dist) go into stop_times, and the map's makers into attributions.
    """
    from stopweave.operators.shapes import updated_stop_times, with_attribution

    out = dict(feed)
    new = used.withColumnRenamed("shape_id", "_new")
    trips = feed["trips"].join(new, "trip_id", "left")
    had = F.col("shape_id") if "shape_id" in feed["trips"].columns else F.lit(None).cast("string")
    out["trips"] = trips.withColumn("shape_id", F.coalesce("_new", had)).drop("_new")
    if "shapes" in feed:
        old = feed["shapes"].join(out["trips"].select("shape_id"), "shape_id", "left_semi")
        shapes = old.unionByName(shapes, allowMissingColumns=True)
    out["shapes"] = shapes
    if stop_dists is not None:
        st = feed["stop_times"]
        if "shape_dist_traveled" not in st.columns:
            st = st.withColumn("shape_dist_traveled", F.lit(None).cast("double"))
        columns = st.columns
        st = updated_stop_times(st.withColumn("seq", F.col("stop_sequence").cast("long")), stop_dists)
        out["stop_times"] = st.select(*columns)
    if attribution:
        had = feed.get("attributions")
        if had is None:
            had = shapes.sparkSession.createDataFrame([], "organization_name string, is_producer string, attribution_url string")
        out["attributions"] = with_attribution(had, MAP_NAME, MAP_URL)
    if "feed_info" in out:
        out["feed_info"] = out["feed_info"].filter("feed_publisher_name <> '' and feed_publisher_url <> ''")
    return out


def with_colors(feed: Mapping[str, DataFrame], colors: DataFrame) -> dict[str, DataFrame]:
    """The feed with routes in the colours (trip_id, color) of their trips; a route of several colours is split.

    Trips of the first colour, or of none, stay with the route; others get a copy of it with its fares.
    """
    from stopweave.functions.text import text_color
    from stopweave.operators.shapes import split_fares, split_routes

    out = dict(feed)
    routes, trips = feed["routes"], feed["trips"]
    split = split_routes(trips.select("trip_id", "route_id").join(colors, "trip_id"))
    split = split.select("trip_id", F.col("route_id").alias("_route"), "color")
    parts = trips.join(split, "trip_id").groupBy("route_id", "_route").agg(F.first("color").alias("color"))
    hexed = lambda c: F.format_string("%06X", c)
    columns = [*routes.columns, *(c for c in ("route_color", "route_text_color") if c not in routes.columns)]
    rows = routes.join(parts, "route_id").drop("route_color", "route_text_color").withColumns(
        {"route_id": F.col("_route"), "route_color": hexed(F.col("color")), "route_text_color": hexed(text_color(F.col("color")))}
    )
    kept = routes.join(parts.select(F.col("_route").alias("route_id")), "route_id", "left_anti")
    out["routes"] = rows.select(*columns).unionByName(kept, allowMissingColumns=True)
    moved = trips.join(split.drop("color"), "trip_id", "left").withColumn("route_id", F.coalesce("_route", "route_id"))
    out["trips"] = moved.select(*trips.columns)
    if "fare_rules" in feed and "route_id" in feed["fare_rules"].columns:
        out["fare_rules"] = split_fares(feed["fare_rules"], parts.select("route_id", F.col("_route").alias("new_id")))
    return out
