"""Shapes: measures along them, what is still used, colours of trips and routes split by colour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopweave.functions.geo import haversine


def measures(points: DataFrame, by: str, order: str = "seq") -> DataFrame:
    """``points`` and ``dist``: metres travelled since the first point."""
    w = Window.partitionBy(by).orderBy(order)
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("dist", F.sum("_step").over(running)).drop("_step")


def hops(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Each stop time with the next one's stop, the metres between and the seconds planned (1 at least)."""
    rows = stop_times.join(stops.select("stop_id", "lat", "lon"), "stop_id")
    w = Window.partitionBy("trip_id").orderBy("seq")
    ahead = {f"next_{c}": F.lead(c).over(w) for c in ("stop_id", "lat", "lon", "dep_s")}
    rows = rows.withColumns(ahead).filter("next_stop_id is not null")
    return rows.select(
        "trip_id",
        "seq",
        "stop_id",
        "next_stop_id",
        haversine(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")).alias("metres"),
        F.greatest(F.col("next_dep_s") - F.col("dep_s"), F.lit(1)).alias("seconds"),
    )


def unused(shapes: DataFrame, trips: DataFrame) -> DataFrame:
    """Shapes (shape_id) that no trip refers to."""
    return shapes.join(trips.select("shape_id"), "shape_id", "left_anti")


def trip_colors(parts: DataFrame, share: float = 0.9) -> DataFrame:
    """trip_id and the colour that covers more than ``share`` of its length (parts: trip_id, color, len)."""
    sums = parts.groupBy("trip_id", "color").agg(F.sum("len").alias("_len"))
    best = sums.groupBy("trip_id").agg(F.sum("_len").alias("_all"), F.max_by("color", F.struct("_len", "color")).alias("color"), F.max("_len").alias("_most"))
    return best.filter(F.col("_most") > F.col("_all") * share).select("trip_id", "color")


def split_routes(trips: DataFrame) -> DataFrame:
    """Trips (trip_id, route_id, color) with the id of their part of the route: the first colour keeps it."""
    rank = F.dense_rank().over(Window.partitionBy("route_id").orderBy("color"))
    colors = trips.select("route_id", "color").distinct().withColumn("_n", rank.cast("long") - 1)
    name = F.when(F.col("_n") == 0, F.col("route_id").cast("string")).otherwise(
        F.concat(F.col("route_id").cast("string"), F.lit("::"), F.col("_n").cast("string"))
    )
    return trips.join(colors, ["route_id", "color"]).select("trip_id", name.alias("route_id"), "color")


def split_fares(fare_rules: DataFrame, parts: DataFrame) -> DataFrame:
    """Fare rules, and those of each route once more for every new route (new_id) that it was split into (route_id)."""
    new = parts.filter(F.col("new_id") != F.col("route_id").cast("string")).distinct()
    copies = fare_rules.join(new, "route_id").withColumn("route_id", F.col("new_id")).select(*fare_rules.columns)
    return fare_rules.withColumn("route_id", F.col("route_id").cast("string")).unionByName(copies)


def updated_stop_times(stop_times: DataFrame, measured: DataFrame) -> DataFrame:
    """stop_times with shape_dist_traveled overwritten where ``measured`` (trip_id, seq, dist) has one."""
    rows = stop_times.join(measured.select("trip_id", "seq", "dist"), ["trip_id", "seq"], "left")
    return rows.withColumn("shape_dist_traveled", F.coalesce("dist", "shape_dist_traveled")).drop("dist")


def with_attribution(attributions: DataFrame, name: str, url: str) -> DataFrame:
    """The organisation's row is appended unless it is there."""
    own = attributions.sparkSession.createDataFrame([(name, url)], "organization_name string, attribution_url string")
    missing = own.join(attributions.select("organization_name"), "organization_name", "left_anti")
    return attributions.unionByName(missing, allowMissingColumns=True)
