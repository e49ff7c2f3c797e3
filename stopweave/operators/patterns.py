"""Trips that share their stops: patterns, prefix tries, mean times, routing attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eligible(trips: DataFrame, stop_times: DataFrame, least: int = 2) -> DataFrame:
    """Trips with at least so many stop times."""
    many = stop_times.groupBy("trip_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return trips.join(many.select("trip_id"), "trip_id", "left_semi")


def patterns(stop_times: DataFrame) -> DataFrame:
    """pattern (stops in order, joined), n_stops, n_trips and the smallest trip_id of trips with equal stops."""
    stops = stop_times.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))).alias("_s"))
    key = F.array_join(F.transform("_s", lambda s: s["stop_id"].cast("string")), ">")
    return stops.select("trip_id", key.alias("pattern"), F.size("_s").cast("long").alias("n_stops")).groupBy("pattern", "n_stops").agg(
        F.count(F.lit(1)).alias("n_trips"), F.min("trip_id").alias("first_trip")
    )


def trie(stop_times: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of all trips: depth, prefix, its parent, trips through it and the mean departure.

    The mean truncates, as all times are whole seconds.
    """
    order = Window.partitionBy("trip_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("dep_s").over(Window.partitionBy("trip_id"))
    rows = stop_times.withColumns(
        {"_p": F.collect_list(F.col("stop_id").cast("string")).over(order), "_t": F.col("dep_s") - first}
    )
    rows = rows.select(
        F.size("_p").cast("long").alias("depth"),
        F.array_join("_p", ">").alias("prefix"),
        F.array_join(F.slice("_p", 1, F.size("_p") - 1), ">").alias("parent"),
        "_t",
    )
    return rows.groupBy("depth", "prefix", "parent").agg(
        F.count(F.lit(1)).alias("n_trips"), F.floor(F.sum("_t") / F.count(F.lit(1))).cast("long").alias("mean_dep_s")
    )


def mean_times(stop_times: DataFrame) -> DataFrame:
    """pattern, pos, n_trips and the mean arr_s and dep_s since the first departure, truncated, of the trips of a pattern.

    ``stop_times``: pattern, trip_id, pos (from 0), arr_s, dep_s; a missing time counts as the other one.
    """
    arr, dep = F.coalesce("arr_s", "dep_s"), F.coalesce("dep_s", "arr_s")
    start = F.min(F.struct("pos", dep.alias("d"))).over(Window.partitionBy("pattern", "trip_id"))["d"]
    rows = stop_times.withColumns({"_a": arr - start, "_d": dep - start})
    mean = lambda c: F.floor(F.sum(c) / F.count(c)).cast("long")
    return rows.groupBy("pattern", "pos").agg(F.count(F.lit(1)).alias("n_trips"), mean("_a").alias("arr_s"), mean("_d").alias("dep_s"))


def routing_attributes(trips: DataFrame, routes: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Trips by where they start and their short name: line_from, short_name, n_trips, n_line_to."""
    ends = stop_times.groupBy("trip_id").agg(
        F.min_by("stop_id", "seq").alias("line_from"), F.max_by("stop_id", "seq").alias("line_to")
    )
    name = F.coalesce(F.nullif(F.col("short_name"), F.lit("")), F.col("long_name"))
    rows = trips.join(routes, "route_id").join(ends, "trip_id").withColumn("short_name", F.lower(name))
    return rows.groupBy("line_from", "short_name").agg(
        F.count(F.lit(1)).alias("n_trips"), F.countDistinct("line_to").alias("n_line_to")
    )


def entrances_to_parents(stops: DataFrame) -> DataFrame:
    """Entrances (location_type 2) take the place of their station: stop_id, resolved."""
    parents = stops.select(F.col("stop_id").alias("parent_station"), F.lit(True).alias("_there"))
    rows = stops.join(parents, "parent_station", "left")
    is_entrance = (F.col("location_type") == 2) & F.col("_there").isNotNull()
    return rows.select("stop_id", F.when(is_entrance, F.col("parent_station")).otherwise(F.col("stop_id")).alias("resolved"))


def distinct_hops(stop_times: DataFrame, attribute: str) -> DataFrame:
    """before, stop_id, the attribute and how many trips pass: pairs that are searched once for all of them."""
    order = Window.partitionBy("trip_id").orderBy("seq")
    rows = stop_times.withColumn("before", F.lag("stop_id").over(order)).filter("before is not null")
    return rows.groupBy("before", "stop_id", attribute).agg(F.countDistinct("trip_id").alias("n_trips"))


def time_expanded(cands: DataFrame, steps: int = 0, step_s: int = 30) -> DataFrame:
    """Candidates (time_s) at their time and at so many later ones; the square of five minutes' shares is their penalty."""
    late = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    rows = cands.withColumn("_n", late)
    return rows.withColumn("time_s", F.col("time_s") + F.col("_n") * step_s).withColumn("time_pen", F.pow(F.col("_n") * step_s / 300, 2)).drop("_n")
