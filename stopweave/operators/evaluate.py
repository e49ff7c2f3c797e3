"""Scores of computed shapes against true ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopweave.functions.polyline import frechet, segments

#: A segment is wrong from this Fréchet distance on, in metres; shares of wrong segments that reports count.
WRONG_M = 100.0
SHARES = (0.0001, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)

PAIR = "trip_id string, n_segments long, n_wrong long, wrong_m double, avg_fd double, max_fd double"


def compared(truth: DataFrame, test: DataFrame, spacing: float = 5.0) -> DataFrame:
    """Segment-wise comparison of trips that both sides have a shape for.

    Both: trip_id, shape array<struct<lat,lon,dist>>, stops array<double> (distances of the stops). Pairs of shapes and
    stops are scored once for all trips that have them, in batches; identical shapes score 0 without a search.
    """
    both = truth.join(test.select("trip_id", F.col("shape").alias("shape_t"), F.col("stops").alias("stops_t")), "trip_id")
    both = both.filter("size(shape) > 0 and size(shape_t) > 0")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                line = lambda s: (np.array([(p["lat"], p["lon"]) for p in s]), np.array([p["dist"] for p in s]))
                parts = [segments(*line(s), np.asarray(d)) for s, d in ((r.shape, r.stops), (r.shape_t, r.stops_t))]
                fds = [0.0 if np.array_equal(a, b) else frechet(a, b, spacing) for a, b in zip(*parts, strict=False)]
                wrong = [i for i, d in enumerate(fds) if d >= WRONG_M]
                metres = sum(float(r.stops[i + 1] - r.stops[i]) for i in wrong)
                out.append((r.trip_id, len(fds), len(wrong), metres, float(np.mean(fds)) if fds else 0.0, max(fds, default=0.0)))
            yield pd.DataFrame(out, columns=["trip_id", "n_segments", "n_wrong", "wrong_m", "avg_fd", "max_fd"])

    pair = ["shape", "stops", "shape_t", "stops_t"]
    keyed = both.select("trip_id", *pair, F.sha2(F.to_json(F.struct(*pair)), 256).alias("_pair"))
    once = keyed.groupBy("_pair").agg(*(F.first(c).alias(c) for c in pair))
    scores = once.select(F.col("_pair").alias("trip_id"), *pair).mapInPandas(run, PAIR).withColumnRenamed("trip_id", "_pair")
    return keyed.select("trip_id", "_pair").join(scores, "_pair").drop("_pair")


def missing(truth: DataFrame, test: DataFrame) -> DataFrame:
    """Trips that the tested feed has not."""
    return truth.join(test.select("trip_id"), "trip_id", "left_anti").select("trip_id")


def summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of trips, mean, largest and smallest avg_fd and how many trips have at most each share wrong."""
    share = F.when(F.col("n_segments") > 0, F.col("n_wrong") / F.col("n_segments")).otherwise(F.lit(0.0))
    counts = [F.count_if(share <= s).alias(f"an_{i}") for i, s in enumerate(SHARES)]
    return scores.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_trips"), F.avg("avg_fd").alias("avg_fd"), F.max("avg_fd").alias("max_fd"), F.min("avg_fd").alias("min_fd"), *counts
    )


def mean_of_feeds(summaries: DataFrame) -> DataFrame:
    """The mean of each number over the rows, one for every feed, of :func:`summary`."""
    names = [c for c in summaries.columns if c != "feed"]
    return summaries.agg(F.count(F.lit(1)).alias("n_feeds"), *(F.avg(c).alias(c) for c in names))


def length_differences(truth: DataFrame, test: DataFrame, by: str = "trip_id") -> DataFrame:
    """``by`` and the difference of lengths (by, len) of what both sides have, absolute and as a share of the true one."""
    both = truth.join(test.select(by, F.col("len").alias("_test")), by)
    diff = F.abs(F.col("_test") - F.col("len"))
    return both.select(by, diff.alias("diff"), F.when(F.col("len") > 0, diff / F.col("len")).alias("share"))


def placed_stops(points: DataFrame, stops: DataFrame, by: str = "trip_id") -> DataFrame:
    """by, n, lat, lon: where a line (by, seq, lat, lon, dist) is at the distances of its stops (by, n, at).

    A stop lies between the last point that is not behind it and the next one; beyond the end, at the end.
    """
    w = Window.partitionBy(by).orderBy("seq")
    ahead = {f"_{c}": F.lead(c).over(w) for c in ("lat", "lon", "dist")}
    rows = points.withColumns(ahead).withColumn("_end", F.coalesce("_dist", F.lit(float("inf"))))
    inside = (F.col("at") >= F.col("dist")) & (F.col("at") < F.col("_end"))
    part = F.when(F.col("_dist") > F.col("dist"), (F.col("at") - F.col("dist")) / (F.col("_dist") - F.col("dist"))).otherwise(0.0)
    on = lambda c: F.coalesce(F.col(c) + part * (F.col(f"_{c}") - F.col(c)), F.col(c)).alias(c)
    return stops.join(rows, by).filter(inside).select(by, "n", on("lat"), on("lon"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place n div 2 (from 0) of each group in order: of two middle ones, the upper."""
    w = Window.partitionBy(by)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2)).select(by, F.col(value).alias("median"))
