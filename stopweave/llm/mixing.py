"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. Within a source the documents
stand in order of size, their expected copies are added up, one random offset is drawn, and a document
is emitted once for each integer that its stretch of the sum (plus offset) crosses. As neighbours in
that order are alike in size, what a source takes misses its target by about one document's size.

The prefix sum is built in three levels, none of which puts a source, a size or a group of copies into
one task: rows are numbered within (source, size, salt), those groups are added up within (source, band
of sizes), and the bands, at most some hundreds for any number of rows, within the source. A salt is the
first bits of the hash that orders documents of one size, so the order is the same for any number of salts.

Texts are read once for their sizes, which are stored; the mix reads them again to emit them.

Nulls and ties: a null source is a source of its own, after all others; a null text has size 0; a document
without doc_id is ordered by its text. Equal rows are interchangeable; of those that repeat more than
``SALT_ROWS`` times one is numbered, and repeated at the end. A source of size 0 has target 0 and takes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopweave.llm.store import ROW, attached, beside, keyed, repeated, split_hot, stored

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Most copies of a document.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one size in a source that are numbered by one task, about.
SALT_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row per source.

    With sources in order of cap / weight, the level is ``(total - caps so far) / (weights left)``;
    those before the first source whose ratio is above it are capped, the others get weight x level.
    """
    rows = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = sizes.withColumn("_w", F.element_at(cycle, (F.row_number().over(rows) - 1) % len(weights) + 1))
    capped = numbered.withColumn("_cap", F.col("source_size") * repeats)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    spent = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = (
        capped.withColumn("_level", (F.sum("source_size").over(everything) - spent) / left)
        .withColumn("_open", F.col("_cap") / F.col("_w") >= F.col("_level"))
        .withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything))
    )
    share = F.col("_w") * F.col("_final._level")
    return levels.select(
        "source",
        "source_size",
        F.when(F.col("_final").isNull() | (F.col("_cap").cast("double") < share), F.col("_cap").cast("double"))
        .otherwise(share)
        .alias("target"),
    )


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, ``ROW``, size, _key (the source), _order (32 bits of hash) and _band (of sizes) of every row, stored."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("null")), F.lit(f"/{seed}"))
    rows = keyed(docs).select(
        "doc_id",
        *ROW,
        word_count(F.col("text")).alias("size"),
        key.alias("_key"),
        F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long").alias("_order"),
    )
    return stored(rows.withColumn("_band", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 32).cast("int")), "sizes")


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """doc_id, ``store.ROW``, size, source_size, target and copies (how often the mix emits it) of every document."""
    return _taken(_measured(docs, seed), weights, repeats, seed)


def _taken(measured: DataFrame, weights: Sequence[float], repeats: int, seed: int) -> DataFrame:
    n = measured.count()
    bits = max(6, math.ceil(math.log2(max(1, n / SALT_ROWS))))
    few, many = split_hot(measured, SALT_ROWS)
    rows = few if many is None else few.unionByName(many)
    rows = rows.withColumn("_salt", F.shiftright("_order", 32 - min(bits, 32)).cast("int"))
    groups = rows.groupBy("_key", "_band", "size", "_salt").agg(F.sum("_times").alias("_n"))
    bands = groups.groupBy("_key", "_band").agg(F.sum("_n").alias("_rows"))
    before_band = Window.partitionBy("_key").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_rows", F.coalesce(F.sum("_rows").over(before_band), F.lit(0)))
    before = Window.partitionBy("_key", "_band").orderBy("size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        groups.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(bands, ["_key", "_band"])
        .select("_key", "_band", "size", "_salt", (F.col("_rows") + F.col("_before")).alias("_from"))
    )
    sizes = measured.groupBy("_key").agg(F.sum("size").alias("source_size"))
    sizes = sizes.select(F.when(F.col("_key") != "-", F.substring("_key", 2, 1 << 30)).alias("source"), "source_size")
    goal = targets(sizes, weights, repeats).select(
        F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("_key"),
        "source_size",
        "target",
    )
    within = Window.partitionBy("_key", "_band", "size", "_salt").orderBy("_order", "doc_id", *ROW)
    ranked = rows.withColumn("_rank", F.sum("_times").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_times"))
    placed = ranked.join(begins, ["_key", "_band", "size", "_salt"]).withColumn("_place", F.col("_from") + F.col("_rank") + 1)
    out = placed.filter("_times = 1")
    if many is not None:
        again = repeated(placed.filter("_times > 1"), SALT_ROWS)
        out = out.unionByName(again.withColumn("_place", F.col("_place") + F.col("_again")).drop("_again"))
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("_key"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    emitted = F.floor(F.col("_place") * expected + offset) - F.floor((F.col("_place") - 1) * expected + offset)
    return out.join(goal, "_key").select("doc_id", *ROW, "size", "source_size", "target", emitted.cast("long").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = copies(docs.select("doc_id", "text", "source"))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all columns."""

    def emit(rows: DataFrame) -> DataFrame:
        measured = _measured(rows, seed)
        taken = _taken(measured, weights, repeats, seed).filter(F.col("copies") > 0)
        again = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        return attached(rows, again, measured, [])

    return beside(docs, ("doc_id", "text", "source"), emit)
