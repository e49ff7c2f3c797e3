"""Hierarchical weighted hash tree: documents descend regions, racks and shards by weighted hash draws.

At each level a document draws, for every child, an exponential variate ``-ln(u) / weight`` with
``u`` hashed from the key and the child's path, and follows the smallest. A child's draw depends on
nothing but its own path and weight, so a weight that changes moves documents only into or out of
that subtree, and within other subtrees nothing moves.

A tree grows by opening a region: the new region's weight is the only one that changes at the root,
so every document that moves goes into it. All is built from SQL functions; a level costs one hash
per child, and no row is shuffled until slots are numbered.

Nulls and ties: a null doc_id hashes as the text ``null``; a null text counts no bytes and has
checksum 0. Repeated rows get the same shard and different slots. Slots follow a hash of the whole row, so
reruns agree; rows equal in all columns are interchangeable, and where they are many they are numbered as one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopweave.llm.store import ROW, attached, keyed, repeated, split_hot, stored

ROW_BYTES = 16
#: Rows of a shard that are numbered by one task.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """Weights by region, rack and shard; shards are numbered depth first."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(shards: int, per_rack: int = 5, racks: int = 2) -> Tree:
        """Regions of ``racks`` racks of ``per_rack`` equal shards; the last one holds the rest."""
        left = [min(per_rack, shards - i) for i in range(0, shards, per_rack)]
        return Tree(tuple(tuple((1.0,) * n for n in left[i : i + racks]) for i in range(0, len(left), racks)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        return Tree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _uniform(key: Column, path: Column) -> Column:
    """A number in (0, 1) from 52 bits of the hash of key and path."""
    return (F.shiftrightunsigned(F.xxhash64(path, key), 12).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def _descend(key: Column, path: Column, weights: Column) -> Column:
    """Index of the child with the smallest draw, the first one on equal draws; weight 0: no child."""

    def draw(weight: Column, i: Column) -> Column:
        value = -F.ln(_uniform(key, F.concat(path, F.lit("."), i.cast("string")))) / weight
        return F.struct(F.when(weight > 0, value).otherwise(F.lit(float("inf"))).alias("draw"), i.alias("child"))

    return F.array_min(F.transform(weights, draw))["child"]


def _row(table: Sequence[Sequence[float]], index: Column) -> Column:
    """Row ``index`` of a table of weights; short rows are filled with 0, so that the table is one literal."""
    width = max(map(len, table))
    rows = [[float(w) for w in row] + [0.0] * (width - len(row)) for row in table]
    return F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in rows]), index + 1)


def with_shard(rows: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """``rows`` and column ``out``: the shard of the key (a string column) in ``tree``."""
    racks = [rack for region in tree.regions for rack in region]
    first_rack, first_shard = [0], [0]
    for region in tree.regions:
        first_rack.append(first_rack[-1] + len(region))
    for rack in racks:
        first_shard.append(first_shard[-1] + len(rack))
    kept = rows.columns
    root = [[sum(map(sum, x)) for x in tree.regions]]
    level = [[sum(k) for k in x] for x in tree.regions]
    first = lambda numbers, at: F.element_at(F.array(*map(F.lit, numbers)), at + 1)
    k = F.col(key)
    rows = rows.withColumn("_r", _descend(k, F.lit("r"), _row(root, F.lit(0))))
    rack = _descend(k, F.concat(F.lit("k"), F.col("_r").cast("string")), _row(level, F.col("_r")))
    rows = rows.withColumn("_k", first(first_rack, F.col("_r")) + rack)
    shard = _descend(k, F.concat(F.lit("s"), F.col("_k").cast("string")), _row(racks, F.col("_k")))
    return rows.select(*kept, (first(first_shard, F.col("_k")) + shard).cast("int").alias(out))


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """``docs`` and their size, text_crc32, shard and, with ``grown``, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns(
        {
            "size": F.octet_length(text).cast("long") + ROW_BYTES,
            "text_crc32": F.crc32(text),
            "_key": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        }
    )
    rows = with_shard(rows, "_key", tree, "shard")
    if grown:
        rows = with_shard(rows, "_key", grown, "grown_shard")
    return rows.drop("_key")


def numbered(slim: DataFrame, buckets: int | None = None) -> DataFrame:
    """``slim``, rows with ``store.ROW`` and shard, and their slot: 0, 1, ... within each shard, without a task that
    holds a whole shard.

    A shard is cut into buckets by a hash of the whole row; a bucket begins where the counts of those before it
    add up to. The counts are shards x buckets rows. Of rows that repeat more than ``SLOT_ROWS`` times one is
    counted and numbered, and repeated at the end.
    """
    few, many = split_hot(slim, SLOT_ROWS)
    if buckets is None:
        n = slim.count()
        buckets = 1 << max(3, math.ceil(math.log2(max(1, n / SLOT_ROWS))))
    rows = few if many is None else few.unionByName(many)
    rows = rows.withColumn("_bucket", F.pmod(ROW[0], F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.sum("_times").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*ROW).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_rank", F.sum("_times").over(within) - F.col("_times"))
    placed = ranked.join(begins, ["shard", "_bucket"]).withColumn("slot", (F.col("_from") + F.col("_rank")).cast("long"))
    out = placed.filter("_times = 1")
    if many is not None:
        again = repeated(placed.filter("_times > 1"), SLOT_ROWS)
        out = out.unionByName(again.withColumn("slot", F.col("slot") + F.col("_again")).drop("_again"))
    return out.drop("_bucket", "_from", "_rank", "_times")


def sharded(docs: DataFrame, tree: Tree) -> DataFrame:
    """``docs`` and their shard and slot. Only hashes and numbers are sorted; texts move once, to their slots."""
    slim = assign(keyed(docs), tree).select(*ROW, "shard")
    slim = stored(slim, "placed")
    return attached(docs, numbered(slim), slim, ["shard", "slot"])


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    tree = Tree.even(shards)
    rows = assign(keyed(docs.select("doc_id", "text")), tree, tree.grown()).drop("text")
    return numbered(stored(rows, "placed")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
