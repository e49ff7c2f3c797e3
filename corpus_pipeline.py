"""A training corpus from ``documents`` in five stages; each gets all rows that the one before it kept.

* toxicity: rows whose score reaches their language's threshold go.
* near_dedup: one row of each group of near-duplicates stays, that of the smallest doc_id (none comes last).
  Rows are judged by their text, also those that share a doc_id or have none; rows without words stay.
* decontamination: documents that hold passages of ``benchmark`` go. A document's text decides, so that
  holds for rows without doc_id, too.
* mixture: each row is there as often as the mix of sources takes it, up to three times or not at all.
* sharding: every row gets shard and slot; all columns of ``documents`` are still there, one that is called
  shard or slot as ``shard_before`` or ``slot_before``.

Empty tables, nulls, repeated rows and further columns, whatever their names, pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopweave.llm import decontam, mixing, neardup, sharding, toxicity
from stopweave.llm.store import beside, stored, table

SHARDS = 40


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    keep = lambda rows: toxicity.classify(rows, model).filter(~F.col("toxic"))
    return beside(docs, ("doc_id", "text", "lang"), keep)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = F.xxhash64("text")
    judged = decontam.decontaminate(docs.select(name.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = stored(judged.filter("contaminated").select(F.col("doc_id").alias("_name")).distinct(), "contaminated")
    keep = lambda rows: rows.withColumn("_name", name).join(bad, "_name", "left_anti")
    return beside(docs, ("doc_id", "text"), keep)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    place = lambda rows: sharding.sharded(rows, sharding.Tree.even(SHARDS))
    return beside(docs, ("doc_id", "text"), place, ("shard", "slot"))


STAGES = [
    ("toxicity", clean),
    ("near_dedup", distinct),
    ("decontamination", unseen),
    ("mixture", mixture),
    ("sharding", shards),
]

#: Training and union-find are not for SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
