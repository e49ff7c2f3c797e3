"""Labelled documents, all or bounded samples of them, and models fitted on samples in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int) -> Column:
    """Whether the row's doc_id falls into the fold no label is learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def label_counts(labels: DataFrame, column: str, learn: Column) -> dict[int, int]:
    rows = labels.filter(learn & F.col(column).isNotNull()).groupBy(column).count().collect()
    return {int(r[0]): int(r[1]) for r in rows}


#: Labels whose documents are found by a broadcast, so that no other text is shuffled.
BROADCAST_LABELS = 1_000_000


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, n: int) -> DataFrame:
    """All documents of the ``n`` labels that may be learnt from: doc_id, text, lang and label.

    A document labelled twice counts with its larger label, and of rows that repeat a doc_id the smallest text.
    """
    known = labels.filter(learn & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(column).alias("label"))
    return _texts(docs, F.broadcast(known) if n <= BROADCAST_LABELS else known.hint("merge"))


def sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: int, seed: int = 0) -> DataFrame:
    """At most ``per_class`` documents of each label that may be learnt from: doc_id, text, lang and label.

    The ids drawn are broadcast, at most ``2 * per_class`` of them, so no text is shuffled.
    A document labelled twice counts with its larger label, and of rows that repeat a doc_id the smallest text.
    """
    known = labels.filter(learn & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(column).alias("label"))
    order = F.xxhash64("doc_id", F.lit(seed))
    drawn = [known.filter(F.col("label") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    return _texts(docs, F.broadcast(drawn[0].unionByName(drawn[1])))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang").join(ids, "doc_id")
    once = rows.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "label")).alias("_r"))
    return once.select("doc_id", "_r.text", "_r.lang", "_r.label")


def fitted(rows: DataFrame, fit: Callable[[list[dict]], object], order: tuple[str, str] = ("doc_id", "text")) -> object:
    """``fit`` of all ``rows``, a bounded sample, in one task of an executor; the driver only gets the model.

    The sample is put into order first, and of rows that repeat the first column the first counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, dict] = {}
        for r in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r[order[0]], r[order[1]] or "")):
            first.setdefault(r[order[0]], r)
        if first:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(list(first.values())))]})

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else fit([])
