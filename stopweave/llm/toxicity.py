"""Toxicity by a convolutional text classifier, trained with numpy.

A word is the sum of two hashed embeddings, of the word and of its first bytes, so that inflected forms
share what they begin with. Filters of one, two and three words run over the whole text, each filter
keeps its maximum, and a logistic unit reads the maxima. Backpropagation only touches the words that won
a maximum. One dimension of each table starts as the smoothed log odds of its bucket, the rest at random.

Training uses every labelled document that may be learnt from. A fifth of them, by a hash of doc_id, is left out
and sets a threshold for each language (best F1; languages with too few labels share one); the log odds are
counted over all others. These are dealt by another hash into shards of about ``SHARD`` documents, each
packed into one row. In each of some rounds all shards train side by side from one network, and what they
changed is averaged: of a bucket's embedding over the shards that changed it. One shard trains in one go.
Language is read for the threshold only, never for the score. The driver holds one network at a time.

Scoring runs over the broadcast tables of every (width, tap) product, 9 MB at any size of input. Nulls and
ties: a null text is empty; an empty text scores the bias alone; with labels of one class only, or none,
every score is that class's smoothed share; a null language has the shared threshold.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stopweave.llm import textvec as tv
from stopweave.llm.labelled import held_out, label_counts, labelled
from stopweave.llm.store import forget, small_batches, stored

FOLDS, FOLD = 4, 2
#: Documents that are trained on in one task, about.
SHARD = 2000
THRESHOLD = 0.3
WORD_BUCKETS, STEM_BUCKETS, STEM_BYTES = 1 << 15, 1 << 14, 5
DIMS, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
EPOCHS, STEPS, BATCH, RATE = 6, 500, 64, 0.02
#: Times that shards are averaged, where there are some.
ROUNDS = 3
#: Labels of either class a language needs for a threshold of its own.
LEAST = 15


@dataclass
class Texts:
    """Bucket numbers of all words, and for text i its words first[i] .. first[i + 1]."""

    word: np.ndarray
    stem: np.ndarray
    first: np.ndarray

    def take(self, rows: np.ndarray) -> Texts:
        counts = np.diff(self.first)[rows]
        first = np.r_[0, np.cumsum(counts)]
        at = np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], counts)
        return Texts(self.word[at], self.stem[at], first)


def texts_of(data: np.ndarray, offsets: np.ndarray) -> Texts:
    words = tv.split_words(tv.LOWER[data], offsets, tv.ALNUM)
    return Texts(
        (words.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int32),
        (words.prefix_hashes(STEM_BYTES) % np.uint64(STEM_BUCKETS)).astype(np.int32),
        words.first,
    )


def gather(column: list[str | None]) -> Texts:
    parts, first = [], [0]
    batch = pa.RecordBatch.from_arrays([pa.array(column, pa.string())], ["text"])
    for _, offsets, data in tv.runs([batch]):
        part = texts_of(data, offsets)
        first.extend((part.first[1:] + first[-1]).tolist())
        parts.append(part)
    empty = [np.zeros(0, np.int32)]
    return Texts(np.concatenate([p.word for p in parts] or empty), np.concatenate([p.stem for p in parts] or empty), np.array(first))


@dataclass
class ConvNet:
    words: np.ndarray
    stems: np.ndarray
    taps: dict[tuple[int, int], np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @staticmethod
    def start(texts: Texts, labels: np.ndarray, seed: int = 0) -> ConvNet:
        return ConvNet.counted(bucket_counts(texts, labels), seed)

    @staticmethod
    def counted(counts: list[np.ndarray], seed: int = 0) -> ConvNet:
        """A network to start from, by :func:`bucket_counts`."""
        rng = np.random.default_rng(seed)
        share = counts[0][1] / counts[0][0]
        tables = []
        for hits, all_ in (counts[1:3], counts[3:5]):
            rate = (hits + 10 * share) / (all_ + 10)
            table = rng.normal(0, 0.1, (len(all_), DIMS)).astype(np.float32)
            table[:, 0] = np.log(rate / (1 - rate)) - np.log(share / (1 - share))
            tables.append(table)
        taps = {(w, k): rng.normal(0, 0.3, (DIMS, FILTERS)).astype(np.float32) for w in WIDTHS for k in range(w)}
        for tap in taps.values():
            tap[0] = np.abs(tap[0]) + 0.3
        bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        return ConvNet(*tables, taps, bias, out, float(np.log(share / (1 - share))))

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Both tables times every tap, side by side: what scoring looks up."""
        taps = np.concatenate([self.taps[w, k] for w in WIDTHS for k in range(w)], axis=1)
        return self.words @ taps, self.stems @ taps

    def pooled(self, texts: Texts, tables: tuple[np.ndarray, np.ndarray] | None = None, where: bool = False):
        words, stems = tables or self.products()
        x = np.ascontiguousarray((words[texts.word] + stems[texts.stem]).T)
        counts = np.diff(texts.first)
        full = np.flatnonzero(counts > 0)
        begins, ends = texts.first[full], texts.first[full + 1]
        pooled = np.zeros((FILTERS * len(WIDTHS), len(counts)), np.float32)
        winners = np.full(pooled.shape, -1, np.int64)
        col = 0
        for i, w in enumerate(WIDTHS if len(full) else ()):
            for f in range(FILTERS):
                z = x[col + f] + self.bias[w][f]
                for k in range(1, w):
                    part = x[col + k * FILTERS + f]
                    z[:-k] += part[k:]
                    for j in range(min(k, len(z))):  # not past the end of a text
                        over = ends - 1 - j
                        over = over[(over >= begins) & (over + k < len(z))]
                        z[over] -= part[over + k]
                top = np.maximum(np.maximum.reduceat(z, begins), 0)
                pooled[i * FILTERS + f, full] = top
                if where:  # the first word of each text that reaches its maximum, -1 where that is 0
                    at = np.flatnonzero((z == np.repeat(top, counts[full])) & (z > 0))[::-1]
                    winners[i * FILTERS + f, np.searchsorted(texts.first, at, "right") - 1] = at
            col += w * FILTERS
        return pooled.T, np.split(winners.T, len(WIDTHS), 1)

    def scores(self, texts: Texts, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        pooled, _ = self.pooled(texts, tables)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30).astype(np.float64)))

    def fit(self, texts: Texts, labels: np.ndarray, weights: np.ndarray, seed: int = 1, part: tuple[int, int] = (0, 1)) -> ConvNet:
        """Trained on; ``part`` (i, n): the i-th of n parts of the training, from 0."""
        rng = np.random.default_rng(seed)
        dense = [self.out, *self.taps.values(), *self.bias.values()]
        first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
        squares = [np.full(len(t), 1e-3, np.float32) for t in (self.words, self.stems)]
        step = 0
        epochs = max(EPOCHS, STEPS * BATCH // len(labels))  # small samples are gone over more often
        for epoch in range(epochs * part[0] // part[1], epochs * (part[0] + 1) // part[1]):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), BATCH):
                rows = order[lo : lo + BATCH]
                some, y, weight = texts.take(rows), labels[rows], weights[rows]
                # the whole product table is not worth making for a batch
                used = [np.unique(ids, return_inverse=True) for ids in (some.word, some.stem)]
                taps = np.concatenate([self.taps[w, k] for w in WIDTHS for k in range(w)], axis=1)
                local = Texts(used[0][1], used[1][1], some.first)
                pooled, winners = self.pooled(local, (self.words[used[0][0]] @ taps, self.stems[used[1][0]] @ taps), True)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30)))
                error = ((p - y) * weight / len(rows)).astype(np.float32)
                grads = [pooled.T @ error + 1e-5 * self.out]
                d_tap = {key: np.zeros_like(v) for key, v in self.taps.items()}
                d_bias = {}
                touched, deltas = [], []
                for i, w in enumerate(WIDTHS):
                    d = error[:, None] * self.out[i * FILTERS : (i + 1) * FILTERS]
                    d = np.where(winners[i] >= 0, d, 0)
                    d_bias[w] = d.sum(0)
                    r, f = np.nonzero((winners[i] >= 0) & (d != 0))
                    at, g = winners[i][r, f], d[r, f]
                    for k in range(w):
                        ok = at + k < some.first[r + 1]
                        t, ff, gg = at[ok] + k, f[ok], g[ok]
                        x = self.words[some.word[t]] + self.stems[some.stem[t]]
                        np.add.at(d_tap[w, k].T, ff, gg[:, None] * x)
                        touched.append(t)
                        deltas.append(gg[:, None] * self.taps[w, k].T[ff])
                grads += [*d_tap.values(), *d_bias.values()]
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for q, g, m, v in zip(dense, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                self.out_bias -= rate * float(np.clip(error.sum() * 10, -1, 1))
                t, delta = np.concatenate(touched), np.concatenate(deltas)
                for table, ids, sq in zip((self.words, self.stems), (some.word, some.stem), squares, strict=True):
                    rows_, back = np.unique(ids[t], return_inverse=True)
                    g = np.zeros((len(rows_), DIMS), np.float32)
                    np.add.at(g, back, delta)
                    sq[rows_] += (g * g).mean(1)
                    table[rows_] -= rate * g / np.sqrt(sq[rows_])[:, None]
        return self


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold of the best weighted F1, midway between the scores it lies between."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum((labels * weights)[order])
    f1 = 2 * hit / (np.cumsum(weights[order]) + (labels * weights).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(np.argmax(f1))
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


@dataclass
class Model:
    net: ConvNet | None
    constant: float
    thresholds: dict[str | None, float]


def bucket_counts(texts: Texts, labels: np.ndarray) -> list[np.ndarray]:
    """Numbers of texts and of those labelled 1; of both tables, in how many texts labelled 1, and in how many, a bucket is."""
    out = [np.array([len(labels), int((labels == 1).sum())])]
    text = np.repeat(np.arange(len(labels)), np.diff(texts.first))
    for ids, size in ((texts.word, WORD_BUCKETS), (texts.stem, STEM_BUCKETS)):
        once = np.unique(ids.astype(np.int64) * len(labels) + text)
        bucket, y = once // len(labels), labels[once % len(labels)]
        out += [np.bincount(bucket[y == 1], minlength=size), np.bincount(bucket, minlength=size)]
    return out


def changes(before: ConvNet, after: ConvNet, n: int) -> list[np.ndarray]:
    """What training on ``n`` texts has changed, as numbers that can be summed over shards for :func:`averaged`."""
    dense = lambda net: np.concatenate([x.ravel() for x in (net.out, *net.taps.values(), *net.bias.values(), np.array([net.out_bias]))])
    out = [np.array([n]), n * (dense(after) - dense(before)).astype(np.float64)]
    for old, new in ((before.words, after.words), (before.stems, after.stems)):
        out += [new - old, (new != old).any(1).astype(np.int32)]
    return out


def averaged(net: ConvNet, summed: list[np.ndarray]) -> ConvNet:
    (n,), dense, words, in_words, stems, in_stems = summed
    at = 0
    for x in (net.out, *net.taps.values(), *net.bias.values()):
        x += (dense[at : at + x.size] / n).reshape(x.shape)
        at += x.size
    net.out_bias += float(dense[at] / n)
    net.words += words / np.maximum(in_words, 1)[:, None]
    net.stems += stems / np.maximum(in_stems, 1)[:, None]
    return net


@dataclass
class Model:
    net: ConvNet | None
    constant: float
    thresholds: dict[str | None, float]


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, shard: int = SHARD) -> Model:
    learn = ~held_out(folds, fold)
    counts = label_counts(labels, "toxic", learn)
    zero, one = counts.get(0, 0), counts.get(1, 0)
    constant = Model(None, (one + 1) / (zero + one + 2), {None: 0.5})
    if not (zero and one):
        return constant
    rows = labelled(docs, labels, "toxic", learn, zero + one).withColumn("left", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0)
    rows = stored(rows, "labelled")
    there = {(r.left, r.label): r["count"] for r in rows.groupBy("left", "label").count().collect()}
    if len({y for _, y in there}) < 2:
        forget(rows)
        return constant
    apart = len(there) == 4  # both classes on both sides
    n = sum(c for (left, _), c in there.items() if not (apart and left))
    net = trained(rows.filter("not left") if apart else rows, max(1, round(n / shard)))
    scored = score(rows.filter("left") if apart else rows, Model(net, 0.0, {}))
    bins = scored.groupBy("lang", "label", F.round("score", 4).alias("s")).count().collect()
    forget(rows)
    return Model(net, 0.0, thresholds(bins))


def trained(rows: DataFrame, shards: int) -> ConvNet:
    """A network trained on all ``rows``: doc_id, text and label."""
    kinds = "shard int, label binary, word binary, stem binary, first binary"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = gather(table["text"].to_pylist())
        label = np.array(table["label"].to_pylist(), np.float32)
        packed = [x.tobytes() for x in (label, texts.word.astype(np.uint16), texts.stem.astype(np.uint16), texts.first.astype(np.int64))]
        names = ["shard", "label", "word", "stem", "first"]
        columns = [pa.array([table["shard"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)]
        return pa.Table.from_arrays(columns, names)

    def unpack(row: dict) -> tuple[Texts, np.ndarray]:
        word, stem = (np.frombuffer(row[c], np.uint16).astype(np.int32) for c in ("word", "stem"))
        return Texts(word, stem, np.frombuffer(row["first"], np.int64)), np.frombuffer(row["label"], np.float32)

    def summed(of: Callable[[int, Texts, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """Sums of what each shard makes; of many shards, first in groups of them."""

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    (row,) = batch.slice(n, 1).to_pylist()
                    made = pickle.dumps(of(row["shard"], *unpack(row)))
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([made], pa.binary())], ["shard", "made"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, least = [], None
            for shard, made in ((s.as_py(), m) for b in batches for s, m in zip(b.column(0), b.column(1), strict=True)):
                own = pickle.loads(made.as_py())
                total = [a + b for a, b in zip(total, own, strict=True)] if total else own
                least = shard if least is None else min(least, shard)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], ["shard", "made"])

        parts = packed.mapInArrow(make, "shard int, made binary")
        if shards > 3:
            parts = parts.repartition(math.isqrt(shards), "shard").mapInArrow(add, "shard int, made binary")
        (got,) = parts.repartition(1).mapInArrow(add, "shard int, made binary").collect()
        return pickle.loads(bytes(got.made))

    own = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")
    dealt = small_batches(rows).select("doc_id", "text", "label", own.alias("shard")).repartition(shards, "shard")
    packed = stored(dealt.groupBy("shard").applyInArrow(pack, kinds), "packed")
    net = ConvNet.counted(summed(lambda _, texts, labels: bucket_counts(texts, labels)))
    rounds = ROUNDS if shards > 1 else 1
    for k in range(rounds):
        sent = pickle.dumps(net)

        def go(shard: int, texts: Texts, labels: np.ndarray, k: int = k, sent: bytes = sent) -> list[np.ndarray]:
            after = pickle.loads(sent).fit(texts, labels, np.ones(len(labels)), 1 + shard * rounds + k, (k, rounds))
            return changes(pickle.loads(sent), after, len(labels))

        net = averaged(net, summed(go))
    forget(packed)
    return net


def thresholds(bins: list[Row]) -> dict[str | None, float]:
    """Of counts by lang, label and s, a rounded score: each language's threshold, and at None that of all."""
    s, ty, tw = (np.array([r[c] for r in bins], np.float64) for c in ("s", "label", "count"))
    tl = np.array([r["lang"] or "" for r in bins])
    found: dict[str | None, float] = {None: best_threshold(s, ty, tw)}
    for name in np.unique(tl):
        mine = tl == name
        ones = (ty * tw)[mine].sum()
        if name and min(ones, tw[mine].sum() - ones) >= LEAST:
            found[str(name)] = best_threshold(s[mine], ty[mine], tw[mine])
    return found


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and their score: 0 to 1, higher where toxicity is likelier; other columns are kept as they are."""
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    net, constant = model.net, model.constant
    shared = docs.sparkSession.sparkContext.broadcast((net, net.products()) if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, data in tv.runs(batches):
            if shared.value:
                net, tables = shared.value
                scores = net.scores(texts_of(data, offsets), tables)
            else:
                scores = np.full(rows.num_rows, constant)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores)], [*rows.schema.names, "score"])

    return small_batches(docs).mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, lang_threshold and toxic (score at or above the threshold of the row's language)."""
    own = {k: v for k, v in model.thresholds.items() if k is not None}
    shared = F.lit(model.thresholds[None])
    limit = shared
    for lang, value in own.items():
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    rows = score(docs, model).withColumn("lang_threshold", limit)
    return rows.withColumn("toxic", F.col("score") >= F.col("lang_threshold"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and what the language's threshold says, of every document."""
    model = train(docs, labels)
    rows = classify(docs.select("doc_id", "text", "lang"), model)
    return rows.select(
        "doc_id",
        held_out(FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "lang_threshold",
        "toxic",
    )
