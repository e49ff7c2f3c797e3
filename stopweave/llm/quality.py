"""Quality by positive-unlabelled learning: trusted positives against unlabelled web text.

A text becomes ``FEATURES`` numbers that say how it is written, not what about: shares of kinds of
characters, of capitals, of repeated words and pairs of words, lengths of words and lines. A network of one
hidden layer minimises the non-negative unbiased risk

    prior * E_P[loss(f, +)] + max(0, E_U[loss(f, -)] - prior * E_P[loss(f, -)])

with logistic loss, so its output is the probability of quality in unlabelled text. When the second term of
a batch falls below zero, the step goes against it instead, which is what keeps the network from fitting
unlabelled positives as negatives. The prior is the smallest ratio of P(g >= t) among unlabelled texts to
that among positives, over thresholds t of a first network g that tells the two samples apart, on texts it
was not fitted on.

Trusted positives are rows labelled 1 outside the held-out fold; rows labelled 0 are not used. Unlabelled
texts are documents without any label. Of either, at most ``SAMPLE`` are taken, by a hash of their id, and
only their features are collected. Nulls and ties: a null text is empty and gets a score like any other;
without positives or without unlabelled texts all scores are the prior, 0.5. A document that is labelled both 0 and
1 is a trusted positive. Rows without doc_id are never learnt from and get a score; rows that repeat a doc_id get one
score each, and of their texts the one of the smallest features is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm import textvec as tv
from stopweave.llm.labelled import held_out
from stopweave.llm.store import small_batches

FOLDS, FOLD = 5, 0
#: Positives, and unlabelled texts, that a model is fitted on, at most.
SAMPLE = 10_000
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 256, 0.005, 1e-4

_KINDS = ("upper", "lower", "digit", "space", "line", "stop", "mark", "bar", "symbol", "other")
_CLASS = np.full(256, 8, np.uint8)
for _k, _b in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\v\f", b"\n", b".,;:'\"-()", b"!?", b"|")):
    _CLASS[list(_b)] = _k
_CLASS[128:] = 9
FEATURES = len(_KINDS) + 12


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text of a run."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, FEATURES))
    kind = _CLASS[data]
    place = np.repeat(np.arange(n) * len(_KINDS), sizes) + kind
    counts = np.bincount(place, minlength=n * len(_KINDS)).reshape(n, len(_KINDS))
    out[:, : len(_KINDS)] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    words = tv.split_words(tv.LOWER[data], offsets, tv.NOT_BLANK)
    n_words, text, hashes = words.counts, words.text_of(), words.hashes()
    length = words.end - words.start
    per_word = np.maximum(n_words, 1)
    mean = lambda x: np.bincount(text, x, n)[:n] / per_word
    ups = np.r_[0, np.cumsum(kind == 0)]
    capital = (ups[words.end] - ups[words.start]) >= 2
    pair_in = text[1:] == text[:-1]
    same = np.zeros(len(text))
    same[1:] = (hashes[1:] == hashes[:-1]) & pair_in
    pairs = tv.gram_hashes(hashes, 2, 0x9E3779B97F4A7C15)[pair_in]
    last = kind[words.end - 1] if len(text) else kind[:0]
    more = (
        np.log1p(n_words),
        np.log1p(mean(length)),
        np.log1p(np.sqrt(np.maximum(mean(length.astype(float) ** 2) - mean(length) ** 2, 0))),
        mean(capital),
        mean(same),
        mean((last == 8) | (last == 7)),
        mean(last == 6),
        mean(length <= 3),
        _distinct(hashes, text, n),
        _distinct(pairs, text[1:][pair_in], n),
        np.log1p(counts[:, 4] / per_word * 100),
        n_words == 0,
    )
    out[:, len(_KINDS) :] = np.stack(more, 1)
    return out


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Share of distinct values in each text; 1 where it has none."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])][: len(v)]
    total = np.bincount(text, minlength=n)
    return np.where(total > 0, np.bincount(t[new], minlength=n) / np.maximum(total, 1), 1)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]

    @staticmethod
    def start(x: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        hidden = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN))
        out = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        return Network(x.mean(0), x.std(0) + 1e-3, [hidden, np.zeros(HIDDEN), out, np.zeros(1)])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.params[0] + self.params[1])
        return h @ self.params[2] + self.params[3][0], (z, h)

    def backward(self, state: tuple, d: np.ndarray) -> list[np.ndarray]:
        z, h = state
        inner = d[:, None] * self.params[2] * (1 - h * h)
        return [z.T @ inner, inner.sum(0), h.T @ d, np.array([d.sum()])]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[0], -30, 30)))


def _fit(net: Network, positive: np.ndarray, unlabelled: np.ndarray, gradients, seed: int) -> Network:
    """Adam over batches that hold positives and unlabelled texts in the samples' proportion."""
    rng = np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params], 0
    batches = max(1, (len(positive) + len(unlabelled)) // BATCH)
    for epoch in range(EPOCHS):
        parts = zip(
            np.array_split(rng.permutation(len(positive)), batches),
            np.array_split(rng.permutation(len(unlabelled)), batches),
            strict=True,
        )
        rate = RATE * (1 - epoch / EPOCHS)
        for p, u in parts:
            if not (len(p) and len(u)):
                continue
            f, state = net.forward(np.r_[positive[p], unlabelled[u]])
            grads = net.backward(state, gradients(f[: len(p)], f[len(p) :]))
            step += 1
            for q, g, m, v in zip(net.params, grads, first, second, strict=True):
                g = g + DECAY * q
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


_sigmoid = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def non_negative(prior: float):
    """Gradient of the non-negative risk of a batch with respect to the outputs for P and for U."""

    def gradients(fp: np.ndarray, fu: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(fp), _sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= 0:
            return np.r_[prior * (sp - 1) / len(fp) - prior * sp / len(fp), su / len(fu)]
        return np.r_[prior * sp / len(fp), -su / len(fu)]

    return gradients


def apart(fp: np.ndarray, fu: np.ndarray) -> np.ndarray:
    """Gradient of the logistic loss of telling P from U, both of equal weight."""
    return np.r_[(_sigmoid(fp) - 1) / len(fp), _sigmoid(fu) / len(fu)]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled texts, from halves of both samples."""
    net = Network.start(np.r_[positive, unlabelled], 3)
    _fit(net, positive[::2], unlabelled[::2], apart, 4)
    p, u = np.sort(net.scores(positive[1::2])), np.sort(net.scores(unlabelled[1::2]))
    if not (len(p) and len(u)):
        return 0.5
    limits = np.quantile(p, np.linspace(0, 0.6, 61))
    above = lambda s: 1 - np.searchsorted(s, limits) / len(s)
    ratio = (above(u) + 1 / len(u)) / above(p)
    return float(np.clip(ratio.min(), 0.05, 0.98))


@dataclass
class Model:
    net: Network | None
    prior: float


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(None, 0.5)
    prior = class_prior(positive, unlabelled)
    net = Network.start(unlabelled, 1)
    net.params[3][0] = np.log(prior / (1 - prior))
    return Model(_fit(net, positive, unlabelled, non_negative(prior), 2), prior)


def _matrix(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents with these ids (a bounded number, so they are broadcast), ascending by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, data in tv.runs(batches):
            x = features(data, offsets)
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), values], ["doc_id", "x"])

    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = rows.mapInArrow(run, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    return np.array([r.x for r in sorted(found)] or np.zeros((0, FEATURES)))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, sample: int = SAMPLE) -> Model:
    order = F.xxhash64("doc_id", F.lit(0))
    trusted = labels.filter((F.col("quality") == 1) & ~held_out(folds, fold)).select("doc_id").distinct()
    others = docs.select("doc_id").distinct().join(labels.select("doc_id"), "doc_id", "left_anti")
    draw = lambda ids: ids.filter("doc_id is not null").orderBy(order, "doc_id").limit(sample)
    return fit(_matrix(docs, draw(trusted)), _matrix(docs, draw(others)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document: the probability of quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, prior = shared.value.net, shared.value.prior
        for rows, offsets, data in tv.runs(batches):
            s = net.scores(features(data, offsets)) if net else np.full(rows.num_rows, prior)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(s)], ["doc_id", "score"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = score(docs, train(docs, labels))
    return rows.select(
        "doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
