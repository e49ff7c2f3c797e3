"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of ``BOOKS`` codewords, one of each codebook, all of full dimension. The
codebooks start as k-means of residuals on at most ``TRAIN`` vectors; then encoding and a joint least-squares
fit of all codewords alternate. Encoding is a beam search that keeps the ``BEAM`` best partial sums per book.

The index holds for every vector its codes, the squared norm of their sum and the vector itself. A search
scans it: inner products with codewords are looked up in a table per query and added, the best ``SHORT`` of
each batch are scored exactly in double precision, and a task keeps the best k it has seen. Queries come in
blocks of ``QUERIES``, each broadcast by itself; the last step ranks what tasks kept, k rows per query and task.

Nulls and ties: null, zero, ragged (of another than the commonest length) and not finite vectors and rows
without id are neither candidates nor queries. Equal scores rank by id, also on the shortlist, where equal
vectors have equal codes. Rows of the query's own id are not its candidates; other repeated rows each count,
and a repeated query asks with the smallest of its vectors.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopweave.llm import textvec as tv
from stopweave.llm.labelled import fitted
from stopweave.llm.store import small_batches, stored

BOOKS, WORDS, BEAM = 16, 256, 6
#: Vectors that codebooks are fitted on, at most.
TRAIN, ROUNDS = 8192, 1
#: Rows of a partition that are scored exactly for each query.
SHORT = 512
QUERIES, BATCH = 4096, 4096
QUERY_EVERY, K = 20, 20


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    v = F.col("embedding")
    good = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    length = good.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.filter(F.size(v) == (length.n if length else 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres


@dataclass
class Codebooks:
    """Codewords, one book after another; their inner products are made where they are needed and not sent along."""

    words: np.ndarray
    books: int

    @functools.cached_property
    def gram(self) -> np.ndarray:
        return (self.words @ self.words.T).astype(np.float32)

    def __getstate__(self) -> dict:
        return {"words": self.words, "books": self.books}

    @property
    def size(self) -> int:
        return len(self.words) // self.books

    @staticmethod
    def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 0) -> Codebooks:
        rng = np.random.default_rng(seed)
        words = max(1, min(words, len(x) // 4))
        rest, parts = x.astype(np.float64), []
        for _ in range(books):
            centres = _kmeans(rest, words, rng)
            own = np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, 1)
            rest = rest - centres[own]
            parts.append(centres)
        fitted = Codebooks(np.concatenate(parts), books)
        for _ in range(ROUNDS):
            codes = fitted.encode(x)
            at = (codes + np.arange(books) * words).ravel()
            pairs = np.zeros((books * words, books * words))
            flat = codes + np.arange(books) * words
            for i in range(books):
                for j in range(books):
                    np.add.at(pairs, (flat[:, i], flat[:, j]), 1)
            sums = np.zeros((books * words, x.shape[1]))
            np.add.at(sums, at, np.repeat(x, books, 0))
            pairs[np.diag_indices_from(pairs)] += 1e-2
            # kept near the last codewords where the sample says nothing
            fitted = Codebooks(np.linalg.solve(pairs, sums + 1e-2 * fitted.words), books)
        return fitted

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        out = np.zeros((len(x), self.books), np.int64)
        k = self.size
        norms = (self.words**2).sum(1)
        for lo in range(0, len(x), 128):
            part = x[lo : lo + 128]
            n = len(part)
            base = norms - 2 * part @ self.words.T
            codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
            for m in range(self.books):
                block = slice(m * k, (m + 1) * k)
                step = np.repeat(base[:, None, block], codes.shape[1], 1)
                for j in range(m):
                    step += 2 * self.gram[codes[:, :, j] + j * k, block]
                total = (cost[:, :, None] + step).reshape(n, -1)
                width = min(beam, total.shape[1])
                best = np.argpartition(total, width - 1, 1)[:, :width]
                from_, word = best // k, best % k
                codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None]], 2)
                cost = np.take_along_axis(total, best, 1)
            out[lo : lo + n] = codes[np.arange(n), np.argmin(cost, 1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.words[codes + np.arange(self.books) * self.size].sum(1)


INDEX = "vec_id long, codes binary, norm float, vector array<double>"


def build_index(rows: DataFrame) -> tuple[DataFrame, Codebooks | None]:
    """Codes, norms and vectors of all usable rows, in the shared folder, and the codebooks."""
    good = usable(small_batches(rows))
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN)
    books = fitted(drawn, lambda v: Codebooks.fit(np.array([r["vector"] for r in v])) if v else None, ("vec_id", "vector"))
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                distinct, back = np.unique(_matrix(part.column(1)), axis=0, return_inverse=True)
                codes = books.encode(distinct)
                norm = (books.decode(codes) ** 2).sum(1).astype(np.float32)
                codes = codes.astype(np.uint8)
                packed = pa.array([c.tobytes() for c in codes[back.ravel()]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), packed, pa.array(norm[back.ravel()]), part.column(1)],
                    ["vec_id", "codes", "norm", "vector"],
                )

    return stored(good.mapInArrow(encode, INDEX), "codes"), books


def _shortlist(approx: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Columns of each row's largest values; of equal values those of the smallest ids."""
    n = approx.shape[1]
    if n <= size:
        return np.tile(np.arange(n), (len(approx), 1))
    best = np.argpartition(approx, n - size, 1)[:, n - size :]
    least = np.take_along_axis(approx, best, 1).min(1)
    for q in np.flatnonzero((approx >= least[:, None]).sum(1) > size):
        above = np.flatnonzero(approx[q] > least[q])
        equal = np.flatnonzero(approx[q] == least[q])
        best[q] = np.r_[above, equal[np.argsort(ids[q, equal], kind="stable")[: size - len(above)]]]
    return best


def _scan(books: Codebooks, ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
    """The k best rows of a partition for each query: those that score best by their codes are kept over all of its
    batches, and their vectors with them; at its end these, and no others, are scored exactly."""
    table = (queries @ books.words.T).astype(np.float32)
    n, size = len(ids), SHORT
    blocks = [slice(at, at + 256) for at in range(0, n, 256)]

    def scored(codes: np.ndarray, norm: np.ndarray, rows: slice) -> np.ndarray:
        approx = table[rows][:, codes[:, 0]]
        for m in range(1, books.books):
            approx += table[rows][:, codes[:, m]]
        return 2 * approx - norm if metric == "l2" else approx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held = np.zeros(0, np.int64), None
        top_s, top_i = np.zeros((n, 0), np.float32), np.zeros((n, 0), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                vec_id, vectors = part.column(0).to_numpy(), _matrix(part.column(3))
                _, data = tv.bytes_of(part.column(1))
                codes = data.reshape(len(vec_id), -1) + np.arange(books.books) * books.size
                norm = part.column(2).to_numpy()
                held_id = np.r_[held_id, vec_id]
                held = vectors if held is None else np.concatenate([held, vectors])
                new = np.arange(len(held_id) - len(vec_id), len(held_id))
                best_s, best_i = [], []
                for rows in blocks:
                    approx = scored(codes, norm, rows)
                    approx[ids[rows, None] == vec_id] = -np.inf
                    s = np.concatenate([top_s[rows], approx], 1)
                    i = np.concatenate([top_i[rows], np.broadcast_to(new, approx.shape)], 1)
                    keep = _shortlist(s, held_id[i], size)
                    best_s.append(np.take_along_axis(s, keep, 1))
                    best_i.append(np.take_along_axis(i, keep, 1))
                top_s, top_i = np.concatenate(best_s), np.concatenate(best_i)
                used = np.zeros(len(held_id), bool)
                used[top_i] = True
                held_id, held, top_i = held_id[used], held[used], (np.cumsum(used) - 1)[top_i]
        if held is None:
            return
        for rows in blocks:
            near, vec_id = held[top_i[rows]], held_id[top_i[rows]]
            exact = np.einsum("qrd,qd->qr", near, queries[rows])
            if metric == "l2":
                exact = 2 * exact - (near**2).sum(2) - (queries[rows] ** 2).sum(1)[:, None]
            exact[top_s[rows] == -np.inf] = -np.inf
            keep = np.lexsort((vec_id, -exact))[:, :k]
            s, i = np.take_along_axis(exact, keep, 1), np.take_along_axis(vec_id, keep, 1)
            found = np.isfinite(s)
            query = np.broadcast_to(ids[rows, None], s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(query[found]), pa.array(i[found]), pa.array(s[found])], ["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = K, metric: str = "ip") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of the index for each of ``queries`` (vec_id, vector)."""
    spark = index.sparkSession
    schema = "query_id long, vec_id long, score double"
    n = queries.count() if books else 0
    blocks = math.ceil(n / QUERIES)
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        ids, vectors = np.array([r.vec_id for r in block], np.int64), np.array([r.vector for r in block])
        shared = spark.sparkContext.broadcast((books, ids, vectors))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books, ids, vectors = shared.value
            if len(ids):
                yield from _scan(books, ids, vectors, k, metric)(batches)

        part = index.mapInArrow(scan, schema)
        found = found.unionByName(stored(part, "near") if blocks > 4 else part)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """The k nearest rows for each row whose id is divisible by ``every``."""
    index, books = build_index(rows)
    queries = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return search(index, books, queries, k)
