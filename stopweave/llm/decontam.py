"""Benchmark decontamination by a distributed positional inverted index of the training text.

The index is partitioned by document. A *segment* is the index of a few megabytes of consecutive texts:
the sorted hashes of its terms, where each term's postings begin, and the postings, which are ascending
word positions in the segment. It holds every token of the corpus and is written once to the shared
folder. As all postings of a text are in one segment, phrases are matched where the segment lies and
nothing is shuffled; only matches leave it.

A phrase is looked up from its rarest term in the segment: the postings of that term, moved back by the
term's offset, are the possible starts. The lists of the other terms, from rare to frequent, are then
intersected with the starts moved forward by their offsets. Phrases are looked up all at once, level by
level. Test items come in blocks of ``BLOCK_BYTES`` of text, each broadcast by itself, so the broadcast is
bounded however many items there are.

Terms are compared by 64-bit hash. Nulls and ties: null and empty texts have no words and no matches;
items of null id or without words match nothing; repeated item ids count once; repeated documents are
reported once for each row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm import textvec as tv
from stopweave.llm.store import small_batches, stored

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Bytes of text in a segment, and of test items in a broadcast.
SEGMENT_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
#: Possible starts that are intersected at once.
AT_ONCE = 1 << 20

SEGMENT = "segment long, doc_ids array<long>, first binary, terms binary, begins binary, postings binary"
HITS = "segment long, ordinal int, words array<struct<begin:int,end:int>>, items array<string>"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, (rows, offsets, data) in enumerate(tv.runs(batches, limit=SEGMENT_BYTES)):
        words = tv.split_words(tv.LOWER[data], offsets, tv.ALNUM)
        hashes = words.hashes()
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        ranked = hashes[order]
        begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)]).astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {
                "segment": pa.array([(part << 33) + k], pa.int64()),
                "doc_ids": pa.array([rows.column(0).cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                "first": pa.array([words.first.astype(np.int32).tobytes()], pa.binary()),
                "terms": pa.array([ranked[begins].tobytes()], pa.binary()),
                "begins": pa.array([np.append(begins, np.int32(len(ranked))).tobytes()], pa.binary()),
                "postings": pa.array([order.tobytes()], pa.binary()),
            }
        )


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment; written to the shared folder, as what is found refers to it by segment and ordinal."""
    return stored(small_batches(docs).select("doc_id", "text").mapInArrow(_index, SEGMENT), "postings")


@dataclass
class Segment:
    first: np.ndarray
    terms: np.ndarray
    begins: np.ndarray
    postings: np.ndarray

    @staticmethod
    def read(row: dict) -> Segment:
        return Segment(
            np.frombuffer(row["first"], np.int32),
            np.frombuffer(row["terms"], np.uint64),
            np.frombuffer(row["begins"], np.int32),
            np.frombuffer(row["postings"], np.int32),
        )

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each term here (any, if it has none) and how often it occurs."""
        if not len(self.terms):
            return np.zeros(hashes.shape, np.int64), np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        df = (self.begins[at + 1] - self.begins[at]).astype(np.int64)
        return at, np.where(self.terms[at] == hashes, df, 0)

    def keys(self) -> np.ndarray:
        """(term, position) of all postings as ascending integers, to be searched."""
        numbers = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.begins))
        return (numbers << 32) | self.postings

    def phrases(self, terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of the phrases in rows of ``terms``: number of the phrase, first word."""
        found_q, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, df = self.lookup(terms)
        inside = np.arange(terms.shape[1]) < lengths[:, None]
        alive = np.flatnonzero((np.where(inside, df, 1) > 0).all(1) & (lengths > 0))
        if not len(alive):
            return found_q[0], found_s[0]
        at, df, lengths = at[alive], df[alive], lengths[alive]
        rarest = np.argsort(np.where(inside[alive], df, 1 << 40), axis=1, kind="stable")
        keys = self.keys()
        pick = np.arange(len(alive))
        counts = df[pick, rarest[:, 0]]
        cuts = np.searchsorted(np.cumsum(counts), np.arange(AT_ONCE, counts.sum() + AT_ONCE, AT_ONCE))
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(alive)], strict=True):
            n = counts[lo:hi]
            if not n.sum():
                continue
            q = np.repeat(pick[lo:hi], n)
            lead = rarest[q, 0]
            nth = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            start = self.postings[self.begins[at[q, lead]] + nth].astype(np.int64) - lead
            ok = start >= 0
            q, start = q[ok], start[ok]
            for level in range(1, terms.shape[1]):
                if not len(q):
                    break
                offset = rarest[q, level]
                want = (at[q, offset].astype(np.int64) << 32) | (start + offset)
                there = np.searchsorted(keys, want)
                ok = (level >= lengths[q]) | (keys[np.minimum(there, len(keys) - 1)] == want)
                q, start = q[ok], start[ok]
            # the first and the last word have to be in the same text
            text = np.searchsorted(self.first, start, "right")
            ok = start + lengths[q] <= self.first[np.minimum(text, len(self.first) - 1)]
            found_q.append(alive[q[ok]])
            found_s.append(start[ok])
        return np.concatenate(found_q), np.concatenate(found_s)

    def proximity(self, terms: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """Smallest stretches of at most len(terms) + slop words that hold all terms, in any order: first word, end."""
        want, need = np.unique(terms, return_counts=True)
        at, df = self.lookup(want)
        if not len(want) or (df < need).any():
            return []
        rare = np.argsort(df, kind="stable")
        places = [self.postings[self.begins[at[i]] : self.begins[at[i] + 1]].astype(np.int64) for i in rare]
        reach = len(terms) + slop
        near = places[0]
        for p, k in zip(places, need[rare], strict=True):  # drop what has too few of a term within reach
            n = np.searchsorted(p, near + reach) - np.searchsorted(p, near - reach, "right")
            near = near[n >= k]
        out = []
        for anchor in near:
            text = int(np.searchsorted(self.first, anchor, "right"))
            low, high = int(self.first[text - 1]), int(self.first[text])
            for begin in range(max(low, int(anchor) - reach + 1), int(anchor) + 1):
                end = begin
                for p, k in zip(places, need[rare], strict=True):
                    i = np.searchsorted(p, begin) + k - 1
                    end = max(end, int(p[i]) + 1) if i < len(p) else high + 1
                if end <= high and end - begin <= reach and any(p[np.searchsorted(p, begin)] == begin for p in places):
                    out.append((begin, end))
        return sorted(set(out))


@dataclass
class Block:
    """Phrases of some test items: hashes of all their words, and for each phrase its first word, length and item."""

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    ids: list[str]
    window: int

    @property
    def terms(self) -> np.ndarray:
        """A rectangle of term hashes, 0 beyond the end of short phrases."""
        places = np.arange(self.window)
        terms = self.words[self.starts[:, None] + places]
        terms[places >= self.lengths[:, None]] = 0
        return terms

    @staticmethod
    def of(items: Sequence[tuple[object, str]], window: int) -> Block:
        text = pa.array([t or "" for _, t in items], pa.large_string())
        offsets, data = tv.bytes_of(text)
        words = tv.split_words(tv.LOWER[data], offsets, tv.ALNUM)
        hashes = words.hashes()
        counts = words.counts
        whole = tv.gram_starts(words.first, window)
        short = np.flatnonzero((counts > 0) & (counts < window))
        item = np.searchsorted(words.first, whole, "right") - 1
        # of an item's equal phrases one; by two hashes of the phrase, as a loss would be one of a phrase
        names = [tv.gram_hashes(hashes, window, base)[whole] for base in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)] if len(whole) else []
        if len(whole):
            order = np.lexsort((*names, item))
            new = np.r_[True, (item[order][1:] != item[order][:-1]) | np.any([x[order][1:] != x[order][:-1] for x in names], axis=0)]
            whole, item = whole[order][new], item[order][new]
        starts = np.r_[whole, words.first[short]]
        lengths = np.r_[np.full(len(whole), window), counts[short]]
        padded = np.append(hashes, np.zeros(window, np.uint64))
        return Block(padded, starts, lengths, np.r_[item, short], [str(i) for i, _ in items], window)


def blocks(items: DataFrame, window: int) -> Iterator[Block]:
    """The items in blocks of about BLOCK_BYTES, one at a time on the driver."""
    known = items.select("item_id", "text").filter("item_id is not null and text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n):
        rows = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        if rows:
            yield Block.of([(r.item_id, r.text) for r in rows], window)


def phrase_hits(index: DataFrame, block: Block) -> DataFrame:
    """Texts with occurrences of the block's phrases: words hit, as ranges in the text, and the items' ids. Stored, so that
    the block's broadcast ends with it."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        terms = block.terms
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment.read(row)
                q, start = segment.phrases(terms, block.lengths)
                text = np.searchsorted(segment.first, start, "right") - 1
                out = []
                for t in np.unique(text):
                    mine = text == t
                    begin = start[mine] - segment.first[t]
                    end = begin + block.lengths[q[mine]]
                    spans = [{"begin": int(b), "end": int(e)} for b, e in _union(begin, end)]
                    names = sorted({block.ids[i] for i in np.unique(block.item[q[mine]])})
                    out.append({"segment": row["segment"], "ordinal": int(t), "words": spans, "items": names})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _HITS)

    found = stored(index.select("segment", "first", "terms", "begins", "postings").mapInArrow(match, HITS), "hits")
    shared.destroy()
    return found


_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_HITS = pa.schema(
    [("segment", pa.int64()), ("ordinal", pa.int32()), ("words", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))]
)


def _union(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Ranges merged where they overlap or touch."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]][: len(begin)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(begin) - 1] if len(begin) else []
    return list(zip(begin[new].tolist(), end[last].tolist(), strict=True))


def proximity_hits(index: DataFrame, terms: Sequence[str], slop: int) -> DataFrame:
    """Texts in which all terms stand within len(terms) + slop words, and where."""
    wanted = Block.of([("q", " ".join(terms))], 1).terms[:, 0]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment.read(row)
                out: dict[int, list] = {}
                for begin, end in segment.proximity(wanted, slop):
                    t = int(np.searchsorted(segment.first, begin, "right")) - 1
                    base = int(segment.first[t])
                    out.setdefault(t, []).append({"begin": begin - base, "end": end - base})
                rows = [{"segment": row["segment"], "ordinal": t, "words": w, "items": ["q"]} for t, w in out.items()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _HITS)

    found = index.select("segment", "first", "terms", "begins", "postings").mapInArrow(match, HITS)
    return found.join(_texts(index), ["segment", "ordinal"]).select("doc_id", "words")


def _texts(index: DataFrame) -> DataFrame:
    """segment, ordinal, doc_id and n_words of every indexed text."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.diff(np.frombuffer(row["first"], np.int32))
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([row["segment"]] * len(counts), pa.int64()),
                        "ordinal": pa.array(np.arange(len(counts), dtype=np.int32)),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "n_words": pa.array(counts.astype(np.int64)),
                    }
                )

    schema = "segment long, ordinal int, doc_id long, n_words long"
    return index.select("segment", "doc_ids", "first").mapInArrow(unpack, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, words (ranges that are hit), items, n_hit and contaminated of every document."""
    index = build_index(docs)
    found = None
    n = 0
    for block in blocks(items, window):
        hits = phrase_hits(index, block)
        found, n = hits if found is None else found.unionByName(hits), n + 1
    texts = _texts(index)
    if found is None:
        rows = texts.withColumn("words", F.array().cast("array<struct<begin:int,end:int>>"))
        rows = rows.withColumn("items", F.array().cast("array<string>"))
    else:
        if n > 1:  # an item is in one block only, a document may have hits in several
            found = found.groupBy("segment", "ordinal").agg(
                F.array_sort(F.flatten(F.collect_list("words"))).alias("words"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            )
        rows = texts.join(found, ["segment", "ordinal"], "left")
        rows = rows.withColumn("words", F.coalesce("words", F.array())).withColumn("items", F.coalesce("items", F.array()))
    # ranges ascend; those of several blocks may overlap, so each counts from where the last one ended
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    hit = F.aggregate(
        "words",
        start,
        lambda a, w: F.struct(
            (a["n"] + F.greatest(w["end"] - F.greatest(w["begin"], a["to"]), F.lit(0))).alias("n"),
            F.greatest(w["end"], a["to"]).alias("to"),
        ),
        lambda a: a["n"].cast("long"),
    )
    rows = rows.withColumn("n_hit", hit)
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))
    return rows.select("doc_id", "n_words", "words", "items", "n_hit", bad.alias("contaminated"))


def digest(rows: DataFrame) -> DataFrame:
    """The result of :func:`decontaminate` with lists turned to counts and a checksum."""
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def naive(docs: Sequence[tuple], items: Sequence[tuple], window: int = WINDOW) -> dict:
    """What :func:`decontaminate` finds, word by word; for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    phrases = []
    for i, t in items:
        w = split(t)
        if i is not None and w:
            phrases += [(str(i), w[k : k + window]) for k in range(max(1, len(w) - window + 1))]
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for name, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    names.add(name)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(names), sha, len(hit) > 0 and SHARE * len(hit) >= len(w))
    return out
