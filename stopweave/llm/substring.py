"""Substring dedup: a count-min prefilter, then exact grouping of the windows it lets through.

Texts are first written to the shared folder as *segments*, some megabytes of compressed text each.

1. Every segment counts its windows of ``WINDOW`` words in a count-min sketch of ``DEPTH`` rows, as wide
   as ``CELLS`` cells for each window of the corpus. A sketch is cut into shards (ranges of cells), each
   written sparsely as the gaps between its cells that are not zero, and shards are merged by range.
   Merged counts are never below the windows' own. The merge answers each segment with one bit for each
   cell it sent: whether that cell's count is two or more.
2. A window all of whose cells have that bit may be repeated. Only those are sent on, as 96-bit hashes
   without positions, grouped exactly by hash range, and answered with one bit each in the order sent.
3. The segment marks the words that repeated windows cover and writes what is left.

A hot window costs one entry for each segment it is in, not one for each occurrence; all shards are
about ``SHARD`` entries. The sketch is never broadcast or collected, and it grows with the corpus.
The text moves once: segments are exchanged by number, and both later steps read that exchange.

Nulls and ties: a null or empty text has no words; repeated rows are documents of their own, so all
their windows are repeats; a window that overlaps its own repeat counts like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm import textvec as tv
from stopweave.llm.store import small_batches, stored

WINDOW = 35
DEPTH = 2
#: Cells of a sketch row for each window of the corpus.
CELLS = 8
#: Windows of the corpus for each shard.
SHARD = 4 << 20
SEGMENT_BYTES = 12 << 20

SEGMENTS = "segment long, n_windows long, doc_ids array<long>, offsets binary, text binary"
ASKED = "step int, shard long, segment long, n long, cells binary"
ANSWER = "segment long, step int, shard long, n long, bits binary"
_ASKED = pa.schema([("step", pa.int32()), ("shard", pa.int64()), ("segment", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())])
_ANSWER = pa.schema([("segment", pa.int64()), ("step", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


def gaps(values: np.ndarray) -> bytes:
    """Ascending integers as the differences between them, seven bits a byte, the last byte's high bit set."""
    d = np.diff(values.astype(np.int64), prepend=0)
    size = np.ones(len(d), np.int64)
    for k in range(1, 9):
        more = d >> (7 * k) > 0
        if not more.any():
            break
        size += more
    last = np.cumsum(size)
    out = np.empty(int(last[-1]) if len(last) else 0, np.uint8)
    at, left = last - size, d
    live = np.arange(len(d))
    while len(live):
        final = size[live] == 1
        out[at[live]] = (left[live] & 127) | (final.astype(np.int64) << 7)
        at[live] += 1
        left[live] >>= 7
        size[live] -= 1
        live = live[~final]
    return out.tobytes()


def ungaps(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b >= 128)
    begins = np.r_[0, ends[:-1] + 1]
    nth = np.arange(len(b)) - np.repeat(begins, ends - begins + 1)
    return np.cumsum(np.add.reduceat((b & 127).astype(np.int64) << (7 * nth), begins))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, pack = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
    held: list[tuple] = []
    size = number = 0

    def flush() -> pa.RecordBatch:
        lengths = np.concatenate([np.diff(o) for _, o, _, _ in held]).astype(np.int32)
        return pa.RecordBatch.from_pydict(
            {
                "segment": pa.array([(part << 33) + number], pa.int64()),
                "n_windows": pa.array([sum(n for *_, n in held)], pa.int64()),
                "doc_ids": pa.array([sum((i for i, *_ in held), [])], pa.list_(pa.int64())),
                "offsets": pa.array([lengths.tobytes()], pa.binary()),
                "text": pa.array([pack.compress(b"".join(d for _, _, d, _ in held))], pa.binary()),
            }
        )

    for rows, offsets, data in tv.runs(batches):
        counts = tv.split_words(data, offsets, tv.NOT_BLANK).counts
        n = int(np.maximum(counts - WINDOW + 1, 0).sum())
        held.append((rows.column(0).cast(pa.int64()).to_pylist(), offsets, data.tobytes(), n))
        size += len(data)
        if size >= SEGMENT_BYTES:
            yield flush()
            held, size, number = [], 0, number + 1
    if held:
        yield flush()


class Segment:
    """Words of a segment, and the 64-bit hashes of its windows."""

    def __init__(self, doc_ids: list, offsets: bytes, text: bytes) -> None:
        self.doc_ids = doc_ids
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        ends = np.r_[0, np.cumsum(np.frombuffer(offsets, np.int32), dtype=np.int64)]
        self.runs: list[tuple[int, int, tv.Words]] = []
        hashes, starts, self.n_words = [], [], 0
        row = 0
        while row < len(doc_ids):
            to = int(np.searchsorted(ends, ends[row] + tv.CHUNK_BYTES, "right")) - 1
            to = min(max(to, row + 1), len(doc_ids))
            words = tv.split_words(data[ends[row] : ends[to]], ends[row : to + 1] - ends[row], tv.NOT_BLANK)
            hashes.append(words.hashes())
            del words._sums, words._back
            starts.append(self.n_words + tv.gram_starts(words.first, WINDOW))
            self.runs.append((row, to, words))
            self.n_words += len(words.start)
            row = to
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)

    def windows(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return tv.gram_hashes(self.words, WINDOW, 0xD6E8FEB86659FD93)[self.starts]

    def more(self) -> np.ndarray:
        """32 further bits of each window's hash, from another polynomial over other hashes of the words."""
        if not len(self.starts):
            return np.zeros(0, np.uint32)
        h = tv.gram_hashes(tv.mix(self.words ^ np.uint64(0xA5A5A5A5)), WINDOW, 0xC2B2AE3D27D4EB4F)
        return (h[self.starts] >> np.uint64(32)).astype(np.uint32)


def _cells(windows: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    return (tv.mix(windows ^ np.uint64(0x51ED270B + row)) >> np.uint64(64 - width_bits)).astype(np.int64)


def _cut(sorted_cells: np.ndarray, shard_bits: int) -> Iterator[tuple[int, int, int]]:
    """Shards of ascending cells: number, and their range in the array."""
    shards = sorted_cells >> shard_bits
    cuts = np.flatnonzero(np.diff(shards, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(shards))[: len(cuts)], strict=True):
        yield int(shards[a]), int(a), int(b)


def _twice(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and whether each is there more than once."""
    if not len(sorted_values):
        return sorted_values, np.zeros(0, bool)
    new = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return sorted_values[new], np.diff(np.append(new, len(sorted_values))) > 1


def _shape(n_windows: int) -> tuple[int, int]:
    """Bits of a cell's number and of its number in its shard."""
    width = max(16, math.ceil(math.log2(max(1, n_windows * CELLS))))
    return width, max(10, width - max(0, math.ceil(math.log2(max(1, n_windows / SHARD)))))


def _sketches(segments: DataFrame, width: int, shard_bits: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                windows = Segment(row["doc_ids"], row["offsets"], row["text"]).windows()
                for depth in range(DEPTH):
                    cells, twice = _twice(np.sort(_cells(windows, depth, width)))
                    out = {k: [] for k in _ASKED.names}
                    for shard, a, b in _cut(cells, shard_bits):
                        # a count of two or more in the segment is all that the merge needs to know
                        sent = gaps(((cells[a:b] - (shard << shard_bits)) << 1) | twice[a:b])
                        for k, v in zip(_ASKED.names, (depth, shard, row["segment"], b - a, sent), strict=True):
                            out[k].append(v)
                    yield pa.RecordBatch.from_pydict(out, _ASKED)

    return segments.select("segment", "doc_ids", "offsets", "text").mapInArrow(ask, ASKED)


def _merge_sketches(table: pa.Table) -> pa.Table:
    parts = [ungaps(x.as_py()) for x in table["cells"]]
    cells = [p >> 1 for p in parts]
    merged = np.sort(np.concatenate(cells + [p[(p & 1) == 1] >> 1 for p in parts]))
    full, twice = _twice(merged)
    full = np.append(full[twice], np.int64(1) << 62)
    bits = [np.packbits(full[np.searchsorted(full, c)] == c).tobytes() for c in cells]
    return pa.table({"segment": table["segment"], "step": table["step"], "shard": table["shard"], "n": table["n"], "bits": bits}, _ANSWER)


def _answers(table: pa.Table, step: int) -> np.ndarray:
    """The bits of one step for a segment, in the order of the values it asked about."""
    rows = sorted(
        (s, n, b)
        for t, s, n, b in zip(*(table[k].to_pylist() for k in ("step", "shard", "n", "bits")), strict=True)
        if t == step
    )
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in rows]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _candidates(windows: np.ndarray, answers: pa.Table, width: int) -> np.ndarray:
    """Numbers of the windows that all rows of the merged sketch count twice or more."""
    maybe = np.ones(len(windows), bool)
    bits = max(1, len(windows).bit_length())
    for depth in range(DEPTH):
        cells = _cells(windows, depth, width)
        if width + bits < 64:  # cell and place in one number sort several times faster than an argsort
            ranked = np.sort((cells << bits) | np.arange(len(cells)))
            order, ranked = ranked & ((1 << bits) - 1), ranked >> bits
        else:
            order = np.argsort(cells)
            ranked = cells[order]
        rank = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)]) - 1
        maybe[order[~_answers(answers, depth)[rank]]] = False
    return np.flatnonzero(maybe)


def _ranked(windows: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the 96-bit hashes, and where in that order a new one begins."""
    order = np.argsort(windows)
    w, m = windows[order], more[order]
    same = w[1:] == w[:-1]
    if (same & (m[1:] != m[:-1])).any():  # two windows that share 64 bits
        order = np.lexsort((more, windows))
        w, m = windows[order], more[order]
        same = w[1:] == w[:-1]
    return order, np.r_[True, ~same | (m[1:] != m[:-1])][: len(order)]


_HASH = np.dtype([("h", np.uint64), ("m", np.uint32), ("twice", np.uint8)])
EXACT = DEPTH


def _ask_exact(width: int, shards: int):
    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in _ASKED.names}
        for row in left.to_pylist():
            segment = Segment(row["doc_ids"], row["offsets"], row["text"])
            windows = segment.windows()
            maybe = _candidates(windows, right, width)
            w, m = windows[maybe], segment.more()[maybe]
            order, new = _ranked(w, m)
            begins = np.flatnonzero(new)
            sent = np.zeros(len(begins), _HASH)
            sent["h"], sent["m"] = w[order[begins]], m[order[begins]]
            sent["twice"] = np.diff(np.append(begins, len(order))) > 1
            cuts = np.searchsorted(sent["h"], np.array([(s << 64) // shards for s in range(1, shards)], np.uint64))
            for s, (a, b) in enumerate(zip(np.r_[0, cuts], np.r_[cuts, len(sent)], strict=True)):
                if b > a:
                    packed = sent[a:b]["h"].tobytes() + sent[a:b]["m"].tobytes() + np.packbits(sent[a:b]["twice"]).tobytes()
                    for k, v in zip(_ASKED.names, (EXACT, s, row["segment"], b - a, packed), strict=True):
                        out[k].append(v)
        return pa.table(out, _ASKED)

    return ask


def _group_exact(table: pa.Table) -> pa.Table:
    sizes = table["n"].to_pylist()
    blobs = table["cells"].to_pylist()
    h = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blobs, sizes, strict=True)])
    m = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
    own = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -1, 12 * n), count=n) for b, n in zip(blobs, sizes, strict=True)])
    order, new = _ranked(h, m)
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(order)))
    repeated = (counts > 1) | (np.maximum.reduceat(own[order], begins) > 0)
    answer = np.empty(len(order), bool)
    answer[order] = np.repeat(repeated, counts)
    bits = [np.packbits(x).tobytes() for x in np.split(answer, np.cumsum(sizes)[:-1])]
    return pa.table({"segment": table["segment"], "step": table["step"], "shard": table["shard"], "n": table["n"], "bits": bits}, _ANSWER)


RESULT = "doc_id long, n_words long, n_removed long, kept string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _finish(width: int):
    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        batches = []
        for row in left.to_pylist():
            segment = Segment(row["doc_ids"], row["offsets"], row["text"])
            windows = segment.windows()
            maybe = _candidates(windows, right, width)
            order, new = _ranked(windows[maybe], segment.more()[maybe])
            repeated = np.zeros(len(maybe), bool)
            repeated[order] = _answers(right, EXACT)[np.cumsum(new) - 1] if len(order) else False
            gone = tv.covered(segment.starts[maybe[repeated]], WINDOW, segment.n_words)
            at = 0
            for begin, end, words in segment.runs:
                n = len(words.start)
                batches.append(_left(words, gone[at : at + n], segment.doc_ids[begin:end]))
                at += n
        return pa.Table.from_batches(batches, _RESULT)

    return finish


def _left(words: tv.Words, gone: np.ndarray, doc_ids: list) -> pa.RecordBatch:
    """The words that are not gone, joined by one space, of a run of texts."""
    kept = np.flatnonzero(~gone)
    text = words.text_of()[kept]
    joined = np.r_[text[1:] == text[:-1], False][: len(kept)]  # whether a word follows in the same text
    data = np.append(words.data, np.uint8(0))
    data[words.end[kept[joined]]] = 0x20
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, words.start[kept], 1)
    np.add.at(step, words.end[kept] + joined, -1)
    mask = np.cumsum(step[:-1]) > 0
    sizes = np.bincount(text, words.end[kept] + joined - words.start[kept], len(doc_ids)).astype(np.int64)
    removed = np.bincount(words.text_of()[gone], minlength=len(doc_ids))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array(words.counts.astype(np.int64)),
            pa.array(removed.astype(np.int64)),
            tv.strings(data[mask], np.r_[0, np.cumsum(sizes)]),
        ],
        schema=_RESULT,
    )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the text that is left) of every document."""
    segments = stored(small_batches(docs).select("doc_id", "text").mapInArrow(_segments, SEGMENTS), "segments", "uncompressed")
    n = segments.agg(F.sum("n_windows")).first()[0] or 0
    width, shard_bits = _shape(n)
    asked = _sketches(segments, width, shard_bits)
    sketch = stored(asked.groupBy("step", "shard").applyInArrow(_merge_sketches, ANSWER), "sketch")
    texts = segments.select("segment", "doc_ids", "offsets", "text")
    shards = max(1, math.ceil(n / SHARD))
    exact = (
        texts.groupBy("segment").cogroup(sketch.groupBy("segment")).applyInArrow(_ask_exact(width, shards), ASKED)
        .groupBy("step", "shard").applyInArrow(_group_exact, ANSWER)
    )
    answers = sketch.unionByName(exact)
    return texts.groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(_finish(width), RESULT)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def naive(texts: list) -> list[tuple[int, int, str]]:
    """n_words, n_removed and the kept text of each, window by window; for tests."""
    import re
    from collections import Counter

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + WINDOW]) for w in split for i in range(len(w) - WINDOW + 1))
    out = []
    for w in split:
        gone: set[int] = set()
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                gone |= set(range(i, i + WINDOW))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
