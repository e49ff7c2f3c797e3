"""MinHash near-dedup with SuperMinHash signatures.

1. *Sign.* A document's set holds the hashes of its distinct shingles of ``SHINGLE`` words. Each element of
   the set is given a random permutation of the ``M`` signature places; rank j with a random fraction is
   its value at the j-th place of its permutation, and the signature keeps the minimum at each place. All
   elements take their ranks level by level, and a document stops at the first level that cannot lower any
   minimum (early stopping). Documents of equal sets form a class, a node of the graph; only classes go on.
2. *Band.* ``M / ROWS`` bands of ``ROWS`` places; classes that share a band are candidates. At a similarity
   of 0.75 a pair has a band in common with probability 1 - 5e-6.
3. *Hubs.* A bucket's hub is its most central member: the one whose buckets are the largest. Each member picks
   the hub it shares most bands with, and the pair is verified on the full sets. One round is for all buckets;
   of those that are still larger than a block and hold several components, ``HUB_ROUNDS`` - 1 more.
4. *Blocks.* What is left of buckets that hold several components is cut into blocks, and pairs of blocks are
   compared by signature, each pair of members in the first band it shares only. Members with a partner that
   agrees in ``MAYBE`` of the places (at a similarity of 0.75 fewer agree with probability 5e-6) meet again
   with their full sets; a task verifies the likeliest pairs first, skips those that its union-find has joined,
   and returns the links that joined, fewer than it has members. No pair that is no link leaves a task.
   So every pair in a bucket is linked, in one component already, or refuted.
5. *Group.* Partitions first reduce their links by union-find to forests; then large-star and small-star
   steps alternate until every node points at the smallest of its component.

Hubs of many members are salted, and every other join key is a bucket, a class or a node that AQE may split.
Nulls and ties: a text without words (null, empty) has the empty set and is linked with nothing. Nodes are texts,
so rows that repeat a doc_id with another text are judged by their text, and rows without doc_id are linked
like others: their component's smallest doc_id, if it has one, is their component_id. Equal rows share class
and component. Tables that only a step needs are deleted after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopweave.llm import textvec as tv
from stopweave.llm.store import beside, forget, let_through, small_batches, stored

SHINGLE = 5
#: Linked if COMMON[0] * size of the intersection >= COMMON[1] * size of the union.
COMMON = (100, 75)
M, ROWS = 128, 4
HUB_ROUNDS = 3
MAYBE = 0.58
#: Members of a block and bytes of their sets, members of a hub for each salt.
BLOCK, BLOCK_BYTES, HUB_SALT = 1024, 4 << 20, 200
#: Rows with signatures, and bytes of sets, that a task compares at once.
GROUP_ROWS, GROUP_BYTES = 20_000, 16 << 20
_FRACTION = 25  # bits of a value below its rank


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each text, and where the texts' begin."""
    words = tv.split_words(tv.LOWER[data], offsets, tv.NOT_BLANK)
    counts = words.counts
    hashes = words.hashes()
    starts = tv.gram_starts(words.first, SHINGLE)
    grams = tv.gram_hashes(hashes, SHINGLE, 0xBF58476D1CE4E5B9)[starts] if len(starts) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - SHINGLE + 1, 0))
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            ok = counts[short] > k
            h[ok] = tv.mix(h[ok] * np.uint64(0x9E3779B97F4A7C15) + hashes[words.first[short[ok]] + k] + np.uint64(k))
        grams, text = np.r_[grams, h], np.r_[text, short]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])][: len(grams)]
    return grams[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set: rank, then fraction, in 32 bits; an empty set has the largest value everywhere."""
    n = len(first) - 1
    out = np.full(n * M, np.iinfo(np.uint32).max, np.uint32)
    text = np.repeat(np.arange(n), np.diff(first))
    h, places = sets, None
    for level in range(M):
        x = tv.mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = level + (((x & np.uint64(0x7FFFFFFF)) * np.uint64(M - level)) >> np.uint64(31)).astype(np.int64)
        if places is None:
            place = pick
        else:
            row = np.arange(len(h))
            place = places[row, pick].astype(np.int64)
            places[row, pick] = places[row, level]
        value = (x >> np.uint64(64 - _FRACTION)).astype(np.uint32) | np.uint32(level << _FRACTION)
        np.minimum.at(out, text * M + place, value)
        open_ = np.unique(text)
        open_ = open_[out.reshape(n, M)[open_].max(1) >= np.uint64(level + 1) << np.uint64(_FRACTION)]
        if not len(open_):
            break
        stays = np.zeros(n, bool)
        stays[open_] = True
        keep = stays[text]
        if places is None:
            h, text, pick = h[keep], text[keep], pick[keep]
            places = np.repeat(np.arange(M, dtype=np.uint8)[None], len(h), 0)
            places[np.arange(len(h)), pick] = 0
        elif not keep.all():
            h, text, places = h[keep], text[keep], places[keep]
    return out.reshape(n, M)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band of each signature; the band's number is part of the key."""
    parts = signature.reshape(len(signature), M // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, M // ROWS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = tv.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


SIGNED = "doc_id long, k long, n_shingles long, c1 long, c2 long, signature binary"


def _names(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's name: the sum of its elements, hashed twice."""
    names = []
    for salt in (1, 2):
        sums = np.r_[np.uint64(0), np.cumsum(tv.mix(sets ^ np.uint64(salt * 0x94D049BB133111EB & (1 << 64) - 1)))]
        names.append(tv.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return names[0], names[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, offsets, data in tv.runs(batches):
        sets, first = shingle_sets(data, offsets)
        sizes = np.diff(first)
        c1, c2 = _names(sets, first)
        # empty sets are no class; spread, so that no task gets all of them
        c1[sizes == 0] = np.random.default_rng(len(data)).integers(0, 1 << 62, int((sizes == 0).sum()))
        packed = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(4 * M), len(sizes), [None, pa.py_buffer(signatures(sets, first).tobytes())]
        )
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).cast(pa.int64()), rows.column(1), *map(pa.array, (sizes, c1, c2)), packed.cast(pa.binary())],
            ["doc_id", "k", "n_shingles", "c1", "c2", "signature"],
        )


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            rows = batch.slice(lo, 2000)
            _, data = tv.bytes_of(rows.column(2))
            keys = band_keys(data.view(np.uint32).reshape(-1, M))
            bands = keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), *(pa.array(np.repeat(rows.column(i).to_numpy(), bands)) for i in (0, 1))],
                ["key", "node", "size"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets by name, each once from a partition."""
    seen: set[tuple[int, int]] = set()
    for _, offsets, data in tv.runs(batches):
        sets, first = shingle_sets(data, offsets)
        c1, c2 = _names(sets, first)
        new = []
        for n, name in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
            if name not in seen:
                seen.add(name)
                new.append(n)
        packed = [sets[first[n] : first[n + 1]].tobytes() for n in new]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c1[new]), pa.array(c2[new]), pa.array(packed, pa.binary())], ["c1", "c2", "shingles"]
        )


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Two ascending sets are alike enough to be linked."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return COMMON[0] * both >= COMMON[1] * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
    for batch in batches:
        keep = [_similar(unpack(a), unpack(b)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _alike(a, b):
    """Sets of these sizes can be similar enough."""
    return F.least(a, b) * COMMON[0] >= F.greatest(a, b) * COMMON[1]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links. ``a`` may be in any number of pairs: its set is dealt out in salted copies."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_SALT).cast("int").alias("_fan"))
    hubs = sets.withColumnRenamed("node", "a").join(fans, "a")
    copies = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)).alias("_salt"), F.col("shingles").alias("sa"))
    salted = pairs.join(fans, "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_fan")).cast("int"))
    both = (
        salted.select("a", "b", "_salt")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(copies, ["a", "_salt"])
    )
    return both.select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links; each node with the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        edges = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 500_000:  # a forest of what was read so far; the stars join forests
            yield flush()
    yield flush()


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node it is connected with, for every node of ``links`` (a, b) but the smallest."""
    edges = stored(links.select("a", "b").mapInArrow(_forest, "u long, v long").distinct(), "forest")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = edges
        edges = stored(small.unionByName(small_low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
        forget(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now


def _mixed(members: DataFrame, comps: DataFrame | None, more_than: int = 1) -> DataFrame:
    """key, node, size, comp, and members n and bytes of the bucket, in buckets of several components."""
    if comps is None:
        now = members.withColumn("comp", F.col("node"))
    else:
        now = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    buckets = now.groupBy("key").agg(
        F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("n"), (F.sum("size") * 8).alias("bytes")
    )
    return now.join(buckets.filter(f"_lo <> _hi and n > {more_than}").drop("_lo", "_hi"), "key")


def _hub_pairs(mixed: DataFrame, used: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The hub that each member, outside the components of its buckets' hubs, shares most bands with; and the buckets'
    hubs (key, node). ``used`` were hubs of their bucket before."""
    central = mixed.groupBy("node").agg(F.sum("n").alias("_n"))
    can = mixed if used is None else mixed.join(used, ["key", "node"], "left_anti")
    order = F.struct("_n", F.xxhash64("node").alias("o"), "node", "comp", "size")
    hubs = stored(can.join(central, "node").groupBy("key").agg(F.max(order).alias("hub")), "hubs")
    met = mixed.join(hubs, "key").filter((F.col("comp") != F.col("hub.comp")) & _alike(F.col("size"), F.col("hub.size")))
    shared = met.groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("_n"))
    best = shared.groupBy("b").agg(F.max(F.struct("_n", "a")).alias("_best"))
    return best.select(F.col("_best.a").alias("a"), "b"), hubs.select("key", F.col("hub.node").alias("node"))


def _met(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of blocks in ``t``: rows x and y of the pairs whose signatures agree often enough, and how often."""
    keys = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    _, data = tv.bytes_of(t["signature"])
    signature = data.view(np.uint32).reshape(-1, M)
    bands = band_keys(signature)
    node, comp, own, size = (t[c].to_numpy() for c in ("node", "comp", "own", "size"))
    cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        rows = order[lo:hi]
        key, i, j = keys[:, lo]
        left, right = rows[own[rows] == i], rows[own[rows] == j]
        xs, ys, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for at in range(0, len(left), 64):
            a = left[at : at + 64, None]
            ok = (comp[a] != comp[right]) & ((node[a] < node[right]) | (i != j))
            ok &= np.minimum(size[a], size[right]) * COMMON[0] >= np.maximum(size[a], size[right]) * COMMON[1]
            x, y = np.nonzero(ok)
            for k in range(0, len(x), 4096):
                u, v = a[x[k : k + 4096], 0], right[y[k : k + 4096]]
                equal = signature[u] == signature[v]
                agree = equal.mean(1)
                first = equal.reshape(len(u), M // ROWS, ROWS).all(2).argmax(1)
                near = (agree >= MAYBE) & (bands[u, first] == key)
                xs.append(u[near])
                ys.append(v[near])
                often.append(agree[near])
        yield np.concatenate(xs), np.concatenate(ys), np.concatenate(often)


def _maybe(t: pa.Table) -> pa.Table:
    """Rows that have a partner."""
    t = t.combine_chunks()
    some = np.zeros(t.num_rows, bool)
    for x, y, _ in _met(t):
        some[x] = some[y] = True
    return t.filter(pa.array(some)).select(MET)


def _link(t: pa.Table) -> pa.Table:
    """Links that join components, at most one for each row."""
    t = t.combine_chunks()
    offsets, data = tv.bytes_of(t["shingles"])
    sets = data.view(np.uint64)
    offsets = offsets // 8
    node, comp = t["node"].to_numpy(), t["comp"].to_numpy()
    links = []
    for x, y, often in _met(t):
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:  # noqa: B023
                parent[c] = c = parent.get(up, up)  # noqa: B023
            return c

        for n in np.lexsort((node[y], node[x], -often)):
            a, b = root(int(comp[x[n]])), root(int(comp[y[n]]))
            if a != b and _similar(*(sets[offsets[r] : offsets[r + 1]] for r in (x[n], y[n]))):
                parent[max(a, b)] = min(a, b)
                links.append((node[x[n]], node[y[n]]))
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


MET = ["key", "i", "j", "node", "comp", "size", "own", "signature"]


def _block_links(mixed: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components in each bucket, from all pairs that buckets still hold."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = mixed.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("key", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "node", "comp", "size", "own")
    rows = stored(rows, "blocks")
    group = lambda n: F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, n)))
    near = rows.join(signed, "node").withColumn("_group", group(rows.count() // GROUP_ROWS)).groupBy("_group")
    schema = "key long, i int, j int, node long, comp long, size long, own int, signature binary"
    near = stored(near.applyInArrow(_maybe, schema), "maybe", "uncompressed")
    total = near.agg(F.sum("size")).first()[0] or 0
    full = near.join(sets, "node").withColumn("_group", group(8 * total // GROUP_BYTES)).groupBy("_group")
    links = stored(full.applyInArrow(_link, "a long, b long"), "links")
    forget(rows, near)
    return links


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, k (a hash of doc_id and text), n_shingles, comp (a number of the component, null: no words) and first
    (doc_id and k of the row of the component that stays) of every document."""
    keyed = docs.select("doc_id", _row_key().alias("k"), "text")
    signed = stored(small_batches(keyed).mapInArrow(_sign, SIGNED), "signed", "uncompressed")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    real = signed.filter("n_shingles > 0").groupBy("c1", "c2")
    real = real.agg(F.min(row).alias("first"), F.max("n_shingles").alias("size"), F.first("signature").alias("signature"))
    classes = stored(real.withColumn("node", F.monotonically_increasing_id()), "classes", "uncompressed")
    banded = classes.select("node", "size", "signature").mapInArrow(_band, "key long, node long, size long")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    members = stored(banded.join(shared, "key"), "members")
    needed = classes.join(members.select("node").distinct(), "node").select("c1", "c2", "node", F.col("first.k").alias("k"))
    needed = stored(needed, "needed")
    sets = let_through(keyed, "k", needed, "k").select("text").mapInArrow(_sets, "c1 long, c2 long, shingles binary")
    sets = sets.groupBy("c1", "c2").agg(F.first("shingles").alias("shingles")).join(needed, ["c1", "c2"])
    sets = stored(sets.select("node", "shingles"), "sets", "uncompressed")
    links, comps, used = None, None, None
    for round_ in range(HUB_ROUNDS):
        mixed = stored(_mixed(members, comps, BLOCK if round_ else 1), "mixed")
        if mixed.isEmpty():
            break
        pairs, hubs = _hub_pairs(mixed, used)
        used = hubs if used is None else used.unionByName(hubs)
        found = stored(verified(stored(pairs, "pairs"), sets), "hub_links")
        forget(mixed)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comps = components(links)
    mixed = stored(_mixed(members, comps), "mixed")
    if not mixed.isEmpty():
        found = _block_links(mixed, classes.select("node", "signature"), sets)
        if not found.isEmpty():
            comps = components(found if links is None else links.unionByName(found))
    forget(mixed, members, needed, sets)
    named = classes.select("c1", "c2", "node", "first")
    named = named.withColumn("comp", F.col("node")) if comps is None else named.join(comps, "node", "left")
    named = named.withColumn("comp", F.coalesce("comp", "node"))
    firsts = named.groupBy("comp").agg(F.min("first").alias("first"))
    named = named.select("c1", "c2", "comp").join(firsts, "comp")
    return signed.select("doc_id", "k", "n_shingles", "c1", "c2").join(named, ["c1", "c2"], "left").drop("c1", "c2")


def _row_key() -> Column:
    return F.xxhash64("doc_id", F.xxhash64("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the component's smallest doc_id) and kept (is it the own one) of every document."""
    out = judged(docs).withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: that of the smallest doc_id (null comes last), of several texts under it
    the one of the smallest hash, and of equal rows one. Rows without words all stay."""
    stay = judged(docs).filter("comp is not null").select(F.col("first.k").alias("_k")).distinct()
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def keep(rows: DataFrame) -> DataFrame:
        again = Window.partitionBy("_k").orderBy(F.xxhash64(*rows.columns))
        once = rows.filter(~wordless).withColumn("_k", _row_key()).join(stay, "_k", "left_semi")
        once = once.withColumn("_copy", F.row_number().over(again)).filter("_copy = 1").select(*rows.columns)
        return once.unionByName(rows.filter(wordless))

    return beside(docs, ("doc_id", "text"), keep)


def naive(docs: list[tuple]) -> list[tuple]:
    """n_shingles and component_id of (doc_id, text) rows with distinct ids, by comparing all pairs; for tests."""
    import re

    sets = {}
    for d, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = {tuple(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))}
        sets[d] = grams - {()}
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and COMMON[0] * both >= COMMON[1] * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return [(d, len(sets[d]), root(d)) for d, _ in docs]
