"""The operators that are SQL functions only: sharding and mixing."""

import math
import random
import zlib
from collections import defaultdict

from stopweave.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x") for d, t, s in rows], DOCS)


ODD = [(None, None, None), (None, "a", None), (5, "", "s"), (5, "", "s"), (7, "é b", ""), (8, "w " * 20_000, "s")]


def test_sharding(spark):
    rows = ODD + [(i, f"text {i}", "s") for i in range(100, 900)]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert 0 < sum(r.grown_shard == 40 for r in got) < 60
    want = sorted((d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
    again = {r.doc_id: r.shard for r in sharding.shard_documents(frame(spark, rows[::-1])).collect()}
    assert all(again[r.doc_id] == r.shard for r in got)
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_weights_move_documents_within_their_subtree(spark):
    tree = sharding.Tree((((1.0, 1.0), (2.0,)), ((4.0,),)))
    heavier = sharding.Tree((((1.0, 1.0), (3.0,)), ((4.0,),)))
    docs = frame(spark, [(i, "", "") for i in range(4000)])
    before = {r.doc_id: r.shard for r in sharding.assign(docs.drop("shard"), tree).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(docs.drop("shard"), heavier).collect()}
    counts = [sum(v == s for v in before.values()) for s in range(4)]
    assert all(abs(c - n) < 150 for c, n in zip(counts, (500, 500, 1000, 2000), strict=True))
    for d, s in before.items():
        if after[d] != s:  # into the rack that grew, or, from the other region, anywhere in its region
            assert after[d] == 2 or (s == 3 and after[d] in (0, 1))


def level(sizes, weights, repeats):
    """Water filling by rounds."""
    left, free, out = sum(sizes.values()), dict(weights), {}
    while free:
        total = sum(free.values())
        over = [s for s in free if left * free[s] / total > repeats * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in free.items()}
        for s in over:
            out[s] = repeats * sizes[s]
            del free[s]
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 5), rng.choice(["a", "a", "a", "é", "b", "Z", None])) for i in range(3000)]
    rows += [(10_000 + i, "x y", "tiny") for i in range(7)] + [(20_000, "", "empty"), (20_001, None, "a")]
    got = mixing.mix_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {d: (len((t or "").split()), s) for d, t, s in rows}
    sizes = defaultdict(int)
    for n, s in by_id.values():
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = level(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}, 3)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        n, s = by_id[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-6)
        assert r.taken in (0, n, 2 * n, 3 * n)
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix_report(frame(spark, rows[::-1])).collect()}
    assert all(again[r.doc_id] == r.taken for r in got)


def test_mixing_odd_rows(spark):
    assert mixing.mix_report(frame(spark, [])).count() == 0
    got = mixing.mix_report(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    docs = frame(spark, ODD)
    assert mixing.mix(docs).columns == docs.columns
    equal = [(1, "a b c", "s")] * 500
    assert sum(r.taken for r in mixing.mix_report(frame(spark, equal)).collect()) == 1500


def test_many_equal_rows(spark, monkeypatch):
    """Rows that repeat more often than a task numbers are numbered as one, and come out as often as before."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    monkeypatch.setattr(mixing, "SALT_ROWS", 10)
    rows = [(1, "same text", "s")] * 95 + [(None, "no id", "s")] * 31 + [(i, f"text {i}", "s") for i in range(2, 60)] + [(2, "text 2", "s")]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text_crc32) for r in got) == sorted((d or 0, zlib.crc32(t.encode())) for d, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    full = sharding.sharded(frame(spark, rows).select("doc_id", "text"), sharding.Tree.even(40)).collect()
    assert sorted((r.doc_id or 0, r.shard, r.slot) for r in full) == sorted((r.doc_id or 0, r.shard, r.slot) for r in got)
    assert sorted((r.doc_id or 0, r.text) for r in full) == sorted((d or 0, t) for d, t, _ in rows)

    report = mixing.mix_report(frame(spark, rows)).collect()
    assert len(report) == len(rows) and sum(r.taken for r in report) == sum(r["size"] for r in report)
    monkeypatch.setattr(mixing, "SALT_ROWS", 10_000)
    plain = mixing.mix_report(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in report) == sorted((r.doc_id or 0, r.taken) for r in plain)
    rows = [(d, t, "t" if i % 7 else "s") for i, (d, t, _) in enumerate(rows)]
    report = mixing.mix_report(frame(spark, rows)).collect()
    times = defaultdict(int)
    for r in report:
        times[r.doc_id] += r.taken // r["size"]
    emitted = defaultdict(int)
    for r in mixing.mix(frame(spark, rows)).collect():
        emitted[r.doc_id] += 1
    assert emitted == {d: n for d, n in times.items() if n}


def test_rows_without_doc_id(spark):
    """Rows of one source and size that have no doc_id are dealt out by their texts."""
    rows = [(None, f"text{i}", "s") for i in range(200)]
    orders = {r._order for r in mixing._measured(frame(spark, rows), 0).collect()}
    assert len(orders) == 200
    assert sum(r.taken for r in mixing.mix_report(frame(spark, rows)).collect()) == 200


def draw(key, path):
    from pyspark.sql import functions as F

    return (F.shiftrightunsigned(F.xxhash64(F.lit(path), F.lit(key)), 12).cast("double") + 0.5) / 2.0**52


def test_shards_against_plain_draws(spark):
    """Each document descends to the child with the smallest -ln(u) / weight, level by level."""
    tree = sharding.Tree((((1.0, 2.0), (3.0,)), ((4.0, 0.0, 1.0),)))
    ids = list(range(60))
    got = {r.doc_id: r.shard for r in sharding.assign(frame(spark, [(i, "", "") for i in ids]).drop("shard"), tree).collect()}
    paths = ["r.0", "r.1", "k0.0", "k0.1", "k1.0", "s0.0", "s0.1", "s1.0", "s2.0", "s2.1", "s2.2"]
    columns = [draw(str(i), p).alias(f"u{i}_{n}") for i in ids for n, p in enumerate(paths)]
    us = list(spark.range(1).select(*columns).first())

    def smallest(weights, u):
        values = [-math.log(x) / w if w else math.inf for w, x in zip(weights, u, strict=True)]
        return values.index(min(values))

    for i in ids:
        u = dict(zip(paths, us[i * len(paths) : (i + 1) * len(paths)], strict=True))
        region = smallest([6.0, 5.0], [u["r.0"], u["r.1"]])
        if region == 0:
            rack = smallest([3.0, 3.0], [u["k0.0"], u["k0.1"]])
            want = smallest([1.0, 2.0], [u["s0.0"], u["s0.1"]]) if rack == 0 else 2
        else:
            want = 3 + smallest([4.0, 0.0, 1.0], [u["s2.0"], u["s2.1"], u["s2.2"]])
        assert got[i] == want
