import random

import numpy as np
import pytest

from stopweave.llm import neardup


def run(spark, docs):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, kept string")
    rows = neardup.near_duplicates(frame).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return rows


def check(spark, docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, docs))
    assert got == sorted(neardup.naive(docs))
    return got


def prose(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**7)}"
    return words


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for n in (1, 3, 20, 100, 1000):
        for share in (0.5, 0.8):
            common = rng.integers(0, 1 << 63, int(n * share), np.uint64)
            sets = [np.unique(np.r_[common, rng.integers(0, 1 << 63, n - len(common), np.uint64)]) for _ in range(2)]
            first = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            a, b = neardup.signatures(np.concatenate(sets), first)
            errors.append(abs((a == b).mean() - len(common) / (2 * n - len(common))))
            assert sorted(a >> 25) != [0] * neardup.M or n > 20
    assert max(errors) < 0.17 and np.mean(errors) < 0.05


def test_signature_is_the_plain_minimum():
    """Level by level with early stopping gives what whole permutations give."""
    sets = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    from stopweave.llm.textvec import mix

    best = [2**40] * neardup.M
    for h in sets:
        places = list(range(neardup.M))
        for j in range(neardup.M):
            x = int(mix(np.array([h]) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0])
            k = j + (((x & 0x7FFFFFFF) * (neardup.M - j)) >> 31)
            places[j], places[k] = places[k], places[j]
            best[places[j]] = min(best[places[j]], (j << 25) | (x >> 39))
    assert neardup.signatures(sets, np.array([0, len(sets)]))[0].tolist() == best


def test_small_cases(spark):
    rng = random.Random(3)
    base = prose(rng, 200)
    chain = [base]
    for _ in range(6):
        chain.append(edited(rng, chain[-1], 3))
    docs = [(100 + i, " ".join(w)) for i, w in enumerate(chain)]
    docs += [(1, " ".join(base).upper()), (2, None), (3, ""), (4, " \n"), (5, "one two"), (6, "One  two"), (7, "one two three")]
    docs += [(8, "go " * 500), (9, "go " * 5), (10, " ".join(prose(rng, 30_000))), (50, " ".join(chain[6]) + " tail")]
    got = check(spark, docs)
    assert dict((d, c) for d, _, c in got)[9] == 8


def test_group_around_one_text(spark):
    """Copies of a text with edits of their own are linked through it, though not with one another."""
    rng = random.Random(4)
    base = prose(rng, 120)
    docs = [(i, " ".join(edited(rng, base, 3))) for i in range(60)] + [(999, " ".join(base))]
    check(spark, docs)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_large_bucket_in_blocks(spark, monkeypatch, rounds):
    """Blocks alone, and after hubs, find what comparing all pairs finds."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "GROUP_ROWS", 50)
    monkeypatch.setattr(neardup, "GROUP_BYTES", 10_000)
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(neardup, "HUB_SALT", 3)
    rng = random.Random(6)
    base = prose(rng, 100)
    docs = [(i, " ".join(edited(rng, base, 1 + i % 9))) for i in range(50)]
    check(spark, docs)


def test_no_more_links_than_members(spark, monkeypatch):
    """A group of n alike texts gives no n * n rows."""
    rng = random.Random(8)
    base = prose(rng, 100)
    docs = [(i, " ".join(edited(rng, base, 1))) for i in range(80)]
    seen = []
    stored = neardup.stored

    def counted(df, name, *codec):
        out = stored(df, name, *codec)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(neardup, "stored", counted)
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)
    check(spark, docs)
    assert max(n for name, n in seen if name == "links") < 80 * neardup.M // neardup.ROWS


def test_rows_that_share_a_doc_id(spark):
    rng = random.Random(9)
    a, b = prose(rng, 60), prose(rng, 40)
    near = " ".join([*a[:-1], "other"])
    a, b = " ".join(a), " ".join(b)
    get = lambda rows: sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, rows)), key=str)
    assert get([(1, a), (1, b), (2, near)]) == [(1, 36, 1, True), (1, 56, 1, True), (2, 56, 1, False)]
    # texts of one doc_id do not join the groups of these texts
    assert get([(1, a), (1, b), (3, a), (4, b), (0, near)]) == sorted(
        [(1, 56, 0, False), (3, 56, 0, False), (0, 56, 0, True), (1, 36, 1, True), (4, 36, 1, False)], key=str
    )
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, k string, _copy int")
    kept = lambda rows: sorted(map(tuple, neardup.deduplicated(frame(rows)).collect()), key=str)
    assert kept([(3, a, "p", 1), (5, near, "q", 2), (5, b, "r", 3)]) == [(3, a, "p", 1), (5, b, "r", 3)]
    assert kept([(None, a, "p", 1), (None, a, "p", 1), (None, near, "p", 1)])[0][0] is None
    assert len(kept([(None, a, "p", 1), (None, a, "p", 1), (None, near, "p", 1), (None, None, "p", 1), (7, " ", "p", 1)])) == 3
    assert kept([(None, a, "p", 1), (9, near, "q", 2)]) == [(9, near, "q", 2)]


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = run(spark, [(1, text), (1, text), (None, text), (2, text), (3, None), (None, None)])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (2, 1, False), (3, 3, True), (None, None, True)], key=str)
    assert run(spark, []) == []


def test_real_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs)
