import random

import numpy as np

from stopweave.llm import substring


def run(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    rows = sorted(map(tuple, substring.dedup_substrings(frame).collect()))
    assert [r[0] for r in rows] == list(range(len(texts)))
    return [r[1:] for r in rows]


def test_gaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        values = np.sort(rng.integers(0, 1 << 40, n))
        assert (substring.ungaps(substring.gaps(values)) == values).all()
    assert list(substring.ungaps(substring.gaps(np.array([0, 0, 127, 128, 1 << 21])))) == [0, 0, 127, 128, 1 << 21]


def test_small_cases(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"é{rng.randrange(10**6)}" for _ in range(n))
    passage, other = prose(35), prose(60)
    texts = [
        prose(100) + "\n" + passage + "  " + prose(10),
        passage,
        passage.replace(" ", "\t"),
        None,
        "",
        "  \n ",
        other[: len(other) // 2] + " " + prose(3) + " " + other,
        other + prose(1),
        "go " * 36,
        "stop " * 35,
        prose(34),
        passage.upper(),
        prose(2000) + " " + other,
        "last",
    ]
    assert run(spark, texts) == substring.naive(texts)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [None, ""]) == [(0, 0, ""), (0, 0, "")]


def test_small_segments_and_shards(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(substring, "SHARD", 5000)
    monkeypatch.setattr(substring, "CELLS", 1)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    texts += texts[:3]
    got = run(spark, texts)
    assert got == substring.naive(texts)
    assert any(r[1] for r in got)
