from collections import Counter

import pytest

import corpus_pipeline
from stopweave.llm import decontam, mixing, neardup, toxicity


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def test_every_stage_against_plain_versions(spark, sf_dir, tables):
    docs = tables["documents"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], sf_dir).cache()
        out.count()
        assert out.columns[: len(docs.columns)] == docs.columns, name
        steps.append(out)
    rows = [[tuple(r) for r in s.select("doc_id", "text").collect()] for s in steps]

    scores = toxicity.classify(docs, toxicity.train(docs, tables["labels"])).collect()
    assert sorted(rows[1]) == sorted((r.doc_id, r.text) for r in scores if r.score < r.lang_threshold)

    assert sorted(rows[2]) == sorted(r for r, (d, _, c) in zip(rows[1], neardup.naive(rows[1]), strict=True) if d == c)

    items = [tuple(r) for r in tables["benchmark"].select("item_id", "text").collect()]
    bad = {d for d, r in decontam.naive(rows[2], items).items() if r[-1]}
    assert bad and sorted(rows[3]) == sorted(r for r in rows[2] if r[0] not in bad)

    times = {r.doc_id: r.taken // r.size for r in mixing.mix_report(steps[3]).collect() if r.size}
    assert {d: n for d, n in Counter(d for d, _ in rows[4]).items() if d in times} == {d: n for d, n in times.items() if n}

    assert sorted(rows[5]) == sorted(rows[4])
    by_shard = {}
    for r in steps[5].collect():
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) <= set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_odd_rows_pass(spark, sf_dir):
    rows = [
        (1, "a plain text", "en", "a", 1, "s", 2, "c"),
        (1, "a plain text", "en", "a", 1, "s", 2, "c"),
        (2, None, None, None, None, None, None, None),
        (None, "text without id", "en", None, 3, "s", 1, "c"),
        (3, "", "", "", 0, "", 0, ""),
        (4, "long " * 60_000, "zz", "b", 5, "s", 3, "k"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, copies string"
    for docs, n in ((spark.createDataFrame(rows, schema), 5), (spark.createDataFrame([], schema), 0)):
        step = docs
        for name, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, sf_dir)
            assert step.columns[: len(docs.columns)] == docs.columns, name
            if name == "decontamination":
                assert step.count() == n
        assert (step.count() > 0) == (n > 0)


def test_columns_that_are_called_shard_and_slot(spark, sf_dir):
    docs = spark.createDataFrame([(i, f"text {i}", "mine", -i) for i in range(30)], "doc_id long, text string, shard string, slot int")
    out = corpus_pipeline.shards(spark, docs, sf_dir)
    assert out.columns == ["doc_id", "text", "shard_before", "slot_before", "shard", "slot"]
    rows = out.collect()
    assert sorted((r.doc_id, r.shard_before, r.slot_before) for r in rows) == [(i, "mine", -i) for i in range(30)]
    assert {r.shard for r in rows} <= set(range(40))


def test_near_dedup_judges_rows_by_text(spark, sf_dir):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (None, a), (None, "c " * 9)], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, docs, sf_dir).collect()}
    assert kept == {(3, a), (5, b), (None, "c " * 9)}
