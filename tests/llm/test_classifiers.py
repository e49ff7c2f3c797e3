import zlib

import numpy as np
import pyarrow as pa
import pytest

from stopweave.llm import quality, textvec, toxicity
from tests_data import documents, table_exists

DOCS = "doc_id long, text string, lang string, score string"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    ones = y == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


ODD = [(900001, "", "en"), (900002, None, None), (900003, "x" * 300_000, "zz"), (900004, "word " * 50_000, "en"), (None, "a", "de"), (900001, "", "en")]


@pytest.mark.parametrize("op,column,least,right,sf,folds,fold", [
    (toxicity, "toxic", 0.75, 0.85, "sf0.01", 4, 2),  # some 30 toxic labels at this size, few of them outside English
    (toxicity, "toxic", 0.93, 0.94, "sf0.1", 4, 2),
    (quality, "quality", 0.97, 0.85, "sf0.01", 5, 0),
])
def test_held_out(spark, op, column, least, right, sf, folds, fold):
    if not table_exists(sf):
        pytest.skip("no test tables")
    docs, labels = documents(spark, sf)
    odd = spark.createDataFrame([(*r, "x") for r in ODD], DOCS)
    docs = docs.select("doc_id", "text", "lang", docs.source.alias("score")).unionByName(odd)
    rows = op.report(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % folds == fold) for r in rows)
    truth = {r.doc_id: r[column] for r in labels.collect()}
    test = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    s, y, p = map(np.array, zip(*test, strict=True))
    assert auc(s, y) > least
    assert (p == y).mean() > right


@pytest.mark.parametrize("op", [toxicity, quality])
def test_without_labels(spark, op):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], DOCS)
    for labels in ([], [(900001, 1, 1)], [(900001, None, None), (None, 1, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert op.report(docs, frame).count() == len(ODD)
    empty = op.report(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 4)), rng.normal(4, 1, (3000, 4))
    for share in (0.3, 0.8):
        k = int(3000 * share)
        model = quality.fit(good[:1500], np.r_[good[1500 : 1500 + k // 2], bad[: (3000 - k) // 2]])
        assert abs(model.prior - share) < 0.1
        assert model.net.scores(good[-200:]).mean() > 0.85 and model.net.scores(bad[-200:]).mean() < 0.15


def test_network_gradient():
    """Scores fall when training on a planted word, for a word in any place of a long text."""
    clean = [f"a{i % 7} b{i % 5} c{i % 3} " * (1 + i % 20) for i in range(200)]
    marked = [c[: len(c) // 2] + " badword " + c[len(c) // 2 :] for c in clean]
    texts = toxicity.gather(clean + marked)
    y = np.r_[np.zeros(200), np.ones(200)].astype(np.float32)
    net = toxicity.ConvNet.start(texts, y).fit(texts, y, np.ones(400))
    s = net.scores(toxicity.gather(["", "badword", "a1 b1 badword", "a1 b1", "", "badwords"]))
    assert s[1] > 0.5 and s[2] > 0.5 and s[3] < 0.5 and s[0] == s[4]
    assert s[5] > s[3]


def test_features_of_runs():
    texts = ["a b c", "", "é é é", "A! B!", "one | two"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    whole = np.concatenate([quality.features(d, o) for _, o, d in textvec.runs([batch])])
    one = np.concatenate([quality.features(d, o) for _, o, d in textvec.runs([batch], limit=1)])
    assert np.allclose(whole, one)


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """No label is left aside, however many there are, and shards that train side by side learn what each of them saw."""
    n = 7000
    rows = [(i, f"a{i % 7} b{i % 5} c{i % 3} " + ("badword" if i % 10 == 0 else "good"), "en") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(n)], "doc_id long, toxic int")
    seen = []
    counted = toxicity.ConvNet.counted
    monkeypatch.setattr(toxicity.ConvNet, "counted", staticmethod(lambda counts: (seen.append(counts[0].tolist()), counted(counts))[1]))
    model = toxicity.train(docs, labels, shard=1500)
    learn = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert 0.75 * len(learn) < seen[0][0] < 0.85 * len(learn) and seen[0][0] > 4000  # the others set thresholds
    s = model.net.scores(toxicity.gather(["a1 b1 c1 badword", "a1 b1 c1 good"]))
    assert s[0] > 0.5 > s[1] and s[1] < model.thresholds["en"] < s[0]
