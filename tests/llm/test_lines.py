import hashlib
import random

import duckdb

from stopweave.llm import lines

SCHEMA = "doc_id long, text string, line string"


def close(a, b):
    if a == b or min(len(a), len(b)) < lines.LEAST:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive(docs):
    all_ = sorted((-1 if d is None else d, i, x) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x)
    out = {}
    for k, (d, i, x) in enumerate(all_):
        before = [y for _, _, y in all_[:k]]
        out[None if d < 0 else d, i] = "equal" if x in before else "near" if any(close(x, y) for y in before) else "kept"
    return out


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)


def check(spark, docs):
    got = {(r.place.doc_id, r.place.line_no): r.kind for r in lines.judged_lines(frame(spark, docs)).collect()}
    want = naive(docs)
    assert got == want
    return want


def test_small_cases(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdé ") for _ in range(700))
    text = "The first line.\nthe first line.\n\nThe first line\nThe  first line.\n" + long
    docs = [
        (3, text),
        (5, "The first line!\nTh first line.\nunlike anything\nThe first line."),
        (7, long[:350] + long[351:] + "\n" + long[:100] + "X" + long[101:] + "\n" + long + "y\n" + "y" + long),
        (8, long[:100] + "XX" + long[101:]),
        (9, "a\nb\nab\nabcdefg\nabcdefh"),
        (10, None),
        (11, ""),
        (12, "\n\n"),
        (None, "unlike anythinh\ncañada del río\ncanada del río"),
        (13, "abcdefgh\nbacdefgh\nabdcefgh\nabcdefgh "),
    ]
    want = check(spark, docs)
    assert {"equal", "near", "kept"} == set(want.values())


def test_random_edits(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab") for _ in range(rng.choice((7, 8, 9, 20, 64, 65, 128, 129)))) for _ in range(40)]
    docs = []
    for i in range(60):
        x = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 1, 2))):
            at = rng.randrange(len(x))
            x[at : at + rng.choice((0, 1))] = rng.choice(([], ["a"], ["b"], ["c"]))
        docs.append((i, "".join(x) + "\n" + rng.choice(base)))
    check(spark, docs)


def test_outputs(spark):
    docs = [(1, "The first line.\nother"), (2, "The first line?\nmore\nother"), (3, None), (4, "other")]
    rows = {r.doc_id: r.text for r in lines.deduplicated(frame(spark, docs)).collect()}
    assert rows == {1: "The first line.\nother", 2: "more", 3: None, 4: ""}
    got = sorted(map(tuple, lines.digest(frame(spark, docs)).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [
        (1, 2, 0, 0, 2, sha("The first line.\nother")), (2, 3, 1, 1, 1, sha("more")), (3, 0, 0, 0, 0, None), (4, 1, 1, 0, 0, sha("")),
    ]
    assert lines.digest(frame(spark, [])).collect() == []
    repeated = lines.digest(frame(spark, [(1, "same line here")] * 3)).collect()
    assert [tuple(r) for r in repeated] == [(1, 1, 0, 0, 1, sha("same line here"))] * 3


def test_rows_that_share_a_doc_id(spark):
    """Rows are told apart by their text: none loses the lines of another."""
    docs = [(1, "some thing\nshared line here"), (7, "shared line here\nother text zzzz"), (7, "keep me please qqqq\nsecond thing wwww")]
    got = sorted(map(tuple, lines.deduplicated(frame(spark, docs)).collect()))
    assert got == [(1, "some thing\nshared line here"), (7, "keep me please qqqq\nsecond thing wwww"), (7, "other text zzzz")]
    none = [(None, "one line of text"), (None, "one line of text\nanother line of it"), (None, "a third document"), (4, "a third document")]
    texts = sorted((r.doc_id or 0, r.text) for r in lines.deduplicated(frame(spark, none)).collect())
    kept = [x for _, t in texts for x in t.split("\n") if x]
    assert sorted(kept) == ["a third document", "another line of it", "one line of text"] and texts[-1] == (4, "")
    assert sum(r.n_kept for r in lines.digest(frame(spark, none)).collect()) == 3


def test_real_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted(map(tuple, lines.digest(docs).collect()))
    assert got == sorted(con.sql(lines.SQL).fetchall())
    assert sum(r[2] for r in got) > 0
    texts = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert all(r[5] == hashlib.sha256(texts[r[0]].encode()).hexdigest() for r in got)
