from stopweave.llm import decontam

DOCS = "doc_id long, text string, items string"


def run(spark, docs, items, **options):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.digest(decontam.decontaminate(frame, tests, **options)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def expected(docs, items):
    found = [(d, *decontam.naive([(d, t)], items)[d]) for d, t in docs]
    return sorted(found, key=str)


WORDS = [f"w{i}" for i in range(40)]
PASSAGE = " ".join(WORDS)
ITEMS = [(1, PASSAGE), (2, "short Item here"), (3, None), (10, "the " * 20), (1, PASSAGE), (None, "alone")]


def test_small_cases(spark):
    docs = [
        (1, "a b " + PASSAGE.upper() + " c"),
        (2, "x, SHORT... item-here y"),
        (3, None),
        (4, ""),
        (5, " ".join(WORDS[:12])),
        (6, " ".join(WORDS[5:18])),
        (7, "the " * 50),
        (8, "filler " * 400 + " ".join(WORDS[:13])),
        (None, "short item here"),
        (6, " ".join(WORDS[5:18])),
        (9, "short item"),
        (10, "alone"),
        (11, "here short"),
    ]
    assert run(spark, docs, ITEMS) == expected(docs, ITEMS)


def test_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 64)
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 100)
    docs = [(i, f"{PASSAGE} short item here " + "the " * (i + 5)) for i in range(12)]
    assert run(spark, docs, ITEMS) == expected(docs, ITEMS)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, [(1, "a b")], []) == expected([(1, "a b")], [])


def test_real_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = run(spark, docs, items)
    assert got == expected(docs, items)
    assert any(r[-1] for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "blue green red"), (3, "red x x x x green blue")], "doc_id long, text string")
    index = decontam.build_index(docs)
    found = {r.doc_id: [(w.begin, w.end) for w in r.words] for r in decontam.proximity_hits(index, ["red", "green", "blue"], 2).collect()}
    assert found == {1: [(0, 5)], 2: [(0, 3)]}
