"""Every query against its oracle, as multisets of rows with columns in order of name."""

import math

import duckdb
import pytest

import stopweave.queries_map  # noqa: F401
import stopweave.queries_match  # noqa: F401
from stopweave.plans.world import TABLES
from stopweave.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(map(norm, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(math.isclose(a, b, abs_tol=2e-3) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(g, w, strict=True)), (g, w)
