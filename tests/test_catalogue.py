"""Every registered query against its DuckDB twin on the small tables."""

import math

import duckdb
import pytest

from chromaweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b)))
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert not bad, bad[:3]
