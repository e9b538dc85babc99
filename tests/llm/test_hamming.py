import random

import duckdb
import pytest

from chromaweave.llm import hamming, queries

SF = "/root/testdata/sf0.01"


def brute(queries, rows, k):
    out = []
    for qi, q in queries:
        near = sorted((sum((a > 0) != (b > 0) for a, b in zip(q, v, strict=True)), i is None, i or 0) for i, v in rows)[:k]
        out += [(qi, n + 1, None if null else i, d) for n, (d, null, i) in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dims,width", [(20, None), (64, 8), (100, 7), (5, None)])
def test_matches_brute_force(spark, dims, width):
    r = random.Random(dims)
    rows = [(i, [r.choice([-1.0, 1.0]) for _ in range(dims)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(5, rows[5][1]), (None, rows[7][1])]
    bad = [(300, None), (301, []), (302, [None] * dims), (303, [1.0] * (dims + 1))]
    df = spark.createDataFrame(rows + bad, "vec long, e array<double>")
    codes = hamming.sign_codes(df, "vec", "e")
    assert codes.count() == len(rows)
    got = hamming.top_k(codes.where("id % 10 = 0"), codes, 4, dims, width)
    assert sorted(map(tuple, got.collect()), key=str) == brute([x for x in rows if x[0] is not None and x[0] % 10 == 0], rows, 4)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0])], "vec long, e array<double>")
    codes = hamming.sign_codes(df, "vec", "e")
    assert sorted(map(tuple, hamming.top_k(codes.where("id = 0"), codes, 10, 2).collect())) == [(0, 1, 0, 0), (0, 2, 1, 1)]
    none = hamming.sign_codes(df.limit(0), "vec", "e")
    assert hamming.top_k(none, none, 10, 2).count() == 0 and hamming.top_k(codes, none, 10, 2).count() == 0


def test_op6_equals_sql(spark):
    got = sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in queries.op6_hamming_top_k(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    sql = f"SELECT query_id, rank, vec_id, distance FROM ({queries.ORACLES['op6_hamming_top_k']})"
    assert got == sorted(con.execute(sql).fetchall())
