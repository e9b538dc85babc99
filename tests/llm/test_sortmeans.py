"""Sort-means against plain rounds that look at every centroid, and against SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm import sortmeans
from chromaweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(vectors, k, rounds, seed):
    """vectors: (id, whole components); every distance in Python's own numbers."""
    order = sorted(vectors, key=lambda x: (hashlib.sha256(f"{seed}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in vectors]
        for j in range(len(centroids)):
            if mine := [v for (_, v), c in zip(vectors, of, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in vectors]
    total = {j: sum(d for _, d, c in last if c == j) for j in range(len(centroids))}
    return sorted(((i, c, d, tuple(centroids[c]), total[c], sum(total.values())) for i, d, c in last), key=repr)


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, tuple(r.centroid), r.cluster_inertia, r.inertia) for r in df.collect()), key=repr)


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def whole(data, scale=1024):
    return [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in data]


@pytest.mark.parametrize("k,dims,n", [(1, 3, 20), (5, 2, 300), (8, 4, 150), (40, 2, 60)])
def test_equals_plain_rounds(spark, k, dims, n):
    g = np.random.default_rng(k)
    # A coarse grid, so that distances tie and vectors repeat.
    data = [(i, (g.integers(-3, 4, dims) / 4).tolist()) for i in range(n)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows_of(sortmeans.cluster(df, "vec_id", "embedding", dims, k, 6)) == plain(whole(data), k, 6, 3)


def test_every_start_gives_the_nearest():
    g = np.random.default_rng(0)
    for scale in (2, 50):
        x, c = g.integers(-scale, scale, (500, 3)), g.integers(-scale, scale, (12, 3))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        for start in range(12):
            best, least = sortmeans.assign(x, np.full(500, start), c)
            assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def test_odd_rows(spark):
    good = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (None, [1.0, 2.0]), (None, None), (4, None), (5, [1.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (9, []), (2, [0.5, -0.25])]
    df = spark.createDataFrame(good, SCHEMA).withColumns({"cluster": F.lit("x"), "v": F.lit(1), "id": F.lit(None)})
    kept = whole([good[i] for i in (0, 1, 2, 10)])
    assert rows_of(sortmeans.cluster(df, "vec_id", "embedding", 2, 8, 3)) == plain(kept, 8, 3, 3)
    assert sortmeans.cluster(df.where("false"), "vec_id", "embedding", 2, 8, 3).count() == 0
    with pytest.raises(ValueError, match="new column"):
        sortmeans.cluster(df, "cluster", "embedding", 2, 8, 3)
    far = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        sortmeans.cluster(far, "vec_id", "embedding", 2, 2, 1).collect()


@pytest.mark.parametrize("sf", [SF])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = con.execute(ORACLES["op11_sort_means"])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert len(want) > 8
    assert sorted(map(tuple, QUERIES["op11_sort_means"](spark, sf).select(*names).collect())) == want
