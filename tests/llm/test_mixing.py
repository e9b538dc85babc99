"""The cube method's totals and probabilities, targets against exact fractions, and the whole query."""

import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chromaweave.llm import mixing
from chromaweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target} by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = Fraction(sum(sizes.values())), set(order), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left, free = left - sum(out[s] for s in over), free - over
    return out


def held(rows, found, most=3):
    """Check a mix of (doc_id, source, text) rows; the largest miss in words."""
    size = {i: len(WORDS.findall(t or "")) for i, _, t in rows}
    total = defaultdict(int)
    for i, s, _ in rows:
        total[s] += size[i]
    want = plain_targets(total)
    taken, source = defaultdict(int), {i: s for i, s, _ in rows}
    assert sorted(r.doc_id for r in found) == sorted(size)
    for r in found:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(float(want[s]))
        assert r.taken == r.copies * r.size and 0 <= r.copies <= most
        assert total[s] == 0 or abs(r.copies - float(want[s]) / total[s]) < 1 + 1e-6
        taken[s] += r.taken
    return max((abs(taken[s] - float(want[s])) for s in total), default=0)


def test_flight_keeps_both_totals_and_probabilities():
    g = np.random.default_rng(1)
    size = g.integers(0, 50, 200).astype(float).tolist()
    mean = np.zeros(200)
    for seed in range(400):
        p = [0.3] * 200
        mixing.move(p, size, np.random.default_rng(seed).random)
        open_ = [x for x in p if mixing.EPS < x < 1 - mixing.EPS]
        assert len(open_) <= 2
        assert sum(p) == pytest.approx(60) and np.dot(p, size) == pytest.approx(0.3 * sum(size))
        mean += np.array(p) / 400
    # 400 runs: a probability of 0.3 has a standard error of 0.023.
    assert abs(mean - 0.3).max() < 0.1 and abs(mean.mean() - 0.3) < 1e-6


def test_long_documents_are_settled_and_totals_kept():
    for seed in range(20):
        size = np.array([20000.0, 9000.0] + [float(i % 60) for i in range(3000)])
        p = np.full(3002, 0.3)
        mixing.move_long(p, size, np.random.default_rng(seed).random)
        assert set(p[:2]) <= {0.0, 1.0} and (p >= 0).all() and (p <= 1).all()
        assert p.sum() == pytest.approx(0.3 * 3002) and p @ size == pytest.approx(0.3 * size.sum())


def test_flight_of_equal_sizes_and_of_few():
    for size in ([5.0] * 9, [0.0] * 9, [1.0, 2.0], [3.0], []):
        p = [1 / 3] * len(size)
        before = sum(p)
        mixing.move(p, size, np.random.default_rng(0).random)
        assert sum(p) == pytest.approx(before)
        mixing.land(p, size)
        assert all(x in (0.0, 1.0) for x in p)
    p = [0.4, 0.6, 0.5]
    mixing.land(p, [10.0, 20.0, 35.0])  # 33.5 words: the third alone misses by 1.5
    assert p == [0, 0, 1]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, None: 5}, {"a": 0, "b": 0}, {"": 7, "Z": 3, "a": 100, "é": 2, "😀": 900, None: 0}, {"a": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(float(t)) for s, t in plain_targets(sizes).items()}


def texts(n, hot=0.4):
    g = np.random.default_rng(n)
    return [(i, "hot" if g.random() < hot else f"s{g.integers(0, 7)}", "w " * int(g.integers(0, 60))) for i in range(n)]


def test_blocks_meet_the_target_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = texts(3000)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    a = mixing.mix(df.repartition(7)).collect()
    assert held(rows, a) <= 2
    b = mixing.mix(df.orderBy(F.desc("doc_id")).coalesce(2)).collect()
    assert sorted(a) == sorted(b)
    # The salted join of many sources gives the same mix.
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(mixing.mix(df).collect()) == sorted(a)


def test_odd_rows(spark):
    rows = [(1, None, "a b c"), (2, "x", None), (3, "x", ""), (4, "y", "one\ttwo\x0bthree\x1cfour five"), (5, "y", "w " * 20000), (6, "zero", " \n "), (7, "y", "b"), (8, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"size": F.lit(-1), "copies": F.lit("x"), "number": F.lit(0)})
    held(rows, mixing.mix(df).collect())
    assert mixing.mix(df.where("false")).count() == 0
    twice = mixing.mix(df.union(df)).collect()
    assert len(twice) == 16 and {r["size"] for r in twice if r.doc_id == 4} == {3}
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.mix(nulls).count() == 8
    with pytest.raises(ValueError, match="new column"):
        mixing.mix(df, row_id="copies")


def test_whole_query(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "source", "text"])
    found = QUERIES["op12_mix_sources"](spark, SF).collect()
    held([tuple(r.values()) for r in t.to_pylist()], found)
    taken, target = defaultdict(int), {}
    source = dict(zip(t["doc_id"].to_pylist(), t["source"].to_pylist(), strict=True))
    for r in found:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target), {s: (taken[s], target[s]) for s in target}
