"""Replicate runs by recount, and readers that fail on bad lines in the middle of a file."""

from collections import Counter

import pytest

from chromaweave.plans import pipelines
from chromaweave.sources import formats

EDGES = [("a", "b", 0.9, "U"), ("b", "c", 0.8, "U"), ("a", "d", 0.6, "D"), ("d", "c", 0.5, "U"), ("c", "e", 0.7, "U")]


@pytest.fixture
def instance(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, weight double, dir string")
    prizes = spark.createDataFrame([("a", 2.0), ("c", 3.0), ("e", 1.0), ("gone", 5.0)], "node string, prize double")
    return edges, prizes, prizes.select("node")


@pytest.mark.parametrize("shuffle", [False, True])
def test_merged_shares_equal_a_recount(instance, shuffle):
    out = pipelines.replicates(*instance, n_runs=6, w=0.5, b=1.0, depth=4, sd=0.5, shuffle=shuffle, seed=2)
    solved = out["solution"].collect()
    assert len({r.run for r in solved}) == 6 and "gone" not in {r.node for r in solved}
    arcs = {(r.run, r.parent, r.node) for r in solved if r.parent}
    edges = Counter((p, c) for _, p, c in arcs)
    nodes = Counter(n for _, n in {(run, n) for run, p, c in arcs for n in (p, c)})
    assert {(r.src, r.dst): r.fraction for r in out["edges"].collect()} == {k: v / 6 for k, v in edges.items()}
    assert {r.node: r.fraction for r in out["nodes"].collect()} == {k: v / 6 for k, v in nodes.items()}
    assert out["objectives"].count() == 6
    out["solution"].unpersist()


def test_runs_without_noise_agree(instance):
    out = pipelines.replicates(*instance, n_runs=3, w=0.5, b=1.0, depth=4, sd=0.0)
    assert {r.fraction for r in out["edges"].collect()} == {1.0} and len({r.objective for r in out["objectives"].collect()}) == 1
    out["solution"].unpersist()


def put(tmp_path, text):
    (tmp_path / "x.txt").write_text(text)
    return f"file://{tmp_path / 'x.txt'}"


@pytest.mark.parametrize("bad", ["C\tD\tBAD\tD\n", "X\tY\n", "A\n", "A\tB\t1\tU\tmore\n"])
def test_bad_interactions_fail(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a line"):
        formats.interactome(spark, put(tmp_path, "A\tC\t0.75\tU\n" + bad + "C\tD\t0.5\n")).count()


@pytest.mark.parametrize("bad", ["D oops\n", "D\n", "D 1 2\n"])
def test_bad_prizes_fail(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a line"):
        formats.prizes(spark, put(tmp_path, "C 1\n" + bad + "E 2\n")).collect()


def test_headers_and_empty_files_pass(spark, tmp_path):
    assert formats.interactome(spark, put(tmp_path, "a b weight\nA B 0.5\n")).count() == 1
    assert formats.prizes(spark, put(tmp_path, "")).count() == 0
