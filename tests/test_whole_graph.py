"""The Steiner queries hand the solver the whole cleaned graph."""

import pytest

from chromaweave.operators import steiner
from chromaweave.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, runs", [("steiner_lineitem", 1), ("cross_validation", 5)])
def test_each_run_has_all_edges(spark, monkeypatch, name, runs):
    seen, solve_runs = [], steiner.solve_runs

    def spy(edges, *more):
        seen.append(edges)
        return solve_runs(edges, *more)

    monkeypatch.setattr(steiner, "solve_runs", spy)
    catalogue.QUERIES[name](spark, SF)
    columns = ["src", "dst", "weight", "dir"]
    want = sorted(tuple(r) for r in catalogue.solver_edges(spark, SF).select(*columns).collect())
    got = seen[0].collect()
    assert {r.run for r in got} == set(range(runs))
    for k in range(runs):
        assert sorted(tuple(r[c] for c in columns) for r in got if r.run == k) == want
