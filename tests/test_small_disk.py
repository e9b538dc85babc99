"""What the solver of large graphs leaves on disk, and runs in groups."""

import os
import random

from chromaweave.operators import ranges, steiner


def instances(spark, n):
    r = random.Random(9)
    e, p, t = [], [], []
    for k in range(n):
        names = [f"n{i}" for i in range(25)]
        e += [(k, a, b, r.random(), r.choice("UD")) for a in names for b in names if a < b and r.random() < 0.2]
        p += [(k, x, r.choice([0.0, 0.3, 1.5, -0.4])) for x in names]
        t += [(k, x) for x in r.sample(names, 6)]
    return [spark.createDataFrame(rows, f"run int, {c}") for rows, c in ((e, "src string, dst string, weight double, dir string"), (p, "node string, prize_total double"), (t, "node string"))]


def folders(spark):
    root = ranges.checkpoint_dir(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_only_tables_that_are_read_stay(spark):
    keep = ranges.Tables(spark)
    a, b = keep(spark.range(5)), keep(spark.range(7))
    keep.only(b)
    assert b.count() == 7 and not any(os.path.exists(f.removeprefix("file://")) for f in a.inputFiles())


def test_solved_forests_leave_no_tables_of_their_steps(spark):
    given = instances(spark, 2)
    before = folders(spark)
    got = steiner.solve_runs(*given, 0.4, 4, few=0)
    # The runs' sizes, the forests, the prizes; a table of a row for each run may be there for each turn.
    assert len(folders(spark) - before) <= 6 and got.count()


def test_runs_in_groups_have_the_same_forests(spark, monkeypatch):
    given = instances(spark, 3)
    rows = lambda: sorted(map(tuple, steiner.solve_runs(*given, 0.4, 4, few=0).collect()))
    want = rows()
    seen, solve = [], steiner._solved_by_joins

    def spy(edges, *more):
        seen.append(sorted(r.run for r in edges.select("run").distinct().collect()))
        return solve(edges, *more)

    monkeypatch.setattr(steiner, "_solved_by_joins", spy)
    monkeypatch.setattr(steiner, "GROUP_ARCS", 1)
    got = rows()
    assert seen == [[0], [1], [2]] and [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_forests_are_the_same_where_nodes_are_too_many_to_broadcast(spark, monkeypatch):
    given = instances(spark, 2)
    rows = lambda: sorted((*r[:3], round(r[3], 9)) for r in steiner.solve_runs(*given, 0.4, 4, few=0).collect())
    want = rows()
    for limit in (0, 12):  # 12: the roots are sent, the nodes that they reach are not
        monkeypatch.setattr(steiner, "BROADCAST_ROWS", limit)
        assert rows() == want


def test_roots_of_runs_without_edges_stay(spark):
    e, p, t = instances(spark, 1)
    p = p.unionByName(spark.createDataFrame([(5, "alone", 2.0)], p.schema))
    t = t.unionByName(spark.createDataFrame([(5, "alone")], t.schema))
    got = {(r.node, r.parent) for r in steiner.solve_runs(e, p, t, 0.4, 4, few=0).where("run = 5").collect()}
    assert got == {("alone", "")}
