"""What a task holds does not grow with the table."""

import pyarrow as pa
from pyspark.sql import functions as F

from chromaweave.operators import graph, motifs, ranges, stats


def test_runs_are_dealt_to_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(ranges, "MOST_ROWS", 100)
    runs = spark.range(3000).selectExpr("id % 700 AS src", "id % 7 AS run", "'x' AS dst")
    out = graph.merge_runs(runs.unionByName(runs), ["src", "dst"], "run", F.lit(7.0))
    want = {}
    for i in range(3000):
        want.setdefault(i % 700, set()).add(i % 7)
    assert {r.src: r.fraction for r in out.collect()} == {k: len(v) / 7 for k, v in want.items()}
    assert out.rdd.getNumPartitions() == 60  # 6,000 rows
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_windows_of_a_batch_are_scored_in_blocks(spark, monkeypatch):
    m = motifs.from_text(spark, {"tata": "TATAW", "one": "G"}).withColumn("ll", F.log2((F.col("p") + 0.01) / 1.04) + 2.0)
    seqs = [(0, "GATTATAAATATATTTGN" * 9), (1, ""), (2, None), (3, "TATAA"), (4, "TATA"), (5, "CCTATATGG" * 5)]
    rows = spark.createDataFrame(seqs, "region int, seq string").coalesce(1)
    sizes = []
    monkeypatch.setattr(motifs, "WINDOWS_AT_ONCE", 1 << 18)
    whole = sorted(map(tuple, motifs.scan(rows, m, -2.0).collect()))
    assert whole
    for block in (1, 5, 64):
        scan = _scan_with_block(monkeypatch, block, rows, m, sizes)
        assert scan == whole
    assert max(sizes) <= 64


def _scan_with_block(monkeypatch, block, rows, m, sizes):
    """The scan run here, not on executors, with a small block; notes the batches' sizes."""
    monkeypatch.setattr(motifs, "WINDOWS_AT_ONCE", block)
    held = {}

    class Seen:
        schema = rows.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            held["run"] = run
            return self

    motifs.scan(Seen(), m, -2.0)
    data = rows.collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r.region for r in data], pa.int32()), pa.array([r.seq for r in data], pa.string())], names=["region", "seq"])
    out = []
    for b in held["run"]([batch]):
        sizes.append(b.num_rows)
        out += [tuple(x.values()) for x in b.to_pylist()]
    return sorted(out)


def test_p_is_made_by_as_many_tasks_as_the_groups_fill(spark):
    points = spark.range(2000).repartition(16).selectExpr("id % 40 AS g", "id % 11 AS x", "id % 7 + id % 11 AS y")
    out = stats.regression(points, "g", "x", "y")
    assert out.count() == 40 and out.where("p IS NULL").count() == 0
    known = out.where("p IS NOT NULL")
    assert known.rdd.getNumPartitions() == 1 and "Python" not in known._jdf.queryExecution().executedPlan().toString()


def test_numbering_needs_no_python_workers(spark):
    rows = spark.range(50).select((F.col("id") * 7 % 50).alias("k"))
    out = ranges.numbered(rows, ["k"])
    assert sorted(map(tuple, out.collect())) == [(i, i) for i in range(50)]
    assert "ExistingRDD" not in str(out._jdf.queryExecution().optimizedPlan()) and "PythonRDD" not in out.rdd._jrdd.rdd().toDebugString()
    assert ranges.numbered(rows.where("k < 0"), ["k"]).collect() == []
