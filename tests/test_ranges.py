"""Global ranks, selection, sweeps and placement, against plain Python; small ranges are forced."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chromaweave.operators import intervals, ranges, robust, sequences, stats


def sizes(df):
    """Rows of each partition that has any."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_numbered_is_one_order_of_all_rows(spark, parts):
    r = random.Random(parts)
    rows = [(i, r.choice([None, "a", "b", "é", "z"]), r.choice([1.5, -2.0, None, 7.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s string, x double").repartition(5)
    got = sorted(ranges.numbered(df, [F.col("x").desc(), "id"], ranges=parts).collect(), key=lambda g: g["rank"])
    assert [g["rank"] for g in got] == list(range(500))
    assert [g["id"] for g in got] == [i for i, _, _ in sorted(rows, key=lambda t: (t[2] is None, -(t[2] or 0), t[0]))]
    grouped = ranges.numbered(df, ["id"], "k", by=["s"], start=1, ranges=parts).collect()
    for s in {t[1] for t in rows}:
        assert [g["id"] for g in sorted((g for g in grouped if g["s"] == s), key=lambda g: g["k"])] == [t[0] for t in rows if t[1] == s]
        assert sorted(g["k"] for g in grouped if g["s"] == s) == list(range(1, sum(t[1] == s for t in rows) + 1))


def test_one_key_and_copies_spread_over_all_ranges(spark):
    one = spark.range(40000).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("v"))
    out = ranges.numbered(one, ["k"], ranges=8)
    assert out.agg(F.count_distinct("rank"), F.max("rank")).first() == (40000, 39999)
    held = sizes(out)
    assert len(held) == 8 and max(held) < 3 * sorted(held)[4]


def test_numbers_repeat(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    a = ranges.numbered(df.repartition(3), ["k"], ranges=4).collect()
    b = ranges.numbered(df.repartition(6, "id"), ["k"], ranges=2).collect()
    assert sorted(a) == sorted(b)


def test_empty_tables(spark):
    none = spark.range(0).select("id", F.lit("c").alias("chrom"))
    assert ranges.numbered(none, ["id"]).count() == 0
    assert ranges.numbered(none, ["id"], by=["chrom"], ranges=3).count() == 0
    df, n = ranges.dealt(none, ["chrom", "id"], 4)
    assert n == 1 and ranges.running(df, n, "chrom", ["id"], F.col("id"), "top").count() == 0
    assert none.where(ranges.least_keys(none, F.xxhash64("id"), 5)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 5000, 19999, 20000, 30000])
def test_selection_is_exact(spark, n):
    df = spark.range(20000)
    key = F.xxhash64("id")
    got = df.where(ranges.least_keys(df, key, n)).select(key.alias("h"), "id").collect()
    every = sorted(df.select(key.alias("h"), "id").collect())
    assert sorted(got) == every[:n]


def test_selection_among_near_keys(spark):
    df = spark.createDataFrame([(x,) for x in [-(1 << 63), -5, -1, 0, 1, 2, 3, (1 << 63) - 1] + list(range(100, 9000))], "x long")
    every = sorted(r.x for r in df.collect())
    for n in (1, 2, 3, 4, 6, 7, 8, 5000, len(every) - 1, len(every)):
        assert sorted(r.x for r in df.where(ranges.least_keys(df, F.col("x"), n)).collect()) == every[:n]


def test_subsets_are_exact_and_nested(spark):
    df = spark.range(9000).withColumnRenamed("id", "k")
    small, large = ({r.k for r in sequences.random_subset(df, "k", n, 4).collect()} for n in (100, 6000))
    assert len(small) == 100 and len(large) == 6000 and small < large
    assert small == {r.k for r in df.orderBy(F.md5(F.concat_ws("/", F.col("k").cast("string"), F.lit("4")))).limit(100).collect()}


def plain_merge(rows, gap):
    out = []
    for by, lo, hi in sorted(rows):
        if out and out[-1][0] == by and lo <= out[-1][2] + gap:
            out[-1] = (by, out[-1][1], max(hi, out[-1][2]), out[-1][3] + 1)
        else:
            out.append((by, lo, hi, 1))
    return out


@pytest.mark.parametrize("parts,gap", [(1, 0), (5, 0), (12, 3)])
def test_merge_and_nearest_for_any_ranges(spark, parts, gap):
    r = random.Random(parts)
    rows = [(r.choice("xxxxy"), lo, lo + r.choice([0, 2, 9, 200 if i % 50 == 0 else 3])) for i in range(600) for lo in [r.randint(0, 3000)]] + [("x", 100, 2500), ("z", 1, 2)]
    df = spark.createDataFrame(rows, "chrom string, lo long, hi long").repartition(4)
    assert sorted(map(tuple, intervals.merge(df, "chrom", "lo", "hi", gap, ranges=parts).select("chrom", "lo", "hi", "n").collect())) == plain_merge(rows, gap)
    starts = [(r.choice("xxy"), r.randint(0, 3000)) for _ in range(40)]
    points = [(i, r.choice("xxyw"), r.choice([777, r.randint(-10, 3100)])) for i in range(800)]
    genes = spark.createDataFrame(starts, "chrom string, tx_start long")
    peaks = spark.createDataFrame(points, "peak_id long, chrom string, peak_loc long")

    def near(chrom, at):
        d = [at - s for c, s in starts if c == chrom]
        return min(d, key=lambda x: (abs(x), -x)) if d else None

    got = {(g.peak_id, g.chrom, g.dist) for g in intervals.nearest_start(peaks, genes, ranges=parts).collect()}
    assert got == {(i, c, near(c, at)) for i, c, at in points}


def test_one_chromosome_spreads(spark):
    million = spark.range(1_000_000).select(F.lit("chr1").alias("chrom"), (F.col("id") * 7919 % 1_000_003).alias("lo"))
    df, n = ranges.dealt(million.withColumn("hi", F.col("lo") + 1), ["chrom", "lo", "hi"])
    rows = [r["n"] for r in df.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert n == len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(rows) < 2 * sorted(rows)[len(rows) // 2]
    merged = intervals.merge(million.withColumn("hi", F.col("lo")), "chrom", "lo", "hi", 1)
    places = {i * 7919 % 1_000_003 for i in range(1_000_000)}
    assert merged.agg(F.sum("n"), F.count("*")).first() == (1_000_000, sum(x - 1 not in places for x in places))


def probe(wanted, n):
    """Occupied ranks by first free rank, one terminal after another; and by a queue in the order of ranks."""
    used = set()
    for w, _, _ in wanted:
        while w in used:
            w = (w + 1) % n
        used.add(w)
    return used


@pytest.mark.parametrize("parts", [1, 4])
def test_placement_takes_the_next_free_ranks(spark, parts):
    r = random.Random(9)
    n, rows = 60, []
    for run, m in enumerate([1, 10, 30, 59, 60]):
        rows += [(run, float(i), r.choice([58, 59, 57, r.randrange(n)]), f"{r.random()}") for i in range(m)]
    df = spark.createDataFrame(rows, "run int, prize double, rank long, o string")
    got = [tuple(g) for g in robust.place(df, n, parts).select("run", "prize", "rank").collect()]
    for run in range(5):
        mine = [(w, o, p) for q, p, w, o in rows if q == run]
        ranks = [k for q, _, k in got if q == run]
        assert len(ranks) == len(set(ranks)) == len(mine) and set(ranks) == probe(mine, n)
        # Nobody stands before those that wanted an earlier rank, seen from the first rank without a queue.
        want = {p: w for w, _, p in mine}
        if len(mine) < n:
            free = next(k for k in range(n) if k not in set(ranks))
            after = lambda k: (k - free - 1) % n  # noqa: E731, B023
            order = sorted((after(k), after(want[p])) for q, p, k in got if q == run)
            assert [w for _, w in order] == sorted(w for _, w in order) and all(k >= w for k, w in order)
    with pytest.raises(Exception, match="more terminals"):
        robust.place(spark.createDataFrame([(0, 1.0, 0, "a"), (0, 2.0, 0, "b")], "run int, prize double, rank long, o string"), 1).collect()


def test_q_values_without_a_global_task(spark):
    r = random.Random(2)
    rows = [(f"m{i}", r.choice([0.01, 0.2, None, r.random()]), r.uniform(-1, 1)) for i in range(300)]
    got = {g.motif: g.q for g in stats.bh_qvalues(spark.createDataFrame(rows, "motif string, p double, slope double")).collect()}
    known = sorted((p, -abs(s), m) for m, p, s in rows if p is not None)
    assert got == {m: pytest.approx(min(1.0, len(known) * p / (i + 1))) for i, (p, _, m) in enumerate(known)}


def test_runs_of_noise_and_shuffles(spark):
    e = spark.createDataFrame([(f"a{i}", f"b{i}", "U", 0.5) for i in range(2000)], "src string, dst string, dir string, weight double")
    got = robust.noise_edges(e, 3, 2.0).agg(F.avg("weight"), F.stddev("weight"), F.count_distinct("weight")).first()
    assert abs(got[0] - 0.5) < 0.1 and abs(got[1] - 2) < 0.1 and got[2] == 6000
    p = spark.createDataFrame([(f"n{i}", float(i)) for i in range(200)], "node string, prize double")
    out = robust.shuffle_prizes(p, 3).collect()
    for run in range(3):
        assert Counter(r.prize for r in out if r.run == run) == Counter(float(i) for i in range(200)) and len({r.node for r in out if r.run == run}) == 200
    assert len({tuple(sorted((r.node, r.prize) for r in out if r.run == run)) for run in range(3)}) == 3


def test_a_backward_sweep_is_linear(spark):
    """One range of many rows: a frame that is read anew for each row takes minutes here."""
    df = spark.range(200_000, numPartitions=2).select(F.lit("c").alias("chrom"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("start"), F.lit(0).alias("_range"))
    start = time.monotonic()
    out = ranges.running(df, 1, "chrom", ["id"], F.col("start"), "next", kind="min", backward=True)
    after = ranges.running(df, 1, "chrom", ["id"], F.col("start"), "next", kind="min", strict=True, backward=True)
    assert out.where("next <> ceil(id / 3) * 3").count() == 0 and out.where("next IS NULL").count() == 200_000 - 1 - 199_998
    assert after.where("next <> (floor(id / 3) + 1) * 3").count() == 0
    assert time.monotonic() - start < 60


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """A given number of ranges is the least one, and a group of many rows stays in its ranges."""
    monkeypatch.setattr(ranges, "MOST_ROWS", 50)
    written, settled = [], ranges.settled
    monkeypatch.setattr(ranges, "settled", lambda df: written.append(settled(df)) or written[-1])
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 == 0, "few").alias("s"))
    out = ranges.numbered(df, ["id"], "k", by=["s"], ranges=2)
    assert {(r.id, r.k) for r in out.collect()} == {(i, i // 4) if i % 4 == 0 else (i, i - i // 4 - 1) for i in range(1000)}
    assert max(sizes(written[0])) <= 150
    assert ranges.dealt(df, ["id"], 2)[1] > 10
