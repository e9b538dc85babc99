import random

import pytest
from pyspark.sql import functions as F

from chromaweave.functions import scalars as S
from chromaweave.operators import graph, intervals, motifs, robust, stats, steiner
from chromaweave.plans import catalogue, pipelines
from chromaweave.sources import formats, sinks
from chromaweave.streaming import peaks as stream

SF = "/root/testdata/sf0.001"


def test_degree_penalty(spark):
    df = spark.createDataFrame([(1,), (2,)], "d int")
    for mu in (0, -1):
        with pytest.raises(ValueError):
            S.degree_penalty(F.col("d"), mu)
    assert [r[0] for r in df.select(S.degree_penalty(F.col("d"), 2)).collect()] == [0.0, -4.0]
    assert df.select(S.degree_penalty(F.col("d"), 2, True)).collect()[1][0] == -8.0


def test_range_join_equals_cross_join(spark):
    r = random.Random(0)
    points = [(r.choice("ab"), r.randrange(60000), i) for i in range(200)]
    spans = [(r.choice("ab"), lo := r.randrange(60000), lo + r.randrange(30000), i) for i in range(80)]
    p, s = spark.createDataFrame(points, "c string, at long, i int"), spark.createDataFrame(spans, "c string, lo long, hi long, j int")
    got = sorted((x.i, x.j) for x in intervals.range_join(p, s, "c", "at", "lo", "hi", 1000).collect())
    assert got == sorted((i, j) for c, at, i in points for d, lo, hi, j in spans if c == d and lo <= at <= hi)


def test_t_tail_and_bh(spark):
    assert abs(stats.incomplete_beta(2.0, 0.5, 0.5) - 0.11611652351681556) < 1e-12
    df = spark.createDataFrame([("a", 0.01, 1.0), ("b", 0.01, -2.0), ("c", 0.5, 1.0)], "motif string, p double, slope double")
    q = {r.motif: r.q for r in stats.bh_qvalues(df).collect()}
    assert q == pytest.approx({"b": 0.03, "a": 0.015, "c": 0.5})


def test_regression_against_numpy(spark):
    import numpy as np

    x = np.array([1.0, 2, 3, 5, 8]), np.array([2.0, 1, 4, 4, 9])
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(*x, strict=True)] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "k string, x double, y double")
    r = stats.regression(df, "k", "x", "y").collect()
    assert [t.k for t in r] == ["m"] and r[0].slope == pytest.approx(np.polyfit(*x, 1)[0])
    t = abs(r[0].r) * (3 / (1 - r[0].r ** 2)) ** 0.5
    grid = np.linspace(t, 2000, 4_000_000)
    density = 2 / (3**0.5 * np.pi * (1 + grid**2 / 3) ** 2)
    assert r[0].p == pytest.approx(2 * np.trapezoid(density, grid), rel=1e-4)


def test_scan_equals_join(spark):
    r = random.Random(3)
    regions = spark.createDataFrame([(i, "".join(r.choice("ACGTN" if i % 5 == 0 else "ACGT") for _ in range(r.randint(0, 60)))) for i in range(30)], "region long, seq string")
    m = catalogue.word_motifs(spark)
    key = lambda df: sorted((x.region, x.motif, x.offset, round(x.fwd, 6), round(x.rev, 6)) for x in df.collect())
    assert key(motifs.scan(regions, m, -3.0)) == key(motifs.scan_sql(regions, m, -3.0))


def test_motif_algebra(spark):
    m = motifs.from_text(spark, {"x": "ACW"})
    assert {(r.pos, r.letter) for r in motifs.revcomp(m).where("p > 0").collect()} == {(0, "A"), (0, "T"), (1, "G"), (2, "T")}
    assert motifs.consensus(m).first().consensus == "ACW"
    assert [round(r.bits, 6) for r in motifs.bits(m).orderBy("pos").collect()] == [2.0, 2.0, 1.0]
    d = motifs.distances(m, m.withColumn("motif", F.lit("y"))).first()
    assert d.euclid == d["diff"] == d.diverge == 0.0
    masked = motifs.mask(spark.createDataFrame([(1, "AACGTT")], "region long, seq string"), spark.createDataFrame([(1, 1)], "region long, offset int"), 3)
    assert masked.first().seq == "ANNNTT"


def random_instance(r):
    names = [f"n{i}" for i in range(r.randint(2, 6))]
    edges = tuple((a, b, r.random(), r.choice("UD")) for a in names for b in names if a < b and r.random() < 0.6)
    return steiner.Instance({n: r.choice([0.0, 0.3, 1.5, -0.4]) for n in names}, edges, frozenset(r.sample(names, 2)), r.choice([0.1, 0.8]), r.choice([2, 3, 5]))


def test_solver_invariants():
    r, worse = random.Random(5), 0
    for _ in range(60):
        inst = random_instance(r)
        best, found = steiner.exact(inst), steiner.heuristic(inst)
        costs = inst.parents()
        for parent in (best, found):
            assert steiner._depth_ok(parent, inst.depth) and all(p in costs[v] for v, p in parent.items())
            assert steiner.value(inst, parent, False) <= steiner.value(inst, {}, False) + 1e-9
        gap = steiner.value(inst, found, False) - steiner.value(inst, best, False)
        assert gap > -1e-9
        worse += gap > 1e-6
    assert worse <= 12
    with pytest.raises(ValueError):
        steiner.solve(steiner.Instance({}, (), frozenset(), 1.0, 0))


def test_runs_are_forests(spark):
    out = catalogue.QUERIES["steiner_lineitem"](spark, SF).collect()
    assert out and all(r.parent != r.node for r in out)


def test_robustness(spark):
    p = catalogue.prizes(spark, SF)
    s = robust.shuffle_prizes(p, 3).groupBy("run").agg(F.sum("prize").alias("s"), F.count_distinct("node").alias("n")).collect()
    assert len(s) == 3 and len({(round(r.s, 4), r.n) for r in s}) == 1
    e = catalogue.solver_edges(spark, SF)
    d = robust.noise_edges(e, 4, 0.333).join(e.withColumnRenamed("weight", "w0"), ["src", "dst", "dir"]).agg(F.avg(F.col("weight") - F.col("w0")).alias("m"), F.stddev(F.col("weight") - F.col("w0")).alias("s")).first()
    assert abs(d.m) < 0.02 and abs(d.s - 0.333) < 0.02
    t = catalogue.QUERIES["random_terminals"](spark, SF)
    assert t.groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("node").alias("d")).where("n <> d").count() == 0


def write(tmp_path, name, text):
    f = tmp_path / name
    f.write_text(text)
    return f"file://{f}"


def test_formats(spark, tmp_path):
    b = write(tmp_path, "x.bed", "#c\nchrom\tchromStart\tchromEnd\nchr1\t10\t21\tp\t5\t+\t188.760\nchr2\t1\t2\n")
    assert [(r.chrom, r.peak_loc, r.name) for r in formats.peaks(spark, b).orderBy("chrom").collect()] == [("chr1", 15, "p"), ("chr2", 1, None)]
    m = write(tmp_path, "x.xls", "# d = 300\nchr\tstart\tend\tlength\tsummit\ttags\tp\tf\tq\nchr1\t100\t200\t100\t30\t5\t1.5\t2.5\t0.1\n")
    assert formats.peaks(spark, m).first().peak_loc == 130 and formats.macs_info(spark, m).first().value == "300"
    g = write(tmp_path, "x.txt", "Position\tIP\n1:123\t5.0\n")
    assert [(r.chrom, r.start) for r in formats.peaks(spark, g).collect()] == [("chr1", -2)]
    fa = write(tmp_path, "x.fa", ">a one\nAC\nGT\n>b\nTT\n>a two\nGG\n")
    assert {r.header: r.seq for r in formats.fasta(spark, fa).collect()} == {"a": "GG", "b": "TT"}
    fq = write(tmp_path, "x.fq", "@r1\nACGT\n+\nIIII\n@r2\nA\n+\nI\n")
    assert [(r.header, r.seq, r.qual) for r in formats.fastq(spark, fq).collect()] == [("r1", "ACGT", "IIII"), ("r2", "A", "I")]
    kg = write(tmp_path, "kg.txt", "\t".join(["g", "chr1", "+", "1", "9", "1", "9", "2", "1,5,", "3,9,", "p", "a"]) + "\n")
    assert formats.known_gene(spark, kg).first().exonStarts == [1, 5]
    pr = write(tmp_path, "p.txt", "name prize\nC 1\nD 1\nC 2\n")
    assert {r.node: r.prize for r in formats.prizes(spark, pr).collect()} == {"C": 2.0, "D": 1.0}
    net = write(tmp_path, "n.txt", "a b weight\nA\tC\t0.75\tU\nC\tD\t0.25\tD\n")
    assert formats.interactome(spark, net).count() == 2
    ok = write(tmp_path, "s.sif", "A pp B\nB pd C\nC pd D\nD pd C\nA pp E\n")
    assert formats.sif(spark, ok).count() == 7 and graph.nodes(formats.sif(spark, ok)).count() == 5
    for bad in ("A dd F\n", "A dd F 0.85\n"):
        with pytest.raises(Exception, match="no SIF line"):
            formats.sif(spark, write(tmp_path, f"bad{len(bad)}.sif", "A pp B\n" + bad)).collect()
    mat = write(tmp_path, "m.tgm", "1 2\n3 4\n")
    rows, cols = (formats.ids(spark, write(tmp_path, n, t)) for n, t in (("t.txt", "x\ny\n"), ("g.txt", "g1\ng2\n")))
    assert {(r.tf, r.gene, r.score) for r in formats.dense_matrix(spark, mat, rows, cols).collect()} == {("x", "g1", 1), ("x", "g2", 2), ("y", "g1", 3), ("y", "g2", 4)}
    cfg = formats.ForestConfig.parse("w = 6\nb = 12\nD = 6\nmu = -1\n")
    assert (cfg.w, cfg.depth, cfg.mu, cfg.noise) == (6, 6, 0, 0.333)
    with pytest.raises(ValueError):
        formats.ForestConfig.parse("b = 1\nD = 5")
    motif = formats.tamo(spark, write(tmp_path, "m.tamo", "Log-odds matrix for Motif   0\n#A 1.0 -2.0\n#C 0 1\n#G 0 0\n#T 0 0\nSource: S\n"))
    assert motif.count() == 8 and motif.first().source == "S"


def test_nib(spark, tmp_path):
    seq = "ACGTNTTGCA"
    code = {"T": 0, "C": 1, "A": 2, "G": 3, "N": 4}
    body = bytes(code[a] << 4 | code[b] for a, b in zip(seq[::2], seq[1::2], strict=True))
    f = tmp_path / "c.nib"
    f.write_bytes(formats.NIB_MAGIC.to_bytes(4, "little") + len(seq).to_bytes(4, "little") + body)
    req = spark.createDataFrame([(1, 1, 4, "+"), (2, 1, 4, "-")], "request_id int, start long, end long, strand string")
    assert {r.request_id: r.seq for r in formats.nib_ranges(spark, f"file://{f}", req).collect()} == {1: "CGT", 2: "ACG"}


def test_forest_pipeline_and_sinks(spark):
    e = spark.createDataFrame([(*x,) for x in W_EDGES], "src string, dst string, weight double, dir string")
    p = spark.createDataFrame([("C", 1.0), ("D", 1.0)], "node string, prize double")
    r = spark.createDataFrame([("A",), ("B",)], "node string")
    out = pipelines.forest(e, p, r, 1.0, 5.0, 5)
    assert {(x.src, x.dst) for x in out["optimal"].collect()} == {("A", "C"), ("C", "D")}
    assert out["solution"].first().objective == pytest.approx(2.0)
    assert [tuple(x) for x in sinks.sif_lines(out["optimal"]).collect()] == [("A", "pp", "C"), ("C", "pd", "D")]
    nodes = out["nodes"].withColumn("prize", F.col("prize_total")).withColumn("terminal_type", F.lit("Proteomic"))
    assert sinks.node_attributes(nodes).count() == 3 and sinks.edge_attributes(out["augmented"]).first().Edge == "A (pp) C"
    text = sinks.fasta_lines(spark.createDataFrame([("h", "A" * 75)], "header string, seq string")).first().value
    assert text == ">h\n" + "A" * 70 + "\n" + "A" * 5


def test_stream_equals_batch(spark, tmp_path):
    pk, ge = catalogue.peaks(spark, SF), catalogue.genes(spark, SF)
    pk.write.parquet(f"file://{tmp_path}/in")
    arriving = spark.readStream.schema(pk.schema).parquet(f"file://{tmp_path}/in")
    run = stream.map_stream(arriving, ge).writeStream.format("memory").queryName("mapped").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    run.awaitTermination(120)
    got = {(r.peak_id, r.gene_id, r.map_type) for r in spark.table("mapped").collect()}
    assert got == {(r.peak_id, r.gene_id, r.map_type) for r in intervals.map_peaks(pk, ge).collect()}


# Two small graphs, their prizes, and the forests expected of them under (w, b, depth).
W_EDGES = (("A", "C", 0.75, "U"), ("B", "D", 0.75, "U"), ("C", "D", 0.25, "D"))
H_EDGES = (("A", "B", 0.9, "D"), ("A", "C", 0.9, "D"), ("A", "D", 0.9, "D"), ("A", "E", 0.9, "D"), ("B", "C", 0.1, "D"), ("D", "E", 0.1, "D"))
H_PRIZES = {"A": 5.0, "B": 6.0, "C": 6.0, "D": 6.0, "E": 6.0}
H_DEGREES = {"A": 4, "B": 2, "C": 2, "D": 2, "E": 2}
W_CASES = [
    (0.25, 5.0, 5, 1.0, "A>C B>D"), (1.0, 5.0, 5, 2.0, "A>C C>D"), (10.0, 5.0, 5, 10.0, ""), (0.0, 0.0, 5, 0.0, ""), (0.0, 0.24, 5, 0.48, ""), (0.0, 0.26, 5, 0.5, "A>C B>D"),
    (0.0, 5.0, 2, 10.0, ""), (0.0, 5.0, 3, 0.5, "A>C B>D"), (1.0, 5.0, 3, 2.5, "A>C B>D"),
]
H_CASES = [(1.0, 0.8, "B>C D>E"), (2.0, 1.4, "A>B A>C A>D A>E")]


def arcs_of(parent):
    return " ".join(sorted(f"{p}>{v}" for v, p in parent.items() if p))


def test_expected_forests():
    for w, b, depth, objective, arcs in W_CASES:
        inst = steiner.Instance({"C": b, "D": b}, W_EDGES, frozenset("AB"), w, depth)
        parent = steiner.solve(inst)
        assert (round(steiner.value(inst, parent), 6), arcs_of(parent)) == (objective, arcs)
    for b, objective, arcs in H_CASES:
        inst = steiner.Instance({k: b * v - 2 * H_DEGREES[k] for k, v in H_PRIZES.items()}, H_EDGES, frozenset("ABD"), 1.0, 5)
        parent = steiner.solve(inst)
        assert (round(steiner.value(inst, parent), 6), arcs_of(parent)) == (objective, arcs)


def test_betweenness_by_levels_equals_that_in_tasks(spark):
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    for few in (0, 100):
        assert {r.node: round(r.betweenness, 6) for r in steiner.betweenness(line, few).collect()} == {"a": 0.0, "b": 0.333333, "c": 0.333333, "d": 0.0}
    r = random.Random(7)
    arcs = spark.createDataFrame([(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(30)], "src string, dst string")
    a, b = ({x.node: round(x.betweenness, 9) for x in steiner.betweenness(arcs, few).collect()} for few in (0, 100))
    assert a == b and max(a.values()) > 0
    assert steiner.betweenness(line.where("false"), 0).count() == steiner.betweenness(line.where("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_of_folded_leaves_equals_that_in_tasks(spark, monkeypatch, seed):
    """Trees on a directed core, and a tree of its own: no level holds a pair with a leaf."""
    r = random.Random(seed)
    core = [(f"c{r.randrange(5)}", f"c{r.randrange(5)}") for _ in range(9)]
    tree = [(f"t{i}", f"t{r.randrange(i)}" if i and r.random() < 0.6 else f"c{r.randrange(5)}") for i in range(12)] + [("x", "y"), ("y", "z"), ("u", "v")]
    arcs = spark.createDataFrame(core + tree + [(b, a) for a, b in tree], "src string, dst string")
    a, b = ({x.node: round(x.betweenness, 9) for x in steiner.betweenness(arcs, few).collect()} for few in (0, 1000))
    assert a == b and max(a.values()) > 0
    names = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct()
    left, nodes, rooted = steiner._folded(names, arcs.where("src <> dst").distinct())
    assert nodes.count() <= 5 + 2 and rooted.count() == names.count() and left.where("src LIKE 't%' OR dst LIKE 't%'").count() == 0


def test_forests_by_joins_are_as_good_as_those_in_tasks(spark):
    """All runs in one table: trees within the limit, objectives as recounted, and in sum no worse than one task's."""
    r = random.Random(4)
    runs = {}
    for k in range(6):
        names = [f"n{i}" for i in range(30)]
        edges = tuple((a, b, r.random(), r.choice("UD")) for a in names for b in names if a < b and r.random() < 0.15)
        runs[k] = steiner.Instance({n: r.choice([0.0, 0.3, 1.5, -0.4]) for n in names}, edges, frozenset(r.sample(names, 8)), 0.4, 4)
    e = spark.createDataFrame([(k, *x) for k, i in runs.items() for x in i.edges], "run int, src string, dst string, weight double, dir string")
    p = spark.createDataFrame([(k, *x) for k, i in runs.items() for x in i.prizes.items()], "run int, node string, prize_total double")
    t = spark.createDataFrame([(k, x) for k, i in runs.items() for x in i.roots], "run int, node string")
    got = steiner.solve_runs(e, p, t, 0.4, 4, few=0).collect()
    assert {x.run for x in got} == set(runs)
    ours = theirs = 0.0
    for k, inst in runs.items():
        parent = {x.node: x.parent for x in got if x.run == k}
        costs = inst.parents()
        assert steiner._depth_ok(parent, 4) and all(q in costs[v] for v, q in parent.items())
        assert {round(x.objective, 6) for x in got if x.run == k} == {round(steiner.value(inst, parent), 6)}
        ours, theirs = ours + steiner.value(inst, parent, False), theirs + steiner.value(inst, steiner.heuristic(inst), False)
        assert steiner.value(inst, parent, False) <= steiner.value(inst, {}, False)
    assert ours <= theirs * 1.05
