"""Background sampling, null distributions, consensus words, guards and reports against recounts."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from chromaweave.operators import background, graph, motifs, tiles
from chromaweave.plans import pipelines
from chromaweave.sources import formats, sinks


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(1)
    chroms = {c: "".join(r.choice("AACGT" if c == "x" else "ACGGCT") for _ in range(6000)) for c in ("x", "y")}
    genes = [(c, r.randint(500, 5500)) for c in chroms for _ in range(6)]
    fore = [(i, c, s, chroms[c][s : s + n]) for i in range(40) for c in [r.choice("xy")] for n in [r.choice([20, 30])] for s in [max(0, min(5900, r.choice([g for k, g in genes if k == c]) + r.randint(-200, 200)))]]
    genome = tiles.cut(spark.createDataFrame(list(chroms.items()), "chrom string, seq string"), "chrom", "seq", 128, 40)
    return chroms, genes, fore, genome, spark.createDataFrame(genes, "chrom string, tx_start long"), spark.createDataFrame(fore, "region long, chrom string, start long, seq string")


def bin_of(s):
    return min(3, math.floor(sum(x in "GC" for x in s) / len(s) * 4)), len(s)


@pytest.mark.parametrize("times", [1, 3])
def test_background_fills_the_quotas(world, times):
    chroms, genes, fore, genome, gene_rows, rows = world
    a = background.sample(rows, gene_rows, genome, 128, bins=4, times=times, jitter=25, seed=4).collect()
    count = {}
    for r in a:
        assert r.seq == chroms[r.chrom][r.start : r.start + r.size] and bin_of(r.seq) == (r.gc, r.size)
        count[r.gc, r.size] = count.get((r.gc, r.size), 0) + 1
        near = min(abs(r.start + r.size // 2 - g) for c, g in genes if c == r.chrom)
        assert abs(near - abs(r.dist)) <= 25
    want = {}
    for _, _, _, s in fore:
        want[bin_of(s)] = want.get(bin_of(s), 0) + times
    assert count == want and {r.strand for r in a} == {"+", "-"} and len({r.proposal for r in a}) == len(a)
    drawn = {min((m - g for c, g in genes if c == k), key=lambda d: (abs(d), -d)) for _, k, s, q in fore for m in [s + len(q) // 2]}
    assert {r.dist for r in a} <= drawn


def test_background_repeats_and_says_what_is_missing(spark, world):
    _, _, _, genome, gene_rows, rows = world
    one = lambda df: sorted(map(tuple, background.sample(df, gene_rows, genome, 128, bins=4, seed=9, jitter=25).collect()))
    assert one(rows) == one(rows.repartition(7).orderBy(F.desc("region")))
    assert background.sample(rows.where("false"), gene_rows, genome, 128).count() == 0
    odd = spark.createDataFrame([(1, "x", 700, "G" * 30)], rows.schema)
    with pytest.raises(ValueError, match="1 background sequences are missing after 3 rounds"):
        background.sample(odd, gene_rows, genome, 128, bins=100, rounds=3)
    with pytest.raises(ValueError, match="chromosome with genes"):
        background.sample(odd.withColumn("chrom", F.lit("z")), gene_rows, genome, 128)


def plain_words(cols, bound):
    out = [("", 0.0)]
    for c in cols:
        out = [(w + x, s + ll) for w, s in out for x, ll in c.items()]
    return {(w, round(s, 9)) for w, s in out if s > bound}


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7])
def test_best_words_of_any_width(spark, width):
    r = random.Random(width)
    cols = [{x: r.uniform(-2, 2) for x in "ACGT"} for _ in range(width)]
    m = spark.createDataFrame([("m", i, x, 0.25, ll) for i, c in enumerate(cols) for x, ll in c.items()], "motif string, pos int, letter string, p double, ll double")
    top = sum(max(c.values()) for c in cols)
    for bound in (top - 1.5, top + 1, -100.0):
        got = {(x.word, round(x.score, 9)) for x in motifs.best_words(m, bound).collect()}
        assert got == plain_words(cols, bound)
    assert motifs.best_words(m.withColumn("t", F.lit(top - 1.5)), "t").count() == len(plain_words(cols, top - 1.5))


def test_random_and_shuffled_motifs(spark):
    widths = spark.createDataFrame([("a", 5), ("b", 2)], "motif string, width int")
    rows = motifs.random_motifs(widths, 200).collect()
    assert len(rows) == 200 * 7 * 4
    tops = [x.letter for x in rows if x.p > 0.5]
    assert len(tops) == 1400 and all(250 < tops.count(c) < 450 for c in "ACGT")
    m = motifs.from_text(spark, {"a": "ACW"})
    dealt = motifs.shuffled_letters(m, 50).collect()
    for i in range(50):
        for pos, want in ((0, [0, 0, 0, 1]), (2, [0, 0, 0.5, 0.5])):
            assert sorted(x.p for x in dealt if x.i == i and x.pos == pos) == want
    null = motifs.null_distribution(m, motifs.shuffled_letters(m, 50))
    own = {(x.pos, x.letter): x.p for x in m.collect()}
    each = []
    for i in range(50):
        d = [math.sqrt(sum((own[p, x.letter] - x.p) ** 2 for x in dealt if x.i == i and x.pos == p)) / math.sqrt(2) for p in range(3)]
        each.append(sum(d) / 3)
    n = null.first()
    assert n.n == 50 and n["mean"] == pytest.approx(statistics.mean(each)) and n.sd == pytest.approx(statistics.stdev(each))
    z = motifs.z_scores(spark.createDataFrame([("a", "b", 0.1), ("q", "b", 0.1)], "motif_a string, motif_b string, diff double"), null).collect()
    assert {x.motif_a: x.z for x in z} == {"a": pytest.approx((n["mean"] - 0.1) / n.sd), "q": None}


def test_placements_of_motifs_with_and_without_flanks(spark):
    m = motifs.from_text(spark, {"a": "ACGT", "b": "CG", "n": "NN"})
    pairs = spark.createDataFrame([("a", "b"), ("a", "n")], "motif_a string, motif_b string")
    rows = motifs.placements(m, m, pairs, 1)
    best = {(x.motif_b, x.distance): (x.value, x.strand, x.offset) for x in motifs.nearest_placements(rows).collect()}
    assert best["b", "diff"] == (0.0, "+", 1) and ("n", "maskdiff") not in best and best["n", "infomaskdiff"][0] == 1.0
    padded = {(x.motif_b, x.strand, x.offset): x["diff"] for x in motifs.placements(m, m, pairs, 1, padded=True).collect()}
    one = math.sqrt(0.75**2 + 3 * 0.25**2) / math.sqrt(2)
    assert padded["b", "+", 1] == pytest.approx(2 * one / 4)  # the two ends of a over background
    assert padded["b", "+", -1] == pytest.approx((one + 1 + 3 * one) / 5)  # G over A; C over a flank, CGT of a over flanks
    assert len(padded) == 2 * 2 * 5


def put(tmp_path, text):
    (tmp_path / "n.txt").write_text(text)
    return f"file://{tmp_path / 'n.txt'}"


@pytest.mark.parametrize("text", ["A B 0.4 U\nB C 0.4\n", "A B 0.4 X\n", "A B 0.4 U\nA B oops U\n", "A B\nA B 0.5\n", "A\nA B 0.5\n", "A B 0.4 U extra\n", "a b weight dir\nA B 0.4 U\nA B 0.5\n"])
def test_interactomes_with_bad_lines_fail(spark, tmp_path, text):
    with pytest.raises(Exception, match="not a line"):
        formats.interactome(spark, put(tmp_path, text)).collect()


@pytest.mark.parametrize("text,n", [("a b weight dir\nA B 0.4 U\nB C 0.5 D\n", 2), ("A B 0.4\n\nB C 0.5\n", 2), ("", 0)])
def test_interactomes_that_pass(spark, tmp_path, text, n):
    assert formats.interactome(spark, put(tmp_path, text)).count() == n


NET = [("a", "b", 0.9, "U"), ("b", "c", 0.8, "U"), ("a", "d", 0.6, "D"), ("d", "c", 0.5, "U"), ("c", "e", 0.7, "U"), ("e", "f", 0.7, "U")]


def network(spark):
    return spark.createDataFrame(NET, "src string, dst string, weight double, dir string")


def test_solutions_stay_in_the_network(spark):
    tree = lambda *x: spark.createDataFrame(list(x), "src string, dst string")
    got = graph.solution_edges(network(spark), tree(("b", "a"), ("a", "d"))).collect()
    assert {(r.src, r.dst, r.dir) for r in got} == {("a", "b", "U"), ("a", "d", "D")}
    for odd in (("d", "a"), ("a", "f")):
        with pytest.raises(Exception, match="the network has no edge"):
            graph.solution_edges(network(spark), tree(odd)).collect()
    with pytest.raises(ValueError, match="dummy list"):
        graph.dummy_neighbours("file", None, network(spark), spark.createDataFrame([("zz",)], "node string"))
    lost = spark.createDataFrame([(x, 1.0) for x in "tuvwxyz"], "node string, prize double")
    for f in (pipelines.forest, pipelines.replicates):
        with pytest.raises(ValueError, match="not in the network"):
            f(network(spark), lost, lost.select("node"), *([2] if f is pipelines.replicates else []), w=0.5, b=1.0, depth=4)


def test_random_terminals_are_merged_with_attributes_and_reported(spark, tmp_path):
    prizes = spark.createDataFrame([("a", 2.0), ("c", 3.0), ("e", 1.0), ("gone", 5.0)], "node string, prize double")
    out = pipelines.replicates(network(spark), prizes, prizes.select("node"), n_runs=5, w=0.2, b=1.0, depth=4, seed=3, random_terminals=True, spread=2.0)
    solved = out["solution"].collect()
    assert {r.run for r in solved} == set(range(5))
    shares = {r.node: r.fraction for r in out["nodes"].collect()}
    rows = {r.node: r for r in out["attributes"].collect()}
    degree = {n: len({b for a, b, *_ in NET if a == n} | {a for a, b, *_ in NET if b == n}) for n in "abcdef"}
    assert {n: r.fraction for n, r in rows.items()} == shares and all(r.degree == degree[n] and r.terminal == (n in "ace") and r.prize == {"a": 2.0, "c": 3.0, "e": 1.0}.get(n, 0.0) for n, r in rows.items())
    both = {(r.src, r.dst): r.fraction for r in out["with_dummy"].collect()}
    roots = {r.node: r.fraction for r in out["roots"].collect()}
    assert both == {(r.src, r.dst): r.fraction for r in out["edges"].collect()} | {("DUMMY", n): x for n, x in roots.items()}
    told = {r.run: r for r in pipelines.report(network(spark), prizes, out["solution"]).collect()}
    for run in range(5):
        arcs = [(r.parent, r.node) for r in solved if r.run == run and r.parent]
        nodes, tops = {n for x in arcs for n in x}, {r.node for r in solved if r.run == run and not r.parent}
        t = told[run]
        assert (t.terminals_given, t.terminals_known, t.terminals_found, t.nodes, t.steiner, t.roots, t.lone_roots) == (4, 3, len(nodes & set("ace")), len(nodes), len(nodes - set("ace")), len(tops), len(tops - nodes))
    text = sinks.report_lines(pipelines.report(network(spark), prizes, out["solution"])).orderBy("run").first().value
    assert text.startswith("terminals given: 4\nterminals known: 3\n")
    sinks.by_run(out["solution"], f"file://{tmp_path}/runs")
    assert spark.read.parquet(f"file://{tmp_path}/runs").where("run = 3").count() == sum(r.run == 3 for r in solved)
    out["solution"].unpersist()


def test_network_equals_keep_max_and_directed_first(spark):
    r = random.Random(11)
    rows = [(r.choice("abcdef"), r.choice("abcdef"), r.random(), r.choice("UD")) for _ in range(300)] + [("x", "y", 0.5, "U"), ("y", "x", 0.7, "U"), ("q", "p", 0.1, "D")]
    df = spark.createDataFrame(rows, "src string, dst string, weight double, dir string")
    key = lambda d: sorted((x.src, x.dst, x.dir, x.weight) for x in d.collect())
    assert key(graph.network(df)) == key(graph.directed_first(graph.keep_max(df)))
    with pytest.raises(Exception, match="U or D"):
        graph.network(df.withColumn("dir", F.lit("X"))).collect()


def test_many_proposals_of_few_sizes_are_dealt_to_tasks_and_not_broadcast(spark):
    open_ = spark.createDataFrame([(20, 2000), (30, 1)], "size int, missing long")
    distances = spark.createDataFrame([(0, 5), (1, -7), (2, 300)], "i long, dist long")
    starts = spark.createDataFrame([(0, "x", 10_000), (1, "y", 20_000)], "i long, chrom string, tx_start long")
    out = background.propose(open_, distances, starts, 3, 2, 0, 4, 10)
    rows = out.collect()
    assert {r.proposal for r in rows} == {f"0/20/{k}" for k in range(16_000)} | {f"0/30/{k}" for k in range(8)} and len(rows) == 16_008
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "Broadcast" not in plan and "REPARTITION_BY_COL" in plan
    # No row is opened to all proposals of its size.
    assert background.CHUNK < 16_000
