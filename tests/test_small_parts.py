"""Every small part by itself, against values worked out by hand or in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chromaweave.functions import scalars
from chromaweave.operators import graph, intervals, motifs, sequences, stats
from chromaweave.sources import formats, sinks


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path / name}"


def values(m):
    return {(r.motif, r.pos, r.letter): (round(r.p, 9), round(r.ll, 9)) for r in m.collect()}


def motif(spark, rows):
    """Long form from {motif: [{letter: p}]}; log odds against a quarter."""
    return spark.createDataFrame([(n, i, x, float(c.get(x, 0.0)), math.log2(c[x]) + 2 if c.get(x) else -98.0) for n, cols in rows.items() for i, c in enumerate(cols) for x in "ACGT"], "motif string, pos int, letter string, p double, ll double")


EVEN = dict.fromkeys("ACGT", 0.25)
SURE = {"A": 1.0}


def test_motif_edges_and_parts(spark):
    m = motif(spark, {"m": [EVEN, SURE, {"C": 0.5, "G": 0.5}, EVEN]})
    assert sorted({r.pos for r in motifs.trimmed(m).collect()}) == [0, 1] and values(motifs.trimmed(m))["m", 0, "A"] == (1.0, 2.0)
    assert values(motifs.slice_motif(m, 1, 3)).keys() == {("m", i, x) for i in (0, 1) for x in "ACGT"}
    quiet = values(motifs.denoise(m, 1.5))
    assert quiet["m", 2, "C"] == (0.25, 0.0) and quiet["m", 1, "A"] == (1.0, 2.0)
    both = motif(spark, {"a": [SURE], "b": [{"C": 1.0}]})
    mean = values(motifs.average(both, spark.createDataFrame([("a", 3.0), ("b", 1.0)], "motif string, weight double"), "ab"))
    assert mean["ab", 0, "A"] == (0.75, round(math.log2(3), 9)) and mean["ab", 0, "C"] == (0.25, 0.0)
    moved = values(motifs.new_background(m, {"A": 0.5, "C": 0.25, "G": 0.125, "T": 0.125}))
    assert moved["m", 1, "A"] == (1.0, 1.0) and moved["m", 2, "G"] == (0.5, 2.0)
    back = values(motifs.from_ll(m.drop("p")))
    assert back["m", 1, "A"] == (1.0, 2.0) and back["m", 0, "T"] == (0.25, 0.0)


def test_motifs_from_counts_with_pseudocounts(spark):
    counts = spark.createDataFrame([("m", i, x, float(n)) for i, col in enumerate([(8, 0, 0, 0), (2, 2, 0, 0)]) for x, n in zip("ACGT", col, strict=True)], "motif string, pos int, letter string, n double")
    got = values(motifs.from_counts(counts, beta=0.5))
    # The second column has half of the first one's counts: the rest is background.
    assert got["m", 0, "A"][0] == round((1 + 0.125) / 1.5, 9) and got["m", 1, "A"][0] == round((3 / 8 + 0.125) / 1.5, 9) and got["m", 1, "T"][0] == round((1 / 8 + 0.125) / 1.5, 9)
    soft = values(motifs.with_pseudocounts(motif(spark, {"m": [SURE]}), 1.0))
    assert soft["m", 0, "A"] == (0.625, round(math.log2(2.5), 9)) and soft["m", 0, "C"] == (0.125, -1.0)


def test_backgrounds_are_found_from_log_odds(spark):
    r = random.Random(5)
    bg = {"A": 0.3, "T": 0.3, "C": 0.2, "G": 0.2}
    cols = []
    for _ in range(6):
        p = [r.uniform(0.05, 1) for _ in "ACGT"]
        cols.append({x: v / sum(p) for x, v in zip("ACGT", p, strict=True)})
    rows = [("m", i, x, math.log2(c[x] / bg[x])) for i, c in enumerate(cols) for x in "ACGT"] + [("flat", 0, x, 0.0) for x in "ACGT"]
    odds = spark.createDataFrame(rows, "motif string, pos int, letter string, ll double")
    found = {(x.motif, x.letter): round(x.bg, 9) for x in motifs.inferred_background(odds).collect()}
    assert found == {("m", x): v for x, v in bg.items()} | {("flat", x): 0.25 for x in "ACGT"}
    assert {(x.pos, x.letter): round(x.p, 9) for x in motifs.from_odds(odds).where("motif = 'm'").collect()} == {(i, x): round(c[x], 9) for i, c in enumerate(cols) for x in "ACGT"}


def test_names_of_sources_and_clusters(spark):
    texts = ["Homo\tx\tTp53;Mouse\ty\tFoxA-1;z", "A;a;B.C;Species: all;Delta", "", "one two;x\ty\tnf1"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").orderBy("i").select(scalars.source_names(F.col("s")).alias("n")).collect()]
    assert got == ["TP53.Z", "A", "", "NF1"]
    clusters = {"B.A.B": "A.B", "V$X.Q": "Q", "V$X.V$Y": "V$X.V$Y"}
    rows = spark.createDataFrame([(k,) for k in clusters], "c string").select("c", scalars.clean_cluster(F.col("c")).alias("n")).collect()
    assert {r.c: r.n for r in rows} == clusters
    assert spark.range(1).select(scalars.nlog10(F.lit(0.001)).alias("x")).first().x == pytest.approx(3.0)


def test_p_values_and_orders(spark):
    df = spark.createDataFrame([(0.25, 10.0), (0.0, 5.0), (1.0, 9.0), (0.5, 2.0), (None, 9.0), (0.9, 3.0), (0.04, 1000.0)], "r2 double, n double")
    got = [r.p for r in df.select(stats.t_two_sided("r2", "n").alias("p")).collect()]
    assert got[0] == pytest.approx(0.1411132812, abs=1e-9) and got[1:5] == [1.0, 0.0, None, None]
    # One degree of freedom: 1 - 2 / pi * atan(t); t = 3.
    assert got[5] == pytest.approx(1 - 2 / math.pi * math.atan(3), abs=1e-12) and 0 < got[6] < 1e-9
    x = [1.0000000000001, 123456789.0123456, -0.1, 0.0]
    assert [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(stats.significant(F.col("x")).alias("y")).collect()] == [float(f"{v:.11e}") for v in x]
    rows = spark.createDataFrame([("b", 0.1, 1.0), ("a", 0.1, -1.00000000000001), ("c", 0.1, 2.0), ("d", 0.01, 0.1)], "motif string, p double, slope double")
    assert [r.motif for r in stats.ordered_results(rows).collect()] == ["d", "c", "a", "b"]


def test_edges_are_counted(spark):
    e = spark.createDataFrame([("a", "b", -0.1, "U"), ("b", "b", 0.5, "U"), ("c", "a", 1.2, "D"), ("c", "d", 0.4, "U")], "src string, dst string, weight double, dir string")
    assert tuple(graph.edge_warnings(e, ["a"]).first()) == (1, 1, 1, 4, 2) and tuple(graph.edge_warnings(e).first()) == (1, 1, 1, 4)
    assert tuple(graph.excluded_nodes(spark.createDataFrame([("a",), ("a",), ("zz",)], "node string"), e).first()) == (2, 1)
    m = spark.createDataFrame([("t", "g", 0.9), ("t", "h", 0.9), ("u", "g", 0.1)], "tf string, gene string, score double")
    assert [(r.src, r.dst) for r in graph.factor_network(m, expressed=spark.createDataFrame([("g",)], "gene string")).collect()] == [("t", "gmrna")]


def test_peaks_need_symbols_where_asked(spark):
    genes = spark.createDataFrame([("c", "g1", 1000, 2000, "+"), ("c", "g2", 9000, 9500, "-")], "chrom string, gene_id string, tx_start long, tx_end long, strand string")
    peaks = spark.createDataFrame([("c", 1, 990)], "chrom string, peak_id int, peak_loc long")
    names = spark.createDataFrame([("g1", "ONE")], "gene_id string, symbol string")
    assert intervals.map_peaks(peaks, genes, xref=names).first().symbol == "ONE"
    with pytest.raises(Exception, match="no symbol for gene g2"):
        intervals.map_peaks(spark.createDataFrame([("c", 1, 9510)], peaks.schema), genes, xref=names).collect()
    regions = spark.createDataFrame([("h1", "c:5", "AC"), ("h2", "c:9", "GT")], "header string, key string, seq string")
    mapped = spark.createDataFrame([("c:5", "old", 1), ("c:5", "new", 2), ("c:7", "x", 3)], "key string, gene string, row_no int")
    assert [tuple(r) for r in sequences.reduce_regions(regions, mapped).collect()] == [("h1 new", "new", "AC")]
    only = spark.createDataFrame([("old",)], "gene string")
    assert [r.gene for r in sequences.reduce_regions(regions, mapped, only).collect()] == ["old"]


def test_tables_of_genes_and_reads(spark, tmp_path):
    kg = put(tmp_path, "x.txt", "".join("\t".join([k, "m", "s", "d", sym, "r", "p", "t"]) + "\n" for k, sym in (("k1", "OLD"), ("k2", "B"), ("k1", "NEW"))))
    assert {r.kgID: r.geneSymbol for r in formats.kg_xref(spark, kg).collect()} == {"k1": "NEW", "k2": "B"}
    ref = put(tmp_path, "r.txt", "\t".join(["1", "NM_1", "chr1", "+", "10", "90", "10", "90", "2", "10,50,", "20,90,", "0", "SYM", "cmpl", "cmpl", "0,1,"]) + "\n")
    r = formats.ref_gene(spark, ref).first()
    assert (r.name2, r.txEnd, r.exonEnds) == ("SYM", 90, [20, 90])
    g = put(tmp_path, "g.txt", "\t".join(["m", "1", "2", "3", "4", "5", "0", "1", "ACGT", "IIII", "chr1", "", "100", "F", "4", "33.5", "0", "", "", "", "", "Y"]) + "\n")
    reads = formats.gerald(spark, g)
    assert tuple(formats.gerald_to_bed(reads).first()) == ("chr1", 100, 104, ".", 33.5, "+")
    with pytest.raises(Exception, match="has 2 fields"):
        formats.gerald(spark, put(tmp_path, "bad.txt", "a\tb\n")).collect()
    assert formats.bed_strings(spark, put(tmp_path, "b.bed", "chr1\tx\t2\n")).first().chromStart == "x"
    ann = put(tmp_path, "a.tsv", "Entry\tEntry name\tGene names\tOrganism\nP1\tA_H\tTP53 P53\tHuman\nP2\tB_M\t\tMouse\n")
    sets = {x.species: x.identifiers for x in formats.species_sets(formats.annotation(spark, ann)).collect()}
    assert sets == {"Human": ["A_H", "P1", "P53", "TP53"], "Mouse": ["B_M", "P2"]}
    assert {x.node for x in formats.node_list(spark, put(tmp_path, "n.txt", "a\nb\na\n\n")).collect()} == {"a", "b"}
    genes = formats.ids(spark, put(tmp_path, "ids.txt", "g1\ng2\n"))
    assert {(x.gene, x.value) for x in formats.expression(spark, put(tmp_path, "y.txt", "1.5\n-2\n"), genes).collect()} == {("g1", 1.5), ("g2", -2.0)}


CONFIG = "# a comment\n[chromatinData]\nbedfile=p.bed\ngenefile=g.txt\nxreffile=x.txt\nwindowsize=\n[motifData]\ntamo_file=m.tamo\nnumthreads=4\ndoNetwork=False\ntfDelimiter=.\n[expressionData]\npvalThresh=0.05\nqvalThresh=\n[regression]\nsavePlot=True\n"


def test_configurations():
    c = formats.AffinityConfig.parse(CONFIG)
    assert (c.bedfile, c.windowsize, c.numthreads, c.do_network, c.tf_delimiter, c.p_threshold, c.q_threshold, c.save_plot, c.fastafile) == ("p.bed", 2000, 4, False, ".", 0.05, None, True, None)
    with pytest.raises(ValueError, match="xreffile"):
        formats.AffinityConfig.parse(CONFIG.replace("xreffile=x.txt\n", ""))
    found = formats.organism_settings("[hg18]\ngenome_dir = /a\nsize = 3\n[mm9]\nx = 1.5\n", "[hg18]\ngenome_dir = /b\n")
    assert found == {"hg18": {"genome_dir": "/b", "size": 3}, "mm9": {"x": 1.5}}


def test_what_is_written(spark, tmp_path):
    m = spark.createDataFrame([("t1", "b", 0.12345), ("t1", "a", 1.0), ("t2", "b", -0.5)], "tf string, gene string, score double")
    assert {r.tf: r.value for r in sinks.score_rows(m).collect()} == {"t1": "1.000\t0.123", "t2": "0.000\t-0.500"}
    sinks.matrix_bundle(m, f"file://{tmp_path}/bundle")
    assert sorted(map(tuple, sinks.read_bundle(spark, f"file://{tmp_path}/bundle").collect())) == sorted(map(tuple, m.collect()))
    sinks.score_table(spark.createDataFrame([("z", 1.5), ("a", 2.0)], "tf string, score double"), f"file://{tmp_path}/scores")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/scores").collect()) == ["a\t2.0", "z\t1.5"]
    results = spark.createDataFrame([("m", 1.0, 0.1, 0.2)], "motif string, slope double, p double, q double")
    assert sinks.regression_table(results).columns == ["Motif", "Slope", "p-val", "q-val"]
    assert [r.value for r in sinks.attribute_lines(spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int"), "k", "v").collect()] == ["a = 1", "b = 2"]
    assert [r.value for r in sinks.numbered_fasta_lines(spark.createDataFrame([(3, "AC")], "n int, seq string"), "n").collect()] == [">3\nAC"]


def test_a_motif_with_one_score_for_all_genes_keeps_its_row(spark, monkeypatch):
    """On large tables each gene has a peak with the best window: the SQL then gives NaN, not no row."""
    from pyspark.sql import functions as F

    from chromaweave.plans import scale

    results = spark.createDataFrame([("b", 2.0, 0.5)], "motif string, slope double, r double")
    points = spark.createDataFrame([("a", 6), ("b", 6)], "motif string, n long")
    monkeypatch.setattr(scale, "peak_run", lambda *_: {"results": results, "points": points})
    got = {r.motif: r for r in scale.peaks_to_regression(spark, "").withColumn("none", F.isnan("slope")).collect()}
    assert got["a"].none and got["a"].n == 6 and got["a"].r2 is None
    assert (got["b"].slope, got["b"].n, got["b"].r2) == (2.0, 6, 0.25)
