"""Readers on files that are cut at odd places: the same rows for any split size."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from chromaweave.operators import motifs, tiles
from chromaweave.sources import formats, lines, sinks

SPLITS = ["7b", "64b", "1m"]


@contextmanager
def cut_at(spark, size):
    """Splits of so many bytes, and files that are not packed together."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path / name}"


@pytest.mark.parametrize("size", SPLITS)
def test_lines_have_their_numbers(spark, tmp_path, size):
    texts = {"a.txt": "\n".join(f"line {i}" * (i % 4) for i in range(40)) + "\n", "b.txt": "", "c.txt": "one\r\ntwo\n\nlast"}
    for n, t in texts.items():
        put(tmp_path, n, t)
    with cut_at(spark, size):
        got, _ = lines.numbered_lines(spark, f"file://{tmp_path}")
        rows = {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in got.collect()}
        full, splits = lines.numbered_lines(spark, f"file://{tmp_path}", F.col("value") != "")
        kept = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in full.collect())
    want = {(n, i, x) for n, t in texts.items() for i, x in enumerate(t.replace("\r", "").split("\n")[: None if not t.endswith("\n") else -1]) if t}
    assert rows == want
    filled = {n: [x for m, _, x in sorted(want) if m == n and x] for n in texts}
    assert kept == sorted((n, i, x) for n, xs in filled.items() for i, x in enumerate(xs))
    assert size != "7b" or splits > 20


@pytest.mark.parametrize("size", SPLITS)
def test_fastq_and_lists_and_matrices(spark, tmp_path, size):
    r = random.Random(3)
    reads = [(f"r{i}", "".join(r.choice("ACGT") for _ in range(r.randint(1, 30))), "@" * 0 + "+I@"[: 1 + i % 3]) for i in range(50)]
    fq = put(tmp_path, "x.fq", "\n" + "".join(f"@{h}\n{s}\n+{h}\n{q}\n{chr(10) if i % 7 == 0 else ''}" for i, (h, s, q) in enumerate(reads)) + "@cut\nAC\n+\n")
    names = put(tmp_path, "n.txt", "".join(f"n{i}\n" if i != 5 else "\n" for i in range(20)) + "\n\n")
    cells = [[r.randint(-9, 9) for _ in range(20)] for _ in range(20)]
    mat = put(tmp_path, "m.tgm", "".join(" ".join(map(str, row)) + " \n" for row in cells))
    with cut_at(spark, size):
        assert sorted((x.header, x.seq, x.qual) for x in formats.fastq(spark, fq).collect()) == sorted(reads)
        listed = {x.row: x.id for x in formats.ids(spark, names).collect()}
        assert listed == {i: f"n{i}" if i != 5 else "" for i in range(20)}
        got = formats.dense_matrix(spark, mat, formats.ids(spark, names), formats.ids(spark, names)).collect()
        pairs = {x.row: x.id for x in formats.zipped_ids(spark, names, names).collect()}
    assert {(x.tf, x.gene): x.score for x in got} == {(listed[i], listed[j]): float(v) for i, row in enumerate(cells) for j, v in enumerate(row)}
    assert pairs[3] == "n3_n3" and len(pairs) == 20
    short = put(tmp_path, "s.txt", "a\nb\n")
    with pytest.raises(Exception, match="no row"):
        formats.zipped_ids(spark, names, short).collect()
    with pytest.raises(Exception, match="no FASTQ record"):
        formats.fastq(spark, put(tmp_path, "bad.fq", "r1\nAC\n+\nII\n")).collect()


@pytest.mark.parametrize("size", SPLITS)
def test_fasta_whole_and_in_tiles(spark, tmp_path, size):
    r = random.Random(4)
    seqs = {f"s{i}": "".join(r.choice("ACGTN") for _ in range(n)) for i, n in enumerate([0, 1, 9, 10, 11, 137, 240])}
    text = "; no record yet\nACGT\n>s5 old\nTTTT\n" + "".join(f">{h} some words\n" + "".join(s[i : i + 11] + "\n" for i in range(0, len(s), 11)) for h, s in seqs.items())
    fa = put(tmp_path, "x.fa", text)
    with cut_at(spark, size):
        assert {x.header: x.seq for x in formats.fasta(spark, fa).collect()} == seqs
        for halo in (0, 4, 25):
            got = {(x.header, x.start): x.seq for x in formats.fasta_tiles(spark, fa, 10, halo).collect()}
            assert got == {(h, i): s[i : i + 10 + halo] for h, s in seqs.items() for i in range(0, max(len(s), 1), 10)}
        ids = formats.fasta_ids(spark, fa).orderBy("line").collect()
        plain = formats.fasta_ids(spark, put(tmp_path, "p.txt", "#c\nx 1\n\n y\t2\n")).orderBy("line").collect()
    assert [x.header for x in ids] == ["s5", *seqs] and [x.header for x in plain] == ["x", "y"]


TAMO = """Log-odds matrix for Motif   0 TATA (4)
#         0         1
#A     -1.500     0.250
#C      1.000     0.000
#G      0.000    -2.000
#T      0.500     1.000
Sequence Logo
#A   9 9
Gamma: 0.20000
Evalue: 1.000e-05
Program specific score: MEME: 3.5
Source:  JASPAR MA001
Motif   0 TATA                      (Bits:  8.24  MAP:   6.53   D: 0.210   1) E:  2.000  ch:  3.00  b:   7
Threshold: 0.75
Log-odds matrix for Motif   1 C (2)
#         0
#A      0.000
#C      2.000
#G      0.000
#T      0.000
Seed   1: WGATAR
"""


@pytest.mark.parametrize("size", SPLITS)
def test_motif_files(spark, tmp_path, size):
    f = put(tmp_path, "m.tamo", TAMO)
    dump = put(tmp_path, "t.pkl", "(dp0\nS'M1'\np1\n(lp2\nF0.5\naF0.25\naF1e-3\nasS'M2'\np3\n(F1\nF2\nF3\ntp4\nsS'short'\n(lp5\nF1\nas.\n")
    with cut_at(spark, size):
        m = formats.tamo(spark, f).collect()
        fields = {x.motif: x for x in formats.tamo_fields(spark, f).collect()}
        thr = {(x.motif_id, x.thres, x.sum_, x.fp) for x in formats.motif_thresholds(spark, dump).collect()}
    assert len(m) == 12 and {(x.pos, x.letter): x.ll for x in m if x.motif == 0}[1, "G"] == -2.0 and {x.source for x in m} == {"JASPAR MA001", ""}
    a = fields[0]
    assert (a.word, a.n_seqs, a.total_bits, a.map_score, a.seed_dist, a.seed_num, a.p_value, a.church, a.n_bound, a.threshold) == ("TATA", None, 8.24, 6.53, 0.21, 1, 0.01, 0.001, 7.0, 0.75)
    assert (a.gamma, a.evalue, a.program, a.program_score, a.source, a.seed) == (0.2, 1e-5, "MEME", "3.5", "JASPAR MA001", "WGATAR") and fields[1].gamma is None
    assert thr == {("M1", 0.5, 0.25, 0.001), ("M2", 1.0, 2.0, 3.0)}


def test_motif_files_round_trip(spark, tmp_path):
    first = put(tmp_path, "m.tamo", TAMO)
    out = sinks.tamo_lines(formats.tamo(spark, first), formats.tamo_fields(spark, first))
    again = put(tmp_path, "again.tamo", "".join(x.value + "\n" for x in out.orderBy("motif").collect()))
    key = lambda p: sorted(tuple(r) for r in formats.tamo(spark, p).collect())
    assert key(again) == key(first)
    a, b = (sorted((r.asDict() for r in formats.tamo_fields(spark, p).collect()), key=lambda d: d["motif"]) for p in (first, again))
    same = ("total_bits", "map_score", "seed_dist", "seed_num", "p_value", "church", "n_bound", "threshold", "source", "gamma", "evalue", "program", "program_score", "seed")
    assert [[d[k] for k in same] for d in a] == [[d[k] for k in same] for d in b]


BED = "track name=x\nchr1\t10\t21\tp\t5\t+\nchr1\tx1\t21\tp\t5\t+\nchr2\t5\t2\nchr3\t1\nchr4\t1\t9\tq\thigh\t*\t3\t99\t0\t2\t1,2,3\t0,1\nchr5\t1\t9\tq\t7\t-\t1\t9\t0\t2\t1,2,\t0,1\n"


@pytest.mark.parametrize("size", SPLITS)
def test_bed_lines_are_checked_not_lost(spark, tmp_path, size):
    with cut_at(spark, size):
        rows = formats.bed_scan(spark, put(tmp_path, "x.bed", BED)).cache()
        bad = {(r["_line"], r.field): r.found for r in formats.quarantined(rows).collect()}
        counts = {r.field: r.n for r in formats.reject_counts(rows).collect()}
        good = formats.kept(rows).orderBy("chrom").collect()
        back = sorted(r.value for r in formats.bed_lines(formats.kept(rows)).collect())
        assert rows.count() == 6
        rows.unpersist()
    assert bad == {(2, "chromStart"): "x1", (3, "chromEnd"): "2", (4, "_fields"): "2", (4, "chromEnd"): "", (5, "score"): "high", (5, "strand"): "*", (5, "thickEnd"): "99", (5, "blockSizes"): "1,2,3"}
    assert counts["chromEnd"] == 2 and [g.chrom for g in good] == ["chr1", "chr5"]
    assert back == ["chr1\t10\t21\tp\t5\t+", "chr5\t1\t9\tq\t7\t-\t1\t9\t0\t2\t1,2,\t0,1"]


def test_scans_keep_what_does_not_cast(spark, tmp_path):
    f = put(tmp_path, "x.tsv", "a\tb\n1\tx\n2x\t\n3\n4\t5\t6\n")
    rows = formats.scanned(spark, f, "a bigint, b double").orderBy("_line").collect()
    assert [(r.a, r.b, r["_errors"], r["_line"]) for r in rows] == [(1, None, {"b": "x"}, 1), (None, None, {"a": "2x"}, 2), (3, None, {"_fields": "1"}, 3), (4, 5.0, {"_fields": "3"}, 4)]
    assert rows[1]["_raw"] == "2x\t" and formats.typed(spark, f, "a bigint, b double").where("a IS NULL").count() == 1


def sequences_of(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ACGTACGTACGTNna") for _ in range(n))) for i, n in enumerate([0, 1, 5, 63, 64, 65, 128, 1000])] + [(99, None), (100, "日本ACGTTATA😀TATAA")]
    return rows, spark.createDataFrame(rows, "region long, seq string")


@pytest.mark.parametrize("tile", [16, 64, 5000])
def test_tiles_of_any_length(spark, tile):
    rows, df = sequences_of(spark)
    assert {(r.region, r.start): r.seq for r in tiles.cut(df, "region", "seq", tile, 3).collect()} == {(i, k): s[k : k + tile + 3] if s is not None else None for i, s in rows for k in range(0, max(len(s or ""), 1), tile)}
    assert {r.region: r.seq for r in tiles.joined(tiles.cut(df, "region", "seq", tile)).collect()} == {i: s or "" for i, s in rows}
    m = motifs.from_text(spark, {"t": "TATA", "g": "GATWC"})
    key = lambda d: sorted((r.region, r.motif, r.offset, r.fwd, r.rev) for r in d.collect())
    want = key(motifs.scan(df, m, 1.0))
    assert want and key(tiles.scan_tiles(tiles.cut(df, "region", "seq", tile, 4), m, 1.0, tile)) == want
    for k in (1, 4, 5):
        for purge in (True, False):
            count = {}
            for _, s in rows:
                for j in range(len(s or "") - k + 1):
                    w = s[j : j + k]
                    if not (purge and "N" in w.upper()):
                        count[w] = count.get(w, 0) + 1
            assert {r.w: r.c for r in tiles.count_words_of_tiles(tiles.cut(df, "region", "seq", tile, k - 1), "seq", k, tile, purge).collect()} == count
            assert {r.w: r.c for r in tiles.count_words(df, "seq", k, purge).collect()} == count
    hits = spark.createDataFrame([(7, tile - 2), (7, 990), (7, 0), (5, 60), (99, 0)], "region long, offset long")
    masked = {r.region: r.seq for r in tiles.joined(tiles.mask_tiles(tiles.cut(df, "region", "seq", tile), hits, 6, tile)).collect()}
    plain = {r.region: r.seq for r in motifs.mask(df, hits.withColumn("offset", F.col("offset").cast("int")).where("region <> 99"), 6).collect()}
    cut = lambda s, n: (s or "")[:n]
    assert {i: cut(x, len(s or "")) for (i, s) in rows for x in [masked[i]]} == {i: cut(plain[i], len(s or "")) for i, s in rows}
    assert all(len(masked[i]) == len(s or "") for i, s in rows)


def test_long_words_and_a_long_sequence(spark):
    long = spark.createDataFrame([(1, "ACGT" * 200_000)], "region long, seq string")
    assert {r.w: r.c for r in tiles.count_words_of_tiles(tiles.cut(long, "region", "seq", halo=39), "seq", 40).collect()} == {("ACGT" * 11)[i : i + 40]: 200_000 - 10 + (i == 0) for i in range(4)}
    assert max(r.n for r in tiles.cut(long, "region", "seq", 1000, 10).select(F.length("seq").alias("n")).collect()) == 1010
