"""The genome store against plain slices, and how many bytes it reads."""

import random

import pytest
from pyspark.sql import functions as F

from chromaweave.sources import formats, genome

CODE = {"T": 0, "C": 1, "A": 2, "G": 3, "N": 4}


def nib(seq, order="little"):
    """Packed bytes of a sequence; lower-case letters are masked."""
    codes = [CODE[x.upper()] | (8 if x.islower() else 0) for x in seq] + [0] * (len(seq) % 2)
    return formats.NIB_MAGIC.to_bytes(4, order) + len(seq).to_bytes(4, order) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))


@pytest.fixture
def store(spark, tmp_path):
    r = random.Random(6)
    seqs = {n: "".join(r.choice("ACGTNacgt") for _ in range(k)) for n, k in (("chr1", 1001), ("chr2", 64), ("chrE", 0))}
    for i, (n, s) in enumerate(seqs.items()):
        (tmp_path / f"{n}.nib").write_bytes(nib(s, ("little", "big")[i % 2]))
    (tmp_path / "notes.txt").write_text("no genome")
    return seqs, f"file://{tmp_path}", tmp_path


def reverse(s):
    return s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


def test_headers_are_checked(spark, store, tmp_path):
    seqs, folder, _ = store
    rows = genome.headers(spark, folder).collect()
    assert {r.chrom: r.n_bases for r in rows} == {n: len(s) for n, s in seqs.items()}
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "chr2.nib").write_bytes(nib("ACG"))
    both = genome.headers(spark, folder, f"{folder}/more")
    assert {r.chrom: r.n_bases for r in both.collect()} == {"chr1": 1001, "chr2": 3, "chrE": 0}
    for name, data in (("bad", b"\0" * 12), ("short", nib("ACGTAC")[:-1]), ("tiny", b"ab")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.nib").write_bytes(data)
        with pytest.raises(Exception, match="no nib file|bytes"):
            genome.headers(spark, f"{folder}/{name}").collect()


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_requests_equal_slices_and_read_what_they_touch(spark, store, block):
    seqs, folder, _ = store
    r = random.Random(block)
    asked = [(i, c, *sorted((r.randint(0, len(seqs[c])), r.randint(0, len(seqs[c])))), r.choice("+-")) for i in range(60) for c in [r.choice(list(seqs))]]
    asked += [(100, "chr1", 0, -1, "+"), (101, "chrE", 0, -1, "-"), (102, "chr2", 63, 64, "+")]
    df = spark.createDataFrame(asked, "request_id long, chrom string, start long, end long, strand string")
    heads = genome.headers(spark, folder)
    want = {}
    for i, c, a, b, s in asked:
        piece = seqs[c][a : len(seqs[c]) if b == -1 else b]
        want[i] = reverse(piece) if s == "-" else piece
    soft = {x.request_id: x.seq for x in genome.sequences(spark, heads, df, "soft", block).collect()}
    assert soft == want
    assert {x.request_id: x.seq for x in genome.sequences(spark, heads, df, "none", block).collect()} == {i: s.upper() for i, s in want.items()}
    hard = {x.request_id: x.seq for x in genome.sequences(spark, heads, df, "hard", block).collect()}
    assert hard == {i: "".join("N" if x.islower() else x for x in s) for i, s in want.items()}
    counted = spark.sparkContext.accumulator(0)
    few = spark.createDataFrame([(1, "chr1", 500, 510, "+"), (2, "chr1", 505, 512, "-"), (3, "chr2", 3, 4, "+")], df.schema)
    assert len(genome.sequences(spark, heads, few, "none", block, counted).collect()) == 3
    # 500-512 lies over a border of blocks of 16 bases, which falls on a whole byte.
    assert counted.value == 6 + 1


def test_requests_outside_fail(spark, store):
    _, folder, _ = store
    heads = genome.headers(spark, folder)
    for bad in (("chr9", 0, 1), ("chr2", 0, 65), ("chr2", -1, 3), ("chr2", 9, 3)):
        with pytest.raises(Exception, match="no such sequence|not inside"):
            genome.sequences(spark, heads, spark.createDataFrame([(1, *bad, "+")], "request_id long, chrom string, start long, end long, strand string")).collect()


def test_tiles_headers_and_bed(spark, store):
    seqs, folder, _ = store
    heads = genome.headers(spark, folder)
    got = {(x.chrom, x.start): x.seq for x in genome.tiles(spark, heads, 50, 7, "soft").collect()}
    assert got == {(c, k): s[k : k + 57] for c, s in seqs.items() for k in range(0, max(len(s), 1), 50)}
    assert {x.chrom for x in genome.tiles(spark, heads, 50, chroms=["chr2"]).collect()} == {"chr2"}
    bed = spark.createDataFrame([(0, "chr1", 5, 9, "-"), (1, "chr2", 0, 4, None)], "line long, chrom string, chromStart long, chromEnd long, strand string")
    assert [(x.header, x.seq) for x in genome.fasta_of_bed(spark, heads, bed, "soft").orderBy("line").collect()] == [(">chr1:5-9(-)", reverse(seqs["chr1"][5:9])), (">chr2:0-4(+)", seqs["chr2"][:4])]
    one = spark.createDataFrame([("/g/chr1.nib", "chr1", 3, -1, "+", 50)], "path string, chrom string, start long, end long, strand string, n long")
    base = [F.col(c) for c in ("path", "chrom", "start", "end", "strand", "n")]
    rows = one.select(
        genome.fasta_header(*base).alias("a"), genome.fasta_header(*base, name=F.lit("mine")).alias("b"), genome.fasta_header(*base, db=F.lit("hg")).alias("c"), genome.fasta_header(*base, tba=F.lit("t")).alias("d"),
    ).first()
    assert tuple(rows) == (">/g/chr1.nib:3-50", ">mine", ">/g/chr1.nib:3-50:hg.chr1:3-50:+:50", ">t.chr1:3-50 of 50")
