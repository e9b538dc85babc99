"""Readers of the domain's file formats.  All stay in Spark: text in, columns out."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.operators.ranges import running
from chromaweave.sources.lines import blocks, numbered_lines

# The formats' columns, in order, with their types.
BED = "chrom string, chromStart bigint, chromEnd bigint, name string, score double, strand string, thickStart string, thickEnd string, itemRgb string, blockCount string, blockSizes string, blockStarts string"
MACS = "chr string, start bigint, end bigint, length bigint, summit bigint, tags bigint, neg_log10_pvalue double, fold_enrichment double, fdr double"
GPS = "Position string, IP double, Control double, Fold double, q_lg10 double, p_lg10 double, IPvsEMP double, IPvsCTR double"
KNOWN_GENE = "name string, chrom string, strand string, txStart bigint, txEnd bigint, cdsStart bigint, cdsEnd bigint, exonCount int, exonStarts string, exonEnds string, proteinID string, alignID string"
REF_GENE = "bin int, name string, chrom string, strand string, txStart bigint, txEnd bigint, cdsStart bigint, cdsEnd bigint, exonCount int, exonStarts string, exonEnds string, score double, name2 string, cdsStartStat string, cdsEndStat string, exonFrames string"
KG_XREF = "kgID string, mRNA string, spID string, spDisplayID string, geneSymbol string, refseq string, protAcc string, description string"
GERALD = "machine string, run_number string, lane string, tile string, x string, y string, idx string, read_no string, read string, quality string, chromosome string, contig string, position bigint, strand string, descriptor string, single_score double, paired_score double, partner_chromosome string, partner_contig string, partner_offset string, partner_strand string, filtering string"
NIB_MAGIC = 0x6BE93D3A
NIB_BASES = "TCAGN"


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ")) for x in schema.split(",")]


def _place() -> Column:
    """Where a line stands, in an order that follows files and, inside them, lines."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def typed(spark: SparkSession, path: str, schema: str, strict: bool = False, comment: str = "#", place: str | None = None) -> DataFrame:
    """Tab-separated rows; comment lines and header rows dropped; a field that does not cast is null, or fails.

    :func:`scanned` keeps the text of what does not cast.
    """
    fields = _fields(schema)
    lines = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split("value", "\t", -1)
    header = F.get(parts, F.lit(0)) == fields[0][0]
    rows = lines.where(~header).select(parts.alias("p"), *([_place().alias(place)] if place else []))
    out = []
    for i, (name, kind) in enumerate(fields):
        raw = F.get("p", F.lit(i))
        out.append((raw.cast(kind) if strict else raw.try_cast(kind)).alias(name))
    return rows.select(*out, *([place] if place else []))


def scanned(spark: SparkSession, path: str, schema: str, comment: str = "#", least: int | None = None) -> DataFrame:
    """As :func:`typed`, with ``_errors``, a map of what is wrong with a row, and its ``_file``, ``_line`` and ``_raw`` text.

    A field that is there but does not cast is null and stands in ``_errors`` under its
    name, as it was read; an empty field is null without an error.  More fields than the
    schema has, or fewer than ``least`` (all), are an error '_fields' with their number.
    Nothing fails and nothing is dropped but comments, blank lines and header rows.
    """
    fields = _fields(schema)
    lines, _ = numbered_lines(spark, path)
    lines = lines.where(~F.col("value").startswith(comment) & (F.trim("value") != "")).withColumn("p", F.split("value", "\t", -1)).where(F.get("p", F.lit(0)) != fields[0][0])
    out, wrong = [], []
    for i, (name, kind) in enumerate(fields):
        raw = F.get("p", F.lit(i))
        out.append(raw.try_cast(kind).alias(name))
        if kind != "string":
            wrong.append(F.when((raw != "") & raw.try_cast(kind).isNull(), F.struct(F.lit(name).alias("key"), raw.alias("value"))))
    n = F.size("p")
    wrong.append(F.when((n > len(fields)) | (n < (len(fields) if least is None else least)), F.struct(F.lit("_fields").alias("key"), n.cast("string").alias("value"))))
    errors = F.map_from_entries(F.filter(F.array(*wrong), lambda x: x.isNotNull()))
    return lines.select(*out, errors.alias("_errors"), F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("value").alias("_raw"))


def kept(rows: DataFrame) -> DataFrame:
    """The rows of a scan without errors, and without its own columns."""
    return rows.where(F.size("_errors") == 0).drop("_errors", "_file", "_line", "_raw")


def quarantined(rows: DataFrame) -> DataFrame:
    """_file, _line, field, found, _raw of each error of a scan."""
    return rows.select("_file", "_line", F.explode("_errors").alias("field", "found"), "_raw")


def reject_counts(rows: DataFrame) -> DataFrame:
    """field, n: how many rows of a scan fail in each field."""
    return rows.select(F.explode(F.map_keys("_errors")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def bed_scan(spark, path) -> DataFrame:
    """BED lines of 3 to 12 fields, checked: :func:`scanned` with what the format asks of the values.

    Besides casts: 0 <= chromStart <= chromEnd, a strand of '+', '-' or '.', a score from
    0 to 1000, thick ends inside the line's, and as many block sizes and starts as
    blockCount says.  'track' and 'browser' lines are no rows.
    """
    rows = scanned(spark, path, BED, least=3).where(~F.col("_raw").rlike("^(track|browser)\\b"))
    number = lambda c: F.col(c).try_cast("bigint")
    listed = lambda c: F.size(F.filter(F.split(c, ","), lambda x: x != ""))
    told = lambda ok, name, value: F.when(~ok, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    checks = [
        told(F.col("chrom") != "", "chrom", F.col("chrom")),
        told(F.col("chromStart") >= 0, "chromStart", F.col("chromStart")),
        told(F.col("chromEnd") >= F.col("chromStart"), "chromEnd", F.col("chromEnd")),
        told(F.col("strand").isin("+", "-", ".", ""), "strand", F.col("strand")),
        told(F.col("score").between(0, 1000), "score", F.col("score")),
        *[told(~given(c) | F.coalesce(number(c).between(F.col("chromStart"), F.col("chromEnd")), F.lit(False)), c, F.col(c)) for c in ("thickStart", "thickEnd")],
        *[told(~given("blockCount") | F.coalesce(listed(c) == number("blockCount"), F.lit(False)), c, F.col(c)) for c in ("blockSizes", "blockStarts")],
    ]
    empty = [told(F.col(c).isNotNull() | F.map_contains_key("_errors", c), c, F.lit("")) for c in ("chromStart", "chromEnd")]
    found = F.map_from_entries(F.filter(F.array(*checks, *empty), lambda x: x.isNotNull() & ~F.map_contains_key("_errors", x["key"])))
    return rows.withColumn("_errors", F.map_concat("_errors", F.map_filter(found, lambda k, v: ~F.map_contains_key("_errors", k))))


def bed_lines(rows: DataFrame) -> DataFrame:
    """value: a BED line for each row, with as many fields as it has before its last nulls; earlier ones are '.', or 0 for a score."""
    names = [n for n, _ in _fields(BED)]
    text = lambda n: F.regexp_replace(F.col(n).cast("string"), r"\.0$", "") if n == "score" else F.col(n).cast("string")
    cells = [text(n) if n in rows.columns else F.lit(None).cast("string") for n in names]
    used = F.greatest(F.lit(3), *[F.when(c.isNotNull(), F.lit(i + 1)).otherwise(F.lit(0)) for i, c in enumerate(cells)])
    filled = F.array(*[F.coalesce(c, F.lit("0" if n == "score" else ".")) for n, c in zip(names, cells, strict=True)])
    return rows.select(F.array_join(F.slice(filled, F.lit(1), used), "\t").alias("value"))


def bed(spark, path):
    return typed(spark, path, BED)


def bed_strings(spark, path):
    return typed(spark, path, re.sub(r" (bigint|double|int)\b", " string", BED))


def macs(spark, path):
    """Rows of a MACS table; ``summit`` counts from ``start``."""
    rows = typed(spark, path, MACS)
    return rows.where("start IS NOT NULL")


def macs_info(spark, path) -> DataFrame:
    """(key, value) of the header's '# key = value' and '# key: value' lines."""
    head = spark.read.text(path).where(F.col("value").rlike(r"^#\s*[^=:]+[=:]"))
    return head.select(F.trim(F.regexp_extract("value", r"^#\s*([^=:]+?)\s*[=:]\s*(.*)$", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^#\s*([^=:]+?)\s*[=:]\s*(.*)$", 2)).alias("value"))


def gps(spark, path):
    """GPS rows with position split into chrom ('chr' added) and mid."""
    rows = typed(spark, path, GPS)
    return rows.withColumns({"chrom": F.concat(F.lit("chr"), F.split_part("Position", F.lit(":"), F.lit(1))), "mid": F.split_part("Position", F.lit(":"), F.lit(2)).try_cast("bigint")})


def _ints(c: str) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))


def known_gene(spark, path):
    return typed(spark, path, KNOWN_GENE, strict=True).withColumns({"exonStarts": _ints("exonStarts"), "exonEnds": _ints("exonEnds")})


def ref_gene(spark, path):
    return typed(spark, path, REF_GENE).withColumns({"exonStarts": _ints("exonStarts"), "exonEnds": _ints("exonEnds")})


def kg_xref(spark, path):
    """The last row of each kgID."""
    rows = typed(spark, path, KG_XREF, place="_n")
    return rows.groupBy("kgID").agg(F.max_by(F.struct(*[n for n, _ in _fields(KG_XREF)[1:]]), "_n").alias("s")).select("kgID", "s.*")


def gerald(spark, path):
    """22 fields or an error."""
    lines = spark.read.text(path)
    n = F.size(F.split("value", "\t", -1))
    bad = F.raise_error(F.concat(F.lit("a GERALD line has "), n.cast("string"), F.lit(" fields"))).cast("boolean")
    checked = lines.where(F.when(n != 22, bad).otherwise(F.lit(True)))
    parts = F.split("value", "\t", -1)
    return checked.select(*[F.get(parts, F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(_fields(GERALD))])


def gerald_to_bed(reads: DataFrame) -> DataFrame:
    return reads.select(F.col("chromosome").alias("chrom"), F.col("position").alias("chromStart"), (F.col("position") + F.length("read")).alias("chromEnd"), F.lit(".").alias("name"), F.col("single_score").alias("score"), F.when(F.col("strand") == "F", "+").otherwise("-").alias("strand"))


def peaks(spark, path, kind: str = "auto") -> DataFrame:
    """chrom, start, end, peak_loc, name by the file's extension: .bed, .xls (MACS) or .txt (GPS)."""
    if kind == "auto":
        kind = {"bed": "BED", "xls": "MACS", "txt": "GPS"}.get(path.rsplit(".", 1)[-1].lower(), "")
    if kind == "BED":
        b = bed(spark, path)
        return b.select("chrom", F.col("chromStart").alias("start"), F.col("chromEnd").alias("end"), F.floor((F.col("chromStart") + F.col("chromEnd")) / 2).alias("peak_loc"), "name")
    if kind == "MACS":
        m = macs(spark, path)
        return m.select(F.col("chr").alias("chrom"), "start", "end", (F.col("start") + F.col("summit")).alias("peak_loc"), F.lit(".").alias("name"))
    if kind == "GPS":
        g = gps(spark, path)
        return g.select("chrom", (F.col("mid") - 125).alias("start"), (F.col("mid") + 125).alias("end"), F.col("mid").alias("peak_loc"), F.lit(".").alias("name"))
    raise ValueError(f"unknown peak format: {path}")


def _first_word(line: Column) -> Column:
    return F.split_part(F.trim(line), F.lit(" "), F.lit(1))


def _records(spark, path, key):
    """Lines of FASTA files with the record they are in: file, block (its header's line), header, and the letters before them in it."""
    lines, splits = numbered_lines(spark, path)
    body = F.regexp_replace("value", r"\s", "")
    is_head = F.col("value").startswith(">")
    lines = lines.select("file", "_range", "line", F.when(is_head, F.lit("")).otherwise(body).alias("seq"), F.when(is_head, (key or _first_word)(F.regexp_replace(F.substring("value", 2, 1 << 30), "\r", ""))).alias("name"))
    lines = running(lines, splits, "file", ["line"], F.length("seq").cast("long"), "_before", kind="sum", strict=True)
    head = F.when(F.col("name").isNotNull(), F.struct("line", F.coalesce("_before", F.lit(0).cast("long")).alias("before"), "name"))
    lines = running(lines, splits, "file", ["line"], head, "_head").where("_head IS NOT NULL")
    return lines.select("file", F.col("_head.line").alias("block"), F.col("_head.name").alias("header"), "seq", (F.coalesce("_before", F.lit(0)) - F.col("_head.before")).alias("start"), F.col("name").isNotNull().alias("is_head"))


def _last_of_equal(records: DataFrame) -> DataFrame:
    """Lines of the last record of each header, by file and line."""
    last = records.where("is_head").groupBy("header").agg(F.max(F.struct("file", "block")).alias("_last")).select("header", "_last.*")
    return records.join(last, ["header", "file", "block"])


def fasta_tiles(spark, path, tile: int = 1 << 16, halo: int = 0, key=None) -> DataFrame:
    """header, start, seq: each sequence cut to tiles of so many letters, each with the next ``halo`` letters behind it.

    No row holds more than a tile, whatever the length of a sequence: lines get their
    place in the sequence by running sums that are carried from split to split, and
    only the lines of one tile are gathered.  A sequence without letters has one empty
    tile; of equal headers the last one is taken.  ``start`` counts from 0.
    """
    each = _last_of_equal(_records(spark, path, key))
    first = F.greatest(F.floor((F.col("start") - halo) / tile), F.lit(0))
    last = F.floor(F.greatest(F.col("start") + F.length("seq") - 1, F.col("start")) / tile)
    parts = each.where("seq <> '' OR is_head").select("header", "start", "seq", F.explode(F.sequence(first, last)).alias("t"))
    lo = F.greatest(F.col("t") * tile - F.col("start"), F.lit(0))
    hi = F.least((F.col("t") + 1) * tile + halo - F.col("start"), F.length("seq"))
    cut = F.substring(F.col("seq"), (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    parts = parts.select("header", "t", (F.col("start") + lo).alias("start"), cut.alias("s"))
    whole = parts.groupBy("header", "t").agg(F.array_sort(F.collect_list(F.struct("start", F.length("s").alias("n"), "s"))).alias("p"))
    return whole.where(F.exists("p", lambda x: x["n"] > 0) | (F.col("t") == 0)).select("header", (F.col("t") * tile).alias("start"), F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


def fasta(spark, path, key=None) -> DataFrame:
    """header, seq; the header's first token unless ``key`` (a column function) says otherwise; the last of equal headers.

    Whole sequences in a row each: for chromosomes see :func:`fasta_tiles`.
    """
    each = _last_of_equal(_records(spark, path, key))
    parts = each.groupBy("header").agg(F.array_sort(F.collect_list(F.struct("start", F.length("seq").alias("n"), "seq"))).alias("p"))
    return parts.select("header", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


def fasta_ids(spark, path) -> DataFrame:
    """header of each record in a FASTA file's order (``line``); of a file without records, the first word of each line without '#'."""
    lines, _ = numbered_lines(spark, path)
    is_head = F.col("value").startswith(">")
    kind = lines.groupBy("file").agg(F.max(is_head).alias("_fasta"))
    word = F.split_part(F.regexp_replace(F.trim("value"), r"\s+", " "), F.lit(" "), F.lit(1))
    plain = ~F.col("_fasta") & ~F.col("value").startswith("#") & (F.trim("value") != "")
    name = F.when(is_head, _first_word(F.substring("value", 2, 1 << 30))).otherwise(F.when(plain, word))
    return lines.join(kind, "file").select("file", "line", name.alias("header")).where("header IS NOT NULL")


def fastq(spark, path) -> DataFrame:
    """header, seq, qual of four-line records; blank lines are skipped, an unfinished last record goes.

    The number of a line among its file's tells its record and its part in it, wherever
    the file is split.  A record that does not begin with '@', or whose third line is no
    '+', fails.
    """
    lines, _ = numbered_lines(spark, path, F.trim("value") != "")
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    each = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(part(0).alias("h"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual")).where("qual IS NOT NULL")
    good = F.col("h").startswith("@") & F.col("plus").startswith("+")
    bad = F.raise_error(F.concat(F.lit("no FASTQ record: "), "h")).cast("string")
    return each.select(F.when(good, F.substring("h", 2, 1 << 30)).otherwise(bad).alias("header"), "seq", "qual")


def _listed(spark, path) -> DataFrame:
    """file, line, value without the blank lines at a file's end."""
    lines, _ = numbered_lines(spark, path)
    last = lines.where(F.trim("value") != "").groupBy("file").agg(F.max("line").alias("_last"))
    return lines.join(F.broadcast(last), "file").where("line <= _last")  # a row for each file


def ids(spark, path) -> DataFrame:
    """row, id of a list with one name a line."""
    return _listed(spark, path).select(F.col("line").cast("int").alias("row"), F.trim("value").alias("id"))


def zipped_ids(spark, *paths: str) -> DataFrame:
    """row, id: the names of several lists of one length, joined by '_' row by row; lists of unlike lengths fail."""
    lists = [ids(spark, p).withColumnRenamed("id", f"id{i}") for i, p in enumerate(paths)]
    out = lists[0]
    for other in lists[1:]:
        out = out.join(other, "row", "full_outer")
    names = [F.col(f"id{i}") for i in range(len(paths))]
    missing = F.raise_error(F.concat(F.lit("a list has no row "), F.col("row").cast("string"))).cast("string")
    whole = F.lit(True)
    for n in names:
        whole = whole & n.isNotNull()
    return out.select("row", F.when(whole, F.concat_ws("_", *names)).otherwise(missing).alias("id"))


def dense_matrix(spark, path, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """tf, gene, score of a whitespace matrix, named by (row, id) lists; a row of the matrix is a line, wherever the file is split."""
    cells = _listed(spark, path).select(F.col("line").cast("int").alias("i"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("j", "x"))
    named = cells.join(rows.select(F.col("row").alias("i"), F.col("id").alias("tf")), "i").join(columns.select(F.col("row").alias("j"), F.col("id").alias("gene")), "j")
    return named.select("tf", "gene", F.col("x").cast("double").alias("score"))


def _tokens(spark, path):
    """The tokens t of each line that has any, and its place _n, which orders the lines of a file however it is split."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("t"), _place().alias("_n"))


def expression(spark, path, genes: DataFrame | None = None) -> DataFrame:
    """gene, value; duplicates stay.  A file with values only is named by ``genes`` (row, id), line by line."""
    if genes is not None:
        values = _listed(spark, path).select(F.col("line").cast("int").alias("row"), F.trim("value").cast("double").alias("value"))
        return values.join(genes.select("row", F.col("id").alias("gene")), "row").select("gene", "value")
    return _tokens(spark, path).select(F.get("t", F.lit(0)).alias("gene"), F.get("t", F.lit(1)).cast("double").alias("value"))


def _failing(t: DataFrame, found: DataFrame) -> DataFrame:
    """No row of ``t``'s columns: fails if ``found``, one row, has a ``line``."""
    fail = F.raise_error(F.concat_ws(" ", F.lit("not a line of this format:"), "line")).cast("boolean")
    return found.where(F.when(F.col("line").isNotNull(), fail).otherwise(F.lit(False))).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema])


def _headless(t: DataFrame, good: Column, header: Column) -> DataFrame:
    """The lines that are ``good``; the first line of each file may be a ``header``, and any other line fails."""
    first = t.groupBy("_n.file").agg(F.min("_n").alias("_n"), F.lit(True).alias("_first")).select("_n", "_first")
    odd = t.where(~good).join(first, "_n", "left").where(F.col("_first").isNull() | ~header).agg(F.min(F.array_join("t", " ")).alias("line"))
    return t.where(good).unionByName(_failing(t, odd))


def interactome(spark, path) -> DataFrame:
    """src, dst, weight, dir of 3- or 4-column lines with a number in the third, and U or D in the fourth.

    All lines of a file have as many columns.  Its first line may be a header: as many
    columns as a line may have, and no number in the third.  Any other line fails.
    """
    third = F.get("t", F.lit(2)).try_cast("double")
    arity = F.size("t").isin(3, 4)
    good = arity & third.isNotNull() & ((F.size("t") == 3) | F.get("t", F.lit(3)).isin("U", "D"))
    body = _headless(_tokens(spark, path), good, arity & third.isNull())
    widths = body.groupBy("_n.file").agg(F.min(F.size("t")).alias("a"), F.max(F.size("t")).alias("b"), F.max_by(F.array_join("t", " "), F.size("t")).alias("line"))
    mixed = widths.where("a <> b").agg(F.min("line").alias("line"))
    body = body.unionByName(_failing(body, mixed))
    return body.select(F.get("t", F.lit(0)).alias("src"), F.get("t", F.lit(1)).alias("dst"), third.alias("weight"), F.coalesce(F.get("t", F.lit(3)), F.lit("U")).alias("dir"))


def prizes(spark, path) -> DataFrame:
    """node, prize of 2-column lines; a file's first line may be a header of two columns, other lines fail; the last of equal nodes."""
    prize = F.get("t", F.lit(1)).try_cast("double")
    two = F.size("t") == 2
    each = _headless(_tokens(spark, path), two & prize.isNotNull(), two & prize.isNull()).select(F.get("t", F.lit(0)).alias("node"), prize.alias("prize"), "_n")
    return each.groupBy("node").agg(F.max_by("prize", "_n").alias("prize"))


def node_list(spark, path) -> DataFrame:
    return _tokens(spark, path).select(F.get("t", F.lit(0)).alias("node")).distinct()


def sif(spark, path) -> DataFrame:
    """src, dst arcs: 'pp' in both directions, 'pd' in one; any other line fails."""
    t = _tokens(spark, path)
    kind = F.get("t", F.lit(1))
    bad = F.raise_error(F.concat(F.lit("no SIF line: "), F.concat_ws(" ", "t"))).cast("boolean")
    t = t.where(F.when((F.size("t") != 3) | ~kind.isin("pp", "pd"), bad).otherwise(F.lit(True)))
    a, b = F.get("t", F.lit(0)), F.get("t", F.lit(2))
    one, two = F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst"))
    return t.select(F.explode(F.when(kind == "pp", F.array(one, two)).otherwise(F.array(one))).alias("e")).select("e.*").distinct()


def annotation(spark, path) -> DataFrame:
    """species, identifier from a table with Entry, Entry name, Gene names and Organism columns."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = F.array_union(F.array("Entry", "Entry name"), F.split(F.coalesce("Gene names", F.lit("")), " "))
    return rows.select(F.col("Organism").alias("species"), F.explode(names).alias("identifier")).where("identifier <> ''").distinct()


def species_sets(identifiers: DataFrame) -> DataFrame:
    """species, identifiers: what :func:`annotation` lists, as one sorted set for each species."""
    return identifiers.groupBy("species").agg(F.array_sort(F.collect_set("identifier")).alias("identifiers"))


def motif_thresholds(spark, path) -> DataFrame:
    """motif_id, thres, sum_, fp read as text from a protocol-0 dump: nothing is unpickled."""
    lines, splits = numbered_lines(spark, path)
    name = F.regexp_extract("value", r"S'([^']+)'", 1)
    each = blocks(lines, splits, name != "")
    number = F.regexp_extract("value", r"^[a(l]*F([-+0-9.eE]+)\s*$", 1)
    rows = each.groupBy("file", "block").agg(F.max(F.when(F.col("line") == F.col("block"), name)).alias("motif_id"), F.array_sort(F.collect_list(F.when(number != "", F.struct("line", number.cast("double").alias("x"))))).alias("v"))
    value = lambda i: F.get(F.col("v.x"), F.lit(i))
    return rows.where(F.size("v") >= 3).select("motif_id", value(0).alias("thres"), value(1).alias("sum_"), value(2).alias("fp"))


#: Fields behind "Motif" lines of motif files: the mark in the text, the name, and whether the text is -log10 of the value.
TAMO_MARKS = [
    ("Bits:", "total_bits", False), ("MAP:", "map_score", False), ("E:", "p_value", True), ("Enr:", "p_value", True), ("Bi:", "binomial", True), ("ch:", "church", True), ("f:", "frac", False), ("Es:", "e_site", True), ("Eq:", "e_seq", True),
    ("mn:", "mncp", False), ("Ra:", "roc_auc", False), ("x2:", "e_chi2", True), ("cR:", "cra", False), ("Cf:", "cfrac", False), ("k:", "kellis", False), ("b:", "n_bound", False), ("nG:", "n_motif", False), ("bn:", "n_bound_motif", False),
]


def _tamo_blocks(spark, path):
    """Lines of motif files with ``motif``, the number of their 'Log-odds matrix' block in the file from 0."""
    lines, splits = numbered_lines(spark, path)
    head = F.col("value").startswith("Log-odds")
    return running(lines, splits, "file", ["line"], F.when(head, 1).otherwise(0).cast("long"), "_n", kind="sum").withColumn("motif", (F.col("_n") - 1).cast("int")).drop("_n")


def tamo(spark, path) -> DataFrame:
    """motif, source, pos, letter, ll of motif files: one 'Log-odds matrix' block a motif, a row for each letter.

    The letter's row is '#A' and numbers; the first such row of a letter in a block is
    its log odds, later ones (the logo) are not.  Blocks run over splits.
    """
    lines = _tamo_blocks(spark, path).where("motif >= 0")
    row = r"^\s*#\s*([ACGT])((?:\s+[-+]?[0-9][-+0-9.eE]*)+)\s*$"
    letters = lines.where(F.col("value").rlike(row)).groupBy("file", "motif", F.regexp_extract("value", row, 1).alias("letter")).agg(F.min_by(F.regexp_extract("value", row, 2), "line").alias("x"))
    source = lines.where(F.col("value").startswith("Source:")).groupBy("file", "motif").agg(F.max_by(F.trim(F.substring("value", 8, 1 << 20)), "line").alias("source"))
    each = letters.join(source, ["file", "motif"], "left").select("motif", F.coalesce("source", F.lit("")).alias("source"), "letter", F.posexplode(F.split(F.trim("x"), r"\s+")).alias("pos", "ll"))
    return each.select("motif", "source", "pos", "letter", F.col("ll").cast("double").alias("ll"))


def tamo_fields(spark, path) -> DataFrame:
    """One row for each motif of motif files: what stands beside the matrix, null where it is missing.

    motif, word and n_seqs, total_bits, map_score, seed_dist, seed_num and the marked
    numbers of its 'Motif' line, threshold, source, gamma, evalue, program and its
    score, family, dataset, beta, background, match_threshold, cv_error, and the text of
    the seed that seed_num names.  Values written as -log10 are given as probabilities.
    """
    lines = _tamo_blocks(spark, path)
    v = F.col("value")

    def told(pattern, kind="string", group=1):
        x = F.nullif(F.regexp_extract(v, pattern, group), F.lit(""))
        return F.max(x.try_cast(kind))

    number = r"\s+([-+0-9.eE]+)"
    marked = {}
    for mark, name, minus_log in TAMO_MARKS:
        x = F.nullif(F.regexp_extract(v, r"^Motif\s.*[\s(]" + mark + number, 1), F.lit("")).try_cast("double")
        marked.setdefault(name, []).append(F.max(F.pow(F.lit(10.0), -x) if minus_log else x))
    d = r"^Motif\s.*\sD:\s+([-+0-9.eE]+)\s+(\d+)\)"
    motif = r"^Motif\s+(\d+)\s+(\S+)(?:\s+\((\d+)\))?"
    beside = r"^fasta file:\s+(\S+)\s+beta:\s+(\S+)\s+background sequences:\s+(\S+)"
    out = lines.where("motif >= 0").groupBy("file", "motif").agg(
        told(motif, group=2).alias("word"), told(motif, "double", 3).alias("n_seqs"), *[F.coalesce(*x).alias(n) for n, x in marked.items()], told(d, "double").alias("seed_dist"), told(d, "int", 2).alias("seed_num"),
        told(r"^Threshold:\s+(\S+)", "double").alias("threshold"), told(r"^Source:\s*(.*?)\s*$").alias("source"), told(r"^Gamma:\s*(\S+)", "double").alias("gamma"), told(r"^Evalue:\s*(\S+)", "double").alias("evalue"),
        told(r"^Program specific score:\s*([^:]+?)\s*:").alias("program"), told(r"^Program specific score:[^:]+:\s*(\S+)").alias("program_score"), told(r"^Family:\s*(.*?)\s*$").alias("family"),
        told(beside).alias("dataset"), told(beside, "double", 2).alias("beta"), told(beside, group=3).alias("background"), told(r"^SVM match threshold:\s*(\S+)", "double").alias("match_threshold"), told(r"^classification error:\s*(\S+)", "double").alias("cv_error"),
    )
    seed = r"^Seed:?\s+(\d+):?\s+(\S+)"
    seeds = lines.where(v.rlike(seed)).groupBy("file", F.regexp_extract(v, seed, 1).cast("int").alias("seed_num")).agg(F.max_by(F.regexp_extract(v, seed, 2), "line").alias("seed"))
    return out.join(seeds, ["file", "seed_num"], "left").drop("file")


def nib_ranges(spark, path: str, requests: DataFrame) -> DataFrame:
    """request_id, seq of (request_id, start, end, strand) in a packed genome file; minus strands are complemented.

    The file is decoded in blocks on the executors; requests meet the blocks they touch.
    """
    from chromaweave.functions.scalars import reverse_complement

    block = 1 << 16

    def decode(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                head = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[:4], "big")
                if NIB_MAGIC not in head:
                    raise ValueError("no nib file")
                n = int.from_bytes(raw[4:8], "little" if head[0] == NIB_MAGIC else "big")
                for at in range(0, n, block):
                    part = raw[8 + at // 2 : 8 + (min(n, at + block) + 1) // 2]
                    bases = "".join(NIB_BASES[min(b >> 4 & 7, 4)] + NIB_BASES[min(b & 7, 4)] for b in part)
                    yield pd.DataFrame({"block": [at // block], "bases": [bases[: min(block, n - at)]]})

    blocks = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "block long, bases string")
    touched = requests.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("end") - F.col("block") * block, F.lit(block))
    cut = F.substring(F.col("bases"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    parts = touched.join(blocks, "block").groupBy("request_id", "strand").agg(F.array_sort(F.collect_list(F.struct("block", cut.alias("s")))).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["s"]), "")
    return parts.select("request_id", F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq).alias("seq"))


@dataclass(frozen=True)
class ForestConfig:
    """Solver parameters; w, b and depth are required."""

    w: float
    b: float
    depth: int
    mu: float = 0.0
    garnet_beta: float = 0.01
    noise: float = 0.333
    g: float = 1e-3
    r: float = 0.0
    threads: int = 1
    processes: int = 1

    @classmethod
    def parse(cls, text: str) -> ForestConfig:
        found = dict(re.findall(r"(?m)^\s*(\w+)\s*=\s*(\S+)", text))
        if missing := {"w", "b", "D"} - found.keys():
            raise ValueError(f"missing parameters: {sorted(missing)}")
        names = {"D": "depth", "garnetBeta": "garnet_beta"}
        values = {names.get(k, k): (int(v) if k in ("D", "threads", "processes") else float(v)) for k, v in found.items() if names.get(k, k) in cls.__dataclass_fields__}
        values["mu"] = max(0.0, values.get("mu", 0.0))
        return cls(**values)


@dataclass(frozen=True)
class AffinityConfig:
    """What a run from peaks to factor scores reads and how; peaks, genes and their names are required."""

    bedfile: str
    genefile: str
    xreffile: str
    fastafile: str | None = None
    windowsize: int = 2000
    tamo_file: str | None = None
    genome: str | None = None
    numthreads: int = 1
    do_network: bool = False
    tf_delimiter: str = ""
    expression_file: str | None = None
    p_threshold: float = 0.01
    q_threshold: float | None = None
    save_plot: bool = False

    @classmethod
    def parse(cls, text: str) -> AffinityConfig:
        """Sections of 'key=value' lines with '#' comments; empty values count as missing."""
        import configparser

        # The sections' keys.
        keys = {
            "bedfile": "bedfile", "genefile": "genefile", "xreffile": "xreffile", "fastafile": "fastafile", "windowsize": "windowsize", "tamo_file": "tamo_file", "genome": "genome", "numthreads": "numthreads",
            "donetwork": "do_network", "tfdelimiter": "tf_delimiter", "expressionfile": "expression_file", "pvalthresh": "p_threshold", "qvalthresh": "q_threshold", "saveplot": "save_plot",
        }
        read = configparser.ConfigParser(interpolation=None)
        read.read_string(text)
        found = {keys[k]: v.strip() for section in read.sections() for k, v in read.items(section) if k in keys and v and v.strip()}
        if missing := {"bedfile", "genefile", "xreffile"} - found.keys():
            raise ValueError(f"missing settings: {sorted(missing)}")
        kinds = {"windowsize": int, "numthreads": int, "p_threshold": float, "q_threshold": float, "do_network": lambda v: v.lower() != "false", "save_plot": lambda v: v.lower() != "false"}
        return cls(**{k: kinds.get(k, str)(v) for k, v in found.items()})


def organism_settings(*texts: str) -> dict[str, dict[str, str | int | float]]:
    """Settings of each organism (a section) from texts of 'key = value' lines; later texts override; numbers are numbers."""
    import configparser

    read = configparser.ConfigParser(interpolation=None)
    for text in texts:
        read.read_string(text)

    def number(v: str):
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    return {s: {k: number(v) for k, v in read.items(s)} for s in read.sections()}
