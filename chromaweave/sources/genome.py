"""A folder of packed genome files (one nib file a sequence) as a store with random access.

A file's name without its extension is the sequence's name.  Eight bytes of header (a
mark and the number of bases) are followed by two bases a byte.  Requests are cut into
blocks, and each task seeks to the bytes of its blocks: bytes that no request touches
are never read.  Files are opened through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.functions.scalars import reverse_complement
from chromaweave.sources.formats import NIB_BASES, NIB_MAGIC

HEAD = 8
#: Bases of a block; a request touches as many blocks as it needs.
BLOCK = 1 << 16
MASKS = ("none", "soft", "hard")


def read_range(path: str, at: int, n: int) -> bytes:
    """``n`` bytes of a file from ``at`` on."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file:///") else path)
    with where.open_input_file(name) as f:
        return f.read_at(n, at)


def parse_head(head: bytes, size: int, path: str) -> tuple[int, str]:
    """Bases and byte order of a nib file of ``size`` bytes; ValueError if its mark or its size is wrong."""
    if len(head) == HEAD:
        for order in ("little", "big"):
            if int.from_bytes(head[:4], order) == NIB_MAGIC:
                n = int.from_bytes(head[4:], order)
                if HEAD + (n + 1) // 2 != size:
                    raise ValueError(f"{path} has {size} bytes, {HEAD + (n + 1) // 2} are needed for {n} bases")
                return n, order
    raise ValueError(f"{path} is no nib file")


def headers(spark: SparkSession, *folders: str, counted=None) -> DataFrame:
    """chrom, path, n_bases of all nib files in the folders, or of the files named; only their headers are read.

    Of equal names the one of the last folder stays.  ``counted`` is an accumulator of
    the bytes read.
    """
    found = None
    for k, folder in enumerate(folders):
        # Neither the listing nor the sizes need the contents, and they are not read.
        one = spark.read.format("binaryFile").option("pathGlobFilter", "*.nib").load(folder).select("path", "length", F.lit(k).alias("k"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no folder")

    def run(batches):
        for b in batches:
            paths = b.column("path").to_pylist()
            bases = []
            for path, size in zip(paths, b.column("length").to_pylist(), strict=True):
                head = read_range(path, 0, HEAD)
                if counted is not None:
                    counted.add(len(head))
                bases.append(parse_head(head, size, path)[0])
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("k"), pa.array(bases, pa.int64())], names=["path", "k", "n_bases"])

    rows = found.mapInArrow(run, "path string, k int, n_bases long")
    rows = rows.withColumn("chrom", F.regexp_extract("path", r"([^/]+)\.nib$", 1))
    return rows.groupBy("chrom").agg(F.max_by(F.struct("path", "n_bases"), F.struct("k", "path")).alias("s")).select("chrom", "s.path", "s.n_bases")


def decoded(raw: bytes, mask: str) -> np.ndarray:
    """The bases of packed bytes, as letters; soft-masked ones in lower case, or N where the mask is hard."""
    packed = np.frombuffer(raw, np.uint8)
    codes = np.empty(2 * len(packed), np.uint8)
    codes[::2], codes[1::2] = packed >> 4, packed & 15
    letters = np.frombuffer((NIB_BASES + "NNN").encode(), np.uint8)[codes & 7].copy()
    masked = codes >= 8
    if mask == "soft":
        letters[masked] |= 32
    elif mask == "hard":
        letters[masked] = ord("N")
    return letters


def _checked(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with path, n_bases and their end (-1: the sequence's); unknown names and places fail."""
    met = requests.join(store, "chrom", "left")
    end = F.when(F.col("end") == -1, F.col("n_bases")).otherwise(F.col("end"))
    told = F.format_string("%s:%s-%s", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    fail = lambda why: F.raise_error(F.concat(F.lit(why), told)).cast("bigint")
    good = F.when(F.col("path").isNull(), fail("no such sequence: ")).when((F.col("start") < 0) | (end < F.col("start")) | (end > F.col("n_bases")), fail("not inside the sequence: ")).otherwise(end)
    return met.withColumn("end", good)


def sequences(spark: SparkSession, store: DataFrame, requests: DataFrame, mask: str = "none", block: int = BLOCK, counted=None) -> DataFrame:
    """request_id, seq of (request_id, chrom, start, end, strand): bases from start to before end, counted from 0.

    An end of -1 is the sequence's end; '-' is the reverse complement.  ``mask`` is
    'none' (all in upper case), 'soft' or 'hard'.  ``block`` is even.  Each block that
    requests touch is read by the task that holds it, from the first to the last byte
    that any of its requests needs, once.  A request of no length is ''.
    """
    if mask not in MASKS or block % 2 or block < 2:
        raise ValueError(f"mask has to be one of {MASKS}, and block even")
    kind = requests.schema["request_id"].dataType.simpleString()
    known = _checked(requests, store).select("request_id", "path", "start", "end", "strand")
    last = F.floor(F.greatest(F.col("end") - 1, F.col("start")) / block)
    cut = known.select("request_id", "path", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("k"))
    cut = cut.select("request_id", "path", "k", F.greatest("start", F.col("k") * block).alias("lo"), F.least("end", (F.col("k") + 1) * block).alias("hi"))
    # What a block's requests need of it; many requests of one block are one row here.
    spans = cut.where("hi > lo").groupBy("path", "k").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))

    def run(batches):
        for b in batches:
            for path, k, first, stop in zip(*[b.column(c).to_pylist() for c in ("path", "k", "first", "last")], strict=True):
                at = first // 2
                raw = read_range(path, HEAD + at, (stop + 1) // 2 - at)
                if counted is not None:
                    counted.add(len(raw))
                letters = decoded(raw, mask)[first - 2 * at : stop - 2 * at].tobytes().decode()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([first], pa.int64()), pa.array([letters])], names=["path", "k", "first", "letters"])

    read = spans.mapInArrow(run, "path string, k long, first long, letters string")
    parts = cut.join(read, ["path", "k"], "left").select("request_id", "k", F.coalesce(F.substring("letters", (F.col("lo") - F.col("first") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), F.lit("")).alias("s"))
    joined = parts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("p")).select("request_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("_seq"))
    out = known.select("request_id", "strand").join(joined, "request_id")
    seq = F.when(F.col("strand") == "-", reverse_complement(F.col("_seq"))).otherwise(F.col("_seq"))
    return out.select(F.col("request_id").cast(kind).alias("request_id"), seq.alias("seq"))


def tiles(spark: SparkSession, store: DataFrame, tile: int = BLOCK, halo: int = 0, mask: str = "none", chroms: list[str] | None = None) -> DataFrame:
    """chrom, start, seq: whole sequences of the store as tiles with halos, for scans; ``chroms`` are read alone."""
    some = store if chroms is None else store.where(F.col("chrom").isin(chroms))
    cut = some.select("chrom", "n_bases", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bases") - 1, F.lit(0)), F.lit(tile).cast("long"))).alias("start"))
    asked = cut.select(F.struct("chrom", "start").alias("request_id"), "chrom", "start", F.least(F.col("start") + tile + halo, F.col("n_bases")).alias("end"), F.lit("+").alias("strand"))
    return sequences(spark, store, asked, mask).select("request_id.chrom", "request_id.start", "seq")


def fasta_header(path: Column, chrom: Column, start: Column, end: Column, strand: Column, n_bases: Column, name: Column | None = None, db: Column | None = None, tba: Column | None = None) -> Column:
    """The header line of a piece: its file and place, or ``name``; with ``db`` the database's, with ``tba`` the aligner's form.

    ``end`` of -1 is the sequence's end.  With ``tba`` and no ``db``, the name is left out.
    """
    none = F.lit(None).cast("string")
    db, tba = (none if x is None else x for x in (db, tba))
    to = F.when(end == -1, n_bases).otherwise(end)
    text = lambda *x: F.concat(*[y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x])
    own = text(path, ":", start, "-", to)
    own = own if name is None else F.coalesce(name, own)
    told = F.when(db.isNotNull(), text(":", db, ".", chrom, ":", start, "-", to, ":", strand, ":", n_bases)).when(tba.isNotNull(), text(tba, ".", chrom, ":", start, "-", to, " of ", n_bases)).otherwise(F.lit(""))
    return F.concat(F.lit(">"), F.when(tba.isNotNull() & db.isNull(), F.lit("")).otherwise(own), told)


def fasta_of_bed(spark: SparkSession, store: DataFrame, bed: DataFrame, mask: str = "none") -> DataFrame:
    """line, header, seq of each row of a BED table (chrom, chromStart, chromEnd, strand) with its number in ``line``."""
    asked = bed.select(F.col("line").alias("request_id"), "chrom", F.col("chromStart").alias("start"), F.col("chromEnd").alias("end"), F.coalesce("strand", F.lit("+")).alias("strand"))
    head = F.format_string(">%s:%d-%d(%s)", "chrom", "start", "end", "strand")
    return asked.select("request_id", head.alias("header")).join(sequences(spark, store, asked, mask), "request_id").select(F.col("request_id").alias("line"), "header", "seq")
