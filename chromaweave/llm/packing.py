"""Concatenate and cut: fixed windows over one global token stream.

Pass one tokenises each partition in order, keeps every document's offset inside
its partition and writes the tokens to the shared folder.  The partitions' token
totals (one row each) are summed up in partition order, which gives each partition
its offset in the global stream.  Pass two only reads: each document is cut where
windows end, and every piece records where it lies.  No text or token is shuffled.

The rest of the stream after the last full window is cut into windows whose
lengths are powers of two, so that nothing has to be padded there.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm.bpe import batches_by_size
from chromaweave.llm.store import give_back, materialise

SEQUENCE_LENGTH = 2048
END_ID = 1
BATCH_BYTES = 2 << 20
#: Bytes of token rows that a task holds before it writes them.
GROUP_BYTES = 32 << 20

_ENCODERS: dict = {}


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def fast_encoder(path: str):
    """The vocabulary of a ``tokenizers`` byte-level BPE file, run by tiktoken.

    Both libraries gave the same ids when they were compared on every code point, and
    tests compare them on whole documents; this one is about five times as fast.  Added
    tokens' strings get the added tokens' ids wherever a text holds them.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        if any(t[k] for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are matched as they stand only")
        byte = _byte_alphabet()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        if [model["model"]["vocab"][m.replace(" ", "")] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("the ids of merged tokens do not follow the order of the merges")
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, path: str, text: str, keep: list[str], end_id: int) -> DataFrame:
    """Pass one: ``keep`` columns, partition number, offset in the partition, count, ids.

    ``ids`` is binary: little-endian unsigned 32-bit numbers, the end id included.
    """
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("_part", T.IntegerType(), False), T.StructField("_at", T.LongType(), False), T.StructField("_n", T.LongType(), False), T.StructField("_ids", T.BinaryType(), False)]
    )

    def run(batches):
        give_back()
        bpe, part, at = fast_encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for b in batches_by_size(whole, text, BATCH_BYTES):
                ids = [(bpe.encode_to_numpy(x, allowed_special="all").astype("<u4").tobytes() if x else b"") + end for x in b.column(text).to_pylist()]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in keep] + [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                    names=[*keep, "_part", "_at", "_n", "_ids"],
                )
        give_back()

    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def tail_windows(total: int, length: int) -> list[int]:
    """Where the windows after the last full one begin, and the end of the stream."""
    at, cuts = total // length * length, []
    rest = total - at
    while rest:
        size = 1 << (rest.bit_length() - 1)
        cuts.append(at)
        at, rest = at + size, rest - size
    return [*cuts, at]


def pack(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = SEQUENCE_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    One row per piece of a document: the ``keep`` columns, ``start`` (its document's
    tokens before it), ``length``, ``ids`` (binary, little-endian unsigned 32 bit),
    ``doc_tokens``, ``sequence_id`` and ``offset`` (its place in the sequence).  Each
    document ends with ``end_id``.  A null or empty text is one piece that holds just
    that id.  Repeated rows are packed as often as they occur.  An empty table gives
    no pieces.  Input columns that are not kept are ignored; kept ones may not have
    the names of the new columns.
    """
    new = {"start", "length", "ids", "doc_tokens", "sequence_id", "offset"}
    if clash := new & set(keep):
        raise ValueError(f"kept columns have the names of new ones: {sorted(clash)}")
    spark = docs.sparkSession
    tokens = materialise(tokenise(docs, path, text, list(keep), end_id), "tokens", GROUP_BYTES)
    # One row for each partition of the input, so its number bounds what is collected and broadcast.
    totals = sorted(tuple(r) for r in tokens.groupBy("_part").agg(F.sum("_n")).collect())
    bases, total = [], 0
    for part, n in totals:
        bases.append((part, total))
        total += n
    full, cuts = total // length, tail_windows(total, length)
    base = spark.createDataFrame(bases, "_part int, _base long")
    tail = F.array(*[F.lit(x).cast("long") for x in cuts])

    def window_of(p):
        return F.when(p < full * length, F.floor(p / F.lit(length))).otherwise(F.lit(full) + F.size(F.filter(tail, lambda t: t <= p)) - 1).cast("long")

    def window_start(k):
        return F.when(k < full, k * length).otherwise(F.element_at(tail, (F.greatest(k - full, F.lit(0)) + 1).cast("int")))

    def piece(k):
        lo = F.greatest(window_start(k), F.col("_from"))
        hi = F.least(window_start(k + 1), F.col("_from") + F.col("_n"))
        return F.struct(
            (lo - F.col("_from")).alias("start"),
            (hi - lo).alias("length"),
            F.substring(F.col("_ids"), ((lo - F.col("_from")) * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"),
            k.alias("sequence_id"),
            (lo - window_start(k)).alias("offset"),
        )

    placed = tokens.join(F.broadcast(base), "_part").withColumn("_from", F.col("_base") + F.col("_at"))
    pieces = placed.select(
        *keep,
        F.col("_n").alias("doc_tokens"),
        F.explode(F.transform(F.sequence(window_of(F.col("_from")), window_of(F.col("_from") + F.col("_n") - 1)), piece)).alias("_p"),
    )
    return pieces.select(*keep, "_p.start", "_p.length", "_p.ids", "doc_tokens", "_p.sequence_id", "_p.offset")
