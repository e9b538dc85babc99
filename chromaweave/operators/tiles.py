"""Long sequences as tiles: (name, start, seq) blocks, each with a halo of the letters that follow.

A window of ``width`` letters that begins in a tile's own letters lies whole in the tile
if its halo has width - 1.  So each window is met once, in the tile where it begins, and
work on tiles gives what work on whole sequences gives, for any tile length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweave.operators import motifs

TILE = 1 << 16


def cut(seqs: DataFrame, name: str, seq: str, tile: int = TILE, halo: int = 0) -> DataFrame:
    """``name``, start, ``seq`` of whole sequences cut to tiles, in one pass over each; ``halo`` is at most a tile.

    A sequence without letters is one empty tile, a null one a null tile.  Files of long
    sequences are better read as tiles at once (``formats.fasta_tiles``).
    """
    if halo > tile:
        raise ValueError("a halo longer than a tile")
    pieces = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{tile}}}"), 0)
    pieces = F.when(F.length(seq) > tile, pieces).otherwise(F.array(seq))
    # Never empty, but said to be outer: else a filter on the array is inferred, and what makes the letters is run again for it.
    each = seqs.select(name, pieces.alias("_p")).select(name, "_p", F.posexplode_outer("_p").alias("_i", "_s"))
    whole = F.concat("_s", F.coalesce(F.substring(F.get("_p", F.col("_i") + 1), 1, halo), F.lit(""))) if halo else F.col("_s")
    return each.select(name, (F.col("_i").cast("long") * tile).alias("start"), whole.alias(seq))


def own_windows(seq: Column, k: int, tile: int) -> Column:
    """The letters of a tile in which its own windows of ``k`` letters lie."""
    return F.substring(seq, 1, tile + k - 1)


#: Letters that are counted at once.
BATCH_LETTERS = 2_000_000


def _gathered(batches):
    """Lists of texts with at least BATCH_LETTERS letters together, the last one with fewer."""
    held, n = [], 0
    for b in batches:
        for x in b.column(0):
            if text := x.as_py():
                held.append(text)
                n += len(text)
                if n >= BATCH_LETTERS:
                    yield held
                    held, n = [], 0
    if held:
        yield held


#: Words up to this length are counted as whole numbers of two bits a letter.
MOST_LETTERS = 31


def count_words(seqs: DataFrame, seq: str, k: int, purge_n: bool = True) -> DataFrame:
    """w, c: how often each word of ``k`` letters occurs in the sequences, counted before anything is shuffled.

    A batch of sequences is one array of letters; words of A, C, G and T are whole
    numbers and counted by sorting, others by their letters.  With ``purge_n``, words
    with an N or n are left out.  Each batch gives its distinct words once.
    """
    if k < 1:
        raise ValueError("words have at least one letter")
    code = np.full(0x110000, 4, np.uint8)
    for i, x in enumerate("ACGT"):
        code[ord(x)] = i
    is_n = np.zeros(0x110000, bool)
    is_n[[ord("N"), ord("n")]] = True

    def run(batches):
        for texts in _gathered(batches):
            letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
            if len(letters) < k:
                continue
            n = len(letters) - k + 1
            # Windows that begin in one sequence and end in it.
            ends = np.cumsum([len(x) for x in texts])
            room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(letters))
            inside = room[:n] >= k
            digits = code[letters]
            odd = np.concatenate([[0], np.cumsum(digits == 4)])
            plain = inside & (odd[k : k + n] == odd[:n]) if k <= MOST_LETTERS else np.zeros(n, bool)
            value = np.zeros(n, np.int64)
            for i in range(k if plain.any() else 0):
                value = value * 4 + digits[i : i + n]
            found, count = np.unique(value[plain], return_counts=True)
            if len(found):
                shift = 2 * np.arange(k - 1, -1, -1)
                words = np.frombuffer(b"ACGT", "S1")[(found[:, None] >> shift) & 3].reshape(-1).view(f"S{k}")
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(f"U{k}").tolist()), pa.array(count)], names=["w", "c"])
            rest = inside & ~plain
            if purge_n:
                ns = np.concatenate([[0], np.cumsum(is_n[letters])])
                rest &= ns[k : k + n] == ns[:n]
            at = np.flatnonzero(rest)
            if len(at):
                windows = np.lib.stride_tricks.sliding_window_view(letters, k)
                for lo in range(0, len(at), 1 << 20):
                    words, count = np.unique(np.ascontiguousarray(windows[at[lo : lo + (1 << 20)]]), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes().decode("utf-32-le") for x in words]), pa.array(count)], names=["w", "c"])

    return seqs.select(F.col(seq).cast("string").alias("s")).mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def count_words_of_tiles(tiles: DataFrame, seq: str, k: int, tile: int = TILE, purge_n: bool = True) -> DataFrame:
    """:func:`count_words` of the whole sequences from tiles with a halo of k - 1 letters or more."""
    return count_words(tiles.select(own_windows(F.col(seq), k, tile).alias(seq)), seq, k, purge_n)


def scan_tiles(tiles: DataFrame, m: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """region, motif, offset, fwd, rev as ``motifs.scan`` of the whole sequences, from tiles (region, start, seq).

    The tiles' halo has the widest motif's letters but one; a narrower motif's windows in
    the halo belong to the next tile.  ``offset`` is a long.
    """
    key = F.struct("region", "start")
    hits = motifs.scan(tiles.select(key.alias("region"), "seq"), m, threshold)
    return hits.where(F.col("offset") < tile).select("region.region", "motif", (F.col("region.start") + F.col("offset")).alias("offset"), "fwd", "rev")


def mask_tiles(tiles: DataFrame, hits: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """region, start, seq: tiles (without halo) with N over every hit (region, offset), hits over a border in both tiles."""
    first, last = F.floor(F.col("offset") / tile), F.floor((F.col("offset") + width - 1) / tile)
    touched = hits.select("region", F.explode(F.sequence(first, last)).alias("_t"), "offset").select("region", (F.col("_t") * tile).alias("start"), (F.col("offset") - F.col("_t") * tile).cast("int").alias("_o"))
    found = touched.groupBy("region", "start").agg(F.collect_set("_o").alias("_o"))  # no more than a tile's letters
    n = F.length("seq")

    def over(acc, o):
        lo = F.greatest(o, F.lit(0))
        size = F.least(o + width, n) - lo
        return F.when(size > 0, F.overlay(acc, F.repeat(F.lit("N"), size), lo + 1, size)).otherwise(acc)

    masked = F.aggregate("_o", F.col("seq"), over)
    return tiles.join(found, ["region", "start"], "left").select("region", "start", F.coalesce(masked, F.col("seq")).alias("seq"))


def joined(tiles: DataFrame, name: str = "region") -> DataFrame:
    """``name``, seq: tiles without halo put together again."""
    parts = F.array_sort(F.collect_list(F.struct("start", "seq")))
    return tiles.groupBy(name).agg(parts.alias("_p")).select(name, F.array_join(F.transform("_p", lambda x: x["seq"]), "").alias("seq"))
