"""Operators over tables of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweave.functions.scalars import gc_content, reverse_complement
from chromaweave.operators.ranges import least_keys
from chromaweave.operators.tiles import count_words, count_words_of_tiles, cut


def gc_histogram(seqs: DataFrame, seq: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """by, bin, n, share: floor(gc * bins), where gc = 1 falls in the last bin; empty bins are left out."""
    by = by or []
    gc = gc_content(F.col(seq))
    each = seqs.where(gc.isNotNull()).select(*by, F.least(F.floor(gc * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = each.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t")) if by else counts.agg(F.sum("n").alias("_t"))
    joined = counts.join(F.broadcast(totals), by) if by else counts.crossJoin(F.broadcast(totals))  # one row
    return joined.select(*by, "bin", "n", (F.col("n") / F.col("_t")).alias("share"))


def kmers(seq: Column, k: int) -> Column:
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k))))


def top_kmers(seqs: DataFrame, seq: str, k: int, purge_n: bool = True) -> DataFrame:
    """kmer, n on the lesser of both strands, most frequent first; sequences of any length (counted in tiles)."""
    rows = seqs.select(F.lit(0).alias("_name"), F.col(seq).alias("_seq"))
    counts = count_words_of_tiles(cut(rows, "_name", "_seq", halo=k - 1), "_seq", k, purge_n=purge_n)
    # Few different words are left after the first count, so strands are joined then.
    canon = F.least("w", reverse_complement(F.col("w")))
    return counts.groupBy(canon.alias("kmer")).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "kmer")


def matches(a: Column, b: str) -> Column:
    """Positions at which two words of equal length agree."""
    return sum((F.when(F.substring(a, i + 1, 1) == c, 1).otherwise(0) for i, c in enumerate(b)), F.lit(0))


def m_matches(seqs: DataFrame, seq: str, word: str, least: int) -> DataFrame:
    """kmer, n of the k-mers that agree with ``word`` on at least so many positions, on either strand."""
    each = count_words(seqs, seq, len(word), purge_n=False).withColumnsRenamed({"w": "kmer", "c": "n"})
    return each.where(F.greatest(matches(F.col("kmer"), word), matches(reverse_complement(F.col("kmer")), word)) >= least)


def _hash_key(key: str, seed: int) -> Column:
    """The first 64 bits of the MD5 of key and seed, as a long in the order of the digest."""
    told = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))))
    half = lambda at: F.conv(F.substring(told, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1) - (1 << 31), 32).bitwiseOR(half(9))


def random_subset(seqs: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), by a hash order that a re-run repeats.  Keys are distinct.

    Rows are neither sorted nor gathered: the greatest hash that is still in is found by
    counting (:func:`~chromaweave.operators.ranges.least_keys`).
    """
    return seqs.where(least_keys(seqs, _hash_key(key, seed), n))


def random_split(seqs: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Rows with ``part`` 0 for exactly int(fraction * rows) of them and 1 for the rest, chosen as in :func:`random_subset`."""
    inside = least_keys(seqs, _hash_key(key, seed), int(fraction * seqs.count()))
    return seqs.withColumn("part", F.when(inside, 0).otherwise(1))


def sizes(seqs: DataFrame, seq: str) -> DataFrame:
    """size, n: how many sequences have each length."""
    return seqs.where(F.col(seq).isNotNull()).groupBy(F.length(seq).alias("size")).agg(F.count("*").alias("n"))


def compare_words(words: DataFrame, a: str, b: str) -> DataFrame:
    """The best ungapped placement of the shorter of two words in the longer, on either strand.

    Adds ``identity``, the share of the shorter word's positions that agree, and
    ``offset`` and ``strand`` of the first best placement ('+' before '-').
    """
    long, short = F.when(F.length(a) >= F.length(b), F.col(a)).otherwise(F.col(b)), F.when(F.length(a) >= F.length(b), F.col(b)).otherwise(F.col(a))
    rows = words.withColumns({"_l": long, "_s": short}).where("length(_s) > 0")

    def agree(word, at):
        return F.size(F.filter(F.sequence(F.lit(1), F.length("_s")), lambda i: F.substring(F.col("_l"), at + i, F.lit(1)) == F.substring(word, i, F.lit(1))))

    places = F.sequence(F.lit(0), F.length("_l") - F.length("_s"))

    def placed(rank, strand, word):
        return F.transform(places, lambda at: F.struct(agree(word, at).alias("same"), F.lit(-rank).alias("plus"), (-at).alias("back"), F.lit(strand).alias("strand")))

    both = [placed(0, "+", F.col("_s")), placed(1, "-", reverse_complement(F.col("_s")))]
    best = F.array_max(F.concat(*both))
    out = rows.withColumn("_b", best)
    return out.withColumns({"identity": F.col("_b.same") / F.length("_s"), "offset": -F.col("_b.back"), "strand": F.col("_b.strand")}).drop("_l", "_s", "_b")


def reduce_regions(regions: DataFrame, mapped: DataFrame, include: DataFrame | None = None) -> DataFrame:
    """Regions (header, key, seq) whose midpoint a peak was mapped at; the last mapped gene names them.

    mapped: key, gene, row_no; include: gene.
    """
    if include is not None:
        mapped = mapped.join(include.select("gene").distinct(), "gene", "left_semi")
    last = mapped.groupBy("key").agg(F.max_by("gene", "row_no").alias("gene"))
    return regions.join(last, "key").select(F.concat_ws(" ", "header", "gene").alias("header"), "gene", "seq")
