"""Background sequences by rejection sampling, matched in size, GC content and distance to genes.

Proposals follow from hashes, so a run repeats.  The foreground gives each bin of GC
content and size its quota.  In each round only sizes whose bins are still open are
drawn, and each bin takes its first proposals, in the order of a hash, up to what is
left of its quota: at the end the bins hold exactly what the foreground's do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweave.functions.scalars import gc_content
from chromaweave.operators.intervals import nearest_start
from chromaweave.operators.ranges import numbered, settled

#: Proposals of a round for each sequence that is still missing.
PROPOSALS = 8
#: Proposals that one row is opened to, so that a size with many is dealt to many tasks.
CHUNK = 4096
ROUNDS = 40


def gc_bin(seq: Column, bins: int) -> Column:
    """floor(gc * bins), where gc = 1 falls in the last bin; null for a sequence without letters."""
    return F.least(F.floor(gc_content(seq) * bins), F.lit(bins - 1)).cast("int")


def quotas(foreground: DataFrame, bins: int) -> DataFrame:
    """gc, size, quota: how many sequences (seq) each bin of GC content and length has."""
    each = foreground.select(gc_bin(F.col("seq"), bins).alias("gc"), F.length("seq").alias("size")).where("gc IS NOT NULL")
    return each.groupBy("gc", "size").agg(F.count("*").alias("quota"))


def _draw(n: int, *keys) -> Column:
    """A whole number from 0 to n - 1 from the MD5 of the keys."""
    told = F.md5(F.concat_ws("/", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(told, 1, 12), 16, 10).cast("long") % n


def propose(open_: DataFrame, distances: DataFrame, starts: DataFrame, n_distances: int, n_starts: int, level: int, seed: int, jitter: int) -> DataFrame:
    """proposal, chrom, start, size, strand, dist: ``PROPOSALS`` intervals for each missing one of (size, missing).

    A gene's start and a foreground distance are drawn by their numbers; the interval
    lies at that distance from the start, but for a jitter.
    """
    last = F.col("missing") * PROPOSALS - 1
    chunks = open_.select("size", last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(CHUNK).cast("long"))).alias("_k")).repartition("size", "_k")
    each = chunks.select("size", F.explode(F.sequence("_k", F.least(F.col("_k") + CHUNK - 1, F.col("_last")))).alias("k"))
    key = lambda what: (F.col("size"), F.col("k"), F.lit(level), F.lit(seed), F.lit(what))
    each = each.select("size", "k", _draw(n_distances, *key("d")).alias("_d"), _draw(n_starts, *key("g")).alias("_g"), (_draw(2 * jitter + 1, *key("j")) - jitter).alias("_j"), F.when(_draw(2, *key("s")) == 0, "+").otherwise("-").alias("strand"))
    # A few rows are opened to very many, which no estimate tells: the proposals must not be broadcast for their few rows.
    each = each.hint("merge").join(distances.select(F.col("i").alias("_d"), "dist"), "_d").hint("merge").join(starts.select(F.col("i").alias("_g"), "chrom", "tx_start"), "_g")
    mid = F.col("tx_start") + F.col("dist") + F.col("_j")
    return each.select(F.concat_ws("/", F.lit(level), "size", "k").alias("proposal"), "chrom", (mid - F.floor(F.col("size") / 2)).alias("start"), "size", "strand", mid.alias("mid"), "dist").where("start >= 0")


def fetched(proposals: DataFrame, genome: DataFrame, tile: int) -> DataFrame:
    """The proposals with ``seq``, their letters on the '+' strand; those that are not wholly in the genome are left out.

    ``genome``: tiles (chrom, start, seq) whose halo is at least the greatest size less 1.
    """
    tiles = genome.select("chrom", F.col("start").alias("_tile"), F.col("seq").alias("_letters"))
    met = proposals.withColumn("_tile", F.floor(F.col("start") / tile) * tile).join(tiles, ["chrom", "_tile"])
    seq = F.substring(F.col("_letters"), (F.col("start") - F.col("_tile") + 1).cast("int"), F.col("size").cast("int"))
    return met.withColumn("seq", seq).where(F.length("seq") == F.col("size")).drop("_tile", "_letters")


def near_as_drawn(proposals: DataFrame, genes: DataFrame, slack: int) -> DataFrame:
    """Proposals whose nearest gene start is about as far as the distance they were drawn with: no other gene is nearer."""
    points = proposals.select("chrom", F.col("mid").alias("peak_loc"), F.col("proposal").alias("peak_id"))
    found = nearest_start(points, genes).select(F.col("peak_id").alias("proposal"), F.col("dist").alias("_near"))
    # A draw at d from one gene may lie at -d from another: what counts is how far the nearest is.
    return proposals.join(found, "proposal").where(F.abs(F.abs("_near") - F.abs("dist")) <= slack).drop("_near")


def sample(foreground: DataFrame, genes: DataFrame, genome: DataFrame, tile: int, bins: int = 100, times: int = 1, jitter: int = 100, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """proposal, chrom, start, size, strand, gc, dist, seq: ``times`` background sequences for each foreground one.

    ``foreground`` (region, chrom, start, seq) and ``genes`` (chrom, tx_start) give the
    quotas and the distances; foreground sequences on chromosomes without genes give no
    distance.  ``seq`` is on the '+' strand; a reverse complement has the same bin.
    Raises ValueError where quotas are open after the last round: the genome then holds
    too few such sequences near genes.  An empty foreground gives no rows.
    """
    spark = foreground.sparkSession
    points = foreground.select("chrom", (F.col("start") + F.floor(F.length("seq") / 2)).alias("peak_loc"), F.col("region").alias("peak_id"))
    known = nearest_start(points, genes).where("dist IS NOT NULL").select("peak_id", "dist")
    distances = numbered(known, ["dist", "peak_id"], "i").select("i", "dist")
    starts = numbered(genes.select("chrom", "tx_start").distinct(), ["chrom", "tx_start"], "i")
    n_distances, n_starts = distances.count(), starts.count()
    quota = settled(quotas(foreground, bins).withColumn("quota", F.col("quota") * times))
    left, parts = quota, []
    for level in range(rounds):
        open_ = left.where("quota > 0").groupBy("size").agg(F.sum("quota").alias("missing"))
        if not open_.limit(1).count():
            break
        if not n_distances or not n_starts:
            raise ValueError("no foreground sequence is on a chromosome with genes")
        drawn = near_as_drawn(settled(propose(open_, distances, starts, n_distances, n_starts, level, seed, jitter)), genes, jitter)
        found = fetched(drawn, genome, tile).withColumn("gc", gc_bin(F.col("seq"), bins))
        found = found.join(left.where("quota > 0"), ["gc", "size"])
        # A bin's first proposals, up to its quota; a bin with many is numbered in ranges.
        ranked = numbered(found.withColumn("_o", F.md5("proposal")), ["_o", "proposal"], "_rank", by=["gc", "size"])
        taken = settled(ranked.where("_rank < quota").select("proposal", "chrom", "start", "size", "strand", "gc", "dist", "seq"))
        parts.append(taken)
        had = taken.groupBy("gc", "size").agg(F.count("*").alias("_had"))
        left = settled(left.join(had, ["gc", "size"], "left").select("gc", "size", (F.col("quota") - F.coalesce("_had", F.lit(0))).alias("quota")))
    missing = left.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    if missing:
        raise ValueError(f"{missing} background sequences are missing after {rounds} rounds")
    if not parts:
        return spark.createDataFrame([], f"proposal string, chrom {genome.schema['chrom'].dataType.simpleString()}, start long, size int, strand string, gc int, dist long, seq string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
