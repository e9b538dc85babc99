"""Genomic intervals: derived windows, binned range joins, classification, merging.

Positions are LONG, closed intervals; strands are '+' or '-'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaweave.operators.ranges import dealt, running

UPSTREAM, DOWNSTREAM = 2000, 2000
BIN = 1 << 14


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")


def summit(start: Column, offset: Column) -> Column:
    return start + offset


def gps_window(mid: Column, half: int = 125) -> tuple[Column, Column]:
    return mid - half, mid + half


def name_peaks(peaks: DataFrame, order: str, name: str = "name") -> DataFrame:
    """Names '.' and integers become Peak_number_<row>; a name that occurred before gets a 'd'."""
    # Rows are numbered within the ordering column's file, as readers give it; no global sort.
    plain = F.when((F.col(name) == ".") | F.col(name).rlike(r"^[0-9]+$"), F.concat(F.lit("Peak_number_"), F.col(order))).otherwise(F.col(name))
    seen = F.row_number().over(W.partitionBy("_plain").orderBy(order))
    return peaks.withColumn("_plain", plain).withColumn(name, F.when(seen > 1, F.concat("_plain", F.lit("d"))).otherwise(F.col("_plain"))).drop("_plain")


def derive(genes: DataFrame, up: int = UPSTREAM, down: int = DOWNSTREAM) -> DataFrame:
    """Adds prom_lo/hi, win_lo/hi, down_lo/hi and the extent ext_lo/hi, by strand."""
    tx, te, plus = F.col("tx_start"), F.col("tx_end"), F.col("strand") == "+"
    zero = F.lit(0).cast("long")

    def pick(a, b):
        return F.when(plus, a).otherwise(b).cast("long")

    out = genes.withColumns(
        {
            "prom_lo": pick(F.greatest(tx - 1 - up, zero), te + 1),
            "prom_hi": pick(tx - 1, te + 1 + up),
            "win_lo": pick(tx + 1, te - down),
            "win_hi": pick(tx + down, te),
            "down_lo": pick(te + 1, tx - 1 - down),
            "down_hi": pick(te + 1 + down, tx - 1),
        }
    )
    return out.withColumns({"ext_lo": pick(F.col("prom_lo"), F.col("down_lo")), "ext_hi": pick(F.col("down_hi"), F.col("prom_hi"))})


def range_join(points: DataFrame, intervals: DataFrame, by: str, point: str, lo: str, hi: str, bin_width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of a point and an interval that holds it, under equal ``by``.

    Intervals are copied to the bins they touch, points lie in one bin, so each pair
    meets once and a busy chromosome is spread over its bins.
    """
    width = F.lit(bin_width)
    bins = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    right = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(bins))
    left = points.withColumn("_bin", F.floor(F.col(point) / width))
    within = (left[by] == right[by]) & (left["_bin"] == right["_bin"]) & left[point].between(right[lo], right[hi])
    return left.join(right, within, how).drop(right[by]).drop(left["_bin"]).drop(right["_bin"])


def classify(tss: bool = True) -> Column:
    """struct(map_type, dist) of a peak at ``peak_loc`` against a derived gene; null where none applies."""
    loc, plus = F.col("peak_loc"), F.col("strand") == "+"

    def dist(plus_at, minus_at):
        return F.when(plus, loc - F.col(plus_at)).otherwise(F.col(minus_at) - loc)

    def kind(name, d):
        return F.struct(F.lit(name).alias("map_type"), d.cast("long").alias("dist"))

    out = F.when(loc.between(F.col("prom_lo"), F.col("prom_hi")), kind("promoter", dist("prom_hi", "prom_lo")))
    near = loc.between(F.col("win_lo"), F.col("win_hi"))
    if tss:
        return out.when(near, kind("near TSS", dist("win_lo", "win_hi")))
    inside = loc.between(F.col("tx_start"), F.col("tx_end"))
    after = loc.between(F.col("down_lo"), F.col("down_hi"))
    return out.when(inside, kind("gene", dist("prom_hi", "prom_lo"))).when(after, kind("after", dist("down_lo", "down_hi")))


def gene_position() -> Column:
    """Place of the peak along the gene, from 0 at its start, by strand."""
    length = (F.col("tx_end") - F.col("tx_start")).cast("double")
    along = F.when(F.col("strand") == "+", F.col("peak_loc") - F.col("tx_start")).otherwise(F.col("tx_end") - F.col("peak_loc"))
    return along / F.nullif(length, F.lit(0.0))


def in_exon(loc: Column, starts: Column, ends: Column) -> Column:
    return F.exists(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: loc.between(x["s"], x["e"]))


def map_peaks(peaks: DataFrame, genes: DataFrame, up: int = UPSTREAM, down: int = DOWNSTREAM, tss: bool = True, intergenic: bool = False, xref: DataFrame | None = None) -> DataFrame:
    """Peaks (chrom, peak_id, peak_loc) with every gene (chrom, gene_id, tx_start, tx_end, strand) they map to.

    With ``intergenic``, peaks without a gene stay with nulls.  With ``xref`` (gene_id,
    symbol) every mapped gene must have a symbol, else the query fails.
    """
    hit = range_join(peaks, derive(genes, up, down), "chrom", "peak_loc", "ext_lo", "ext_hi")
    hit = hit.withColumn("_m", classify(tss)).where("_m IS NOT NULL").select(*peaks.columns, "gene_id", "_m.map_type", "_m.dist", gene_position().alias("gene_pos")).distinct()
    if xref is not None:
        hit = hit.join(xref.select("gene_id", "symbol"), "gene_id", "left")
        hit = hit.withColumn("symbol", F.when(F.col("symbol").isNull(), F.raise_error(F.concat(F.lit("no symbol for gene "), F.col("gene_id").cast("string"))).cast("string")).otherwise(F.col("symbol")))
    if not intergenic:
        return hit
    return peaks.join(hit.drop(*[c for c in peaks.columns if c != "peak_id"]), "peak_id", "left").withColumn("map_type", F.coalesce("map_type", F.lit("None")))


def nearest_start(peaks: DataFrame, genes: DataFrame, ranges: int | None = None) -> DataFrame:
    """Signed distance of least absolute value from each peak to a gene start on its chromosome.

    Starts and peaks are merged in order; the nearest start is the last before or the
    first after, so no pair is formed.  Ties prefer the start before.  A chromosome is
    swept range by range, with the last and the first start carried over their borders;
    peaks of one position are spread over ranges by a hash of their id.
    """
    starts = genes.select("chrom", F.col("tx_start").alias("at"), F.lit(None).cast(peaks.schema["peak_id"].dataType).alias("peak_id"), F.lit(-1).cast("long").alias("tie"), F.col("tx_start").alias("start")).distinct()
    tie = F.shiftrightunsigned(F.xxhash64("peak_id"), 1)
    here = peaks.select("chrom", F.col("peak_loc").alias("at"), "peak_id", tie.alias("tie"), F.lit(None).cast(genes.schema["tx_start"].dataType).alias("start"))
    # Starts come before the peaks of their position.
    both = here.unionByName(starts)
    both, n = dealt(both, ["chrom", "at", "tie"], ranges)
    order = ["at", "tie"]
    both = running(both, n, "chrom", order, F.col("start"), "b")
    both = running(both, n, "chrom", order, F.col("start"), "a", kind="min", backward=True)
    found = both.where("start IS NULL")
    db, da = F.col("at") - F.col("b"), F.col("at") - F.col("a")
    near = F.when(F.col("a").isNull() | (F.abs(db) <= F.abs(da)), db).otherwise(da)
    return found.select("chrom", "peak_id", near.alias("dist"))


def merge(intervals: DataFrame, by: str, lo: str, hi: str, gap: int = 0, ranges: int | None = None) -> DataFrame:
    """Unions of intervals that overlap or lie within ``gap``: by, lo, hi, n.

    A chromosome is swept range by range, with the greatest end so far carried over
    their borders; an island is named by its start, which no other island shares.
    Intervals with equal ends are counted once and weigh as many as they are.
    """
    each = intervals.groupBy(by, lo, hi).agg(F.count("*").alias("_n"))
    each, n = dealt(each, [by, lo, hi], ranges)
    each = running(each, n, by, [lo, hi], F.col(hi), "_reach", strict=True)
    new = F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + gap), F.col(lo))
    each = running(each, n, by, [lo, hi], new, "_island")
    return each.groupBy(by, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.sum("_n").alias("n")).drop("_island")
