"""Peaks that keep arriving, against static genes: a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.operators import intervals


def map_stream(peaks: DataFrame, genes: DataFrame, up: int = intervals.UPSTREAM, down: int = intervals.DOWNSTREAM, tss: bool = True) -> DataFrame:
    """As :func:`intervals.map_peaks`, for a streaming ``peaks``; each gene and peak meet once, so nothing has to be deduplicated."""
    hit = intervals.range_join(peaks, intervals.derive(genes, up, down), "chrom", "peak_loc", "ext_lo", "ext_hi")
    return hit.withColumn("_m", intervals.classify(tss)).where("_m IS NOT NULL").select("chrom", "peak_id", "peak_loc", "gene_id", F.col("_m.map_type").alias("map_type"), F.col("_m.dist").alias("dist"))
