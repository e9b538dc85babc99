"""Lines of text files with their true numbers, however the files are split."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.operators.ranges import running


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> tuple[DataFrame, int]:
    """(value, file, _range, line) of the lines that are kept, and the most splits of a file.

    ``line`` counts the kept lines of each file from 0, ``keep`` is a condition on
    ``value``.  Each split's lines are counted where they are read; the counts, one row
    for each split, are summed up in the order of the splits on the driver.  No line is
    shuffled.  ``_range`` is the number of the split in its file, so that
    :func:`~chromaweave.operators.ranges.running` can carry state from split to split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    raw = (raw if keep is None else raw.where(keep)).withColumn("_id", F.monotonically_increasing_id())
    found = raw.groupBy("file", "_start").agg(F.count("*").alias("n"), F.min("_id").alias("first")).collect()
    of_file = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["file"], r["_start"])):
        of_file[r["file"]].append(r)
    rows = []
    for file, splits in of_file.items():
        base = 0
        for k, r in enumerate(splits):
            rows.append((file, r["_start"], k, base - r["first"]))
            base += r["n"]
    # One row for each split.
    place = spark.createDataFrame(rows, "file string, _start long, _range int, _shift long")
    lines = raw.join(F.broadcast(place), ["file", "_start"])
    return lines.select("value", "file", "_range", (F.col("_id") + F.col("_shift")).alias("line")), max((len(x) for x in of_file.values()), default=1)


def blocks(lines: DataFrame, splits: int, header: Column) -> DataFrame:
    """Lines from each header line on, with the header's line as ``block``; lines before the first header go."""
    return running(lines, splits, "file", ["line"], F.when(header, F.col("line")), "block").where("block IS NOT NULL")
