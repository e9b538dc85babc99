"""Global order without a global task: ranks by ranges, selection by radix, sweeps with carried state.

Rows are dealt to ranges of the sort key.  What one range has to know of the ranges
before and behind it is one small summary for each range, so the driver scans as many
summaries as there are ranges, never rows.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import accumulate
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled keys for each splitter: a range then seldom holds more than twice its share.
SAMPLE_PER_RANGE = 40
#: Rows below which a further range is not worth its jobs.
ROWS_PER_RANGE = 125_000
#: Rows beyond which a range is cut further, however many ranges there are.
MOST_ROWS = 1_000_000
#: Bits of a hash that one round of the selection counts by.
RADIX_BITS = 12
#: Rows among which a selection ends on the driver.
FEW_ROWS = 1 << RADIX_BITS


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints: ``spark.checkpoint.dir``, and for a local session without one a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="chromaweave-")
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows as written to the checkpoint folder: later jobs see the same rows in the same partitions."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Written tables of one computation, in the checkpoint folder; those that nothing reads any more are deleted.

    They are Parquet, of which a row takes a fraction of what it takes in a checkpoint.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def __call__(self, df: DataFrame) -> DataFrame:
        """The rows as written: later jobs see the same rows."""
        folder = f"{checkpoint_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[folder] = out
        return out

    def only(self, *kept: DataFrame) -> None:
        """Delete all tables but these, and let Spark drop the shuffles of what was written."""
        for folder, df in list(self.folders.items()):
            if not any(df is k for k in kept):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                del self.folders[folder]
        del df, kept
        gc.collect()
        self.spark._jvm.System.gc()


def parts_for(spark: SparkSession, rows: int) -> int:
    """Ranges for so many rows: as many as the session's shuffles have, fewer for small tables, more for large ones."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE)), -(-rows // MOST_ROWS))


def _columns(df: DataFrame, order) -> list[Column]:
    return [df[c] if isinstance(c, str) else c for c in order]


def numbered(df: DataFrame, order: list, name: str = "rank", by: list[str] | None = None, start: int = 0, ranges: int | None = None) -> DataFrame:
    """``df`` with the place of each row in the order (of its ``by`` group): ``start``, ``start`` + 1, ...

    Rows that ``order`` leaves equal are numbered by a hash of the whole row, so the
    numbers repeat in a later run; identical rows are interchangeable.  A key that a
    third of the rows share is spread over ranges by that hash, and copies of one row
    by a random number.  One shuffle by ranges of the key and one written table; the
    driver sees one count for each range.  ``ranges`` is the least number of ranges:
    they are as many more as :data:`MOST_ROWS` asks for.
    """
    by = by or []
    marks = df.withColumns({"_h": F.xxhash64(*[df[c] for c in df.columns]), "_r": F.rand(7)}) if df.columns else df
    keys = [marks[c] for c in by] + _columns(marks, order) + [marks["_h"], marks["_r"]]
    n = df.count()
    parts = parts_for(df.sparkSession, n) if ranges is None else max(ranges, -(-n // MOST_ROWS))
    spread = marks.repartitionByRange(parts, *keys) if parts > 1 else marks.repartition(1)
    # The upper bits of this id are the partition, which is the range; the lower 33 count its rows.
    placed = settled(spread.sortWithinPartitions(*keys).drop("_h", "_r").withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    used = sorted(counts)
    before = list(zip(used, accumulate([counts[p] for p in used], initial=0), strict=False))
    # One row for each range; as an Arrow table it needs no Python workers, as a list it would take one for each core.
    base = df.sparkSession.createDataFrame(pa.table({"_p": pa.array([p for p, _ in before], pa.int64()), "_base": pa.array([b for _, b in before], pa.int64())}))
    out = placed.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + inside + start).drop("_base", "_id")
    if by:
        # A group's first number, once for each range that holds rows of the group: no key of the join has more rows than a range.
        own = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
        held = out.groupBy(*own, F.col("_p").alias("_q")).agg(F.min(name).alias("_first"))
        held = held.withColumn("_first", F.min("_first").over(W.partitionBy(*[f"_b{i}" for i in range(len(by))])))
        same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
        out = out.join(held, reduce(and_, same, F.col("_p") == F.col("_q"))).withColumn(name, F.col(name) - F.col("_first") + start)
    return out.select(*[c for c in df.columns if c != name], name)


def least_keys(df: DataFrame, key: Column, n: int) -> Column:
    """A condition that holds for the ``n`` rows of ``df`` with the least values of the long ``key``.

    Selection by radix: rows are counted by the key's leading bits, then by the next
    bits of the one bucket in which row ``n`` lies.  Nothing is shuffled but counts, and
    at most :data:`FEW_ROWS` keys reach the driver.  Keys are hashes of distinct values;
    where several rows share the last key, all of them are in.
    """
    if n <= 0:
        return F.lit(False)
    # Order-preserving: the sign bit is flipped, so that digits compare as unsigned.
    word = key.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    keys = df.select(word.alias("w"))
    left, shift, prefix = n, 64, 0
    while True:
        shift = max(0, shift - RADIX_BITS)
        digit = F.shiftrightunsigned("w", shift)
        counts = sorted((r["d"] % (1 << (64 - shift)), r["n"]) for r in keys.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())
        for prefix, here in counts:
            if left <= here:
                break
            left -= here
        else:
            return F.lit(True)  # fewer rows than n
        bucket = F.shiftrightunsigned(word, shift) == F.lit(_signed(prefix)).cast("long")
        if left == here:
            bound = ((prefix + 1) << shift) - 1
            break
        keys = df.where(bucket).select(word.alias("w"))
        if shift == 0 or here <= FEW_ROWS:
            last = sorted(r["w"] % (1 << 64) for r in keys.collect())[left - 1] if shift else prefix
            bound = last
            break
    return key <= F.lit(_signed(bound ^ (1 << 63))).cast("long")


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >= 1 << 63 else x


def dealt(df: DataFrame, keys: list[str], ranges: int | None = None, seed: int = 11) -> tuple[DataFrame, int]:
    """``df`` with ``_range``, the range of ``keys`` in which a row lies, and the number of ranges.

    A later range has greater keys only.  The splitters are quantiles of a sample of the
    keys, about :data:`SAMPLE_PER_RANGE` for each range.  They decide where rows go,
    never what comes out, and are searched in two steps of about the square root of
    their number.  Rows with equal keys stay together: the last key should tell them apart.
    """
    n = df.count()
    ranges = max(ranges, -(-n // MOST_ROWS)) if ranges else parts_for(df.sparkSession, n)
    if ranges < 2:
        return df.withColumn("_range", F.lit(0)), 1
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    whole = reduce(and_, [F.col(c).isNotNull() for c in keys])
    sample = df.where(whole).sample(min(1.0, SAMPLE_PER_RANGE * ranges / max(n, 1)), seed).select(*named).collect()
    found = sorted(tuple(r) for r in sample)
    cuts = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    if not cuts:
        return df.withColumn("_range", F.lit(0)), 1
    types = [df.schema[c].dataType for c in keys]
    as_key = lambda c: F.struct(*[F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(c, types, strict=True))])
    width = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    key = F.struct(*named)
    block = F.size(F.filter(F.array(*[as_key(b[0]) for b in blocks]), lambda c: c <= key))
    inner = F.element_at(F.array(*[F.array(*[as_key(c) for c in b]) for b in blocks]), F.greatest(block, F.lit(1)))
    at = F.when(block > 0, (block - 1) * width + F.size(F.filter(inner, lambda c: c <= key))).otherwise(0)
    return df.withColumn("_range", at.cast("int")), len(cuts) + 1


#: What a running value is made of: over a window, of two summaries on the driver, of two columns.
KINDS = {
    "max": (F.max, max, F.greatest),
    "min": (F.min, min, F.least),
    "sum": (F.sum, lambda a, b: a + b, lambda a, b: F.when(F.col(a).isNull(), F.col(b)).otherwise(F.col(a) + F.coalesce(F.col(b), F.lit(0)))),
}


def _carry(summaries: DataFrame, by: str, combine: Callable, backward: bool) -> DataFrame:
    """(_by, _at, _carry): the combined value of a group's ranges before (or behind) each of its ranges.

    ``summaries`` has a row (``by``, _range, _value) for each group and range that occur
    together.  A group in one range needs no carry, so only groups that cross a splitter
    reach the driver: no more than two rows for each splitter.
    """
    crossing = summaries.groupBy(by).agg(F.collect_list(F.struct("_range", "_value")).alias("_s")).where(F.size("_s") > 1)
    rows = []
    for r in crossing.collect():
        now = None
        for x in sorted(r["_s"], key=lambda x: x["_range"], reverse=backward):
            if now is not None:
                rows.append((r[by], x["_range"], now))
            if x["_value"] is not None:
                now = x["_value"] if now is None else combine(now, x["_value"])
    kinds = [summaries.schema[c].dataType for c in (by, "_value")]
    return summaries.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_by", kinds[0]), T.StructField("_at", T.IntegerType()), T.StructField("_carry", kinds[1])]))


def running(df: DataFrame, ranges: int, by: str, order: list, value: Column, name: str, kind: str = "max", strict: bool = False, backward: bool = False) -> DataFrame:
    """The greatest (or least, or summed) ``value`` of a group up to each row, null if there is none.

    ``df`` comes from :func:`dealt` by (``by``, then ``order``), or has ranges of its own
    that follow each other in that order.  ``strict`` leaves the row itself out,
    ``backward`` looks from the row to the end of its group.  A group is worked range by
    range: one shuffle by (group, range), one combined summary for each and what
    :func:`_carry` joins back.  ``order`` holds names where it is read backward.
    """
    # Backward is forward in the reversed order: a frame up to the end would be read anew for every row.
    ordered = [F.desc(c) for c in order] if backward else order
    frame = W.partitionBy(by, "_range").orderBy(*ordered).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    over, combine, both = KINDS[kind]
    inside = over(value).over(frame)
    if ranges == 1:
        return df.withColumn(name, inside)
    summaries = df.groupBy(by, "_range").agg(over(value).alias("_value"))
    # No more than two rows for each splitter.
    carry = F.broadcast(_carry(summaries, by, combine, backward))
    out = df.withColumn(name, inside)
    return out.join(carry, out[by].eqNullSafe(carry["_by"]) & (out["_range"] == carry["_at"]), "left").withColumn(name, both(name, "_carry")).drop("_by", "_at", "_carry")
