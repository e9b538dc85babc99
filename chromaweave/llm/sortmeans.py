"""Centroid clustering by sort-means, in whole numbers.

Each round orders, for every centroid, the others by their distance from it.  A vector
begins with the centroid it was assigned to last and looks at the others in that order;
as soon as one is farther from its centroid than twice the vector's own distance, it
and all behind it are farther from the vector too, and the search stops.  The bound is
strict: a centroid at exactly twice the distance can tie, and of equal distances the
smaller number wins.

Components are whole numbers, so sums are exact and a run repeats whatever the
partitioning.  A round reads the written table of the round before, and writes the new
assignments and each task's sums in one pass; what is gathered is one row for each task
and centroid, and k times dims numbers reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm.store import materialise, release

#: Components become floor(SCALE * x).
SCALE = 1024
#: Greatest magnitude of a whole component for 64 of them: squared distances then fit in 63 bits.
MOST = 1 << 27
#: Most components of all centroids together; they are held by the driver and by every task.
CENTROID_NUMBERS = 1 << 22


def whole_vectors(rows: DataFrame, row_id: str, vector: str, dims: int, scale: int = SCALE) -> DataFrame:
    """(id, v): vectors of exactly ``dims`` components, none null or not finite, as floor(scale * x).

    Other rows are left out.  A component beyond what squared distances of 63 bits
    allow (2 ** 27 for 64 components) fails the query, as it would overflow.
    """
    x = lambda c: F.lit(float(scale)) * c.cast("double")
    finite = ~F.exists(vector, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(c.cast("double")) == float("inf")))
    beyond = F.exists(vector, lambda c: (x(c) >= float(MOST)) | (x(c) < -float(MOST)))
    whole = F.transform(vector, lambda c: F.floor(x(c)))
    too_far = F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}")).cast("array<long>")
    # Both in one projection, so that only kept rows are looked at.
    kept = rows.where((F.size(vector) == dims) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(row_id).alias("id"), F.when(beyond, too_far).otherwise(whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, lowercase hex; equal ones by their components."""
    told = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in vectors.select(told.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each row of ``x``, beginning at ``before``."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    # Each centroid is the first of its own order, whatever its copies are.
    away = apart + 1
    np.fill_diagonal(away, 0)
    order = np.argsort(away, axis=1, kind="stable")
    own = ((x - centroids[before]) ** 2).sum(1)
    best, least = before.copy(), own.copy()
    rows = np.arange(len(x))
    for step in range(1, len(centroids)):
        other = order[before[rows], step]
        # d(c, c') > 2 d(x, c), in squares.
        rows = rows[apart[before[rows], other] <= 4 * own[rows]]
        if not len(rows):
            break
        other = order[before[rows], step]
        d = ((x[rows] - centroids[other]) ** 2).sum(1)
        nearer = (d < least[rows]) | ((d == least[rows]) & (other < best[rows]))
        at = rows[nearer]
        best[at], least[at] = other[nearer], d[nearer]
    return best, least


def _pass(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The vectors of a written table with their new assignments, and behind them each task's sums."""
    c, dims = np.array(centroids, np.int64), len(centroids[0])
    k = len(centroids)

    def run(batches):
        sums, counts, total = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        longs = pa.list_(pa.int64())
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            best, least = assign(x, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), c)
            for j in np.unique(best):
                mine = best == j
                sums[j] += x[mine].sum(0)
                counts[j] += mine.sum()
                total[j] += least[mine].sum()
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(best.astype(np.int32)), pa.array(least), none, pa.nulls(b.num_rows, longs)], names=names)
        used = np.flatnonzero(counts)
        if len(used):
            told = pa.array(list(sums[used]), longs)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), b.column("id").type), pa.nulls(len(used), longs), pa.array(used.astype(np.int32)), pa.array(total[used]), pa.array(counts[used]), told], names=names)

    schema = T.StructType([table.schema["id"], T.StructField("v", T.ArrayType(T.LongType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    names = schema.names
    return table.where("n IS NULL").select("id", "v", "cluster").mapInArrow(run, schema)


def _totals(table: DataFrame, dims: int) -> dict[int, tuple[int, int, list[int]]]:
    """Rows, distances and components of each centroid's vectors, summed over all tasks."""
    big = lambda x: F.sum(x.cast("decimal(38,0)"))
    parts = table.where("n IS NOT NULL").select("cluster", "distance", "n", "sums")
    heads = {r["cluster"]: (int(r["n"]), int(r["d"])) for r in parts.groupBy("cluster").agg(big(F.col("n")).alias("n"), big(F.col("distance")).alias("d")).collect()}
    sums: dict[int, list[int]] = {j: [0] * dims for j in heads}
    for r in parts.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(big(F.col("s")).alias("s")).collect():
        sums[r["cluster"]][r["i"]] = int(r["s"])
    return {j: (*heads[j], sums[j]) for j in heads}


def cluster(rows: DataFrame, row_id: str, vector: str, dims: int, k: int, rounds: int, seed: int = 3, scale: int = SCALE) -> DataFrame:
    """``row_id``, cluster, distance (squared), centroid (its components), cluster_inertia and inertia of each kept vector.

    Which vectors are kept says :func:`whole_vectors`.  Repeated rows are vectors each,
    and may be centroids each: of two centroids alike the second stays without vectors.
    With fewer than ``k`` vectors there are as many centroids as vectors.  A centroid
    without vectors stays where it is.  A null id is a vector like others; in the order
    of the first centroids it stands as ''.  Other columns of any name are ignored;
    ``row_id`` may not have the name of a new column.  An empty table gives no rows.
    """
    new = {"cluster", "distance", "centroid", "cluster_inertia", "inertia"}
    if row_id.lower() in new:
        raise ValueError(f"the id has the name of a new column: {row_id}")
    if k * dims > CENTROID_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} components are more than {CENTROID_NUMBERS} numbers")
    if dims > 64:
        raise ValueError("squared distances of more than 64 components may not fit in 63 bits")
    spark = rows.sparkSession
    vectors = whole_vectors(rows, row_id, vector, dims, scale)
    start = vectors.withColumns({"cluster": F.lit(0), "distance": F.lit(None).cast("long"), "n": F.lit(None).cast("long"), "sums": F.lit(None).cast("array<long>")})
    table = materialise(start, "vectors")
    centroids = first_centroids(table, k, seed)
    out = T.StructType([T.StructField("_c", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.LongType())), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType())])
    told = []
    if centroids:
        for i in range(rounds + 1):
            now = materialise(_pass(table, centroids), "assigned")
            release(table)
            table = now
            totals = _totals(table, dims)
            if i < rounds:
                centroids = [[s // totals[j][0] for s in totals[j][2]] if j in totals else c for j, c in enumerate(centroids)]
        inertia = sum(d for _, d, _ in totals.values())
        told = [(j, c, totals[j][1], inertia) for j, c in enumerate(centroids) if j in totals]
    # One row for each centroid.
    named = F.broadcast(spark.createDataFrame(told, out))
    found = table.where("n IS NULL").join(named, F.col("cluster") == F.col("_c"))
    return found.select(F.col("id").alias(row_id), "cluster", "distance", "centroid", "cluster_inertia", "inertia")
