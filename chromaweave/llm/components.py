"""Connected components: union-find in parts of bounded size, joined by star rounds.

The edges are dealt into parts of at most ``PART`` edges.  Each task contracts its
part by union-find to stars around least nodes; alternating large-star and small-star
steps then join the stars of different parts.  Every round is written to the shared
folder, so that lost executors cost no more than the round under way.  Minima are taken
by aggregates, which combine before they shuffle, and go to the edges by a broadcast of
checked size, or by a join in which the edges of a node with many are salted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.llm.store import materialise, release

ROUNDS = 60
#: Edges that one task contracts at once.
PART = 500_000
#: Tables of (node, least node) are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Parts that the edges of each node are dealt to in a shuffled join.
SALTS = 16


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1, the least node of each one's component under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]


def _contract(batches):
    """Edges (u, v) of a part as stars: (node, least node of its component in the part)."""
    batches = list(batches)  # PART edges at most
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    ends = pa.chunked_array(table["u"].chunks + table["v"].chunks).combine_chunks().dictionary_encode()
    names, at = ends.dictionary, ends.indices.to_numpy()
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[at]
    label = least_labels(at[: len(table)], at[len(table) :], len(order))
    child = np.flatnonzero(label != np.arange(len(order)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(order[child])), names.take(pa.array(order[label[child]]))], names=["u", "v"])


def with_least(edges: DataFrame, least: DataFrame, key: str, small: bool) -> DataFrame:
    """``edges`` joined with (key, m), without a task that holds all edges of one node."""
    if small:
        return edges.join(F.broadcast(least), key)
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", part: int = PART, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) for every node that has an edge to another: the least node of its component.

    Self-edges, repeated edges and edges with a null end are ignored; nodes are numbers,
    strings or bytes.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialise(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(ROUNDS):
        parts = max(1, -(-now.count() // part))
        stars = materialise(now.repartition(parts).mapInArrow(_contract, now.schema), "edges")
        release(now)
        now = stars
        # Stars, when each node has one parent and no parent has one; one part always is.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        if parts == 1 or not ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 OR (c = 1 AND p = 1)").limit(1).count():
            break
        small = now.count() <= broadcast_rows
        # Large star: neighbours above a node move to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        moved = with_least(now, least.select(F.col("u").alias("v"), "m"), "v", small).select("u", F.col("m").alias("v"))
        large = materialise(moved.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "edges")
        # Small star: neighbours below a node, and the node, move to the least of them.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = with_least(large, below, "u", small).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(moved.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(now, large)
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
