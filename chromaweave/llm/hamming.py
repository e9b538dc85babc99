"""Exact top-k search among binary codes by incremental multi-index hashing.

Codes are cut into m segments, and each segment's value is a key of an index.  In
round r every open query looks up, in each segment, all values at distance r from its
own; what it finds is verified on whole codes.  After round r every code nearer than
m * (r + 1) has been found, since a code farther than r in each segment is at least so
far away in all.  A query is closed as soon as its k-th verified distance is below
that bound, so no code that could displace a result is left out.

Equal codes are indexed once, with the k least ids of their rows; no further id of
theirs could be among the results.  Equal query codes are searched once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaweave.llm.store import materialise

WORD = 64


def sign_codes(rows: DataFrame, row_id: str, vector: str, dims: int | None = None) -> DataFrame:
    """(id, code): one bit for each component over 0, in array<bigint> words of 64 bits.

    Rows whose vector is null, holds nulls or has another length than ``dims`` (by
    default the most frequent length, the longer of equally frequent ones) have no code
    and are left out.
    """
    size = F.size(vector)
    if dims is None:
        found = rows.where(F.col(vector).isNotNull() & (size > 0)).groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims = found["d"] if found else 0
    whole = rows.where((size == dims) & ~F.exists(vector, lambda x: x.isNull()) & F.lit(dims > 0))

    def word(w):
        bits = F.sequence(F.lit(0), F.lit(min(WORD, dims - w * WORD) - 1))
        one = lambda acc, j: acc.bitwiseOR(F.when(F.element_at(vector, j + w * WORD + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), one)

    return whole.select(F.col(row_id).alias("id"), F.array(*[word(w) for w in range(-(-dims // WORD))] or [F.lit(0).cast("long")]).alias("code"))


def _segments(dims: int, width: int) -> list[tuple[int, int, int]]:
    """(word, shift, bits) of each segment; none crosses a word."""
    out = []
    for w in range(-(-dims // WORD)):
        bits = min(WORD, dims - w * WORD)
        parts = max(1, round(bits / width))
        edges = [bits * i // parts for i in range(parts + 1)]
        out += [(w, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def _part(code: Column, segment: tuple[int, int, int]) -> Column:
    w, shift, bits = segment
    mask = (1 << bits) - 1 if bits < WORD else -1
    return F.shiftrightunsigned(F.element_at(code, w + 1), shift).bitwiseAND(F.lit(mask).cast("long"))


def top_k(queries: DataFrame, rows: DataFrame, k: int, dims: int, width: int | None = None) -> DataFrame:
    """The ``k`` rows nearest to each query: query_id, rank (from 1), id, distance.

    Both inputs have id and code (:func:`sign_codes`).  Equal distances rank by id,
    nulls last.  A query finds itself if it is among the rows.  Fewer rows than k give
    fewer results; none give none.  Repeated rows are results each; so are repeated
    queries.  ``width`` is the bits of a segment, by default the logarithm of the number
    of distinct codes less 2, so that a key has a few codes and lookups stay few.
    """
    ranked = W.partitionBy("code").orderBy(F.col("id").isNull(), "id")
    ids = rows.select("code", "id", F.row_number().over(ranked).alias("i")).where(F.col("i") <= k)
    codes = materialise(ids.groupBy("code").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("null"), "id"))).alias("ids")), "codes")
    n = codes.count()
    width = width or max(4, min(16, round(log2(max(n, 2))) - 2))
    segments = _segments(max(dims, 1), width)
    m, rounds = len(segments), max(s[2] for s in segments)
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), _part(F.col("code"), s).alias("key")) for i, s in enumerate(segments)]))
    index = materialise(codes.select("code", "ids", keyed.alias("p")).select("code", "ids", "p.*"), "index")
    open_ = materialise(queries.select(F.col("code").alias("q")).distinct(), "open")
    best = lambda df: df.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    closed: list[DataFrame] = []
    kept = None
    for r in range(rounds + 1):
        # From a table, not as literals: thousands of masks would swell every plan.
        masks = [(i, sum(1 << b for b in bits)) for i, s in enumerate(segments) if r <= s[2] for bits in combinations(range(s[2]), r)]
        masks = materialise(rows.sparkSession.createDataFrame(masks, "s int, mask long"), "masks")
        own = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), _part(F.col("q"), s).alias("own")) for i, s in enumerate(segments)]))
        look = open_.select("q", own.alias("o")).select("q", "o.s", "o.own")
        # At most 12870 masks (16 choose 8) a segment.
        look = look.join(F.broadcast(masks), "s").select("q", "s", F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
        met = look.join(index, ["s", "key"])
        apart = [F.bit_count(_part(F.col("q"), s).bitwiseXOR(_part(F.col("code"), s))) for s in segments]
        # A code is met in every segment at distance r, and may have been met before: it counts once.
        first = reduce(lambda a, b: a & b, [F.when(F.col("s") > i, d > r).otherwise(d >= r) for i, d in enumerate(apart)])
        met = met.where(first).withColumn("d", reduce(lambda a, b: a + b, apart))
        entry = F.transform("ids", lambda x: F.struct(F.col("d").alias("d"), x["null"].alias("null"), x["id"].alias("id")))
        # The nearest k codes of a query hold its nearest k ids.
        near = W.partitionBy("q").orderBy("d", F.element_at("ids", 1))
        met = met.select("q", "d", "ids", F.row_number().over(near).alias("i")).where(F.col("i") <= k).select("q", entry.alias("top"))
        top = met if kept is None else met.unionByName(kept)
        empty = F.slice(F.array(F.struct(F.lit(0).alias("d"), F.lit(False).alias("null"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"))), 1, 0)
        top = best(top).join(open_, "q", "right").select("q", F.coalesce("top", empty).alias("top"))
        top = materialise(top, "top")
        bound = m * (r + 1)
        done = (F.size("top") >= k) & (F.get(F.col("top.d"), F.lit(k - 1)) < bound) | F.lit(r == rounds)
        closed.append(top.where(done))
        kept = top.where(~done)
        if not kept.limit(1).count():
            break
        open_ = kept.select("q")
    answers = reduce(DataFrame.unionByName, closed)
    named = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(answers, "q")
    out = named.select("query_id", F.posexplode("top").alias("rank", "t"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("t.id").alias("id"), F.col("t.d").alias("distance"))
