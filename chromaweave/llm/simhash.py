"""SimHash fingerprints and exact search in a Hamming radius, in DataFrame operations only.

A term is a word; it weighs by its occurrences and by its length, since short words
tell little.  Its hash votes with that weight on each of 128 signed bits.  Votes are
summed two to a 64-bit number (32 bits each), one sum for each pair of bits.

The search cuts fingerprints into blocks and permutes the blocks: fingerprints that
differ in at most ``radius`` bits agree on all blocks but ``radius`` of them, so they
meet in a table keyed by some choice of the others.  Equal fingerprints are searched
once, and a pair that meets in several tables is kept in the first of them only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 128
LANES = 0x0000000100000001
SPACES = r"[\x20\x09-\x0D]+"
#: Letters of a word from which on its weight no longer grows.
LONG_WORD = 32
LEAST_LONG = -(1 << 63)


def words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES)


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``hi`` and ``lo`` (long), the fingerprint of all ``text`` under the same keys.

    Keys must tell rows apart.  A null, empty or blank text has the fingerprint 0.
    """
    each = rows.select(*keys, F.explode(words(F.col(text))).alias("_w"))
    long = F.least(F.length("_w"), F.lit(LONG_WORD)).cast("long")
    each = each.select(
        *keys,
        F.when(long == 0, F.lit(0)).otherwise(F.greatest(long - 3, F.lit(0)) * 4 + 1).cast("long").alias("_t"),
        F.xxhash64("_w", F.lit(1)).alias("_hi"),
        F.xxhash64("_w", F.lit(2)).alias("_lo"),
    )
    sums = [F.sum("_t").alias("_t")]
    for half in ("_hi", "_lo"):
        sums += [F.sum(F.shiftrightunsigned(half, k).bitwiseAND(F.lit(LANES)) * F.col("_t")).alias(f"{half}{k}") for k in range(32)]
    votes = each.groupBy(*keys).agg(*sums)

    def word_of(half):
        bits = []
        for k in range(32):
            low = F.col(f"{half}{k}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(f"{half}{k}", 32)
            for count, j in ((low, k), (high, k + 32)):
                bit = 1 << j if j < 63 else LEAST_LONG
                bits.append(F.when(count * 2 > F.col("_t"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return votes.select(*keys, word_of("_hi").alias("hi"), word_of("_lo").alias("lo"))


def as_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - distance(hi, lo, hi2, lo2) / F.lit(float(BITS))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds up to ``key``, less one: a binary search over a literal array."""
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def halve(at, step):
        there = at + step
        return F.when((there < len(bounds)) & (F.try_element_at(array, there + 1) <= key), there).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document and the next one by ascending id, the first after the last.

    Gives _bucket and _pos (together they tell rows apart), _ghost, the id, the text
    and ``_next``.  Ids are cut into ranges of about equal size; the rows at a range's
    lower bound are copied as ghosts behind the range before it, so that each range is
    sorted by itself and no task sees all rows.  Null ids come first; rows with equal
    ids are ordered by their texts' hashes.  Of a ghost only its text counts.  Ids are
    whole numbers; others raise a TypeError.
    """
    if not isinstance(docs.schema[doc_id].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"{doc_id} has to be a whole number")
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_LONG))
    rows = docs.select(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), key.alias("_key"))
    n = min(8192, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One row of at most n + 1 numbers.
    cut = rows.agg(F.min("_key").alias("least"), F.percentile_approx("_key", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()
    bounds = sorted({cut["least"], *(cut["cuts"] or [])} - {None}) or [LEAST_LONG]
    rows = rows.withColumn("_bucket", _bucket(F.col("_key"), bounds))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("wrap"), F.lit(0).alias("ghost"))
    first = F.col("_bucket") == 0
    ghost = F.struct(
        F.when(first, len(bounds) - 1).otherwise(F.col("_bucket") - 1).alias("b"), F.when(first, 1).otherwise(0).alias("wrap"), F.lit(1).alias("ghost")
    )
    at_bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("_bucket") + 1) == F.col("_key")
    rows = rows.withColumn("_place", F.explode(F.when(at_bound, F.array(own, ghost)).otherwise(F.array(own))))
    order = W.partitionBy("_bucket").orderBy("_wrap", "_key", F.xxhash64("_text"), "_ghost")
    rows = rows.select(doc_id, "_text", "_key", F.col("_place.b").alias("_bucket"), F.col("_place.wrap").alias("_wrap"), F.col("_place.ghost").alias("_ghost"))
    return rows.select("_bucket", F.row_number().over(order).alias("_pos"), "_ghost", doc_id, "_text", F.lead("_text").over(order).alias("_next"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as
    many of the next document.  Gives the id, n_chars, edited_sha256, hi, lo,
    edited_hi, edited_lo, next_hi, next_lo.  One row for each input row, repeated ones
    too; null texts count as empty; an empty table gives an empty table; other columns
    are ignored.
    """
    rows = with_next(docs, doc_id, text)
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = rows.select("_bucket", "_pos", "_ghost", F.col(doc_id).alias("_id"), n.cast("long").alias("n_chars"), "_text", F.when(F.col("_ghost") == 0, edited).alias("_edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    versions = F.when(F.col("_ghost") == 0, F.array(F.struct(F.lit(0).alias("v"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("t"))))
    rows = rows.withColumn("_v", F.explode(F.coalesce(versions, F.array(F.struct(F.lit(0).alias("v"), F.col("_text").alias("t"))))))
    keys = ["_bucket", "_pos", "_ghost", "_id", "n_chars", "edited_sha256", "_version"]
    found = fingerprints(rows.select(*keys[:-1], F.col("_v.v").alias("_version"), F.col("_v.t").alias("_text")), keys, "_text")
    order = W.partitionBy("_bucket").orderBy("_pos", "_version")
    ahead = [F.lead(c, k).over(order).alias(f"{name}_{c}") for k, name in ((1, "edited"), (2, "next")) for c in ("hi", "lo")]
    found = found.select("*", *ahead).where("_ghost = 0 AND _version = 0")
    return found.select(F.col("_id").alias(doc_id), "n_chars", "edited_sha256", "hi", "lo", "edited_hi", "edited_lo", "next_hi", "next_lo")


def near(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Every pair of a query and a row whose fingerprints (hi, lo) differ in at most ``radius`` bits.

    Gives query_id, row_id (arrays would repeat copies: one row for each pair of ids)
    and distance.  Rows with a null fingerprint match nothing.
    """
    if not 0 <= radius < blocks or BITS % 2 or blocks > BITS:
        raise ValueError("there must be more blocks than bits that may differ")
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def bits(hi, lo, a, b):
        """Bits a to b (from the top) as two numbers, others zero."""
        mask = ((1 << (BITS - a)) - 1) ^ ((1 << (BITS - b)) - 1)
        high, low = mask >> 64, mask & ((1 << 64) - 1)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return hi.bitwiseAND(F.lit(signed(high)).cast("long")), lo.bitwiseAND(F.lit(signed(low)).cast("long"))

    tables = list(combinations(range(blocks), blocks - radius))

    def keys(hi, lo):
        out = []
        for number, chosen in enumerate(tables):
            parts = [bits(hi, lo, edges[i], edges[i + 1]) for i in chosen]
            out.append(F.struct(F.lit(number).alias("table"), reduce(lambda a, b: a.bitwiseOR(b), [p[0] for p in parts]).alias("kh"), reduce(lambda a, b: a.bitwiseOR(b), [p[1] for p in parts]).alias("kl")))
        return F.explode(F.array(*out))

    def side(df, a):
        each = df.where("hi IS NOT NULL AND lo IS NOT NULL").select("hi", "lo").distinct()
        return each.select(F.col("hi").alias(f"{a}hi"), F.col("lo").alias(f"{a}lo"), keys(F.col("hi"), F.col("lo")).alias("k")).select(f"{a}hi", f"{a}lo", "k.*")

    pairs = side(queries, "q").join(side(rows, "r"), ["table", "kh", "kl"])
    qh, ql, rh, rl = (F.col(c) for c in ("qhi", "qlo", "rhi", "rlo"))
    pairs = pairs.withColumn("distance", distance(qh, ql, rh, rl)).where(F.col("distance") <= radius)

    def agrees(chosen):
        tests = []
        for i in chosen:
            (a, b), (c, d) = bits(qh, ql, edges[i], edges[i + 1]), bits(rh, rl, edges[i], edges[i + 1])
            tests += [a == c, b == d]
        return reduce(lambda a, b: a & b, tests)

    first = F.least(*[F.when(agrees(chosen), number).otherwise(len(tables)) for number, chosen in enumerate(tables)], F.lit(len(tables)))
    pairs = pairs.where(F.col("table") == first).select("qhi", "qlo", "rhi", "rlo", "distance")
    q = queries.select(F.col(query_id).alias("query_id"), F.col("hi").alias("qhi"), F.col("lo").alias("qlo"))
    r = rows.select(F.col(row_id).alias("row_id"), F.col("hi").alias("rhi"), F.col("lo").alias("rlo"))
    return pairs.join(q, ["qhi", "qlo"]).join(r, ["rhi", "rlo"]).select("query_id", "row_id", "distance")
