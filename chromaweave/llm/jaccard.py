"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

1. Every text becomes its set of distinct 5-word shingles, as 58-bit hashes.  A first
   pass finds which shingles may lie in several texts, and how common they are
   (``setjoin.rarity``); rare ones come first in every set.
2. Two sets that reach the threshold share a shingle in their prefixes.  Documents with
   equal sets are one member; members with equal size and prefix are one group; only
   groups are joined on prefix shingles, and only on those that several texts may have.
3. Groups that meet are filtered by size, by how many of their shingles can be matched
   at all, by where the shingle stands in their prefixes, and by parities of their sets
   (``setjoin.meetings``), in tasks that tell only the pairs which pass.
4. What passes is expanded to members and verified on whole sets.  The first rounds
   verify one partner for each group, at last the one that differs least, and one
   member of each group against the others; then all pairs are expanded that could
   still connect different components.  So large groups of near copies cost a few
   pairs per member, and no link that could join components is lost.

Sets of members are made again from texts where they are needed, and go through the
network once per round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm.components import components
from chromaweave.llm.linededup import with_row_ids
from chromaweave.llm.setjoin import BROADCAST_ROWS, fits, input_bytes, matched, meetings, parities, prefix_length, rarity, shared_lists, verified
from chromaweave.llm.store import free_shuffles, materialise, release

WORDS = 5
THRESHOLD_PERCENT = 80
HASH_MASK = np.uint64((1 << 58) - 1)
#: Word hashes that a worker remembers.
CACHE_WORDS = 250_000
#: Rounds in which each group tries the partner that differs least, at most; another one follows if so large a share linked.
BEST_ROUNDS, BEST_SHARE = 2, 0.1


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = WordHashes()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted 58-bit hashes of the distinct n-word shingles; of all words where they are fewer."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    m = len(words) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out & HASH_MASK)


def member_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def keyed(rows: DataFrame, table, n: int, percent: int, carry: list[str]) -> DataFrame:
    """``carry`` with the set's size, how many can be matched, its key, its group's key, what can be matched of its prefix, and, with that, its parities."""
    schema = T.StructType(
        [rows.schema[c] for c in carry]
        + [T.StructField("_n", T.LongType(), False), T.StructField("_e", T.LongType(), False), T.StructField("_member", T.BinaryType()), T.StructField("_group", T.LongType()), T.StructField("_prefix", T.ArrayType(T.LongType(), False)), T.StructField("_bits", T.BinaryType())]
    )

    def run(batches):
        rarity = table.value
        for b in batches:
            sizes, matchable, keys, groups, prefixes, bits = [], [], [], [], [], []
            for t in b.column("_text").to_pylist():
                s = rarity.ordered(shingles(t, n))
                p = s[: prefix_length(len(s), percent)]
                sizes.append(len(s))
                matchable.append(len(matched(s)))
                keys.append(member_key(s) if len(s) else None)
                groups.append(xxhash.xxh3_64_intdigest(p.tobytes(), len(s)) - (1 << 63) if len(s) else None)
                # Sets too few of whose elements can be matched have no partner.
                prefixes.append(matched(p).astype(np.int64) if 100 * matchable[-1] >= percent * len(s) else [])
                bits.append(parities(s) if len(prefixes[-1]) else None)
            lists = pa.array(prefixes, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in carry] + [pa.array(sizes, pa.int64()), pa.array(matchable, pa.int64()), pa.array(keys, pa.binary()), pa.array(groups, pa.int64()), lists, pa.array(bits, pa.binary())], names=[*carry, "_n", "_e", "_member", "_group", "_prefix", "_bits"])

    return rows.select(*carry, "_text").mapInArrow(run, schema)


def check(pairs: DataFrame, rows: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of members whose whole sets reach the threshold.

    Texts of the members are found by the hash of a text that has the member's set.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_member")).distinct()
    need = materialise(known.join(ends, "_member", "left_semi").select("_member", "_t1", "_t2"), "need")
    small = need.count() <= BROADCAST_ROWS
    texts = rows.select("_t1", "_t2", "_text").join(F.broadcast(need) if small else need, ["_t1", "_t2"])
    texts = texts.groupBy("_member").agg(F.first("_text").alias("text")).withColumnRenamed("_member", "member")
    links = verified(pairs, texts, lambda t: shingles(t, n), percent)
    release(need)
    return links


def replaced(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``new``, written; ``old``, which it was made from, is deleted."""
    out = materialise(new, name)
    release(old)
    return out


def memberships(rows: DataFrame, carry: list[str], n: int, percent: int, sketch_bits: int | None) -> tuple[DataFrame, DataFrame]:
    """(keys, roots) of rows with ``carry`` columns, _text, _t1 and _t2.

    keys: the carried columns, set size _n and member _member (null without shingles);
    roots: _member and root, the same for linked members.
    """
    spark = rows.sparkSession
    table = spark.sparkContext.broadcast(rarity(rows.select("_text"), lambda t: shingles(t, n), input_bytes(rows), sketch_bits, sketch_bits))
    keys = materialise(keyed(rows, table, n, percent, [*carry, "_t1", "_t2"]), "keys")
    known = keys.where("_member IS NOT NULL").groupBy("_member").agg(F.first("_group").alias("_group"), F.min(F.struct("_t1", "_t2")).alias("t"))
    known = materialise(known.select("_member", "_group", "t.*"), "members")

    # Groups that meet on a shingle of their prefixes.
    groups = keys.where("size(_prefix) > 0").groupBy(F.col("_group").alias("node")).agg(F.first("_n").alias("n"), F.first("_e").alias("e"), F.first("_prefix").alias("_prefix"))
    lists = shared_lists(groups.select("node", "n", "e", F.posexplode("_prefix").alias("at", "s")))
    hubs = materialise(lists.groupBy("s").agg(F.min(F.struct("n", "node", "e")).alias("h")).select("s", *[F.col(f"h.{c}").alias(f"h{c}") for c in ("n", "node", "e")]), "hubs")
    small = hubs.count() <= BROADCAST_ROWS
    met = lists.join(F.broadcast(hubs) if small else hubs, "s").where((F.col("node") != F.col("hnode")) & fits(F.col("n"), F.col("e"), F.col("hn"), F.col("he"), percent))
    best = met.groupBy("node", "hnode").count().groupBy("node").agg(F.max_by("hnode", F.struct("count", "hnode")).alias("hnode"))

    # First within each group, and each group with its best partner among the hubs.
    lead = materialise(known.groupBy(F.col("_group").alias("node")).agg(F.min("_member").alias("lead"), F.count("*").alias("members")), "leads")
    inside = known.join(lead.where("members > 1"), F.col("_group") == F.col("node")).where("_member <> lead").select(F.col("lead").alias("a"), F.col("_member").alias("b"))
    across = best.join(lead, "node").join(lead.select(F.col("node").alias("hnode"), F.col("lead").alias("_to")), "hnode").select(F.col("_to").alias("a"), F.col("lead").alias("b"))
    tested = materialise(inside.unionByName(across), "pairs")
    release(hubs)
    free_shuffles(spark)
    links = check(tested, rows, known, n, percent)
    roots = materialise(components(links), "roots")

    def where_now():
        """(members with their roots, groups with their least and greatest root)."""
        moved = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
        placed = known.join(moved.select(F.col("node").alias("_member"), "root"), "_member", "left").select("_member", F.col("_group").alias("node"), F.coalesce("root", "_member").alias("root"))
        placed = materialise(placed, "placed")
        spread = materialise(placed.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "spread")
        return placed, spread

    placed, spread = where_now()
    listed = lists.select("node").distinct()
    # A group of several members has no parities of its own.
    several = lead.where("members > 1").select("node")
    parity = keys.where("size(_prefix) > 0").groupBy(F.col("_group").alias("node")).agg(F.first("_bits").alias("bits"))
    parity = materialise(parity.join(listed, "node", "left_semi").join(several, "node", "left_anti"), "parities")
    free_shuffles(spark)

    # Rounds in which each group tries the partner of another component that differs least,
    # so that classes of many near copies grow together; then all pairs left.
    turn, last = 0, False
    while not last:
        last = turn == BEST_ROUNDS
        turn += 1
        meet = meetings(lists, spread.join(listed, "node", "left_semi"), parity, percent, best=not last)
        if not last:
            pairs = meet.join(lead.select(F.col("node").alias("node1"), F.col("lead").alias("a")), "node1").join(lead.select(F.col("node").alias("node2"), F.col("lead").alias("b")), "node2").select("a", "b")
        else:
            inner = spread.where("lo <> hi").select(F.col("node").alias("node1"), F.col("node").alias("node2"))
            side = lambda i: placed.select(F.col("node").alias(f"node{i}"), F.col("_member").alias("ab"[i - 1]), F.col("root").alias(f"root{i}"))
            pairs = meet.select("node1", "node2").unionByName(inner).join(side(1), "node1").join(side(2), "node2")
            pairs = pairs.where("root1 <> root2").where((F.col("node1") != F.col("node2")) | (F.col("a") < F.col("b"))).select("a", "b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = materialise(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        release(meet)
        tried = pairs.count()
        more = check(pairs, rows, known, n, percent) if tried else pairs
        found = more.count()
        if found < BEST_SHARE * tried or not tried:
            turn = BEST_ROUNDS  # all pairs left come next
        if found:
            links = replaced(links, links.unionByName(more), "links")
            release(roots, placed, spread)
            roots = materialise(components(links), "roots")
            placed, spread = where_now()
        if more is not pairs:
            release(more)
        tested = replaced(tested, tested.unionByName(pairs), "tested")
        release(pairs)
        free_shuffles(spark)
    release(lists, parity, tested, links, lead, known, spread, roots)
    return keys.select(*carry, "_n", "_member"), placed.select("_member", "root")


def _rows(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(*more, body.alias("_text"), F.xxhash64(body).alias("_t1"), F.xxhash64(body, F.lit(1)).alias("_t2"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = THRESHOLD_PERCENT, sketch_bits: int | None = None) -> DataFrame:
    """One row per document: the id, ``n_shingles`` and ``component_id``.

    Words are runs without ASCII white space, A-Z in lower case.  Documents link when
    100 * intersection >= percent * union of their shingle sets; component_id is the
    least id reachable by links, the document's own without any.  Null or blank texts
    have no shingles and no links.  Equal texts always link.  Null ids never are a
    component's id unless all its ids are null.  Repeated rows are answered each; an
    empty table gives an empty table; other columns are ignored.
    """
    keys, roots = memberships(_rows(docs, text, F.col(doc_id).alias("_id")), ["_id"], n, percent, sketch_bits)
    least = keys.where("_member IS NOT NULL").groupBy("_member").agg(F.min("_id").alias("_least")).join(roots, "_member")
    least = least.join(least.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("_member", "component_id")
    out = keys.join(least, "_member", "left")
    return out.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = THRESHOLD_PERCENT, sketch_bits: int | None = None) -> DataFrame:
    """``docs`` with one document of each class: the one of the least id, nulls last, then the first row.

    Documents without shingles all stay.  Repeated rows are copies of each other; an
    empty table gives an empty table; other columns may have any name.
    """
    named, row = with_row_ids(docs)
    placed_at = [F.col(row[0]).alias("_file"), F.col(row[1]).alias("_at")]
    keys, roots = memberships(_rows(named, text, F.col(doc_id).alias("_id"), *placed_at), ["_id", "_file", "_at"], n, percent, sketch_bits)
    placed = keys.where("_member IS NOT NULL").select("_member", F.struct(F.col("_id").isNull().alias("null"), "_id", "_file", "_at").alias("place")).join(roots, "_member")
    first = placed.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("size")).where("size > 1")
    gone = materialise(placed.join(first, "root").where("place <> first").select(F.col("place._file").alias(row[0]), F.col("place._at").alias(row[1])), "gone")
    release(keys, roots)
    small = gone.count() <= BROADCAST_ROWS
    return named.join(F.broadcast(gone) if small else gone, row, "left_anti").select(*docs.columns)
