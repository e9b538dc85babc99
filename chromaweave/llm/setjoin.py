"""What the joins on set similarity share: rarity of elements, prefixes, filters, verification.

Sets are sorted arrays of distinct 58-bit hashes.  A first pass over all texts counts, in
a sketch, how common elements are, and marks in a bitmap those that may lie in more than
one text.  An element whose bit is not set lies in one text only and matches nothing.  So

- sets are ordered by rarity, unmatched elements first, then by the logarithm of the
  count, then by hash; any total order keeps the join exact;
- the prefix of a set of n, its first n - ceil(t n) + 1 elements, meets every set that
  reaches the threshold t; its unmatched elements need not be looked up;
- sets of n and m elements of which e and f can be matched share min(e, f) at most;
- sets that have to share o elements share one among the first e - o + 1 and f - o + 1
  that can be matched;
- parities of the numbers of elements in ``PARITY_BITS`` buckets differ in no more buckets
  than there are elements in one set only.

In a large group of near copies most pairs share a prefix element, so pairs are not joined
as rows: the rows of an element go to a task, in blocks where they are many, which tests
pairs by the last three rules and tells those that pass.

Sketch and bitmap grow with the input up to a fixed size.  Beyond it they tell less, and
lists of candidates are longer; what is found stays the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweave.llm.store import batches_of, materialise, release

HASH_BITS = 58
#: Bytes of (compressed) input for each counter of the sketch; its least and largest size in bits.
BYTES_PER_COUNTER, LEAST_BITS, MOST_BITS = 128, 16, 24
#: Bits of the bitmap for each byte of input, as a power of 2; its least and largest size.
SEEN_SHIFT, LEAST_SEEN, MOST_SEEN = -1, 16, 29
#: Slots that a task collects before it tells them.
CHUNK = 1 << 21
#: Counters or bits told at once.
SLICE, SEEN_SLICE = 1 << 16, 1 << 20
#: Tables of keys are broadcast up to so many rows, about 20 MB, and shuffled beyond.
BROADCAST_ROWS = 500_000
#: Pairs handed to Python at once: each carries two whole sets.
PAIRS_AT_ONCE = 64
#: Buckets of a set's parities.
PARITY_BITS = 2048
#: Rows of an element that one task tests against each other or against another block.
BLOCK_ROWS = 4096
#: Tables with parities are broadcast up to so many rows.
BROADCAST_PARITIES = 50_000

Elements = Callable[[str | None], np.ndarray]


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size; only the sizes of sketches depend on it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Rarity:
    """How common elements are: ``levels`` by a hash's lowest bits, ``seen`` (a bitmap) by its highest."""

    def __init__(self, levels: np.ndarray, seen: np.ndarray):
        self.levels, self.seen = levels, seen

    def ordered(self, s: np.ndarray) -> np.ndarray:
        """The elements with their level in front (0: unmatched), sorted."""
        slot = s >> np.uint64(HASH_BITS - (len(self.seen) * 8).bit_length() + 1)
        matched = (self.seen[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
        level = np.maximum(self.levels[(s & np.uint64(len(self.levels) - 1)).astype(np.int64)], 1) * matched
        return np.sort((level.astype(np.uint64) << np.uint64(HASH_BITS)) | s)


def matched(s: np.ndarray) -> np.ndarray:
    """Those of ordered elements that may be matched."""
    return s[np.searchsorted(s, np.uint64(1 << HASH_BITS)) :]


def prefix_length(n: int, percent: int) -> int:
    """How many first elements of a set of n meet those of every set that reaches the threshold."""
    return n - -(-n * percent // 100) + 1 if n else 0


def rarity(texts: DataFrame, elements: Elements, size: int, bits: int | None = None, seen_bits: int | None = None) -> Rarity:
    """Of all elements of the (one) text column; ``size``: about how many bytes it has.

    Tasks tell counters and bits in compressed slices; slices are combined by number,
    so that no worker holds more than the slices of its own partition.
    """
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_COUNTER).bit_length()))
    if seen_bits is None:
        seen_bits = min(MOST_SEEN, max(LEAST_SEEN, size.bit_length() + SEEN_SHIFT))
    counters, width, seen_width = 1 << bits, min(SLICE, 1 << bits), min(SEEN_SLICE, 1 << seen_bits)
    names = ["seen", "i", "c", "d"]

    def row(seen, i, c, d=None):
        return pa.RecordBatch.from_arrays([pa.array([seen], pa.bool_()), pa.array([i], pa.int32()), pa.array([c], pa.binary()), pa.array([d], pa.binary())], names=names)

    def packed(slots):
        bits = np.zeros(seen_width, bool)
        bits[slots] = True
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)

    def told(pending):
        slots = np.concatenate(pending)
        slots.sort()
        twice = slots[1:][slots[1:] == slots[:-1]]
        cuts = np.arange(0, (1 << seen_bits) + 1, seen_width, dtype=np.int64)
        at, at2 = np.searchsorted(slots, cuts), np.searchsorted(twice, cuts)
        for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
            yield row(True, i, packed(slots[at[i] : at[i + 1]].astype(np.int64) - cuts[i]), packed(twice[at2[i] : at2[i + 1]].astype(np.int64) - cuts[i]))

    def count(batches):
        counts, pending, held = np.zeros(counters, np.uint16), [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                s = elements(t)
                at = (s & np.uint64(counters - 1)).astype(np.int64)
                counts[at] = np.minimum(counts[at], 65534) + 1
                pending.append((s >> np.uint64(HASH_BITS - seen_bits)).astype(np.uint32))
                held += len(s)
                if held >= CHUNK:
                    yield from told(pending)
                    pending, held = [], 0
        if held:
            yield from told(pending)
        for i in range(counters // width):
            part = counts[i * width : (i + 1) * width]
            if part.any():
                yield row(False, i, zlib.compress(part.tobytes(), 1))

    def combine(batches):
        sums: dict[int, np.ndarray] = {}
        once: dict[int, np.ndarray] = {}
        more: dict[int, np.ndarray] = {}
        for b in batches:
            for seen, i, c, d in zip(*(b.column(x).to_pylist() for x in names), strict=True):
                if seen:
                    c, d = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (c, d))
                    if i in once:
                        more[i] = more[i] | d | (once[i] & c)
                        once[i] = once[i] | c
                    else:
                        once[i], more[i] = c, d
                else:
                    part = np.frombuffer(zlib.decompress(c), np.uint16)
                    sums[i] = sums[i] + part if i in sums else part.astype(np.uint64)
        for i, s in sums.items():
            yield row(False, i, zlib.compress(np.minimum(2 * np.log2(np.maximum(s, 1)), 63).astype(np.uint8).tobytes()))
        for i, m in more.items():
            yield row(True, i, zlib.compress(m.tobytes(), 1))

    schema = "seen boolean, i int, c binary, d binary"
    slices = counters // width + (1 << seen_bits) // seen_width
    parts = texts.mapInArrow(count, schema).repartition(min(slices, 64), "seen", "i").mapInArrow(combine, schema)
    levels, seen = np.zeros(counters, np.uint8), np.zeros((1 << seen_bits) // 8, np.uint8)
    for r in parts.toLocalIterator():  # both of fixed size
        part = np.frombuffer(zlib.decompress(r["c"]), np.uint8)
        if r["seen"]:
            seen[r["i"] * seen_width // 8 : (r["i"] + 1) * seen_width // 8] = part
        else:
            levels[r["i"] * width : (r["i"] + 1) * width] = part
    return Rarity(levels, seen)


def fits(n: Column, e: Column, m: Column, f: Column, percent: int) -> Column:
    """Whether sets of n and m elements, of which e and f can be matched, may reach the threshold."""
    return F.least(e, f) * (100 + percent) >= (n + m) * percent


def parities(s: np.ndarray) -> bytes:
    """Whether an odd number of the elements lies in each bucket."""
    odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def shared_lists(posted: DataFrame) -> DataFrame:
    """The rows (s, node, ...) whose element several nodes have, written."""
    several = posted.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("s")
    several = materialise(several, "shared")
    out = materialise(posted.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "s"), "lists")
    release(several)
    return out


class _Block:
    """Rows (p, q, node, n, e, at, lo, hi, inside, part, bits) of one element, and which of them may hold near sets.

    ``part`` tells the blocks p and q apart; rows of the same one are tested against each
    other only where p is q.
    """

    def __init__(self, table: pa.Table, percent: int):
        self.node = table["node"].combine_chunks()
        self.n, self.e, self.at, self.lo, self.hi, self.part = (table[c].to_numpy() for c in ("n", "e", "at", "lo", "hi", "part"))
        self.inside, self.two = table["inside"].to_numpy(), table["p"][0].as_py() != table["q"][0].as_py()
        bits = table["bits"].to_pylist()
        self.known = np.array([b is not None for b in bits])
        self.bits = np.frombuffer(b"".join(b or bytes(PARITY_BITS // 8) for b in bits), np.uint64).reshape(len(bits), -1)
        self.percent = percent

    def partners(self, i: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows that row i, not inside, may be near to, and in how many buckets they differ; of rows not inside either only later ones."""
        other = self.part != self.part[i] if self.two else np.ones(len(self.n), bool)
        if later:
            other &= self.inside | (np.arange(len(self.n)) > i)
        other &= (self.lo != self.lo[i]) | (self.hi != self.hi[i]) | (self.lo != self.hi)
        other[i] = False
        j = np.flatnonzero(other)
        need = -(-(self.n[i] + self.n[j]) * self.percent // (100 + self.percent))
        j_ok = (self.at[i] <= self.e[i] - need) & (self.at[j] <= self.e[j] - need)
        j, need = j[j_ok], need[j_ok]
        apart = np.bitwise_count(self.bits[j] ^ self.bits[i]).sum(1, dtype=np.int64)
        apart[~(self.known[j] & self.known[i])] = 0
        near = apart <= self.n[i] + self.n[j] - 2 * need
        return j[near], apart[near]

    def pairs(self, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, row, share of elements that differ at least) of pairs that may be near; ``best``: the best one of each row not inside."""
        one, two, share = [], [], []
        for i in np.flatnonzero(~self.inside).tolist():
            j, apart = self.partners(i, not best)
            if len(j):
                x = apart / (self.n[i] + self.n[j])
                if best:
                    k = np.argmin(x)
                    j, x = j[k : k + 1], x[k : k + 1]
                one.append(np.full(len(j), i))
                two.append(j)
                share.append(x)
        return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in ((one, np.int64), (two, np.int64), (share, np.float64)))


def meetings(lists: DataFrame, spread: DataFrame, parity: DataFrame, percent: int, best: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node1, node2, apart), written, of nodes that may hold near sets of different components.

    ``lists`` has s, node, n, e and at: the matchable elements of every node's prefix, and
    their places among them, from 0.  ``spread`` has node, lo and hi: the least and greatest
    component of the sets that a node stands for.  ``parity`` has node and bits, the
    parities of its set, null for a node of several.  Nodes of an element's largest
    component meet those of others only.  ``apart``: the share of both sets' elements that
    differ at least.  ``best``: for each node outside the largest component only the
    partner that differs least.
    """
    small = spread.count() <= BROADCAST_ROWS
    spread = spread.select("node", F.xxhash64("lo").alias("lo"), F.xxhash64("hi").alias("hi"))
    located = lists.join(F.broadcast(spread) if small else spread, "node")
    mixed = located.groupBy("s").agg(F.min(F.least("lo", "hi")).alias("l"), F.max(F.greatest("lo", "hi")).alias("h"), F.count("*").alias("rows")).where("l <> h").select("s", "rows")
    mixed = materialise(mixed, "mixed")
    located = materialise(located.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed, "s"), "located")
    release(mixed)
    uniform = F.col("lo") == F.col("hi")
    major = located.where(uniform).groupBy("s", "lo").count().groupBy("s").agg(F.max_by("lo", F.struct("count", "lo")).alias("major"))
    placed = located.join(major, "s", "left").withColumn("inside", F.coalesce(uniform & (F.col("lo") == F.col("major")), F.lit(False)))
    few = parity.count() <= BROADCAST_PARITIES
    placed = placed.join(F.broadcast(parity) if few else parity, "node", "left")
    # A block meets itself and every other one.
    blocks = F.ceil(F.col("rows") / F.lit(block_rows)).cast("int")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("s", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "node", "n", "e", "at", "lo", "hi", "inside", "part", "bits")
    key = ["s", "p", "q"]
    node = lists.schema["node"].dataType.simpleString()

    def run(batches):
        left = None
        for b in batches:
            table = pa.Table.from_batches([b])
            if left is not None:
                table = pa.concat_tables([left, table])
            ids = np.stack([table[c].to_numpy() for c in key])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            yield from told(table, np.concatenate([[0], cuts]))
            left = table.slice(cuts[-1] if len(cuts) else 0)  # block_rows, twice, at most
        if left is not None:
            yield from told(left, np.array([0, len(left)]))

    def told(table, cuts):
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if z - a > 1:
                block = _Block(table.slice(a, z - a), percent)
                one, two, apart = block.pairs(best)
                if len(one):
                    yield pa.RecordBatch.from_arrays([block.node.take(pa.array(one)), block.node.take(pa.array(two)), pa.array(apart)], names=["node1", "node2", "apart"])

    dealt = placed.repartition(*key).sortWithinPartitions(*key)
    met = dealt.mapInArrow(run, f"node1 {node}, node2 {node}, apart double")
    if best:
        met = met.groupBy("node1").agg(F.min(F.struct("apart", "node2")).alias("b")).select("node1", "b.node2", "b.apart")
    else:
        met = met.groupBy(F.least("node1", "node2").alias("node1"), F.greatest("node1", "node2").alias("node2")).agg(F.min("apart").alias("apart"))
    out = materialise(met, "meet")
    release(located)
    return out


def verified(pairs: DataFrame, texts: DataFrame, elements: Elements, percent: int, as_sets: bool = True) -> DataFrame:
    """Those of the pairs (a, b) of members whose whole sets reach the threshold, written.

    ``texts`` has member and text, once for every member of a pair.  Sets are made once
    for every text, or (short texts, much smaller than their sets) for every pair; then
    ``texts`` has n, the sets' sizes, and pairs of too different sizes are not tried.
    """
    body, made = texts, None

    def make(batches):
        for b in batches:
            sets = [elements(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("member"), pa.array(sets, pa.binary())], names=["member", "text"])

    if as_sets:
        body = made = materialise(body.select("member", "text").mapInArrow(make, "member binary, text binary"), "sets").withColumn("n", F.lit(1))
    one, two = (body.select(F.col("member").alias(x), F.col("text").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "sa", "sb")

    def test(batches):
        for b in batches:
            keep, last, y = [], None, None
            for one, other in zip(b.column("sa"), b.column("sb"), strict=True):
                if as_sets:
                    x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                else:
                    x, other = elements(one.as_py()), other.as_py()
                    if other != last:  # pairs come by their second member
                        last, y = other, elements(other)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with batches_of(pairs.sparkSession, PAIRS_AT_ONCE):
        links = materialise(both.mapInArrow(test, "a binary, b binary"), "links")
    if made is not None:
        release(made)
    return links
