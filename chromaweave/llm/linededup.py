"""Fuzzy line deduplication by MinHash.

A line's shingles are all its runs of ``SHINGLE`` characters; a shorter line is one
shingle.  Lines with equal text (a 128-bit hash) count as one.  Blank lines are left
alone.

1. One pass over the texts cuts lines and signs each distinct line by 18 minima over
   the hashes of its shingles (rolling hashes of whole batches in numpy); three minima
   make a band.  For lines of Jaccard 0.8 a band agrees with probability 0.51, one of
   six with 0.986.
2. Bands of several lines are found by an aggregate; only their lines go on, each to a
   task for every one of its bands.  There bitmaps of the shingle sets rule out most
   pairs, and the others are compared whole unless links connect them already.
3. Bands too large for a task (``TASK_ELEMENTS``) are compared by a prefix join on rare
   shingles (``setjoin``).  Either way no pair of a band is left out that could connect
   two components.
4. Lines are linked if the exact Jaccard similarity of their shingle sets reaches the
   threshold; components of links are found by distributed union-find, and the first
   line of each component is kept.

The signing runs in Python: a run of characters costs about 260 ns in the JVM (explode,
hash, 18 minima in one aggregate), and 34 ns here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm.components import components
from chromaweave.llm.setjoin import BROADCAST_ROWS, HASH_BITS, LEAST_SEEN, MOST_SEEN, matched, meetings, parities, prefix_length, rarity, shared_lists, verified
from chromaweave.llm.store import free_shuffles, materialise, release, unused

SHINGLE = 9
THRESHOLD_PERCENT = 80
BANDS, ROWS = 6, 3
#: Code points hashed at once.
BLOCK = 1 << 17
#: Bands whose lines have up to so many shingles are compared by one task, larger ones by a join.
TASK_ELEMENTS = 4_000_000
#: Distinct lines that a task remembers, so that it signs them once.
SEEN_LINES = 250_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TURNS = np.random.default_rng(9).integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns, and their names, which tell rows apart and do not change between runs.

    Files know their rows' numbers; what does not come from files is written first.
    """
    row = [unused("_file", docs.columns), unused("_at", docs.columns)]
    try:
        named = docs.select("*", F.xxhash64("_metadata.file_path").alias(row[0]), F.col("_metadata.row_index").alias(row[1]))
        named.schema  # noqa: B018  resolves the columns
        return named, row
    except AnalysisException:
        return materialise(docs.select("*", F.lit(0).cast("long").alias(row[0]), F.monotonically_increasing_id().alias(row[1])), "rows"), row


def lines_of(text: str | None) -> list[str]:
    """The lines of a text, without carriage returns and the blanks around."""
    return [] if text is None else [x.strip(" ") for x in text.replace("\r", "").split("\n")]


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))


def _runs(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n code points, by doubling."""
    one = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    one ^= one >> np.uint64(31)
    one *= _MULTIPLY
    out, size, power, factors = one, 1, _MULTIPLY, []
    bits = bin(n)[3:]
    with np.errstate(over="ignore"):
        for bit in bits:
            out, size = out[: len(out) - size] * power + out[size:], 2 * size
            power = power * power
            if bit == "1":
                out, size = out[: len(out) - 1] * _MULTIPLY + one[size : size + len(out) - 1], size + 1
                power = power * _MULTIPLY
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingle_hashes(line: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted 58-bit hashes of the distinct shingles of a line."""
    if not line:
        return np.empty(0, np.uint64)
    return np.unique(_runs(_points(line.ljust(n, "\0")), n) >> np.uint64(64 - HASH_BITS))


def sign(lines: list[str], n: int = SHINGLE) -> np.ndarray:
    """The minima (lines x 18) of each line's shingles' hashes."""
    out = np.full((len(lines), BANDS * ROWS), np.uint64(2**64 - 1))
    pieces = [(j, s[a : a + BLOCK + n - 1]) for j, s in enumerate(x.ljust(n, "\0") for x in lines) for a in range(0, len(s) - n + 1, BLOCK)]
    at = 0
    while at < len(pieces):
        stop, size = at, 0
        while stop < len(pieces) and (size == 0 or size + len(pieces[stop][1]) <= BLOCK):
            size += len(pieces[stop][1])
            stop += 1
        run = pieces[at:stop]
        lengths = np.array([len(s) for _, s in run])
        starts = np.cumsum(lengths) - lengths
        h = _runs(_points("".join(s for _, s in run) + "\0"), n)
        # From each piece's first run to after its last; runs across pieces lie between.
        cuts = np.stack([starts, starts + lengths - n + 1], 1).ravel()
        which = [j for j, _ in run]
        for k, turn in enumerate(_TURNS):
            least = np.minimum.reduceat(h ^ turn, cuts)[::2]
            if stop - at == 1:
                out[which[0], k] = min(out[which[0], k], least[0])
            else:
                np.minimum.at(out[:, k], which, least)
        at = stop
    return out


def bands_of(minima: np.ndarray) -> np.ndarray:
    """(lines x 6) hashes of the bands."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), 1))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = (h ^ minima[:, r::ROWS]) * _MULTIPLY
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def signed_lines(rows: DataFrame, row: list[str], text: str, order: str, n: int) -> DataFrame:
    """(file, at, ln, order, key, half, bands) of every line that is not blank; bands once for each line of a task."""
    schema = T.StructType(
        [T.StructField("file", T.LongType()), T.StructField("at", T.LongType()), T.StructField("ln", T.IntegerType()), T.StructField("order", rows.schema[order].dataType), T.StructField("key", T.BinaryType()), T.StructField("half", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            of, numbers, keys, new, new_at = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for j, line in enumerate(lines_of(t)):
                    if line:
                        k = line_key(line)
                        if k not in seen:
                            if len(seen) >= SEEN_LINES:
                                seen.clear()
                            seen.add(k)
                            new.append(line)
                            new_at.append(len(keys))
                        of.append(i)
                        numbers.append(j)
                        keys.append(k)
            counts = np.zeros(len(keys) + 1, np.int32)
            counts[1:][new_at] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(bands_of(sign(new, n)).ravel()), mask=pa.array(counts[1:] == 0))
            take = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in ("file", "at")], pa.array(numbers, pa.int32()), b.column("order").take(take), pa.array(keys, pa.binary()), pa.array(np.frombuffer(b"".join(keys), "<i8")[::2]), lists], names=schema.names)

    wanted = rows.select(F.col(row[0]).alias("file"), F.col(row[1]).alias("at"), F.col(order).alias("order"), F.col(text).cast("string").alias("text"))
    return wanted.mapInArrow(run, schema)


def _texts(rows: DataFrame, text: str, need: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    """(member, text, n) with the sizes of sets of the lines whose keys are needed."""
    count = need.count()
    wanted = None
    if count <= broadcast_rows:
        keys = np.frombuffer(b"".join(bytes(r["member"])[:8] for r in need.toLocalIterator()), "<u8")
        wanted = rows.sparkSession.sparkContext.broadcast(np.unique(keys))  # 8 bytes for each

    def run(batches):
        for b in batches:
            lines = [x for t in b.column(0).to_pylist() for x in lines_of(t) if x]
            keys = [line_key(x) for x in lines]
            if wanted is not None:
                table = wanted.value
                h = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
                hit = table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)
                keep = {keys[i]: lines[i] for i in np.flatnonzero(hit).tolist()}
            else:
                keep = dict(zip(keys, lines, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(keep), pa.binary()), pa.array(list(keep.values()), pa.string())], names=["member", "text"])

    def measure(batches):
        for b in batches:
            yield b.append_column("n", pa.array([len(shingle_hashes(t, n)) for t in b.column("text").to_pylist()], pa.int64()))

    found = rows.select(F.col(text).cast("string")).mapInArrow(run, "member binary, text string")
    found = found.join(F.broadcast(need) if count <= broadcast_rows else need, "member", "left_semi")
    found = found.groupBy("member").agg(F.first("text").alias("text"))
    return materialise(found.mapInArrow(measure, "member binary, text string, n long"), "linetexts")


class _Band:
    """Links of the lines of one band, enough to connect all that are near.

    A bitmap of each set's hashes gives a lower bound of how many elements two sets do
    not share, and so rules out most pairs; what it leaves is compared whole, nearest
    first, unless earlier links connect the two already.
    """

    BITS = 2048

    def __init__(self, texts: list[str], n: int, percent: int):
        self.sets = [shingle_hashes(t, n) for t in texts]
        self.sizes = np.array([len(s) for s in self.sets])
        self.percent = percent

    def near(self, i: int, j: int) -> bool:
        x, y = self.sets[i], self.sets[j]
        both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def links(self) -> list[tuple[int, int]]:
        if len(self.sets) == 2:
            return [(0, 1)] if self.near(0, 1) else []
        bits = np.zeros((len(self.sets), self.BITS), bool)
        for row, s in zip(bits, self.sets, strict=True):
            row[(s & np.uint64(self.BITS - 1)).astype(np.int64)] = True
        bitmaps = np.packbits(bits, axis=1).view(np.uint64)
        root, out = np.arange(len(self.sets)), []
        for i in range(1, len(self.sets)):
            apart = np.bitwise_count(bitmaps[:i] ^ bitmaps[i]).sum(1, dtype=np.int64)
            may = np.flatnonzero(apart * (100 + self.percent) <= (self.sizes[:i] + self.sizes[i]) * (100 - self.percent))
            for j in may[np.argsort(apart[may], kind="stable")].tolist():
                if root[i] != root[j] and self.near(i, j):
                    out.append((j, i))
                    lo, hi = sorted((root[i], root[j]))
                    root[: i + 1][root[: i + 1] == hi] = lo
        return out


def _band_links(placed: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of near lines, from rows (band, key, text) of bands that fit a task."""

    def found(keys, texts):
        return [(keys[i], keys[j]) for i, j in _Band(texts, n, percent).links()] if len(keys) > 1 else []

    def run(batches):
        band, keys, texts, out = None, [], [], []
        for b in batches:
            for x, k, t in zip(*(b.column(c).to_pylist() for c in ("band", "key", "text")), strict=True):
                if x != band:
                    out += found(keys, texts)
                    band, keys, texts = x, [], []
                keys.append(k)
                texts.append(t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])
                out = []
        out += found(keys, texts)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    dealt = placed.select("band", "key", "text").repartition("band").sortWithinPartitions("band", "key")
    return materialise(dealt.mapInArrow(run, "a binary, b binary"), "bandlinks")


def _large_links(placed: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of near lines, from rows (band, key) of bands that no task should hold.

    Lines are compared with the least and the greatest line of their band, then, where
    components differ, by a prefix join on the elements of the band that they share.
    """
    spark, elements = texts.sparkSession, lambda t: shingle_hashes(t, n)
    ends = placed.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    ends = placed.join(F.broadcast(materialise(ends, "bandends")), "band").select("key", F.explode(F.array("lo", "hi")).alias("to")).where("key <> to")
    pairs = materialise(ends.select(F.least("key", "to").alias("a"), F.greatest("key", "to").alias("b")).distinct(), "linepairs")
    links = verified(pairs, texts, elements, percent, as_sets=False)
    roots = materialise(components(links), "lineroots")
    moved = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
    placed = placed.join(moved.select(F.col("node").alias("key"), "root"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    members = placed.groupBy(F.col("key").alias("member")).agg(F.first("root").alias("root"), F.collect_set("band").alias("bands"))  # BANDS at most
    members = materialise(members.join(texts, "member"), "openlines")
    size = members.agg(F.sum("n")).first()[0] or 0
    table = spark.sparkContext.broadcast(rarity(members.select("text"), elements, size, seen_bits=min(MOST_SEEN, max(LEAST_SEEN, (8 * size).bit_length()))))

    def run(batches):
        held = table.value
        for b in batches:
            matchable, prefixes = [], []
            for t in b.column("text").to_pylist():
                s = held.ordered(shingle_hashes(t, n))
                matchable.append(len(matched(s)))
                prefixes.append(matched(s[: prefix_length(len(s), percent)]).astype(np.int64) if 100 * matchable[-1] >= percent * len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column("member"), b.column("bands"), b.column("n"), pa.array(matchable, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], names=["node", "bands", "n", "e", "prefix"])

    posted = members.mapInArrow(run, "node binary, bands array<long>, n long, e long, prefix array<long>").where("size(prefix) > 0")
    posted = posted.select("node", "n", "e", "prefix", F.explode("bands").alias("band")).select("node", "n", "e", "band", F.posexplode("prefix").alias("at", "x"))
    lists = shared_lists(posted.select("node", "n", "e", "at", F.xxhash64("band", "x").alias("s")))
    spread = members.select(F.col("member").alias("node"), F.col("root").alias("lo"), F.col("root").alias("hi"))

    def tell(batches):
        for b in batches:
            bits = [parities(elements(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("member"), pa.array(bits, pa.binary())], names=["node", "bits"])

    parity = materialise(members.select("member", "text").mapInArrow(tell, "node binary, bits binary"), "parities")
    met = meetings(lists, spread, parity, percent).select(F.col("node1").alias("a"), F.col("node2").alias("b"))
    more = verified(met.join(pairs, ["a", "b"], "left_anti"), texts, elements, percent, as_sets=False)
    out = materialise(links.unionByName(more), "largelinks")
    release(pairs, links, roots, members, lists, parity, met, more)
    return out


def near_components(rows: DataFrame, text: str, lines: DataFrame, n: int, percent: int, broadcast_rows: int, task_elements: int) -> DataFrame:
    """(node, root) of the keys of lines linked to others."""
    spark = rows.sparkSession
    # By the first half of keys: most bands have one line, and go here.
    shared = lines.where("bands IS NOT NULL").select("half", F.explode("bands").alias("band"))
    shared = shared.groupBy("band").agg(F.min("half").alias("lo"), F.max("half").alias("hi")).where("lo <> hi").select("band")
    shared = materialise(shared, "sharedbands")
    posted = lines.where("bands IS NOT NULL").select("key", F.explode("bands").alias("band"))
    buckets = posted.join(F.broadcast(shared) if shared.count() <= broadcast_rows else shared, "band").distinct()
    buckets = materialise(buckets, "linebuckets")
    release(shared)
    # Near lines share most of their bands, and bands of the same lines are compared once.
    marks = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"), F.count("*").alias("m")]
    once = buckets.groupBy("band").agg(*marks).groupBy("x", "y", "m").agg(F.min("band").alias("band")).select("band")
    every, buckets = buckets, materialise(buckets.join(once, "band", "left_semi"), "linebuckets")
    release(every)
    need = materialise(buckets.select(F.col("key").alias("member")).distinct(), "needlines")
    texts = _texts(rows, text, need, n, broadcast_rows)
    release(need)
    free_shuffles(spark)
    # How many elements the lines of a band have tells whether a task can hold them.
    placed = buckets.join(texts.select(F.col("member").alias("key"), "text", "n"), "key")
    large = placed.groupBy("band").agg(F.sum("n").alias("all")).where(F.col("all") > task_elements).select("band")
    large = materialise(large, "largebands")
    if large.limit(1).count():
        links = _band_links(placed.join(F.broadcast(large), "band", "left_anti"), n, percent)
        more = _large_links(materialise(buckets.join(F.broadcast(large), "band", "left_semi"), "largebuckets"), texts, n, percent)
        links = materialise(links.unionByName(more), "linelinks")
    else:
        links = _band_links(placed, n, percent)
    release(buckets, texts, large)
    free_shuffles(spark)
    roots = materialise(components(links), "lineroots")
    release(links)
    return roots


def dropped_lines(rows: DataFrame, row: list[str], text: str = "text", order: str = "doc_id", n: int = SHINGLE, percent: int = THRESHOLD_PERCENT, broadcast_rows: int = BROADCAST_ROWS, task_elements: int = TASK_ELEMENTS) -> DataFrame:
    """(file, at, drop), written: the numbers of the lines of a document that repeat an earlier one.

    Earlier means: of the least document by ``order`` (nulls last), then by row id and
    line number.
    """
    lines = materialise(signed_lines(rows, row, text, order, n), "lines")
    roots = near_components(rows, text, lines, n, percent, broadcast_rows, task_elements)
    place = F.struct(F.col("order").isNull().alias("null"), "order", "file", "at", "ln")
    # Lines that stand alone drop out; of the others the first place by key, and by component.
    first = lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    moved = F.broadcast(roots) if roots.count() <= broadcast_rows else roots
    known = first.join(moved.select(F.col("node").alias("key"), "root"), "key", "left").where("n > 1 OR root IS NOT NULL")
    known = materialise(known.select("key", "first", "root"), "knownlines")
    kept = known.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("kept"))
    kept = F.broadcast(kept) if known.count() <= broadcast_rows else kept
    keep = known.join(kept, "root", "left").select("key", F.coalesce("kept", "first").alias("keep"))
    keep = materialise(keep, "keep")
    seen = lines.select("key", "file", "at", "ln", place.alias("place"))
    drops = seen.join(F.broadcast(keep) if keep.count() <= broadcast_rows else keep, "key").where("place <> keep")
    drops = materialise(drops.groupBy("file", "at").agg(F.collect_set("ln").alias("drop")), "drops")
    release(lines, roots, known, keep)
    return drops


def dedup_lines(docs: DataFrame, text: str = "text", order: str = "doc_id", kept: str | None = None, n: int = SHINGLE, percent: int = THRESHOLD_PERCENT, broadcast_rows: int = BROADCAST_ROWS, task_elements: int = TASK_ELEMENTS) -> DataFrame:
    """``docs`` without lines that repeat, exactly or nearly, a line elsewhere.

    Of each group of near lines the first one stays, by document and line number.  Blank
    lines stay.  Rows and their order of columns stay; a text of which nothing is left
    becomes empty; null texts stay null.  ``kept`` names an additional column: the
    numbers of the kept lines; an input column of that name is replaced.  Repeated rows
    lose all lines but in the first; an empty table gives an empty table.  Other
    columns may have any name.  Tables of keys go to every task up to
    ``broadcast_rows`` rows, and are shuffled beyond.
    """
    rows, row = with_row_ids(docs)
    drops = dropped_lines(rows, row, text, order, n, percent, broadcast_rows, task_elements)
    gone = unused("_drop", docs.columns)
    drops = drops.select(F.col("file").alias(row[0]), F.col("at").alias(row[1]), F.col("drop").alias(gone))
    joined = rows.join(F.broadcast(drops) if drops.count() <= broadcast_rows else drops, row, "left")
    out = [c for c in docs.columns if c != kept]
    schema = T.StructType([T.StructField(c, T.StringType()) if c == text else docs.schema[c] for c in out] + ([T.StructField(kept, T.ArrayType(T.IntegerType()))] if kept else []))

    def cut(batches):
        for b in batches:
            texts, numbers = b.column(text).to_pylist(), []
            for i, without in enumerate(b.column(gone).to_pylist()):
                lines = texts[i].split("\n") if texts[i] is not None and (kept or without) else []
                stay = range(len(lines))
                if without:
                    stay = sorted(set(stay).difference(without))
                    texts[i] = "\n".join([lines[j] for j in stay])
                numbers.append(None if texts[i] is None else list(stay))
            columns = [pa.array(texts, pa.string()) if c == text else b.column(c) for c in out]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(numbers, pa.list_(pa.int32()))] if kept else []), names=schema.names)

    wanted = [F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in out]
    return joined.select(*wanted, gone).mapInArrow(cut, schema)
