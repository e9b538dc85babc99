"""Two tokenizers' tokens of one text, aligned by the bytes they cover.

The end offsets of B's tokens, in order, are a static interval index.  Each token of A
stabs it twice by bisection: the tokens of B between the two hits overlap it.  A gap
between two tokens of B that no token of A spans ends a group, since a token of A ends
there as well.

Texts are cut at single spaces between other characters before anything is encoded.
Neither tokenizer has a token that reaches over such a place: A's pre-tokens begin with
their space, and no piece of B holds its space sign behind another sign.  So each of the
chunks is aligned by itself, once for all its occurrences in a block of texts, and the
answers are those of the whole text.  Texts in which a chunk fails to give its own bytes
back are encoded whole.

How many documents hold a pair of ids linked is counted in blocks of texts, then over
all blocks by a join on the pair.  Nothing is broadcast and no pair leaves a block
twice, so a frequent pair costs one row for each block of :data:`BLOCK_CHARS` characters.
"""

from __future__ import annotations

import hashlib
import re
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm.packing import fast_encoder
from chromaweave.llm.store import batches_of, materialise, release, unused

#: Characters of text after which a block is closed; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters of distinct chunks that a worker remembers from block to block.
KEPT_CHARS = 4_000_000
#: Rows of texts handed to Python at once.
TEXT_ROWS = 500
#: A single space between two other characters: no token of either side reaches over it.
CUT = re.compile(r"(?<=\S) (?=\S)")

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def stab(a_start, a_end, b_start, b_end):
    """For tokens of A, the first and one past the last token of B they overlap; B's tokens are sorted and disjoint."""
    return np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")


def unspanned(lo, hi, n_b: int):
    """Whether the gap behind each of ``n_b`` tokens of B is spanned by no token of A."""
    depth = np.zeros(n_b + 1, np.int64)
    some = hi > lo
    np.add.at(depth, lo[some], 1)
    np.add.at(depth, hi[some] - 1, -1)
    return np.cumsum(depth)[:n_b] == 0


def _ragged(starts, sizes):
    """The numbers starts[i], starts[i] + 1, ... of each i, ``sizes[i]`` of them, in one array."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Tokenizers:
    """Both vocabularies as tables of bytes, and the alignment of lists of chunks."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = fast_encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        #: Whether texts may be cut; a piece with a space sign behind another sign would reach over the cut.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.told = np.array([f"{i}{s}" for s in (",", "|", ";") for i in range(most)], object)
        self.most = most

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def chunks(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def align(self, chunks: list[str]) -> dict:
        """What each chunk has, with a space before it: numbers, links and the groups as text.

        ``ok`` is false, and all else empty, where the tokens' bytes are not the chunk's.
        """
        ids_a = [self.a.encode_ordinary(" " + c) for c in chunks]
        ids_b = self.b.encode(chunks, num_threads=1) if chunks else []
        want = [(" " + c).encode() for c in chunks]
        ok = np.array([b"".join([self.bytes_a[i] for i in x]) == w and b"".join([self.bytes_b[i] for i in y]) == w for x, y, w in zip(ids_a, ids_b, want, strict=True)], bool)
        none: list[int] = []
        ids_a, ids_b = [x if k else none for x, k in zip(ids_a, ok, strict=True)], [x if k else none for x, k in zip(ids_b, ok, strict=True)]
        n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        a = np.fromiter((i for x in ids_a for i in x), np.int64, int(n_a.sum()))
        b = np.fromiter((i for x in ids_b for i in x), np.int64, int(n_b.sum()))
        of_a, of_b = np.repeat(np.arange(len(chunks)), n_a), np.repeat(np.arange(len(chunks)), n_b)
        a_end, b_end = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # All chunks lie on one line of bytes: both sides of a chunk have the same length.
        lo, hi = stab(a_end - self.len_a[a], a_end, b_end - self.len_b[b], b_end)
        ends = unspanned(lo, hi, len(b))
        group_b = np.cumsum(ends) - ends
        group_a = group_b[lo] if len(b) else lo
        links = hi - lo
        linked_a, linked_b = np.repeat(np.arange(len(a)), links), _ragged(lo, links)
        n_groups = np.bincount(of_b, ends, len(chunks)).astype(np.int64)
        n_links = np.bincount(of_a, links, len(chunks)).astype(np.int64)
        # Groups as text: the tokens of A of each group, then those of B.
        total = len(a) + len(b)
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        token, side, group = np.empty(total, np.int64), np.empty(total, np.int8), np.empty(total + 1, np.int64)
        token[at_a], token[at_b] = a, b
        side[at_a], side[at_b] = 0, 1
        group[at_a], group[at_b] = group_a, group_b
        group[total:] = -1
        mark = np.where(group[:-1] != group[1:], 2, np.where(np.append(side[1:], 0) != side, 1, 0)) if total else token
        said = self.told[mark * self.most + token].tolist()
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = ["".join(said[i:j])[:-1] for i, j in zip(cuts, cuts[1:], strict=False)]
        return {"ok": ok, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups, "pairs": a[linked_a] * len(self.bytes_b) + b[linked_b]}


_LOADED: dict = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Tokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


class Known:
    """Chunks aligned so far, numbered, with their answers in arrays."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.columns = {c: np.empty(0, np.int64) for c in NUMBERS} | {"ok": np.empty(0, bool), "pairs": np.empty(0, np.int64)}

    def learn(self, chunks) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        if not new:
            return
        found = self.both.align(new)
        for c in new:
            self.number[c] = len(self.number)
            self.chars += len(c)
        self.groups += found["groups"]
        self.columns = {c: np.concatenate([x, found[c]]) for c, x in self.columns.items()}


def align_block(known: Known, texts: list[str | None], digest: bool) -> dict:
    """One block: numbers and groups of each text; its distinct pairs, how many texts hold each; each text's pairs."""
    both = known.both
    if known.chars > KEPT_CHARS:
        known.clear()
    cut = [both.chunks(t) if t else [] for t in texts]
    known.learn(c for t in cut for c in t)
    number = known.number.__getitem__
    slots = [list(map(number, t)) for t in cut]
    ok = known.columns["ok"]
    if not ok.all():
        odd = [i for i, s in enumerate(slots) if not ok[s].all()]
        # What fails in parts is tried as a whole, and has no tokens if that fails too.
        known.learn(texts[i] for i in odd)
        for i in odd:
            s = number(texts[i])
            slots[i] = [s] if known.columns["ok"][s] else []
    sizes = np.array([len(s) for s in slots], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    flat = np.fromiter((x for s in slots for x in s), np.int64, int(sizes.sum()))
    out = {c: np.bincount(of, known.columns[c][flat], len(texts)).astype(np.int64) for c in NUMBERS}
    groups = (";".join([known.groups[x] for x in s]) for s in slots)
    out["groups"] = [hashlib.sha256(g.encode()).hexdigest() if digest and g else g for g in groups]
    # Distinct chunks of each text, then distinct pairs of each text with how often they occur.
    n_links = known.columns["n_links"]
    kinds = len(known.number)
    each, times = np.unique(of * kinds + flat, return_counts=True)
    doc, slot = each // max(kinds, 1), each % max(kinds, 1)
    first = np.cumsum(n_links) - n_links
    here = known.columns["pairs"][_ragged(first[slot], n_links[slot])]
    pairs, which = np.unique(here, return_inverse=True)
    key, back = np.unique(np.repeat(doc, n_links[slot]) * max(len(pairs), 1) + which, return_inverse=True)
    out["mult"] = np.bincount(back, np.repeat(times, n_links[slot]), len(key)).astype("<i4")
    out["idx"] = (key % max(len(pairs), 1)).astype("<i4")
    out["ptr"] = np.searchsorted(key, np.arange(len(texts) + 1) * max(len(pairs), 1)).astype("<i4")
    out["pair"], out["df"] = pairs, np.bincount(out["idx"], minlength=len(pairs)).astype(np.int64)
    return out


def _blocks(batches, text: str):
    """Record batches gathered until their texts have BLOCK_CHARS characters."""
    held, chars = [], 0
    for b in batches:
        at = 0
        sizes = [len(x.as_py() or "") for x in b.column(text)]
        for i, n in enumerate(sizes):
            if chars and chars + n > BLOCK_CHARS:
                held.append(b.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, chars, at = [], 0, i
            chars += n
        held.append(b.slice(at))
    if held and (whole := pa.Table.from_batches(held)).num_rows:
        yield whole


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Each text's tokens in both tokenizers, cut into groups, and how usual its links are.

    ``path_a`` is a byte-level BPE file of ``tokenizers``, ``path_b`` a ``sentencepiece``
    model that puts a space before a text; A gets the same space.  Special tokens'
    strings are ordinary text.  One row for each row of ``docs``: the ``keep`` columns,
    n_a, n_b (tokens), n_groups, n_links (overlapping pairs of tokens), n_best (links
    whose pair of ids is linked in as many texts as any pair of its A id), count_sum
    (over the links, in how many texts their pair is linked) and ``groups``:
    ``a1,a2|b1;a3|b2,b3``, the ids of each group in order, or with ``digest`` the
    SHA-256 of that, lowercase hex.

    A null or empty text, and one that the tokens of A or B do not spell byte by byte,
    has no tokens: zeros and ''.  Repeated rows count as documents each.  An empty
    table gives no rows.  Columns that are not kept are ignored; kept ones may not have
    the names of the new columns.
    """
    new = {*NUMBERS, "n_best", "count_sum", "groups"}
    if clash := new & {c.lower() for c in keep}:
        raise ValueError(f"kept columns have the names of new ones: {sorted(clash)}")
    fields = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in NUMBERS] + [T.StructField("groups", T.StringType())])
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(fields)), T.StructField("pair", T.ArrayType(T.LongType())), T.StructField("df", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("ptr", "idx", "mult")]
    )
    body = unused("_text", keep)

    def blocks(batches):
        known, part = Known(tokenizers(path_a, path_b)), TaskContext.get().partitionId()
        numbers = count()
        for table in _blocks(batches, body):
            found = align_block(known, table.column(body).to_pylist(), digest)
            columns = [table.column(c).combine_chunks() for c in keep] + [pa.array(found[c]) for c in NUMBERS] + [pa.array(found["groups"], pa.string())]
            rows = pa.StructArray.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[*keep, *NUMBERS, "groups"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + next(numbers)]), one(rows), one(pa.array(found["pair"])), one(pa.array(found["df"]))] + [pa.array([found[c].tobytes()], pa.binary()) for c in ("ptr", "idx", "mult")],
                names=schema.names,
            )

    spark = docs.sparkSession
    with batches_of(spark, TEXT_ROWS):
        aligned = materialise(docs.select(*keep, F.col(text).cast("string").alias(body)).mapInArrow(blocks, schema), "aligned")
    counted = aligned.select(F.explode(F.arrays_zip("pair", "df")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.df").alias("n"))
    n_b = len(tokenizers(path_a, path_b).bytes_b)
    # An id of A has at most as many pairs as B has ids.
    best = F.max("n").over(W.partitionBy(F.expr(f"pair div {n_b}")))
    counted = materialise(counted.withColumn("best", F.col("n") == best), "pairs")
    asked = aligned.select("block", F.explode("pair").alias("pair")).join(counted, "pair")
    # A block has as many pairs as its characters allow.
    told = asked.groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("told"))
    out = T.StructType([*fields.fields[:-1], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), fields.fields[-1]])

    def totals(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                rows = row.column("docs").flatten()
                pairs = row.column("told").flatten()  # none where no text of the block has tokens
                ptr, idx, mult = (np.frombuffer(row.column(c)[0].as_py(), "<i4").astype(np.int64) for c in ("ptr", "idx", "mult"))
                pair, n, best = (pairs.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.argsort(pair)
                n, best = n[order], best[order]
                each = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ptr])
                own = [rows.field(i) for i in range(rows.type.num_fields)]
                n_best, count_sum = (each(np.where(best[idx], mult, 0)), each(n[idx] * mult)) if len(idx) else (np.zeros(len(rows), np.int64),) * 2
                yield pa.RecordBatch.from_arrays([*own[:-1], pa.array(n_best), pa.array(count_sum), own[-1]], names=out.names)

    with batches_of(spark, 1):
        done = materialise(aligned.select("block", "docs", "ptr", "idx", "mult").join(told, "block", "left").select("docs", "ptr", "idx", "mult", "told").mapInArrow(totals, out), "linked")
    release(aligned, counted)
    return done
