"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, exact decoding.

Pre-tokenisation uses no regular expression.  Every code point is mapped to one
of a few classes by table lookup.  Two finite automata read the classes: one from
the right (what follows), one from the left (which token is open).  A symbol acts
on an automaton as a function from states to states; such functions compose
associatively, so all prefixes are composed by a doubling scan over arrays.  The
functions that can arise are numbered once (the transition monoid), which makes
composing two of them a single table lookup.  Both automata forget their past
after a few symbols, and the scan ends as soon as every composite is constant.

Texts of any length are handled in one piece; batches are cut by characters, so
a worker holds at most one batch of ``BATCH_CHARS`` characters or one longer text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters handled at once; bounds the arrays of a worker.
BATCH_CHARS = 1 << 20
#: Distinct pieces whose merges a worker remembers.
CACHE_PIECES = 400_000
#: Rank of pairs that do not merge.
NO_PAIR = np.int32(2**31 - 1)

# Classes of code points (fixed order).
SPACE, WHITE, STMD, RV, LOW_L, LOW_E, LETTER, NUMBER, OTHER, QUOTE = range(10)
# Code points with the Unicode property White_Space, but for the space.
WHITE_POINTS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Automaton:
    """A finite automaton whose symbols act on all states at once.

    ``delta[symbol][state]`` is the next state.  ``run`` gives, for each position,
    the state before it, started in state 0.
    """

    def __init__(self, delta: list[list[int]]):
        symbols = [tuple(row) for row in delta]
        found = list(dict.fromkeys(symbols))
        seen = set(found)
        for f in found:  # grows while it is read
            for g in symbols:
                fg = tuple(g[x] for x in f)
                if fg not in seen:
                    seen.add(fg)
                    found.append(fg)
        number = {f: i for i, f in enumerate(found)}
        m = len(found)
        self.of_symbol = np.array([number[s] for s in symbols], np.uint16)
        self.width = m
        self.then = np.array([[number[tuple(g[x] for x in f)] for g in found] for f in found], np.uint16).ravel()
        self.constant = np.array([len(set(f)) == 1 for f in found])
        self.from_start = np.array([f[0] for f in found], np.uint8)

    def run(self, symbols: np.ndarray) -> np.ndarray:
        acts = self.of_symbol[symbols]
        step = 1
        while step < len(acts) and not self.constant[acts[step - 1 :]].all():
            nxt = acts.copy()
            nxt[step:] = self.then[acts[:-step].astype(np.int32) * self.width + acts[step:]]
            acts = nxt
            step *= 2
        before = np.empty(len(acts), np.uint8)
        before[:1] = 0
        before[1:] = self.from_start[acts[:-1]]
        return before


def _followers() -> Automaton:
    # States, read from the right: 0 end, 1 white space, 2 s t m d, 3 r or v before e,
    # 4 l before l, 5 e, 6 single l, 7 any other.
    delta = []
    for c in range(10):
        row = []
        for s in range(8):
            if c in (SPACE, WHITE):
                row.append(1)
            elif c == STMD:
                row.append(2)
            elif c == RV:
                row.append(3 if s == 5 else 7)
            elif c == LOW_L:
                row.append(4 if s in (4, 6) else 6)
            elif c == LOW_E:
                row.append(5)
            else:
                row.append(7)
        delta.append(row)
    return Automaton(delta)


# Symbols of the left automaton.
_L, _N, _O, _Q2, _Q3, _JOIN, _WHITE_RUN, _WHITE_LAST = range(8)


def _symbol_table() -> np.ndarray:
    table = np.zeros((10, 8), np.uint8)
    for c in range(10):
        for s in range(8):
            before_text = s >= 2
            if c == SPACE:
                x = _JOIN if before_text else _WHITE_RUN
            elif c == WHITE:
                x = _WHITE_LAST if before_text else _WHITE_RUN
            elif c == NUMBER:
                x = _N
            elif c == OTHER:
                x = _O
            elif c == QUOTE:
                x = _Q2 if s == 2 else _Q3 if s in (3, 4) else _O
            else:
                x = _L
            table[c, s] = x
    return table.ravel()


def _openings() -> tuple[Automaton, np.ndarray]:
    # States: 0 nothing open, 1 letters, 2 numbers, 3 others, 4 space that joins,
    # 5 white run, 6 one letter of a contraction to come, 7 two to come.
    delta, cut = [], []
    for x in range(8):
        row, cuts = [], []
        for s in range(8):
            if x == _L:
                nxt, c = (0, False) if s == 6 else (6, False) if s == 7 else (1, s not in (1, 4))
            elif x == _N:
                nxt, c = 2, s not in (2, 4)
            elif x == _O or (x in (_Q2, _Q3) and s in (3, 4)):
                nxt, c = 3, s not in (3, 4)
            elif x in (_Q2, _Q3):
                nxt, c = (6 if x == _Q2 else 7), True
            elif x == _JOIN:
                nxt, c = 4, True
            elif x == _WHITE_LAST:
                nxt, c = 0, True
            else:
                nxt, c = 5, s != 5
            row.append(nxt)
            cuts.append(c)
        delta.append(row)
        cut.append(cuts)
    return Automaton(delta), np.array(cut).ravel()


class PreTokenizer:
    """Finds where the pieces of a text begin."""

    def __init__(self):
        import regex

        # \p{L} and \p{N} by the Unicode tables of the regex package.
        every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        classes = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                classes[m.start() : m.end()] = kind
        classes[WHITE_POINTS] = WHITE
        classes[ord(" ")] = SPACE
        classes[ord("'")] = QUOTE
        for kind, letters in ((STMD, "stmd"), (RV, "rv"), (LOW_L, "l"), (LOW_E, "e")):
            classes[[ord(x) for x in letters]] = kind
        self.classes = classes
        self.followers = _followers()
        self.symbols = _symbol_table()
        self.openings, self.cut = _openings()

    def starts(self, text: str) -> np.ndarray:
        """Code-point positions at which a piece begins."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[points]
        after = self.followers.run(classes[::-1])[::-1]
        symbols = self.symbols[classes.astype(np.uint16) * 8 + after]
        open_ = self.openings.run(symbols)
        return np.flatnonzero(self.cut[symbols.astype(np.uint16) * 8 + open_])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Ranks of what two tokens merge to, in an open-addressed hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        todo = np.array([(a << 32) | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int32)
        at = self.slot(todo)
        while len(todo):  # one of those that want a slot gets it, the others try the next one
            free = self.keys[at] == -1
            self.keys[at[free]] = todo[free]
            won = self.keys[at] == todo
            self.values[at[won]] = value[won]
            todo, value, at = todo[~won], value[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        at = self.slot(keys)
        out = self.values[at]
        other = self.keys[at] != keys
        out[other] = NO_PAIR
        more = np.nonzero(other & (self.keys[at] != -1))
        while len(more[0]):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            hit = self.keys[at[more]] == keys[more]
            out[tuple(x[hit] for x in more)] = self.values[at[more]][hit]
            go = ~hit & (self.keys[at[more]] != -1)
            more = tuple(x[go] for x in more)
        return out


class ByteBPE:
    """Encoder and decoder over a rank file in tiktoken's format."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.ranks = read_ranks(path)
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.vocab[i] = piece
        self.sizes = np.array([len(x) for x in self.vocab], np.int64)
        self.pre = PreTokenizer()
        self.pairs = PairTable(self.ranks)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.blob = np.frombuffer(b"".join(self.vocab), np.uint8)
        self.blob_at = np.cumsum(self.sizes) - self.sizes
        self.cache: dict[str, bytes] = {}  # ids as packed int32
        self.cache_pieces = cache_pieces

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge adjacent parts, always the pair of least rank, leftmost first."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = 1 << 60
        pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap over a linked list: n log n for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins at i
        back = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and alive[j] and end[j] == stop):
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                back[stop] = i
            offer(i)
            if back[i] >= 0:
                offer(back[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """:meth:`merge` of pieces of one length, all at once; ids as packed int32."""
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)].reshape(len(pieces), -1)
        out = [b""] * len(pieces)

        def put(rows, ids):
            raw, step = ids.tobytes(), ids.shape[1] * 4
            for i, r in enumerate(rows.tolist()):
                out[r] = raw[i * step : (i + 1) * step]

        rows, width = np.arange(len(pieces)), ids.shape[1]
        pairs = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        while width > 1 and len(rows):
            at = pairs.argmin(1)
            every = np.arange(len(rows))
            best = pairs[every, at]
            over = best == NO_PAIR
            if over.any():
                put(rows[over], ids[over])
                go = ~over
                rows, ids, pairs, at, best = rows[go], ids[go], pairs[go], at[go], best[go]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids[every, at] = best
            ids = ids[keep].reshape(len(rows), width - 1)
            keep = np.ones(pairs.shape, bool)
            keep[every, at] = False
            pairs = pairs[keep].reshape(len(rows), width - 2)
            width -= 1
            left = np.flatnonzero(at > 0)
            j = at[left]
            pairs[left, j - 1] = self.pairs.lookup(ids[left, j - 1], ids[left, j])
            right = np.flatnonzero(at < width - 1)
            j = at[right]
            pairs[right, j] = self.pairs.lookup(ids[right, j], ids[right, j + 1])
        put(rows, ids)
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Merges of pieces that the cache does not hold."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        found = {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            if raw in self.ranks:
                found[p] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > 32:
                found[p] = np.array(self.merge(raw), "<i4").tobytes()
            else:
                by_length.setdefault(len(raw), []).append((p, raw))
        for group in by_length.values():
            found.update(zip([p for p, _ in group], self.merge_many([raw for _, raw in group]), strict=True))
        return found

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; a piece never crosses the end of its text."""
        split = []
        for text in texts:
            at = self.pre.starts(text).tolist() if text else []
            split.append([text[i:j] for i, j in zip(at, [*at[1:], None], strict=False)])
        distinct = set().union(*split)
        new = {p for p in distinct if p not in self.cache}
        if len(self.cache) + len(new) > self.cache_pieces:
            self.cache.clear()
            new = distinct
        cache = self.cache
        learned = self.learn(new)
        cache.update(learned)
        out = [np.frombuffer(b"".join(map(cache.__getitem__, pieces)), "<i4") for pieces in split]
        for p in [p for p in learned if len(p) > 64]:
            del cache[p]
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token begins."""
        ends = np.cumsum(self.sizes[ids])
        return (ends - self.sizes[ids]).astype(np.int32)

    def decode(self, ids) -> bytes:
        return self.decode_many(np.asarray(ids, np.int64)).tobytes()

    def decode_many(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after another."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.vocab)):
            raise ValueError("an id outside the vocabulary")
        sizes = self.sizes[ids]
        shift = self.blob_at[ids] - (np.cumsum(sizes) - sizes)
        return self.blob[np.repeat(shift, sizes) + np.arange(sizes.sum())]


_ENCODERS: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """The worker's encoder for a rank file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBPE(path)
    return _ENCODERS[path]


def batches_by_size(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of ``column`` each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = "offsets") -> DataFrame:
    """Token ids of ``text``, and the byte offset of each token in its UTF-8 form.

    Replaces the text column by ``ids`` and ``offsets`` (array<int>); the other
    columns stay.  A null text counts as empty and has no ids.  Rows are neither
    dropped nor merged, so ties and repeated rows stay as they are, and an empty
    table gives an empty table.  Columns of the input that are called like the new
    ones are replaced.
    """
    new = [ids] + ([offsets] if offsets else [])
    keep = [c for c in docs.columns if c != text and c not in new]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.ArrayType(T.IntegerType(), False), False) for c in new])

    def run(batches):
        bpe = encoder(path)
        for whole in batches:
            for b in batches_by_size(whole, text, BATCH_CHARS):
                got = bpe.encode_many([x or "" for x in b.column(text).to_pylist()])
                lists = [list_array(got, pa.int32())]
                if offsets:
                    lists.append(list_array([bpe.offsets(x) for x in got], pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + lists, names=keep + new)

    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Bytes of the tokens in ``ids``, as the binary column ``out``; all other columns stay.

    Null ids give null bytes.  Ids outside the vocabulary raise an error.
    """
    keep = [c for c in tokens.columns if c != out]
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField(out, T.BinaryType(), True)])

    def run(batches):
        bpe = encoder(path)
        for b in batches:
            at = 0
            while at < b.num_rows:
                # As many rows as hold BATCH_CHARS tokens, one at least.
                lists = b.column(ids)
                ends = lists.offsets.to_numpy()
                n = max(1, int(np.searchsorted(ends, ends[at] + BATCH_CHARS, "right")) - 1 - at)
                part, lists = b.slice(at, n), lists.slice(at, n)
                at += n
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                raw = bpe.decode_many(flat)
                token_ends = np.concatenate([[0], np.cumsum(bpe.sizes[flat])])
                cuts = token_ends[np.concatenate([[0], np.cumsum(counts)])]
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])
                data = pc.if_else(lists.is_valid(), data, pa.scalar(None, pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [data], names=[*keep, out])

    return tokens.select(*[F.col(c) for c in keep]).mapInArrow(run, schema)
