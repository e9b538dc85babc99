"""Personal data: patterns, and terms that disclose protected entities.

The patterns give the protected entities: e-mail addresses, IP addresses, card and
phone numbers.  A term (word) that occurs nearly only together with one entity
reveals it even where the entity is masked.  How much it reveals is estimated from
the corpus: over all distinct texts, the pointwise mutual information of term and
entity, log2 P(e | t) / P(e), relative to the entity's own information content,
-log2 P(e).  At 1 the term gives the entity away.  Terms at or over the disclosure
threshold are protected in the texts that hold the entity.  Estimates need support:
pairs in fewer than ``least_texts`` distinct texts are no evidence.

Sanitised texts have entities generalised to their kind and disclosing terms removed
to a placeholder.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm.store import materialise, release, unused

KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]
#: Least share of an entity's information that a term has to carry.
DISCLOSURE = 0.95
#: Least number of distinct texts that hold a term and an entity together.
LEAST_TEXTS = 4
#: Tables are broadcast up to so many rows (of texts with terms: terms), and shuffled beyond.
BROADCAST_ROWS = 200_000

# The patterns, written so that no start is tried twice within a run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """An address holds one @, so each @ is looked at once, with what is left of it since the last match."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            over = m.end()
        else:
            over = at + 1
        at = text.find("@", max(over, at + 1))


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def entity(kind: int, value: str) -> int:
    """Hash of an entity; numbers count by their digits, addresses in lower case."""
    value = value.lower() if kind < 2 else digits_of(value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode("utf-8", "replace")) - (1 << 63)


def core_of(word: str) -> str:
    """What of a word can disclose: no punctuation around it."""
    return word.strip(_TRIM)


def terms(text: str, spans: list[tuple[int, int, int]]):
    """(hash, start, end) of the words that can disclose: those outside the text's base spans."""
    taken = sorted((a, b) for _, a, b in spans)
    at = over = 0
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            over = max(over, taken[at][1])
            at += 1
        if over <= m.start() and (core := core_of(m[0])):
            start = m.start() + m[0].index(core)
            yield term_hash(core), start, start + len(core)


def may_overlap(word: str) -> bool:
    """Whether a base span can reach into a word: it holds digits or an @, or else only what joins a phone number's digits."""
    return any(c in "0123456789@" for c in word) or not word.strip("().-")


def term_hash(core: str) -> int:
    return xxhash.xxh3_64_intdigest(core.lower().encode("utf-8", "replace")) - (1 << 63)


def text_key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def _entities(batches):
    """(text, entities) of the texts that hold any."""
    for b in batches:
        keys, found = [], []
        for t in b.column("_text").to_pylist():
            if t and (spans := base_spans(t)):
                keys.append(text_key(t))
                found.append(sorted({entity(k, t[a:e]) for k, a, e in spans}))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["_key", "_es"])


def _pairs(batches):
    """(term, entity) for every term of a text with recurring entities, and (term, null) once."""
    for b in batches:
        for es, t in zip(b.column("_es").to_pylist(), b.column("_text").to_pylist(), strict=True):
            ts = pa.array(np.array(sorted({h for h, _, _ in terms(t, base_spans(t))}), np.int64))
            for e in [None, *es]:
                yield pa.RecordBatch.from_arrays([ts, pa.array([e] * len(ts), pa.int64())], names=["t", "e"])


#: Bits of the slot numbers of :class:`_Bounds` (4 MB).
SLOT_BITS = 22


class _Bounds:
    """For hashed terms, an upper bound of the texts a term may be in and still disclose; 0 for no candidate.

    A table of fixed size, in powers of the square root of 2; terms that share a slot
    share the greater bound, so it errs on the side of telling too much.
    """

    def __init__(self, levels: np.ndarray | None = None):
        self.levels = np.zeros(1 << SLOT_BITS, np.uint8) if levels is None else levels

    @staticmethod
    def slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def add(self, hashes: np.ndarray, bounds: np.ndarray) -> None:
        level = np.minimum(np.ceil(2 * np.log2(np.maximum(bounds, 1))) + 1, 255).astype(np.uint8)
        np.maximum.at(self.levels, self.slots(hashes), level)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        level = self.levels[self.slots(hashes)].astype(float)
        return np.where(level > 0, np.floor(2 ** ((level - 1) / 2)) + 2, 0).astype(np.int64)


#: Words that a worker remembers.
CACHE_WORDS = 250_000


def disclosing(docs: DataFrame, text: str, least_texts: int, disclosure: float) -> DataFrame:
    """(_key, ts): for a text (by key) that holds recurring entities, the terms that disclose one of them."""
    rows = docs.select(F.col(text).cast("string").alias("_text"))
    held = materialise(rows.mapInArrow(_entities, "_key binary, _es array<long>"), "entities")
    held_once = held.groupBy("_key").agg(F.first("_es").alias("_es"))
    each = held_once.select("_key", F.explode("_es").alias("e"))
    recurring = each.groupBy("e").agg(F.count("*").alias("ne")).where(F.col("ne") >= least_texts)
    with_recurring = each.join(recurring, "e").groupBy("_key").agg(F.collect_set("e").alias("_es"))
    with_recurring = materialise(with_recurring, "recurring")

    def key_texts(batches):
        for b in batches:
            keys = [text_key(t) if t else None for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("_text")], names=["_key", "_text"])

    # Only texts with an entity can be among them; the pattern test is far cheaper than a shuffle of all texts.
    may = rows.where(F.col("_text").rlike("[0-9@]"))
    small = with_recurring.count() <= BROADCAST_ROWS
    texts = may.mapInArrow(key_texts, "_key binary, _text string").join(F.broadcast(with_recurring) if small else with_recurring, "_key")
    texts = texts.groupBy("_key").agg(F.first("_text").alias("_text"), F.first("_es").alias("_es"))
    counted = materialise(texts.mapInArrow(_pairs, "t long, e long").groupBy("t", "e").agg(F.count("*").alias("n")), "counted")
    total = F.lit(float(max(1, rows.where("_text <> ''").select(F.xxhash64("_text").alias("a"), F.xxhash64("_text", F.lit(1)).alias("b")).distinct().count())))

    def tells(pairs, nt):
        information = -F.log2(F.col("ne") / total)
        return pairs.where((information > 0) & (F.log2(F.col("nte") / F.col(nt) / (F.col("ne") / total)) >= disclosure * information))

    # The texts at hand hold a term at least as often as it is there said; common words go here.
    least = counted.where("e IS NULL").select("t", F.col("n").alias("least"))
    pairs = counted.where(F.col("e").isNotNull() & (F.col("n") >= least_texts)).select("t", "e", F.col("n").alias("nte"))
    pairs = materialise(tells(pairs.join(recurring, "e").join(least, "t"), "least").drop("least"), "pairs")
    wanted = pairs.select("t").distinct()

    # How many distinct texts hold each candidate term, over the whole corpus.
    bound = pairs.groupBy("t").agg(F.max(F.col("nte") * F.pow(total / F.col("ne"), F.lit(1 - disclosure))).alias("b"))

    def tabulate(batches):
        table = _Bounds()
        for b in batches:
            table.add(b.column("t").to_numpy(), b.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([table.levels.tobytes()], pa.binary())], names=["m"])

    tables = bound.coalesce(8).mapInArrow(tabulate, "m binary").collect()  # at most 8 tables of 4 MB
    levels = np.maximum.reduce([np.frombuffer(r["m"], np.uint8) for r in tables]) if tables else np.zeros(1 << SLOT_BITS, np.uint8)
    held_table = docs.sparkSession.sparkContext.broadcast(levels)

    def count_terms(batches):
        """(term, text) for the first different texts of each term in this task, one more than its bound.

        A term of more texts than its bound discloses nothing, however many more there are.
        """
        told: dict[int, int] = {}
        seen: set[bytes] = set()
        table = _Bounds(held_table.value)
        known: dict[bytes, tuple[int, int, bool] | None] = {}  # hash and bound of a word that may be a candidate; whether a span may hold it
        for b in batches:
            split = [(t, set(t.encode("utf-8", "replace").split())) for t in b.column("_text").to_pylist() if t]
            new = [w for w in set().union(*(ws for _, ws in split)) if w not in known]
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(set().union(*(ws for _, ws in split)))
            cores = [core_of(w.decode("utf-8")) for w in new]
            hashes = np.array([term_hash(c) if c else 0 for c in cores], np.int64)
            bounds = table.get(hashes).tolist()
            known.update((w, (h, m, may_overlap(w.decode("utf-8"))) if c and m else None) for w, h, c, m in zip(new, hashes.tolist(), cores, bounds, strict=True))
            ts, keys = [], []
            for t, ws in split:
                may = {x for x in map(known.__getitem__, ws) if x is not None and told.get(x[0], 0) < x[1]}
                hit = {x[0] for x in may}
                if any(x[2] for x in may):
                    # Where such a word lies in base spans only, the text does not hold it as a term.
                    hit &= {h for h, _, _ in terms(t, base_spans(t))}
                if not hit or (key := text_key(t)) in seen:
                    continue
                if len(seen) >= CACHE_WORDS:
                    seen.clear()  # an equal text that comes again is told again, and counts once all the same
                    told.clear()
                seen.add(key)
                for h in hit:
                    told[h] = told.get(h, 0) + 1
                ts += sorted(hit)
                keys += [key] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ts, pa.int64()), pa.array(keys, pa.binary())], names=["t", "_key"])

    any_pairs = pairs.limit(1).count() > 0
    if not any_pairs:
        release(held)
        return docs.sparkSession.createDataFrame([], "_key binary, ts array<long>")
    seen = rows.mapInArrow(count_terms, "t long, _key binary").join(wanted, "t", "left_semi")
    held_terms = seen.distinct().groupBy("t").agg(F.count("*").alias("nt"))
    telling = tells(pairs.join(held_terms, "t"), "nt").select("t", "e")
    out = with_recurring.select("_key", F.explode("_es").alias("e")).join(telling, "e").groupBy("_key").agg(F.collect_set("t").alias("ts"))
    return materialise(out, "disclosing")


def protect(docs: DataFrame, text: str = "text", spans: str = "spans", sanitised: str | None = "sanitised", least_texts: int = LEAST_TEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """The input's columns, ``spans`` and, if named, the sanitised text.

    ``spans`` is array<struct<kind, start, end>> by kind (email, ip, card, phone, term),
    then start, in code points, end exclusive.  Spans of different kinds may overlap;
    what they cover together is replaced once, by the kind that begins first.  A null
    text has no spans and stays null; an empty one stays empty.  Repeated rows are
    answered each and count once as evidence.  An empty table gives an empty table.
    Input columns called like the new ones are replaced, unless it is the text itself.
    """
    telling = disclosing(docs, text, least_texts, disclosure)
    new = [spans] + ([sanitised] if sanitised else [])
    keep = [c for c in docs.columns if c not in new or c == text]
    span_type = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out_keep = [c for c in keep if c not in new]
    schema = T.StructType([docs.schema[c] for c in out_keep] + [T.StructField(spans, span_type)] + ([T.StructField(sanitised, T.StringType())] if sanitised else []))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    key, told_as = unused("_key", docs.columns), unused("_ts", docs.columns)
    # Checked size: a table of at most BROADCAST_ROWS terms goes to every task, a larger one is joined by shuffle.
    local = None
    if (telling.agg(F.sum(F.size("ts") + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        local = docs.sparkSession.sparkContext.broadcast({bytes(r["_key"]): frozenset(r["ts"]) for r in telling.toLocalIterator()})

    def find(t, told):
        found = base_spans(t)
        if told:
            found += [(4, a, b) for h, a, b in terms(t, list(found)) if h in told]
        return found

    def mask(t, found):
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in found):
            if a >= at:
                out += [t[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def answer(b, tolds):
        texts = b.column(text).to_pylist()
        found = [find(t, told) if t else [] for t, told in zip(texts, tolds, strict=True)]
        columns = [b.column(c) for c in out_keep] + [pa.array([[{"kind": KINDS[k], "start": a, "end": e} for k, a, e in f] for f in found], arrow)]
        if sanitised:
            columns.append(pa.array([t if t is None else mask(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    def run_local(batches):
        table = local.value
        for b in batches:
            yield answer(b, [table.get(text_key(t)) if t and table else None for t in b.column(text).to_pylist()])

    def run_joined(batches):
        for b in batches:
            yield answer(b, [frozenset(x) if x else None for x in b.column(told_as).to_pylist()])

    if local is not None:
        return docs.select(*keep).mapInArrow(run_local, schema)

    def add_key(batches):
        for b in batches:
            keys = [text_key(t) if t else None for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, key])

    keyed = docs.select(*keep).mapInArrow(add_key, T.StructType([docs.schema[c] for c in keep] + [T.StructField(key, T.BinaryType())]))
    return keyed.join(telling.select(F.col("_key").alias(key), F.col("ts").alias(told_as)), key, "left").select(*keep, told_as).mapInArrow(run_joined, schema)
