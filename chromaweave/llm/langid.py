"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams of 1 to 3 characters of the lower-cased letters, other
characters counting as one separator, hashed into a fixed number of slots.  Document
frequencies come from every training document.  Weights are fitted in numpy by
follow-the-regularised-leader with an elastic net, on a bounded sample of training
rows (``sample_rows``, an equal number at most for each label, chosen by a hash of the
whole row), and a temperature is fitted on the part of that sample that was not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaweave.llm.store import materialise, release

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
GRAMS = (1, 2, 3)
#: Rows of labelled text that the weights are fitted on, at most.
SAMPLE_ROWS = 4000
#: Of a classifier's bounded sample: the labels that may be learned, the most frequent ones.
MAX_LABELS = 256
BLOCK_CHARS = 1 << 20
UNDETERMINED = "und"

_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    if not _FOLDED:
        table = np.zeros(0x110000, np.uint64)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLDED.append(table)
    return _FOLDED[0]


def slot_counts(text: str) -> np.ndarray:
    """How often each slot's n-grams occur in the text; all zero without letters."""
    counts = np.zeros(SLOTS, np.int64)
    widest = max(GRAMS)
    for at in range(0, len(text), BLOCK_CHARS):
        # Blocks overlap, so that each n-gram is counted in the block where it ends.
        lead = "" if at == 0 else text[max(0, at - widest + 1) : at]
        points = np.frombuffer((lead + text[at : at + BLOCK_CHARS]).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _folded()[points]
        pad = np.zeros(1, np.uint64)
        first, last = at == 0, at + BLOCK_CHARS >= len(text)
        c = np.concatenate([pad[: int(first)], c, pad[: int(last)]])
        skip = len(lead)
        for n in GRAMS:
            if len(c) < n:
                continue
            m = len(c) - n + 1
            h = np.full(m, n, np.uint64)
            any_letter = np.zeros(m, bool)
            for j in range(n):
                part = c[j : j + m]
                h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                any_letter |= part != 0
            new = max(0, skip - n + 1)
            slots = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS))[new:][any_letter[new:]]
            counts += np.bincount(slots.astype(np.int64), minlength=SLOTS)
    return counts


def vector(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = (1 + np.log(counts)) * idf[slots]
    return x / np.sqrt((x * x).sum())


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots x labels, mostly zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return vector(slots, counts, self.idf) @ self.weights[slots] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.labels:
            return UNDETERMINED, 0.0
        counts = slot_counts(text)
        slots = np.flatnonzero(counts)
        if not len(slots):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(slots, counts[slots]) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, alpha=1.0, beta=1.0, l1=0.02, l2=0.001, epochs=4, seed=0) -> Model:
    """FTRL-proximal over (label number, slots, counts) rows; the bias is not penalised."""
    k = len(labels)
    z, n = np.zeros((SLOTS, k)), np.zeros((SLOTS, k))
    zb, nb = np.zeros(k), np.zeros(k)
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    vectors = [vector(s, c, idf) for _, s, c in rows]

    def weights(z, n):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            label, slots, _ = rows[i]
            x = vectors[i][:, None]
            w, wb = weights(z[slots], n[slots]), -zb * alpha / (beta + np.sqrt(nb))
            err = softmax((x * w).sum(0) + wb)
            err[label] -= 1
            g = x * err
            grown = n[slots] + g * g
            z[slots] += g - (np.sqrt(grown) - np.sqrt(n[slots])) / alpha * w
            n[slots] = grown
            grown = nb + err * err
            zb += err - (np.sqrt(grown) - np.sqrt(nb)) / alpha * wb
            nb = grown
    return Model(labels, idf, weights(z, n).astype(np.float32), -zb * alpha / (beta + np.sqrt(nb)))


def fit_temperature(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> float:
    """The temperature of least log loss on the rows, by a search over a fixed geometric grid."""
    if not rows:
        return 1.0
    logits = np.array([model.logits(s, c) for _, s, c in rows])
    y = np.array([label for label, _, _ in rows])

    def loss(t):
        z = logits / t
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.05, 20, 241), key=loss))


def sampled(rows: DataFrame, sizes: dict[str, int], labels: list[str], each: int) -> list[tuple[int, str, str]]:
    """(label number, label, text) of ``each`` rows of each label at most, the least by a hash of the row.

    Rows have a hash of their id, so that copies of a text do not go together.  A share
    of each label that holds ``each`` rows with a wide margin is picked first, and cut
    to the number in a window over what was picked.
    """
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, 1.5 * (each + 20) / sizes[k]))]) if labels else None
    if share is None:
        return []
    picked = rows.where(F.col("label").isin(labels)).where(F.pmod("h", F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    nth = F.row_number().over(W.partitionBy("label").orderBy("h", "text"))
    picked = picked.withColumn("nth", nth).where(F.col("nth") <= each).select("label", "text", "h")
    found = sorted((r["h"], r["label"], r["text"]) for r in picked.toLocalIterator())  # sample_rows at most
    return [(labels.index(x), x, body) for _, x, body in found]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", train: Column | None = None, sample_rows: int = SAMPLE_ROWS, max_labels: int = MAX_LABELS, doc_id: str = "doc_id") -> Model:
    """Fit a model on the rows where ``train`` holds and text and label are not null.

    ``doc_id`` only helps to choose the sample.

    Without such rows the model has no labels and predicts ``und``.
    """
    rows = docs.where(F.lit(True) if train is None else train).select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("h"))
    rows = rows.where("label IS NOT NULL AND text IS NOT NULL")
    # One row for each label, max_labels at most.
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_labels).collect()}
    labels = sorted(sizes)
    each = max(1, sample_rows // max(1, len(labels)))
    schema = "slot int, df long, docs long"

    def gather(batches):
        df, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for body in b.column("text").to_pylist():
                at = np.flatnonzero(slot_counts(body))
                n += len(at) > 0
                df[at] += 1
        at = np.flatnonzero(df)
        none = [None] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array([*at, None], pa.int32()), pa.array([*df[at], None], pa.int64()), pa.array([*none, n], pa.int64())], names=["slot", "df", "docs"])

    found = materialise(rows.select("text").mapInArrow(gather, schema), "langid")
    total = found.agg(F.sum("docs")).first()[0] or 0
    idf = np.full(SLOTS, np.log1p(total) + 1)
    # One row for each slot at most.
    for slot, n in found.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("df")).collect():
        idf[slot] = np.log((1 + total) / (1 + n)) + 1
    release(found)
    kept = []
    for i, name, body in sampled(rows, sizes, labels, each):
        counts = slot_counts(body)
        slots = np.flatnonzero(counts)
        if len(slots):
            kept.append((i, slots, counts[slots]))
    # Labels of which the sample has no text with letters are not learned.
    labels = [x for i, x in enumerate(labels) if any(r[0] == i for r in kept)] if kept else []
    number = {i: j for j, i in enumerate(sorted({r[0] for r in kept}))}
    kept = [(number[i], s, c) for i, s, c in kept]
    held = kept[:: 5] if len(kept) >= 50 else []
    trained = [r for j, r in enumerate(kept) if j % 5] if held else kept
    if not kept:
        return Model([], idf, np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    model = fit_ftrl(trained, labels, idf)
    model.temperature = fit_temperature(model, held)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """The input's columns, the predicted label and its calibrated probability.

    ``und`` with score 0 where the text is null or has no letter, or where the model
    knows no label.  Columns called like the new ones are replaced.  Repeated rows
    are predicted each; an empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in (label, score)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(label, T.StringType(), False), T.StructField(score, T.DoubleType(), False)])
    used = np.flatnonzero(np.any(model.weights != 0, axis=1)) if model.labels else np.zeros(0, np.int64)
    packed = (model.labels, model.idf.astype(np.float32), used, model.weights[used], model.bias, model.temperature)

    def run(batches):
        labels, idf, at, values, bias, temperature = packed
        weights = np.zeros((SLOTS, len(labels)), np.float32)
        weights[at] = values
        m = Model(labels, idf, weights, bias, temperature)
        for b in batches:
            got = [m.predict(x) for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], names=[*keep, label, score])

    return docs.select(*keep).mapInArrow(run, schema)
