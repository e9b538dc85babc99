"""Position-specific motifs in long form (motif, pos, letter, p, ll) and scans with them.

``pos`` counts from 0.  ``ll`` is the log2 odds of the letter against the background.
"""

from __future__ import annotations

from functools import reduce
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BACKGROUND = {"A": 0.25, "C": 0.25, "G": 0.25, "T": 0.25}
# IUPAC codes and their bases.
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "W": "AT", "M": "AC", "R": "AG", "S": "CG", "Y": "CT", "K": "GT", "B": "CGT", "D": "AGT", "V": "ACG", "H": "ACT", "N": "ACGT"}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}
MIN_LOG = -100.0


def _bg(letter, background=None):
    bg = background or BACKGROUND
    return F.create_map(*[F.lit(x) for kv in bg.items() for x in kv])[letter]


def _with_ll(m: DataFrame, background=None) -> DataFrame:
    logp = F.when(F.col("p") > 0, F.log2("p")).otherwise(F.lit(MIN_LOG))
    return m.withColumn("ll", logp - F.log2(_bg(F.col("letter"), background)))


def from_sequences(seqs: DataFrame, motif: str, seq: str, bgscale: float = 1.0, background=None) -> DataFrame:
    """p = (n + bgscale * bg) / (N + bgscale) of aligned sequences of one length per motif.

    Equal sequences are one row with their number before they are cut to letters.
    """
    words = seqs.groupBy(F.col(motif).alias("motif"), F.upper(seq).alias("_w")).agg(F.count("*").alias("_k"))
    each = words.select("motif", "_k", F.posexplode(F.split("_w", "")).alias("pos", "letter"))
    counts = each.where(F.col("letter").isin(*BACKGROUND)).groupBy("motif", "pos").agg(*[F.sum(F.when(F.col("letter") == x, F.col("_k")).otherwise(0)).alias(x) for x in BACKGROUND], F.sum("_k").alias("_n"))
    long = counts.select("motif", "pos", "_n", F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.col(x).alias("n")) for x in BACKGROUND])).alias("l")).select("motif", "pos", "_n", "l.letter", "l.n")
    p = (F.col("n") + bgscale * _bg(F.col("letter"), background)) / (F.col("_n") + bgscale)
    return _with_ll(long.withColumn("p", p), background).select("motif", "pos", "letter", "p", "ll")


def from_counts(counts: DataFrame, beta: float = 0.01, background=None) -> DataFrame:
    """(motif, pos, letter, n): columns padded to the largest total, then beta * bg pseudocounts."""
    total = F.sum("n").over(W.partitionBy("motif", "pos"))
    most = F.max("_t").over(W.partitionBy("motif"))
    bg = _bg(F.col("letter"), background)
    padded = counts.withColumn("_t", total).withColumn("_m", most).withColumn("_n", F.col("n") + (F.col("_m") - F.col("_t")) * bg)
    return _with_ll(padded.withColumn("p", (F.col("_n") / F.col("_m") + beta * bg) / (1 + beta)), background).select("motif", "pos", "letter", "p", "ll")


def from_text(spark, motifs: dict[str, str]) -> DataFrame:
    """IUPAC words; a code's bases share its probability."""
    rows = [(name, i, x, (1.0 / len(CODES[c]) if x in CODES[c] else 0.0)) for name, word in motifs.items() for i, c in enumerate(word.upper()) for x in BACKGROUND]
    return _with_ll(spark.createDataFrame(rows, "motif string, pos int, letter string, p double"))


def from_ll(m: DataFrame, background=None) -> DataFrame:
    """(motif, pos, letter, ll) with p = 2 ** (ll + log2 bg)."""
    return m.withColumn("p", F.pow(F.lit(2.0), F.col("ll") + F.log2(_bg(F.col("letter"), background))))


def inferred_background(m: DataFrame) -> DataFrame:
    """motif, letter, bg: the background that log odds (motif, pos, letter, ll) were taken against, A as T and C as G.

    The probabilities of a position sum up to 1, which gives the background of A and T
    from the odds; positions with all odds near 1, those that leave it open, and those
    that put it outside 0.1 to 1.1 do not count.  The mean of the others, or 0.25.
    """
    odds = lambda x: F.max(F.when(F.col("letter") == x, F.pow(F.lit(2.0), F.col("ll"))))
    flat = F.max(F.abs(F.col("ll"))) < 0.01
    col = m.groupBy("motif", "pos").agg((odds("A") + odds("T")).alias("at"), (odds("C") + odds("G")).alias("gc"), flat.alias("flat"))
    apart = F.col("at") - F.col("gc")
    one = F.when(~F.col("flat") & (F.abs(apart) >= 0.01), (1 - 0.5 * F.col("gc")) / apart)
    mean = col.select("motif", one.alias("x")).groupBy("motif").agg(F.avg(F.when(F.col("x").between(0.1, 1.1), F.col("x"))).alias("x"))
    at = F.coalesce("x", F.lit(0.25))
    letters = F.array(*[F.struct(F.lit(x).alias("letter"), (at if x in "AT" else 0.5 - at).alias("bg")) for x in BACKGROUND])
    return mean.select("motif", F.explode(letters).alias("l")).select("motif", "l.letter", "l.bg")


def from_odds(m: DataFrame) -> DataFrame:
    """(motif, pos, letter, ll) with p = 2 ** ll * bg, the background inferred for each motif."""
    return m.join(inferred_background(m), ["motif", "letter"]).withColumn("p", F.pow(F.lit(2.0), "ll") * F.col("bg")).drop("bg")


def with_pseudocounts(m: DataFrame, beta: float, background: dict[str, float] | None = None) -> DataFrame:
    """(p + beta * bg) / (1 + beta) in every position, with its log odds."""
    return _with_ll(m.withColumn("p", (F.col("p") + beta * _bg(F.col("letter"), background)) / (1 + beta)), background).select("motif", "pos", "letter", "p", "ll")


def new_background(m: DataFrame, background: dict[str, float]) -> DataFrame:
    return _with_ll(m.drop("ll"), background)


def bits(m: DataFrame, background=None) -> DataFrame:
    """Information of each position, at least 0."""
    bg = _bg(F.col("letter"), background)
    part = F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0) - bg * F.log2(bg)
    return m.groupBy("motif", "pos").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("bits"))


def score_range(m: DataFrame, ambiguous: bool = False) -> DataFrame:
    """maxscore and minscore; with ambiguity codes (N, B score 0) columns never lie wholly below or above 0."""
    hi, lo = F.max("ll"), F.min("ll")
    if ambiguous:
        hi, lo = F.greatest(hi, F.lit(0.0)), F.least(lo, F.lit(0.0))
    return m.groupBy("motif", "pos").agg(hi.alias("_h"), lo.alias("_l")).groupBy("motif").agg(F.sum("_h").alias("maxscore"), F.sum("_l").alias("minscore"), F.count("*").alias("width"))


def consensus(m: DataFrame) -> DataFrame:
    """One letter a position: '.' under 0.25 bits, lower case under 1 bit, else the IUPAC code of up to two bases with positive ll."""
    top = F.slice(F.array_sort(F.filter(F.collect_list(F.struct((-F.col("ll")).alias("s"), "letter")), lambda x: x["s"] < 0)), 1, 2)
    code = F.create_map(*[F.lit(x) for k, v in CODES.items() for x in ("".join(sorted(v)), k)])
    each = m.groupBy("motif", "pos").agg(F.array_join(F.array_sort(F.transform(top, lambda x: x["letter"])), "").alias("_k")).join(bits(m), ["motif", "pos"])
    letter = F.coalesce(code[F.col("_k")], F.lit("N"))
    letter = F.when(F.col("bits") < 0.25, ".").when(F.col("bits") < 1, F.lower(letter)).otherwise(letter)
    return each.select("motif", F.struct("pos", letter.alias("x")).alias("s")).groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "").alias("consensus"))


def revcomp(m: DataFrame) -> DataFrame:
    last = F.max("pos").over(W.partitionBy("motif"))
    letter = F.create_map(*[F.lit(x) for kv in COMPLEMENT.items() for x in kv])[F.col("letter")]
    return m.withColumns({"pos": last - F.col("pos"), "letter": letter})


def slice_motif(m: DataFrame, start: int, stop: int) -> DataFrame:
    return m.where(F.col("pos").between(start, stop - 1)).withColumn("pos", F.col("pos") - start)


def trimmed(m: DataFrame, least_bits: float = 0.1) -> DataFrame:
    """Without uninformative positions at the ends."""
    edge = bits(m).where(F.col("bits") > least_bits).groupBy("motif").agg(F.min("pos").alias("_a"), F.max("pos").alias("_b"))
    return m.join(edge, "motif").where("pos BETWEEN _a AND _b").withColumn("pos", F.col("pos") - F.col("_a")).drop("_a", "_b")


def denoise(m: DataFrame, least_bits: float) -> DataFrame:
    weak = bits(m).where(F.col("bits") < least_bits).select("motif", "pos", F.lit(True).alias("_w"))
    out = m.join(weak, ["motif", "pos"], "left")
    return out.withColumns({"p": F.when(F.col("_w"), _bg(F.col("letter"))).otherwise(F.col("p")), "ll": F.when(F.col("_w"), 0.0).otherwise(F.col("ll"))}).drop("_w")


def average(m: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """Weighted mean of the motifs' probabilities by position; weights: (motif, weight)."""
    out = m.join(weights, "motif").groupBy("pos", "letter").agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))
    return _with_ll(out.select(F.lit(name).alias("motif"), "pos", "letter", "p"))


def distances(a: DataFrame, b: DataFrame, background=None) -> DataFrame:
    """motif_a, motif_b and euclid, diff, maskdiff, infomaskdiff, diverge over common positions."""
    bg = _bg(F.col("letter"), background)
    both = a.select("pos", "letter", F.col("motif").alias("motif_a"), F.col("p").alias("pa")).join(b.select("pos", "letter", F.col("motif").alias("motif_b"), F.col("p").alias("pb")), ["pos", "letter"])
    info = F.greatest(F.sum(F.when(F.col("pb") > 0, F.col("pb") * F.log2("pb")).otherwise(0.0) - bg * F.log2(bg)), F.lit(0.0))
    flat = F.max(F.abs(F.col("pb") - bg)) < 0.05
    kl = F.sum(F.when((F.col("pa") > 0) & (F.col("pb") > 0), F.col("pa") * F.log2(F.col("pa") / F.col("pb"))).otherwise(0.0))
    col = both.groupBy("motif_a", "motif_b", "pos").agg(F.sum(F.pow(F.col("pa") - F.col("pb"), F.lit(2.0))).alias("sq"), info.alias("bits"), flat.alias("flat"), kl.alias("kl"))
    d = F.sqrt("sq") / F.sqrt(F.lit(2.0))
    most = F.max("bits")
    return col.groupBy("motif_a", "motif_b").agg(
        F.sqrt(F.sum("sq")).alias("euclid"),
        F.avg(d).alias("diff"),
        F.avg(F.when(~F.col("flat"), d)).alias("maskdiff"),
        F.when(most < 0.1, F.lit(1.0)).otherwise(F.sum(d * F.col("bits")) / F.sum("bits")).alias("infomaskdiff"),
        F.avg(F.when(F.col("bits") > 0, F.col("kl"))).alias("diverge"),
    )


def scan_sql(regions: DataFrame, m: DataFrame, threshold) -> DataFrame:
    """region, motif, offset, fwd, rev of windows whose better strand exceeds the threshold.

    A plain join of positions and letters: the oracle of :func:`scan`, for small tables.
    """
    width = m.groupBy("motif").agg((F.max("pos") + 1).alias("_w"))
    rc = revcomp(m).select("motif", "pos", "letter", F.col("ll").alias("rl"))
    full = m.select("motif", "pos", "letter", "ll").join(rc, ["motif", "pos", "letter"]).join(width, "motif")
    letters = regions.select("region", F.length("seq").alias("_n"), F.posexplode(F.split("seq", "")).alias("at", "letter"))
    hit = letters.join(F.broadcast(full), "letter").withColumn("offset", F.col("at") - F.col("pos")).where("offset >= 0 AND offset + _w <= _n")
    win = hit.groupBy("region", "motif", "offset", "_w").agg(F.sum("ll").alias("fwd"), F.sum("rl").alias("rev"), F.count("*").alias("_c")).where("_c = _w")
    return win.where(F.greatest("fwd", "rev") > threshold).select("region", "motif", "offset", "fwd", "rev")


#: Windows that a task scores at once.
WINDOWS_AT_ONCE = 1 << 18


def scan(regions: DataFrame, m: DataFrame, threshold: float) -> DataFrame:
    """As :func:`scan_sql`, by batches of regions in parallel: motifs are small and go to every task.

    Windows with letters other than A, C, G, T have no score.
    """
    rows = m.select("motif", "pos", "letter", "ll").collect()  # motifs: a few rows for each position
    tables: dict[str, np.ndarray] = {}
    for name in {r["motif"] for r in rows}:
        own = [r for r in rows if r["motif"] == name]
        t = np.full((max(r["pos"] for r in own) + 1, 5), np.nan)
        for r in own:
            t[r["pos"], "ACGT".index(r["letter"])] = r["ll"]
        tables[name] = t
    code = np.full(256, 4, np.uint8)
    for i, x in enumerate("ACGT"):
        code[ord(x)] = i
    widest = max(map(len, tables.values()), default=0)
    schema = T.StructType([regions.schema["region"], T.StructField("motif", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("fwd", T.DoubleType()), T.StructField("rev", T.DoubleType())])

    def run(batches):
        for b in batches:
            # All sequences of a batch in a row; the gaps between them score nowhere.
            parts = [code[np.frombuffer((x or "").encode("ascii", "replace"), np.uint8)] for x in b.column("seq").to_pylist()]
            lengths = np.array([len(x) for x in parts], np.int64)
            begin = np.cumsum(lengths + widest) - lengths - widest
            gap = np.full(widest, 4, np.uint8)
            s = np.concatenate([y for x in parts for y in (x, gap)] or [gap])
            del parts
            for name, t in tables.items():
                back = t[::-1, [3, 2, 1, 0, 4]]
                # Windows are scored so many at once, however many letters a batch has.
                for lo in range(0, len(s) - len(t) + 1, WINDOWS_AT_ONCE):
                    n = min(WINDOWS_AT_ONCE, len(s) - len(t) + 1 - lo)
                    fwd, rev = np.zeros(n), np.zeros(n)
                    for i in range(len(t)):
                        here = s[lo + i : lo + i + n]
                        fwd += t[i][here]
                        rev += back[i][here]
                    hit = np.flatnonzero(np.maximum(fwd, rev) > threshold)
                    if len(hit):
                        at = hit + lo
                        of = np.searchsorted(begin, at, side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [b.column("region").take(pa.array(of)), pa.array([name] * len(hit)), pa.array(at - begin[of], pa.int32()), pa.array(fwd[hit]), pa.array(rev[hit])], names=schema.names,
                        )

    return regions.select("region", "seq").mapInArrow(run, schema)


def best_hits(hits: DataFrame) -> DataFrame:
    s = F.greatest("fwd", "rev")
    return hits.groupBy("region", "motif").agg(F.max(s).alias("best"), F.min_by("offset", F.struct(-s, "offset")).alias("offset"))


def scan_sum(hits: DataFrame) -> DataFrame:
    """total, hits, mean and log of summed exponentials of window scores, the better strand each."""
    s = F.greatest("fwd", "rev")
    return hits.groupBy("region", "motif").agg(F.sum(s).alias("total"), F.count("*").alias("hits"), F.avg(s).alias("mean"), F.log(F.sum(F.exp(s))).alias("logsum"))


def mask(regions: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """Sequences with N over every hit."""
    found = hits.groupBy("region").agg(F.collect_set("offset").alias("_o"))
    masked = F.aggregate("_o", F.col("seq"), lambda acc, o: F.overlay(acc, F.lit("N" * width), o + 1, F.lit(width)))
    return regions.join(found, "region", "left").select("region", F.coalesce(masked, F.col("seq")).alias("seq"))


# -- thresholds, alignment, generation, text -------------------------------------------


def own_threshold(seqs: DataFrame, m: DataFrame, z: float) -> DataFrame:
    """motif, threshold: the mean less z standard deviations of the scores of a motif's own sequences (motif, seq)."""
    scored = window_scores(seqs, m)
    return scored.groupBy("motif").agg((F.avg("score") - z * F.coalesce(F.stddev_samp("score"), F.lit(0.0))).alias("threshold"))


def window_scores(seqs: DataFrame, m: DataFrame) -> DataFrame:
    """motif, seq, score: the summed ll of a word's first letters under its motif, as many as the motif is wide.

    Words shorter than the motif, or with other letters there, have no score.
    """
    width = m.groupBy("motif").agg((F.max("pos") + 1).alias("width"))
    each = seqs.select("motif", "seq", F.posexplode(F.split("seq", "")).alias("pos", "letter")).join(F.broadcast(m.select("motif", "pos", "letter", "ll")), ["motif", "pos", "letter"])
    # Equal words of one motif are one row here, and multiplied back.
    times = seqs.groupBy("motif", "seq").agg(F.count("*").alias("times"))
    out = each.groupBy("motif", "seq").agg(F.sum("ll").alias("all"), F.count("*").alias("letters")).join(times, ["motif", "seq"]).join(F.broadcast(width), "motif")
    return out.where(F.col("letters") == F.col("width") * F.col("times")).select("motif", "seq", F.explode(F.array_repeat(F.col("all") / F.col("times"), F.col("times").cast("int"))).alias("score"))


def max_distance(m: DataFrame) -> DataFrame:
    """motif, maxdiff: the greatest mean column distance that any motif can have to it."""
    worst = F.sqrt(F.sum(F.pow("p", F.lit(2.0))) + 1 - 2 * F.min("p")) / F.sqrt(F.lit(2.0))
    return m.groupBy("motif", "pos").agg(worst.alias("d")).groupBy("motif").agg(F.avg("d").alias("maxdiff"))


def aligned_distance(a: DataFrame, b: DataFrame, overlap: int) -> DataFrame:
    """motif_a, motif_b, distance, offset, strand: the least mean column distance over all placements.

    Placements of b against a have at least ``overlap`` columns in common, on either
    strand of b.  Motifs are short, so the offsets are a join on the letter only.
    """
    sides = [b.select("motif", "pos", "letter", "p").withColumn("strand", F.lit("+")), revcomp(b).select("motif", "pos", "letter", "p").withColumn("strand", F.lit("-"))]
    other = sides[0].unionByName(sides[1]).select(F.col("motif").alias("motif_b"), F.col("pos").alias("pos_b"), "letter", F.col("p").alias("pb"), "strand")
    both = a.select(F.col("motif").alias("motif_a"), "pos", "letter", F.col("p").alias("pa")).join(F.broadcast(other), "letter")
    each = both.groupBy("motif_a", "motif_b", "strand", "pos", "pos_b").agg((F.sqrt(F.sum(F.pow(F.col("pa") - F.col("pb"), F.lit(2.0)))) / F.sqrt(F.lit(2.0))).alias("d"))
    placed = each.groupBy("motif_a", "motif_b", "strand", (F.col("pos") - F.col("pos_b")).alias("offset")).agg(F.avg("d").alias("distance"), F.count("*").alias("columns")).where(F.col("columns") >= overlap)
    best = F.min(F.struct(F.round("distance", 12).alias("distance"), "strand", "offset"))
    return placed.groupBy("motif_a", "motif_b").agg(best.alias("b")).select("motif_a", "motif_b", "b.distance", "b.strand", "b.offset")


def columns_of(m: DataFrame) -> DataFrame:
    """motif, pos, p: the probabilities of A, C, G and T of each position."""
    return m.groupBy("motif", "pos").agg(F.array(*[F.coalesce(F.max(F.when(F.col("letter") == x, F.col("p"))), F.lit(0.0)) for x in BACKGROUND]).alias("p"))


def placements(a: DataFrame, b: DataFrame, pairs: DataFrame, overlap: int, padded: bool = False, background=None) -> DataFrame:
    """motif_a, motif_b, strand, offset and diff, maskdiff, infomaskdiff, diverge of every placement of b against a.

    ``pairs`` (motif_a, motif_b) are compared.  At least ``overlap`` columns of both lie
    over each other; column p of a lies over column p - offset of b.  Only these count,
    or, if ``padded``, all columns of both, over background where the other has none.
    The distances are those of :func:`distances`, with b as the second motif.
    """
    bg = background or BACKGROUND
    flat = F.array(*[F.lit(bg[x]) for x in BACKGROUND])
    width = lambda m: m.groupBy("motif").agg((F.max("pos") + 1).alias("_w"))
    both = b.select("motif", "pos", "letter", "p").withColumn("strand", F.lit("+")).unionByName(revcomp(b).select("motif", "pos", "letter", "p").withColumn("strand", F.lit("-")))
    wide_b = both.groupBy("motif", "strand", "pos").agg(F.array(*[F.coalesce(F.max(F.when(F.col("letter") == x, F.col("p"))), F.lit(0.0)) for x in BACKGROUND]).alias("pb"))
    wa, wb = width(a).withColumnsRenamed({"motif": "motif_a", "_w": "wa"}), width(b).withColumnsRenamed({"motif": "motif_b", "_w": "wb"})
    placed = pairs.select("motif_a", "motif_b").join(wa, "motif_a").join(wb, "motif_b").where((F.col("wa") >= overlap) & (F.col("wb") >= overlap))
    placed = placed.select("*", F.explode(F.sequence(overlap - F.col("wb"), F.col("wa") - overlap)).alias("offset"), F.lit(["+", "-"]).alias("_s")).select("*", F.explode("_s").alias("strand")).drop("_s")
    lo, hi = F.lit(0), F.col("wa")
    if padded:
        lo, hi = F.least(lo, F.col("offset")), F.greatest(hi, F.col("offset") + F.col("wb"))
    else:
        lo, hi = F.greatest(lo, F.col("offset")), F.least(hi, F.col("offset") + F.col("wb"))
    each = placed.select("motif_a", "motif_b", "strand", "offset", F.explode(F.sequence(lo, hi - 1)).alias("at")).withColumn("at_b", F.col("at") - F.col("offset"))
    each = each.join(columns_of(a).select(F.col("motif").alias("motif_a"), F.col("pos").alias("at"), F.col("p").alias("pa")), ["motif_a", "at"], "left")
    each = each.join(wide_b.select(F.col("motif").alias("motif_b"), "strand", F.col("pos").alias("at_b"), "pb"), ["motif_b", "strand", "at_b"], "left")
    each = each.withColumns({"pa": F.coalesce("pa", flat), "pb": F.coalesce("pb", flat)})
    x = [F.get("pa", F.lit(i)) for i in range(4)]
    y = [F.get("pb", F.lit(i)) for i in range(4)]
    back = [bg[k] for k in BACKGROUND]
    total = lambda parts: reduce(lambda u, v: u + v, parts)
    d = F.sqrt(total([(u - v) * (u - v) for u, v in zip(x, y, strict=True)])) / F.sqrt(F.lit(2.0))
    info = F.greatest(total([F.when(v > 0, v * F.log2(v)).otherwise(0.0) - q * log2(q) for v, q in zip(y, back, strict=True)]), F.lit(0.0))
    even = F.greatest(*[F.abs(v - q) for v, q in zip(y, back, strict=True)]) < 0.05
    kl = total([F.when((u > 0) & (v > 0), u * F.log2(u / v)).otherwise(0.0) for u, v in zip(x, y, strict=True)])
    col = each.select("motif_a", "motif_b", "strand", "offset", d.alias("d"), info.alias("bits"), even.alias("even"), kl.alias("kl"))
    return col.groupBy("motif_a", "motif_b", "strand", "offset").agg(
        F.avg("d").alias("diff"),
        F.avg(F.when(~F.col("even"), F.col("d"))).alias("maskdiff"),
        F.when(F.max("bits") < 0.1, F.lit(1.0)).otherwise(F.sum(F.col("d") * F.col("bits")) / F.sum("bits")).alias("infomaskdiff"),
        F.avg(F.when(F.col("bits") > 0, F.col("kl"))).alias("diverge"),
    )


DISTANCES = ("diff", "maskdiff", "infomaskdiff", "diverge")


def nearest_placements(placed: DataFrame) -> DataFrame:
    """motif_a, motif_b, distance, value, strand, offset: the best placement of a pair under each distance.

    Placements without a value, as all columns are masked, do not count; of equal ones
    the '+' strand and the least offset.
    """
    long = placed.select("motif_a", "motif_b", "strand", "offset", F.explode(F.create_map(*[x for d in DISTANCES for x in (F.lit(d), F.round(d, 12))])).alias("distance", "value")).where("value IS NOT NULL")
    return long.groupBy("motif_a", "motif_b", "distance").agg(F.min(F.struct("value", "strand", "offset")).alias("b")).select("motif_a", "motif_b", "distance", "b.value", "b.strand", "b.offset")


def _digit(*keys) -> Column:
    """A whole number from 0 to 2 ** 32 - 1 from the MD5 of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def random_motifs(widths: DataFrame, n: int, seed: int = 0, dominant: float = 0.91) -> DataFrame:
    """motif, i, pos, letter, p: ``n`` random motifs for each (motif, width), a letter drawn by hash dominant at each position."""
    each = widths.select("motif", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.sequence(F.lit(0), F.col("width") - 1).alias("_p")).select("motif", "i", F.explode("_p").alias("pos"))
    top = _digit(F.col("motif"), F.col("pos"), F.col("i"), F.lit(seed)) % 4
    p = lambda k: F.when(top == k, F.lit(dominant)).otherwise(F.lit((1 - dominant) / 3))
    return each.select("motif", "i", "pos", F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), p(k).alias("p")) for k, x in enumerate(BACKGROUND)])).alias("x")).select("motif", "i", "pos", "x.letter", "x.p")


def shuffled_letters(m: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """motif, i, pos, letter, p: ``n`` copies of each motif, in each the probabilities of a position dealt anew to the letters.

    The probabilities of a position stay as they are; the letters take them in the order
    of a hash of motif, copy, position and letter.
    """
    each = m.groupBy("motif", "pos").agg(F.array_sort(F.collect_list(F.struct("letter", "p"))).alias("_x")).select("motif", "pos", "_x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    order = F.array_sort(F.transform("_x", lambda x: F.struct(F.md5(F.concat_ws("/", "motif", F.col("i").cast("string"), F.col("pos").cast("string"), x["letter"], F.lit(str(seed)))).alias("h"), x["letter"].alias("letter"))))
    dealt = F.zip_with(order, "_x", lambda o, x: F.struct(o["letter"].alias("letter"), x["p"].alias("p")))
    return each.select("motif", "i", "pos", F.explode(dealt).alias("x")).select("motif", "i", "pos", "x.letter", "x.p")


def null_distribution(m: DataFrame, others: DataFrame) -> DataFrame:
    """motif, n, mean, sd of the mean column distance between each motif and its random ones (motif, i, pos, letter, p)."""
    both = m.select("motif", "pos", "letter", F.col("p").alias("pa")).join(others, ["motif", "pos", "letter"])
    col = both.groupBy("motif", "i", "pos").agg((F.sqrt(F.sum(F.pow(F.col("pa") - F.col("p"), F.lit(2.0)))) / F.sqrt(F.lit(2.0))).alias("d"))
    each = col.groupBy("motif", "i").agg(F.avg("d").alias("distance"))
    return each.groupBy("motif").agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.coalesce(F.stddev_samp("distance"), F.lit(0.0)).alias("sd"))


def z_scores(observed: DataFrame, null: DataFrame, distance: str = "diff") -> DataFrame:
    """The observed (motif_a, ..., ``distance``) with z, in standard deviations below the mean of motif_a's null distribution."""
    known = null.select(F.col("motif").alias("motif_a"), F.col("mean").alias("_mean"), F.col("sd").alias("_sd"))
    return observed.join(known, "motif_a", "left").withColumn("z", (F.col("_mean") - F.col(distance)) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_mean", "_sd")


#: Positions whose words are rows of their own, so that one motif's words are many tasks' work.
SPREAD = 3


def best_words(m: DataFrame, threshold: float | str) -> DataFrame:
    """motif, word, score of all words that score over the threshold (a number, or a column of ``m``).

    Position by position, a word goes on only if the best of what is left can still
    lift it over the threshold.  A motif is one row, its words grow in an array inside
    it; after :data:`SPREAD` positions each beginning is a row.  Nothing is joined.
    """
    bound = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else F.first(threshold)
    letters = m.groupBy("motif", "pos").agg(F.array_sort(F.collect_list(F.struct("letter", "ll"))).alias("x"), F.max("ll").alias("top"), bound.cast("double").alias("bound"))
    each = letters.groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "top"))).alias("c"), F.first("bound").alias("bound"))
    # What the positions behind each can add at most, from the last on.
    left = F.reverse(F.aggregate(F.reverse("c"), F.array(F.lit(0.0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["top"]))))
    each = each.withColumn("left", F.slice(left, F.lit(2), F.size("c")))

    def grown(words, steps):
        def one(acc, step):
            longer = F.flatten(F.transform(acc, lambda w: F.transform(step["c"]["x"], lambda y: F.struct(F.concat(w["word"], y["letter"]).alias("word"), (w["score"] + y["ll"]).alias("score")))))
            return F.filter(longer, lambda w: w["score"] + step["left"] > F.col("bound"))

        return F.aggregate(steps, words, one)

    steps = F.zip_with("c", "left", lambda c, r: F.struct(c.alias("c"), r.alias("left")))
    empty = F.array(F.struct(F.lit("").alias("word"), F.lit(0.0).alias("score")))
    begun = each.select("motif", "bound", steps.alias("s")).withColumn("w", grown(empty, F.slice("s", 1, SPREAD)))
    rows = begun.select("motif", "bound", F.expr(f"slice(s, {SPREAD + 1}, greatest(size(s) - {SPREAD}, 0))").alias("s"), F.explode("w").alias("w")).repartition("motif", "w.word")
    return rows.select("motif", F.explode(grown(F.array("w"), F.col("s"))).alias("w")).select("motif", "w.word", "w.score")


def emit(m: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """motif, i, word: n words of each motif, letters drawn by its probabilities; a hash is the random number."""
    upto = F.sum("p").over(W.partitionBy("motif", "pos").orderBy("letter"))
    total = F.sum("p").over(W.partitionBy("motif", "pos"))
    bounds = m.select("motif", "pos", "letter", (upto / total).alias("hi"))
    table = bounds.groupBy("motif", "pos").agg(F.array_sort(F.collect_list(F.struct("hi", "letter"))).alias("letters"))
    draws = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    u = (F.pmod(F.xxhash64("motif", "pos", "i", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    letter = F.element_at(F.filter(F.transform("letters", lambda x: F.struct((x["hi"] > u).alias("ok"), x["letter"].alias("letter"))), lambda x: x["ok"]), 1)["letter"]
    drawn = draws.select("motif", "i", F.struct("pos", F.coalesce(letter, F.element_at("letters", -1)["letter"]).alias("x")).alias("s"))
    return drawn.groupBy("motif", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "").alias("word"))


def shuffle_positions(m: DataFrame, seed: int = 0) -> DataFrame:
    """Each motif with its positions in a hash order that a re-run repeats."""
    order = F.row_number().over(W.partitionBy("motif").orderBy(F.md5(F.concat_ws("/", "motif", F.col("pos").cast("string"), F.lit(str(seed)))), "pos")) - 1
    return m.join(m.select("motif", "pos").distinct().select("motif", "pos", order.cast("int").alias("_new")), ["motif", "pos"]).withColumn("pos", F.col("_new")).drop("_new")


def merged(a: DataFrame, b: DataFrame, overlap: int, name: str) -> DataFrame:
    """b behind a, the last ``overlap`` positions of a averaged with the first of b."""
    shift = a.agg((F.max("pos") + 1 - overlap).alias("_shift"))
    moved = b.crossJoin(F.broadcast(shift)).withColumn("pos", (F.col("pos") + F.col("_shift")).cast("int"))  # one row
    both = a.select("pos", "letter", "p").unionByName(moved.select("pos", "letter", "p")).groupBy("pos", "letter").agg(F.avg("p").alias("p"))
    return _with_ll(both.select(F.lit(name).alias("motif"), "pos", "letter", "p"))


def as_rows(m: DataFrame) -> DataFrame:
    """motif, pos, p: a map from letters to probabilities for each position."""
    return m.groupBy("motif", "pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "p")))).alias("p"))


def summary(m: DataFrame) -> DataFrame:
    """motif, line: consensus, width, total information and best score as text."""
    info = bits(m).groupBy("motif").agg(F.sum("bits").alias("bits"))
    out = consensus(m).join(info, "motif").join(score_range(m), "motif")
    return out.select("motif", F.format_string("%s width=%d bits=%.3f max=%.3f", "consensus", "width", F.col("bits") + 0.0, "maxscore").alias("line"))


def normalised(hits: DataFrame, m: DataFrame, score: str = "score") -> DataFrame:
    """Scores of (motif, score) as shares of the motif's range, 0 at the least and 1 at the greatest possible."""
    lo, hi = F.col("minscore"), F.col("maxscore")
    return hits.join(F.broadcast(score_range(m)), "motif").withColumn(score, (F.col(score) - lo) / (hi - lo)).drop("minscore", "maxscore", "width")


def back_projected(thresholds: DataFrame, m: DataFrame) -> DataFrame:
    """(motif, threshold) as shares of the motif's range, turned into scores."""
    lo, hi = F.col("minscore"), F.col("maxscore")
    return thresholds.join(F.broadcast(score_range(m)), "motif").select("motif", (F.col("threshold") * (hi - lo) + lo).alias("threshold"))


def affinities(hits: DataFrame, thresholds: DataFrame, m: DataFrame, total: str = "total", fp: str = "fp", typ: str = "typ") -> DataFrame:
    """region, motif, affinity of scanned windows, from sums of weights that combine before they shuffle.

    ``thresholds``: motif, and for each the normalised scores ``total`` and ``fp`` and the
    type, as in :func:`chromaweave.functions.scalars.affinity`.
    """
    typ_ = F.greatest(F.col(typ).cast("double"), F.lit(1.000001))
    gap = F.col(fp) - F.col(total)
    weight = F.ln(typ_) / F.when(gap == 0, F.lit(0.1)).otherwise(gap)
    known = thresholds.select("motif", weight.alias("_w"), (2 * typ_ * F.exp(weight * F.col(total))).alias("_b"))
    scored = normalised(hits.select("region", "motif", F.greatest("fwd", "rev").alias("score")), m).join(F.broadcast(known), "motif")
    a = F.sum(F.exp(F.col("_w") * F.col("score")))
    return scored.groupBy("region", "motif").agg((a / (a + F.first("_b"))).alias("affinity"))
