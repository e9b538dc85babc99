"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes each of its documents floor(r) times,
and once more with probability r - floor(r).  The cube method moves these probabilities
to 0 or 1 without moving two totals of the source: the documents taken and the words
taken.  In the flight, three documents at a time go along the direction in which both
totals stand still, until one of them is settled.

A source is dealt to blocks of at most about :data:`BLOCK` documents, by a hash of the
document.  Each block flies by itself and leaves at most two documents open; what all
blocks of a source leave is dealt to blocks again, until one is left.  There long
documents fly with all others, so that no long one stays to the end.  At most
:data:`LANDING` documents stay open, and of all their outcomes the one with the least
error in words, then in documents, is taken.  So a hot source is as many tasks as it has
blocks, and a source's words miss its target by no more than that landing problem does.

Random numbers follow from the seed, the level, the source and the block; blocks follow
from the documents.  A run repeats whatever the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweave.llm.store import materialise
from chromaweave.operators.ranges import numbered

#: Runs of other characters than a space and the controls 9 to 13 are words.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a block, on average.
BLOCK = 4096
#: Documents at which the flight of a source's last block ends.
LANDING = 12
#: Documents over so many times the mean size fly with all others of a source's last block.
LONG = 4
#: Probabilities so near to 0 or 1 count as settled.
EPS = 1e-9
#: Sources whose table is broadcast, and the bytes of its rows; with more, the join is salted.
BROADCAST_ROWS = 100_000
SALTS = 16


def words(text: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) with its number from 0 by code point (null last) and its target.

    Sources have the weights in turn and share the sum of all sizes by them.  A target
    stops at ``most`` times its source's size; what it would have been more is shared
    again by weight, until none is above.  Which sources stop follows from one number,
    the words for a weight of 1: it is kept as an exact fraction, rises from round to
    round, and each round is one aggregate over the sources.
    """
    ordered = numbered(totals.withColumn("_null", F.col("source").isNull()), ["_null", "source"], name="number")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ordered = ordered.withColumn("weight", weight)
    whole = lambda x: x.cast("decimal(38,0)")
    first = ordered.agg(F.sum(whole(F.col("source_size"))).alias("s"), F.sum("weight").alias("w")).first()
    total = int(first["s"] or 0)
    num, den = total, int(first["w"] or 1)

    def stops(num, den):
        return whole(F.col("weight")) * F.lit(num).cast("decimal(30,0)") > whole(F.col("source_size")) * F.lit(most * den).cast("decimal(18,0)")

    while True:
        seen = ordered.agg(F.sum(F.when(stops(num, den), whole(F.col("source_size")))).alias("s"), F.sum(F.when(~stops(num, den), F.col("weight"))).alias("w")).first()
        now = total - most * int(seen["s"] or 0), int(seen["w"] or 0)
        if now[1] == 0 or now == (num, den):
            break
        num, den = now
    target = F.when(stops(num, den), (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.lit(num / den))
    return ordered.select("source", "number", "source_size", target.alias("target"))


def move(p: list[float], size: list[float], random, leave: int = 0) -> None:
    """The flight: settle entries of ``p`` in place, in order, until at most two, or ``leave``, are open.

    The sums of p and of p * size stay as they are, but for rounding.
    """
    held: list[int] = []
    coming, left = 0, sum(EPS < x < 1 - EPS for x in p)
    while left > leave:
        while len(held) < 3 and coming < len(p):
            if EPS < p[coming] < 1 - EPS:
                held.append(coming)
            coming += 1
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            step = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            step = (1.0, -1.0)
        else:
            return
        ahead = min([(1 - p[i]) / u if u > 0 else -p[i] / u for i, u in zip(held, step, strict=True) if u])
        back = min([p[i] / u if u > 0 else (p[i] - 1) / u for i, u in zip(held, step, strict=True) if u])
        go = ahead if random() * (ahead + back) < back else -back
        stay = []
        for i, u in zip(held, step, strict=True):
            x = p[i] + go * u
            if EPS < x < 1 - EPS:
                p[i] = x
                stay.append(i)
            else:
                p[i] = float(round(x))
                left -= 1
        held = stay


def move_long(p: np.ndarray, size: np.ndarray, random) -> None:
    """The flight with all open documents at once, in place, until the long ones are settled.

    A long document among short ones hardly moves where three go together.  Here it goes
    ahead, and all others give way a little: along its unit vector's projection on the
    directions in which both totals stand still.
    """
    open_ = (p > EPS) & (p < 1 - EPS)
    long_ = open_ & (size > LONG * size[open_].mean() if open_.any() else False)
    for a in [i for i in np.argsort(-size, kind="stable") if long_[i]]:
        while EPS < p[a] < 1 - EPS:
            at = np.flatnonzero((p > EPS) & (p < 1 - EPS))
            if len(at) <= LANDING:
                return
            rows = np.stack([np.ones(len(at)), size[at] / max(size[at].max(), 1.0)])
            if np.ptp(rows[1]) == 0:
                rows = rows[:1]
            own = np.flatnonzero(at == a)[0]
            u = -rows.T @ np.linalg.solve(rows @ rows.T, rows[:, own])
            u[own] += 1
            u[np.abs(u) < 1e-12] = 0
            if not u[own]:
                break
            ahead = np.where(u > 0, 1 - p[at], -p[at])[u != 0] / u[u != 0]
            back = np.where(u > 0, p[at], p[at] - 1)[u != 0] / u[u != 0]
            go = ahead.min() if random() * (ahead.min() + back.min()) < back.min() else -back.min()
            now = p[at] + go * u
            p[at] = np.where(now < EPS, 0.0, np.where(now > 1 - EPS, 1.0, now))


def land(p: list[float], size: list[float]) -> None:
    """Settle what is open in place: of all outcomes, the nearest in size, then in number, then the first."""
    at = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    if not at:
        return
    open_, s = np.array([p[i] for i in at]), np.array([size[i] for i in at], float)
    outcomes = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = np.abs(outcomes @ s - open_ @ s).round(6)
    best = np.lexsort([np.abs(outcomes.sum(1) - open_.sum()).round(6), off])[0]
    for i, z in zip(at, outcomes[best], strict=True):
        p[i] = float(z)


def _fly(level: int, seed: int):
    def run(rows: pa.Table) -> pa.Table:
        size, tie = rows["size"].to_numpy(), rows["_o"].to_numpy()
        last = rows["blocks"][0].as_py() == 1
        # In no order of size, so that what stays open has many sizes.
        order = np.lexsort([size, tie])
        p, own = rows["p"].to_numpy()[order], size[order].astype(float)
        random = np.random.default_rng([seed, level, rows["number"][0].as_py(), rows["_block"][0].as_py()]).random
        if last:
            move_long(p, own, random)
        p, own = p.tolist(), own.tolist()
        move(p, own, random, LANDING if last else 0)
        if last:
            land(p, own)
        now = np.empty(len(p))
        now[order] = p
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(now))

    return run


def _with_blocks(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with one row for each source, without a task that holds all rows of a hot source."""
    strings = [F.coalesce(F.length(c), F.lit(0)) for c, t in of.dtypes if t == "string"]
    known = of.agg(F.count("*").alias("n"), F.coalesce(F.max(sum(strings, F.lit(0))), F.lit(0)).alias("longest")).first()
    if known["n"] * (known["longest"] + 64) <= BROADCAST_ROWS * 64:
        return rows.join(F.broadcast(of), key)
    salted = rows.withColumn("_salt", F.pmod(F.col("_o"), F.lit(SALTS)))
    return salted.join(of.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "_salt"]).drop("_salt")


def mix(docs: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 12) -> DataFrame:
    """``row_id``, size, source_size, target, copies and taken of each document.

    ``size`` is the text's words (null: 0), ``target`` what :func:`targets` gives its
    source, ``copies`` how often the mix holds the document, from 0 to ``most``, and
    ``taken`` the words of all its copies.  A mix is made by repeating each document so
    often (``explode(sequence(1, copies))``).

    A null source is a source, the last one.  Sources of size 0 have target 0.  Repeated
    rows are documents each, and lie in one block.  A null id is an id like others.
    Other columns of any name are ignored; ``row_id`` may not have the name of a new
    column.  An empty table gives no rows.
    """
    new = {"size", "source_size", "target", "copies", "taken"}
    if row_id.lower() in new:
        raise ValueError(f"the id has the name of a new column: {row_id}")
    rows = docs.select(F.col(row_id).alias("id"), F.col(source).cast("string").alias("source"), words(text).alias("size"))
    rows = materialise(rows, "sizes")
    totals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).select("source", "source_size"), weights, most)
    n = rows.groupBy("source").agg(F.count("*").alias("docs"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.floor(ratio + EPS)
    share = F.greatest(ratio - near, F.lit(0.0))
    # A null source joins as one: its key says that it is null.
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    blocks = F.ceil(F.col("docs") / BLOCK)
    counted = n.select(key.alias("key"), blocks.alias("blocks"))
    of = totals.withColumns({"base": near, "p": F.when(share > EPS, share).otherwise(F.lit(0.0)), "key": key}).drop("source").join(counted, "key")
    of = materialise(of, "sources")
    order = F.xxhash64("id", "source", "size")
    start = _with_blocks(rows.select("id", "size", key.alias("key"), order.alias("_o")), of, "key").drop("key")
    columns = "id", "size", "number", "source_size", "target", "base", "p", "blocks", "_o"
    now = start.select(*columns)
    settled = [now.where("p = 0")]
    open_ = now.where("p > 0")
    level, written = 0, []
    while True:
        # Another hash for each level, so that what one block left is dealt anew.
        block = F.pmod(F.xxhash64("_o", F.lit(level)), F.col("blocks"))
        dealt = open_.withColumn("_block", block)
        flown = materialise(dealt.groupBy("number", "_block").applyInArrow(_fly(level, seed), dealt.schema).select(*columns), "flown")
        written.append(flown)
        settled.append(flown.where(f"p < {EPS} OR p > {1 - EPS}"))
        rest = flown.where(f"p >= {EPS} AND p <= {1 - EPS}").drop("blocks")
        left = rest.groupBy("number").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        if not left.limit(1).count():
            break
        open_ = _with_blocks(rest, left, "number").select(*columns)
        level += 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = (F.col("base") + F.round("p")).cast("int")
    return out.select(F.col("id").alias(row_id), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
