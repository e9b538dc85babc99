"""Perturbed runs: noise, shuffles, matched random terminals, folds, knockouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.operators.ranges import dealt, numbered, running


def _order(key: str, run, seed: int):
    return F.md5(F.concat_ws("/", F.col(key).cast("string"), F.col(run).cast("string") if isinstance(run, str) else run, F.lit(str(seed))))


def runs_of(df: DataFrame, n: int) -> DataFrame:
    """A copy of the rows for each run 0 to n - 1."""
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _unit(salt, *keys: str):
    """A number in (0, 1) from the MD5 of the keys and the salt."""
    told = F.md5(F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.lit(str(salt))))
    return (F.conv(F.substring(told, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(seed: int, *keys: str):
    """Standard normal noise by Box and Muller, the same in every run."""
    return F.sqrt(-2 * F.log(_unit(f"{seed}/1", *keys))) * F.cos(2 * F.pi() * _unit(f"{seed}/2", *keys))


def noise_edges(edges: DataFrame, n_runs: int, sd: float, seed: int = 0) -> DataFrame:
    """Normal noise on every stored edge of every run, from hashes, so that runs repeat."""
    return runs_of(edges, n_runs).withColumn("weight", F.col("weight") + normal(seed, "src", "dst", "dir", "run") * sd)


def shuffle_prizes(prizes: DataFrame, n_runs: int, seed: int = 0) -> DataFrame:
    """In each run the prizes are dealt anew among the nodes: two rankings joined."""
    runs = runs_of(prizes, n_runs)
    # The prizes have one order in all runs.
    a = numbered(prizes, ["node"], "i").select("i", "prize")
    b = numbered(runs, [_order("node", "run", seed), "node"], "i", by=["run"]).select("run", "node", "i")
    return b.join(a, "i").select("run", "node", "prize")


def folds(prizes: DataFrame, k: int, seed: int = 0, key: str = "node") -> DataFrame:
    """``fold`` from 0 to k - 1, by the rank in a hash order."""
    return numbered(prizes, [_order(key, F.lit(""), seed), key], "_i").withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i")


def random_terminals(prizes: DataFrame, degrees: DataFrame, n_runs: int, spread: float = 100.0, seed: int = 0) -> DataFrame:
    """In each run every terminal is replaced by a node of near degree rank; nodes are not used twice.

    The rank moves by normal noise of the given spread.  Where several terminals come to
    one node, they go on to the next free ranks in the order of their wanted ranks (equal
    ones by hash), from the last rank on to the first.
    """
    ranked = numbered(degrees, ["degree", "node"])
    n = ranked.count()
    wanted = runs_of(prizes.join(ranked, "node"), n_runs)
    moved = F.round(F.col("rank") + normal(seed, "node", "run") * spread).cast("long")
    wanted = wanted.select("run", "prize", F.pmod(moved, F.lit(n)).alias("rank"), _order("node", "run", seed).alias("o"))
    placed = place(wanted, n)
    return placed.join(ranked.select("rank", "node"), "rank").select("run", "node", "prize")


def place(wanted: DataFrame, n: int, ranges: int | None = None) -> DataFrame:
    """(run, prize, rank): each row of (run, prize, rank, o) at its own of ``n`` ranks, from the wanted one on, cyclically.

    In the order of (rank, o), row i of m goes to i + the greatest of (rank - row) so
    far: the first free rank after what stands before it.  What is pushed over the last
    rank goes on at the first, ahead of those that want to be there: so the order is
    run through twice, and the second lap counts.  Both laps follow from one running
    maximum and the maximum of the run.
    """
    each = numbered(wanted, ["rank", "o"], "i", by=["run"])
    lag = F.col("rank") - F.col("i")
    each, parts = dealt(each, ["run", "i"], ranges)
    each = running(each, parts, "run", ["i"], lag, "_push")
    laps = each.groupBy("run").agg(F.max(lag).alias("_all"), F.count("*").alias("_m"))
    full = F.when(F.col("_m") <= n, F.lit(n)).otherwise(F.raise_error(F.lit("more terminals than nodes")).cast("int"))
    at = F.col("_m") + F.col("i") + F.greatest(F.col("_all"), full - F.col("_m") + F.col("_push"))
    return each.join(laps, "run").select("run", "prize", F.pmod(at, F.lit(n)).alias("rank"))


def fold_summary(held: DataFrame, solution_nodes: DataFrame, terminals: DataFrame) -> DataFrame:
    """fold, held_out, recovered, steiner: per fold's solution (fold, node)."""
    sol = solution_nodes.select("fold", "node").distinct()
    recovered = held.join(sol, ["fold", "node"], "left_semi").groupBy("fold").agg(F.count("*").alias("recovered"))
    steiner = sol.join(terminals.select("node"), "node", "left_anti").groupBy("fold").agg(F.count("*").alias("steiner"))
    out = held.groupBy("fold").agg(F.count("*").alias("held_out")).join(recovered, "fold", "left").join(steiner, "fold", "left")
    return out.na.fill(0, ["recovered", "steiner"])
