"""Interaction graphs: edge cleaning, prizes, penalties, augmentation, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweave.functions.scalars import degree_penalty
from chromaweave.operators.ranges import parts_for

LEAST_WEIGHT, MOST_WEIGHT = 0.0, 0.99


def clean_edges(edges: DataFrame, knockout: list[str] | DataFrame | None = None) -> DataFrame:
    """Weights clamped to [0, 0.99]; self-edges and edges that touch a knocked-out node dropped."""
    out = edges.where(F.col("src") != F.col("dst"))
    if isinstance(knockout, DataFrame):
        gone = knockout.select(F.col("node").alias("_gone")).distinct()
        out = out.join(gone, F.col("src") == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti")
    elif knockout:
        out = out.where(~F.col("src").isin(knockout) & ~F.col("dst").isin(knockout))
    weight = F.col("weight").try_cast("double")
    bad = F.raise_error(F.concat_ws(" ", F.lit("weight is no number:"), F.col("weight").cast("string"))).cast("double")
    return out.withColumn("weight", F.when(weight.isNull(), bad).otherwise(F.least(F.greatest(weight, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))))


def edge_warnings(edges: DataFrame, knockout: list[str] | None = None) -> DataFrame:
    """One row: below, above, self and total edge counts, and with ``knockout`` how many edges touch such a node."""
    gone = [F.count_if(F.col("src").isin(knockout) | F.col("dst").isin(knockout)).alias("n_knockout")] if knockout else []
    return edges.agg(F.count_if(F.col("weight") < LEAST_WEIGHT).alias("n_below"), F.count_if(F.col("weight") > MOST_WEIGHT).alias("n_above"), F.count_if(F.col("src") == F.col("dst")).alias("n_self"), F.count("*").alias("n_edges"), *gone)


def excluded_nodes(listed: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes of a list, and how many of them the network does not have."""
    here = listed.select("node").distinct().join(nodes(edges).withColumn("_in", F.lit(1)), "node", "left")
    return here.agg(F.count("*").alias("n_listed"), F.count_if(F.col("_in").isNull()).alias("n_excluded"))


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once, ends in order; directed ones as they are (dir 'U' or 'D')."""
    flip = (F.col("dir") == "U") & (F.col("src") > F.col("dst"))
    return edges.withColumns({"src": F.when(flip, F.col("dst")).otherwise(F.col("src")), "dst": F.when(flip, F.col("src")).otherwise(F.col("dst"))})


def keep_max(edges: DataFrame) -> DataFrame:
    return canonical(edges).groupBy("src", "dst", "dir").agg(F.max("weight").alias("weight"))


def directed_first(edges: DataFrame) -> DataFrame:
    """Undirected edges give way to a directed edge between the same ends, in either direction."""
    own = canonical(edges)
    ends = own.where("dir = 'D'").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return own.where("dir = 'D'").unionByName(own.where("dir = 'U'").join(ends, ["src", "dst"], "left_anti").select(own.columns))


def network(edges: DataFrame) -> DataFrame:
    """:func:`directed_first` of :func:`keep_max` in one aggregate: a row for each pair of nodes, whatever its edges.

    src, dst, dir, weight; a direction other than 'U' or 'D' fails.
    """
    kind = F.when(F.col("dir").isin("U", "D"), F.col("dir")).otherwise(F.raise_error(F.concat(F.lit("an edge is U or D, not "), F.coalesce("dir", F.lit("null")))).cast("string"))
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") <= F.col("dst")).alias("on"), kind.alias("kind"), "weight")
    most = lambda c: F.max(F.when(c, F.col("weight")))
    pairs = ends.groupBy("a", "b").agg(most(F.col("kind") == "U").alias("u"), most((F.col("kind") == "D") & F.col("on")).alias("ab"), most((F.col("kind") == "D") & ~F.col("on")).alias("ba"))
    edge = lambda src, dst, way, w: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(way).alias("dir"), F.col(w).alias("weight"))
    ways = F.array(edge("a", "b", "D", "ab"), edge("b", "a", "D", "ba"))
    kept = F.when(F.col("ab").isNull() & F.col("ba").isNull(), F.array(edge("a", "b", "U", "u"))).otherwise(F.filter(ways, lambda e: e["weight"].isNotNull()))
    return pairs.select(F.explode(kept).alias("e")).select("e.*")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, whatever the direction."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def out_degree(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("node")).union(edges.where("dir = 'U'").select("dst"))
    return out.groupBy("node").agg(F.count("*").alias("out_degree"))


def known_prizes(prizes: DataFrame, edges: DataFrame) -> DataFrame:
    """Prizes of nodes that the graph has."""
    return prizes.join(nodes(edges), "node", "left_semi")


def join_prizes(protein: DataFrame, factors: DataFrame, scale: float) -> DataFrame:
    """Factor prizes, scaled, override protein prizes; types of both are joined by '_'."""
    p = protein.select("node", F.col("prize").alias("_p"))
    g = factors.select("node", (F.col("prize") * scale).alias("_g"))
    kind = F.concat_ws("_", F.when(F.col("_p").isNotNull(), "Proteomic"), F.when(F.col("_g").isNotNull(), "TF"))
    return p.join(g, "node", "full_outer").select("node", F.coalesce("_g", "_p").alias("prize"), kind.alias("terminal_type"))


def total_prizes(prizes: DataFrame, edges: DataFrame, beta: float, mu: float = 0.0, squared: bool = False, exclude_terminals: bool = False) -> DataFrame:
    """node, prize_neg, prize_total: beta * prize plus the degree penalty; other nodes only with a penalty."""
    own = prizes.select("node", (F.col("prize") * beta).alias("_b"))
    if mu <= 0:
        return own.select("node", F.lit(0.0).alias("prize_neg"), F.col("_b").alias("prize_total"))
    both = degree(edges).select("node", degree_penalty(F.col("degree"), mu, squared).alias("_pen")).join(own, "node", "full_outer")
    neg = F.coalesce("_pen", F.lit(0.0))
    neg = F.when(F.col("_b").isNotNull(), F.lit(0.0)).otherwise(neg) if exclude_terminals else neg
    out = both.select("node", neg.alias("prize_neg"), F.col("_b"))
    return out.where("_b IS NOT NULL OR prize_neg <> 0").select("node", "prize_neg", (F.coalesce("_b", F.lit(0.0)) + F.col("prize_neg")).alias("prize_total"))


def dummy_neighbours(mode: str, prizes: DataFrame, edges: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Nodes that may hang on the dummy: 'terminals', 'all', 'others', or 'file' for ``listed``."""
    if mode == "terminals":
        return prizes.select("node").distinct()
    if mode == "all":
        return nodes(edges)
    if mode == "others":
        return nodes(edges).join(prizes.select("node"), "node", "left_anti")
    if mode == "file" and listed is not None:
        known = listed.select("node").distinct().join(nodes(edges), "node", "left_semi")
        if not known.limit(1).count():
            raise ValueError("no node of the dummy list is in the network")
        return known
    raise ValueError(f"unknown dummy mode {mode}")


def induced(edges: DataFrame, chosen_nodes: DataFrame, chosen_edges: DataFrame | None = None) -> DataFrame:
    """Edges with both ends among the nodes, without those already chosen."""
    n = chosen_nodes.select("node").distinct()
    out = edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return out if chosen_edges is None else out.join(chosen_edges.select("src", "dst"), ["src", "dst"], "left_anti")


def objective(prizes: DataFrame, chosen_nodes: DataFrame, chosen_edges: DataFrame, roots_used: DataFrame, w: float) -> DataFrame:
    """One row: excluded prizes, edge costs (1 - weight), roots' cost and their sum."""
    lost = prizes.join(chosen_nodes.select("node").distinct(), "node", "left_anti").agg(F.coalesce(F.sum("prize_total"), F.lit(0.0)).alias("excluded"))
    cost = chosen_edges.agg(F.coalesce(F.sum(1 - F.col("weight")), F.lit(0.0)).alias("cost"))
    dummy = roots_used.agg((F.count("*") * F.lit(float(w))).alias("roots"))
    # Three tables of one row each.
    return lost.crossJoin(cost).crossJoin(dummy).select("*", (F.col("excluded") + F.col("cost") + F.col("roots")).alias("objective"))


def merge_runs(runs: DataFrame, keys: list[str], run: str, n_runs: Column) -> DataFrame:
    """Share of the runs whose result holds each key.

    Rows are dealt by key before anything is counted: few of them repeat, so a table of
    a whole input split's keys would hold nearly all its rows and save no shuffle.  The
    number of tasks follows from the rows, so that none holds more as the table grows.
    """
    parts = parts_for(runs.sparkSession, runs.count())
    dealt = runs.select(*keys, run).repartition(parts, *keys)
    return dealt.distinct().groupBy(*keys).agg((F.count("*") / n_runs).alias("fraction"))


def factor_network(matrix: DataFrame, least: float = 0.3, exclude: tuple[str, ...] = (), expressed: DataFrame | None = None, suffix: str = "mrna") -> DataFrame:
    """src, dst, weight from (tf, gene, score): scores over ``least``, 1 capped at 0.9999, greatest per pair."""
    out = matrix.where(F.col("score") > least)
    if exclude:
        out = out.where(~F.upper("tf").isin(*exclude))
    if expressed is not None:
        out = out.join(expressed.select("gene").distinct(), "gene", "left_semi")
    capped = F.when(F.col("score") == 1.0, 0.9999).otherwise(F.col("score"))
    return out.groupBy(F.col("tf").alias("src"), F.concat("gene", F.lit(suffix)).alias("dst")).agg(F.max(capped).alias("weight"))


def singleton_roots(roots: DataFrame, chosen: DataFrame) -> DataFrame:
    """node: the roots (node) that no chosen edge touches."""
    return roots.select("node").distinct().join(nodes(chosen), "node", "left_anti")


def run_counts(prizes: DataFrame, chosen: DataFrame, roots: DataFrame) -> DataFrame:
    """One row: terminals given and in the solution, nodes, roots, and roots that stand alone."""
    terminals, found = prizes.select("node").distinct(), nodes(chosen)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(terminals, "terminals"), one(terminals.join(found, "node", "left_semi"), "terminals_found"), one(found, "nodes"), one(roots.select("node").distinct(), "roots"), one(singleton_roots(roots, chosen), "singleton_roots")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def guarded_prizes(prizes: DataFrame, edges: DataFrame, most: float = 0.9) -> DataFrame:
    """:func:`known_prizes`; raises ValueError where more than that share of the prizes is not in the network."""
    kept = known_prizes(prizes, edges)
    n, left = prizes.count(), kept.count()
    if n and (n - left) / n > most:
        raise ValueError(f"{n - left} of {n} prizes are not in the network")
    return kept


def solution_edges(edges: DataFrame, tree: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The network's edges between parents and children (src, dst of ``tree``), in the direction that the tree uses them.

    An undirected edge may be used either way.  An arc of the tree that the network does
    not have fails the query.  ``by`` are columns that both have, such as a run.
    """
    by = by or []
    named = tree.select(*by, F.col("src").alias("_p"), F.col("dst").alias("_c"))
    ways = edges.select(*by, "src", "dst", "weight", "dir", F.col("src").alias("_p"), F.col("dst").alias("_c"))
    back = edges.where("dir = 'U'").select(*by, "src", "dst", "weight", "dir", F.col("dst").alias("_p"), F.col("src").alias("_c"))
    met = named.join(ways.unionByName(back), [*by, "_p", "_c"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("the network has no edge"), "_p", "_c")).cast("string")
    return met.select(*by, F.when(F.col("src").isNull(), missing).otherwise(F.col("src")).alias("src"), "dst", "weight", "dir").distinct()


def with_dummy(fractions: DataFrame, roots: DataFrame, dummy: str = "DUMMY") -> DataFrame:
    """Shares of edges (src, dst, fraction) with an edge from the dummy to each root (node, fraction)."""
    return fractions.select("src", "dst", "fraction").unionByName(roots.select(F.lit(dummy).alias("src"), F.col("node").alias("dst"), "fraction"))


def merged_attributes(shares: DataFrame, prizes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, fraction, prize, terminal, degree of merged nodes (node, fraction): what all runs have in common."""
    out = shares.join(prizes.select("node", "prize"), "node", "left").join(degree(edges), "node", "left")
    return out.select("node", "fraction", F.coalesce("prize", F.lit(0.0)).alias("prize"), F.col("prize").isNotNull().alias("terminal"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
