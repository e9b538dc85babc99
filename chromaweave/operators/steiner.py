"""Prize-collecting Steiner forests: exact for small instances, heuristic for large ones.

A forest hangs on a dummy root.  Its cost is the prizes of the nodes it leaves out, the
costs 1 - weight of its edges, and w for each tree; a path from the dummy to a node may
hold at most D - 1 edges, the dummy's own included.  Directed edges a -> b may only be
used with a as the parent.  A small instance is solved in one task, runs in parallel; a
large one is solved by joins, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.operators.ranges import Tables, settled

#: Runs that are solved by joins go together up to so many arcs, so that the tables of one group are on disk at a time.
GROUP_ARCS = 20_000_000
#: Tables of nodes that are sent to all tasks, up to so many rows; beyond, arcs are shuffled to them.
BROADCAST_ROWS = 500_000
#: Instances up to so many parent assignments are solved exactly.
EXACT_LIMIT = 300_000


@dataclass(frozen=True)
class Instance:
    prizes: dict[str, float]
    edges: tuple[tuple[str, str, float, str], ...]  # src, dst, weight, U or D
    roots: frozenset[str]
    w: float
    depth: int

    def parents(self) -> dict[str, dict[str, float]]:
        """Possible parents of each node and the edges' costs; '' is the dummy."""
        if self.depth < 1:
            raise ValueError("depth must be at least 1")
        out: dict[str, dict[str, float]] = {}
        for a, b, weight, kind in self.edges:
            for p, c in ((a, b), (b, a))[: 2 if kind == "U" else 1]:
                own = out.setdefault(c, {})
                own[p] = min(own.get(p, 9e9), 1 - weight)
                out.setdefault(p, {})
        for r in self.roots:
            out.setdefault(r, {})[""] = self.w
        return out


def value(inst: Instance, parent: dict[str, str], reported: bool = True, costs=None) -> float:
    """The objective; as reported, single roots count as left out."""
    costs, used = costs or inst.parents(), set(parent)
    if reported:
        inner = {p for p in parent.values() if p}
        used = {v for v in parent if parent[v] or v in inner}
    lost = sum(x for v, x in inst.prizes.items() if v not in used)
    return lost + sum(costs[v][p] for v, p in parent.items())


def _depth_ok(parent: dict[str, str], limit: int) -> bool:
    for v in parent:
        n, at, seen = 0, v, set()
        while at:
            if at in seen or at not in parent:
                return False
            seen.add(at)
            at = parent[at]
            n += 1
        if n > limit - 1:
            return False
    return True


def exact(inst: Instance) -> dict[str, str]:
    """Best parent assignment; of equal ones that of fewest nodes, then the least."""
    choices = inst.parents()
    names = sorted(v for v in choices if choices[v])
    best, best_key = {}, (value(inst, {}, False), 0, ())
    for pick in product(*[[None, *sorted(choices[v])] for v in names]):
        parent = {v: p for v, p in zip(names, pick, strict=True) if p is not None}
        key = (round(value(inst, parent, False, choices), 9), len(parent), tuple(sorted(parent.items())))
        if key < best_key and _depth_ok(parent, inst.depth):
            best, best_key = parent, key
    return best


def _prune(inst: Instance, parent: dict[str, str], costs) -> dict[str, str]:
    """Strong pruning: a subtree stays if its net value exceeds the edge that holds it."""
    children: dict[str, list[str]] = {}
    for v, p in parent.items():
        children.setdefault(p, []).append(v)
    order, stack = [], list(children.get("", []))
    while stack:
        v = stack.pop()
        order.append(v)
        stack += children.get(v, [])
    net: dict[str, float] = {}
    keep = {}
    for v in reversed(order):
        net[v] = inst.prizes.get(v, 0.0) + sum(max(0.0, net[c] - costs[c][v]) for c in children.get(v, []))
    good: set[str] = set()
    for v in order:
        p = parent[v]
        if (p == "" or p in good) and net[v] - costs[v][p] > 1e-12:
            keep[v] = p
            good.add(v)
    return keep


def heuristic(inst: Instance, rounds: int = 3) -> dict[str, str]:
    """Layers of cheapest depth-limited paths from the dummy, strong pruning, then reattachment."""
    costs = inst.parents()
    out: dict[str, list[tuple[str, float]]] = {}
    for c, own in costs.items():
        for p, x in own.items():
            out.setdefault(p, []).append((c, x))
    best: dict[str, str] = {}
    discount = {v: 0.0 for v in costs}
    for turn in range(rounds):
        dist, via, hops = {"": 0.0}, {}, {"": 0}
        front = {""}
        for _ in range(max(0, inst.depth - 1)):
            nxt = set()
            for u in sorted(front):
                for v, x in out.get(u, []):
                    step = max(0.0, x - discount[v]) + 1e-9
                    if dist[u] + step < dist.get(v, 9e9) - 1e-12 and hops[u] + 1 <= inst.depth - 1:
                        dist[v], via[v], hops[v] = dist[u] + step, u, hops[u] + 1
                        nxt.add(v)
            front = nxt
        if not _depth_ok(via, inst.depth):
            # Later layers may have moved an ancestor: keep what is still a tree within the limit.
            via = {v: p for v, p in via.items() if _depth_ok({k: via[k] for k in _path(via, v)}, inst.depth)}
        found = _prune(inst, via, costs)
        if value(inst, found, False, costs) < value(inst, best, False, costs) - 1e-12:
            best = found
        discount = {v: max(0.0, inst.prizes.get(v, 0.0)) * (turn + 1) / rounds for v in costs}
    return _improve(inst, best, costs)


def _path(via, v):
    out = []
    while v and v in via and v not in out:
        out.append(v)
        v = via[v]
    return out


def _improve(inst: Instance, parent: dict[str, str], costs) -> dict[str, str]:
    """Attach prized nodes next to the forest and move nodes to cheaper parents while it pays."""
    now = dict(parent)
    by_prize = sorted(costs, key=lambda v: (-inst.prizes.get(v, 0.0), v))
    for _ in range(20):
        moved = False
        for v in by_prize:
            # What v costs now: its prize, or the edge that holds it.
            held = now.get(v)
            price = inst.prizes.get(v, 0.0) if held is None else costs[v][held]
            depth = inst.depth if held is None else len(_path(now, v))
            for p, x in sorted(costs[v].items(), key=lambda kv: (kv[1], kv[0])):
                if x >= price - 1e-12:
                    break
                above = _path(now, p) if p else []
                # No deeper than before, so what hangs below v stays within the limit; never below itself.
                if (p and p not in now) or v in above or len(above) + 1 > min(depth, inst.depth - 1):
                    continue
                now[v], moved = p, True
                break
        pruned = _prune(inst, now, costs)
        if value(inst, pruned, False, costs) < value(inst, now, False, costs) - 1e-12:
            now, moved = pruned, True
        if not moved:
            break
    return now


def solve(inst: Instance) -> dict[str, str]:
    size = 1
    for own in inst.parents().values():
        size *= 1 + len(own)
        if size > EXACT_LIMIT:
            return heuristic(inst)
    return exact(inst)


def solve_runs(edges: DataFrame, prizes: DataFrame, roots: DataFrame, w: float, depth: int, few: int = EXACT_LIMIT) -> DataFrame:
    """run, node, parent ('' under the dummy) and objective, for every run.

    edges: run, src, dst, weight, dir; prizes: run, node, prize_total; roots: run, node.
    A run of at most ``few`` arcs, counted as they are given, is solved in one task, a
    larger one by joins; with so many different arcs none would be solved exactly.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    spark = edges.sparkSession
    sizes = settled(edges.groupBy("run").agg(F.sum(F.when(F.col("dir") == "U", 2).otherwise(1)).alias("_n")))  # a row for each run
    large = sizes.where(F.col("_n") > few)
    groups = _groups([(r["run"], r["_n"]) for r in large.orderBy("run").collect()])  # a row for each run that has more than ``few`` arcs
    if not groups:
        return _solved_in_tasks(edges, prizes, roots, w, depth)
    out = []
    for runs in groups:
        chosen = F.broadcast(spark.createDataFrame([(r,) for r in runs], edges.select("run").schema))
        out.append(_solved_by_joins(*[df.join(chosen, "run", "left_semi") for df in (edges, prizes, roots)], w, depth))
    # Also runs without edges, whose roots may be trees by themselves.
    given = reduce(DataFrame.union, [df.select("run").distinct() for df in (prizes, roots, sizes.where(F.col("_n") <= few))])
    if given.join(F.broadcast(large.select("run")), "run", "left_anti").limit(1).count():
        out.append(_solved_in_tasks(*[df.join(F.broadcast(large.select("run")), "run", "left_anti") for df in (edges, prizes, roots)], w, depth))
    return reduce(DataFrame.unionByName, out)


def _groups(sizes: list[tuple], most: int | None = None) -> list[list]:
    """Runs in groups of at most so many arcs, one run at least."""
    out, total = [], 0
    for run, n in sizes:
        if not out or total + n > (most or GROUP_ARCS):
            out.append([])
            total = 0
        out[-1].append(run)
        total += n
    return out


def _solved_in_tasks(edges: DataFrame, prizes: DataFrame, roots: DataFrame, w: float, depth: int) -> DataFrame:
    both = edges.selectExpr("run", "'e' AS kind", "src AS a", "dst AS b", "weight AS x", "dir").unionByName(prizes.selectExpr("run", "'p' AS kind", "node AS a", "'' AS b", "prize_total AS x", "'' AS dir"))
    both = both.unionByName(roots.selectExpr("run", "'r' AS kind", "node AS a", "'' AS b", "0.0D AS x", "'' AS dir"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "a", "b", "dir", "x"])
        e, p, r = (pdf[pdf.kind == k] for k in "epr")
        inst = Instance(dict(zip(p.a, p.x, strict=True)), tuple(zip(e.a, e.b, e.x, e.dir, strict=True)), frozenset(r.a), w, depth)
        parent = solve(inst)
        run = pdf.run.iloc[0]
        # Plain objects: Arrow-backed strings come in chunks, which a grouped result cannot hold.
        names = {"node": pd.Series(list(parent), dtype=object), "parent": pd.Series(list(parent.values()), dtype=object)}
        return pd.DataFrame({"run": run, **names, "objective": value(inst, parent)}, columns=["run", "node", "parent", "objective"])

    run_type = edges.schema["run"].dataType.simpleString()
    return both.groupBy("run").applyInPandas(one, f"run {run_type}, node string, parent string, objective double")


KEY = ["run", "node"]
#: Rounds of moves in a forest that is built by joins; each lowers the objective, and the last one finds none.
MOVES = 20


def _by_depth(tree: DataFrame, depth: int, keep=settled) -> list[DataFrame]:
    """The rows of (run, node, parent, ...) that hang on the dummy within the limit, by their depth; others are left out."""
    levels = [keep(tree.where("parent = ''"))]
    for _ in range(depth - 2):
        above = levels[-1].select("run", F.col("node").alias("parent"))
        levels.append(keep(tree.join(above, ["run", "parent"], "left_semi").select(tree.columns)))
    return levels


def _pruned(levels: list[DataFrame], keep=settled) -> DataFrame:
    """:func:`_prune` of (run, node, parent, cost, prize), level by level: what is kept, with its depth."""
    gains, below = [], None
    for level in reversed(levels):
        net = F.col("prize")
        if below is not None:
            level, net = level.join(below, KEY, "left"), net + F.coalesce("_below", F.lit(0.0))
        held = keep(level.withColumn("_gain", net - F.col("cost")).where("_gain > 1e-12").select("run", "node", "parent", "cost", "prize", "_gain"))
        gains.append(held)
        below = held.groupBy("run", F.col("parent").alias("node")).agg(F.sum("_gain").alias("_below"))
    kept = []
    for i, held in enumerate(reversed(gains)):
        if kept:
            held = held.join(kept[-1].select("run", F.col("node").alias("parent")), ["run", "parent"], "left_semi")
        kept.append(keep(held.select("run", "node", "parent", "cost", "prize", F.lit(i + 1).alias("depth"))))
    return reduce(DataFrame.unionByName, kept)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """To be sent to all tasks if it has few rows, of which ``rows`` is the number or a bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _solved_by_joins(edges: DataFrame, prizes: DataFrame, roots: DataFrame, w: float, depth: int, rounds: int = 3) -> DataFrame:
    """The heuristic of all runs together: layers, pruning and moves as joins by node; no task holds a run.

    Nodes of a layer are reached and moved at once, not one after the other, so that a
    tie or the order of two moves may fall otherwise than in :func:`heuristic`.  Arcs are
    written once, those into one node side by side: what is found for a node is then
    combined before it is shuffled, and arcs are shuffled only to more nodes than
    :data:`BROADCAST_ROWS`.  A table is deleted as soon as nothing reads it.
    """
    keep = Tables(edges.sparkSession)
    prizes = keep(prizes.groupBy(*KEY).agg(F.max("prize_total").alias("prize")))
    n_prizes = prizes.count()
    tops = roots.select(*KEY).distinct().select(*KEY, F.lit("").alias("parent"), F.lit(float(w)).alias("cost")).join(prizes, KEY, "left")
    tops = keep(tops.withColumn("prize", F.coalesce("prize", F.lit(0.0))) if depth > 1 else tops.where("false"))
    n_tops = tops.count()
    given = keep(edges.select("run", "src", "dst", "dir", (1 - F.col("weight")).alias("cost")))
    keep.only(prizes, tops, given)
    ends = lambda p, node: F.struct(F.col(p).alias("p"), F.col(node).alias("node"))
    ways = F.when(F.col("dir") == "U", F.array(ends("src", "dst"), ends("dst", "src"))).otherwise(F.array(ends("src", "dst")))
    # The rows of a node stay together in the aggregate by arc, and are written side by side.
    arcs = given.select("run", F.explode(ways).alias("_w"), "cost").select("run", "_w.p", "_w.node", "cost").repartition(*KEY)
    arcs = arcs.groupBy("run", "p", "node").agg(F.min("cost").alias("cost"))
    priced = arcs.join(_few(prizes, n_prizes), KEY, "left").select("run", "p", "node", "cost", F.coalesce("prize", F.lit(0.0)).alias("prize"))
    priced = keep(priced.sortWithinPartitions(*KEY))
    keep.only(prizes, tops, priced)
    best = None
    for turn in range(rounds):
        discount = F.greatest(F.lit(0.0), F.col("prize")) * (turn / rounds)
        step = F.greatest(F.lit(0.0), F.col("cost") - discount) + 1e-9
        first = front = keep(tops.select("*", step.alias("dist")))
        known, n_front = front, n_tops
        for _ in range(depth - 2):
            useful = priced
            if n_front > BROADCAST_ROWS >= n_tops and n_front:
                # Arcs that cannot bring a root nearer than it was at first, even from the nearest node, are not shuffled.
                nearest = front.agg(F.min("dist")).first()[0]
                useful = useful.join(F.broadcast(first.select(*KEY, F.col("dist").alias("_top"))), KEY, "left")
                useful = useful.where(F.col("_top").isNull() | (F.lit(nearest) + step < F.col("_top") - 1e-12)).drop("_top")
            ahead = useful.join(_few(front.select("run", F.col("node").alias("p"), F.col("dist").alias("_d")), n_front), ["run", "p"])
            # The first of the nearest parents, and a row for each node.
            near = ahead.groupBy(*KEY).agg(F.min(F.struct((F.col("_d") + step).alias("dist"), F.col("p").alias("parent"), "cost")).alias("b"), F.first("prize").alias("prize"))
            near = near.select(*KEY, "b.parent", "b.cost", "prize", "b.dist")
            front = keep(near.join(known.select(*KEY, F.col("dist").alias("_had")), KEY, "left").where("_had IS NULL OR dist < _had - 1e-12").drop("_had"))
            n_front = front.count()
            known = keep(known.join(front.select(*KEY), KEY, "left_anti").unionByName(front))
        found = _pruned(_by_depth(known.drop("dist"), depth, keep), keep)
        best = keep(found if best is None else _better(best, found))
        del first, front, known, found, useful, ahead, near
        keep.only(prizes, tops, priced, best)
    now, n_now = best, best.count()
    # A node moves only for less than what it costs now or would cost left out: its prize, or its first edge.
    bound = now.select(*KEY, F.col("cost").alias("_held"))
    useful = priced.unionByName(tops.select("run", F.col("parent").alias("p"), "node", "cost", "prize")).join(_few(bound, n_now), KEY, "left")
    useful = keep(useful.where("cost < greatest(prize, _held) - 1e-12").drop("_held"))
    del best, bound
    keep.only(prizes, useful, now)
    for _ in range(MOVES):
        above = now.select("run", F.col("node").alias("p"), F.col("depth").alias("_at"))
        above = above.unionByName(now.select("run").distinct().select("run", F.lit("").alias("p"), F.lit(0).alias("_at")))
        held = now.select(*KEY, F.col("cost").alias("_held"), F.col("depth").alias("_depth"))
        can = useful.join(_few(above.where(F.col("_at") < depth - 1), n_now), ["run", "p"]).join(_few(held, n_now), KEY, "left")
        # A parent's depth is less than the node's, before all moves: so they make no circle, and nothing comes to lie deeper.
        can = can.where((F.col("cost") < F.coalesce("_held", F.col("prize")) - 1e-12) & (F.col("_at") < F.coalesce(F.col("_depth"), F.lit(depth))))
        moved = keep(can.groupBy(*KEY).agg(F.min(F.struct("cost", F.col("p").alias("parent"))).alias("b"), F.first("prize").alias("prize")).select(*KEY, "b.parent", "b.cost", "prize"))
        if not moved.limit(1).count():
            break
        tree = keep(now.select(*KEY, "parent", "cost", "prize").join(moved.select(*KEY), KEY, "left_anti").unionByName(moved))
        now = keep(_pruned(_by_depth(tree, depth, keep), keep))
        n_now = now.count()
        del above, held, can, moved, tree
        keep.only(prizes, useful, now)
    del useful
    keep.only(prizes, now)
    return _reported(now, prizes)


def _better(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two forests of each run that of the greater gain, the first where they are alike."""
    gain = lambda df, name: df.groupBy("run").agg(F.sum(F.col("prize") - F.col("cost")).alias(name))
    chosen = gain(a, "_a").join(gain(b, "_b"), "run", "full_outer").select("run", (F.coalesce("_b", F.lit(0.0)) > F.coalesce("_a", F.lit(0.0)) + 1e-12).alias("_second"))
    chosen = F.broadcast(settled(chosen))  # a row for each run
    return a.join(chosen.where("NOT _second"), "run", "left_semi").unionByName(b.join(chosen.where("_second"), "run", "left_semi"))


def _reported(forest: DataFrame, prizes: DataFrame) -> DataFrame:
    """The forests with :func:`value` as reported: single roots count as left out."""
    inner = forest.where("parent <> ''").select("run", F.col("parent").alias("node"))
    used = forest.where("parent <> ''").select(*KEY).unionByName(inner).distinct()
    lost = prizes.join(used, KEY, "left_anti").groupBy("run").agg(F.sum("prize").alias("_lost"))
    cost = forest.groupBy("run").agg(F.sum("cost").alias("_cost"))
    total = cost.join(lost, "run", "left").select("run", (F.col("_cost") + F.coalesce("_lost", F.lit(0.0))).alias("objective"))
    return forest.join(F.broadcast(total), "run").select("run", "node", "parent", "objective")  # a row for each run


#: Arcs of a graph that is sent whole to the tasks; a larger one is searched by joins.
FEW_ARCS = 50_000


def betweenness(arcs: DataFrame, few: int = FEW_ARCS) -> DataFrame:
    """node, betweenness of a directed, unweighted graph (src, dst), over (n - 1)(n - 2).

    A graph of at most ``few`` arcs, such as one forest, goes to all tasks, which share
    its sources.  In a larger one leaves are folded into their neighbours first, as they
    lie on no path but their own.  What is left is searched by joins from all sources at
    once, level by level, each level a written table; every pair of it that is connected
    is a row there.
    """
    arcs = arcs.select("src", "dst").distinct()
    if arcs.limit(few + 1).count() <= few:
        return _betweenness_of_few(arcs)
    return _betweenness_by_levels(arcs)


#: Leaves are folded as long as a round takes one node in so many.
LEAVES_EVERY = 100


def _folded(names: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of a graph when its leaves are folded into their neighbours, round by round.

    A leaf has arcs from and to one node only, so all its paths lead through that node.
    Gives the core's arcs, its nodes (node, w), and all nodes (node, root, w, sq): the
    core's node that each was folded into, how many nodes were folded into it with
    itself, and the sum of the squares of its branches' sizes.
    """
    live = names.select("node", F.lit(1.0).alias("w"), F.lit(0.0).alias("sq"))
    folds, n = [], names.count()
    while n:
        ends = arcs.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out")).unionByName(arcs.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0).alias("out")))
        ends = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("out").alias("out"), F.min("other").alias("parent"), F.max("other").alias("_last"))
        leaves = ends.where("n = 2 AND out = 1 AND parent = _last").select("node", "parent")
        # Of two nodes that have only each other, one stays.
        pair = leaves.select(F.col("node").alias("parent"), F.col("parent").alias("node"), F.lit(True).alias("_pair"))
        leaves = settled(leaves.join(pair, ["node", "parent"], "left").where("_pair IS NULL OR node > parent").select("node", "parent").join(live, "node"))
        here = leaves.count()
        if not here:
            break
        folds.append(leaves)
        gained = leaves.groupBy(F.col("parent").alias("node")).agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("w")).alias("_sq"))
        plus = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c)
        live = settled(live.join(leaves.select("node"), "node", "left_anti").join(gained, "node", "left").select("node", plus("w"), plus("sq")))
        arcs = settled(arcs.join(leaves.select(F.col("node").alias("src")), "src", "left_anti").join(leaves.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        n -= here
        if here * LEAVES_EVERY < n:
            break
    rooted = live.select("node", F.col("node").alias("root"), "w", "sq")
    for leaves in reversed(folds):
        above = rooted.select(F.col("node").alias("parent"), "root")
        rooted = rooted.unionByName(settled(leaves.join(above, "parent").select("node", "root", "w", "sq")))
    return arcs, live.select("node", "w"), rooted


def _betweenness_by_levels(arcs: DataFrame) -> DataFrame:
    names = settled(arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct())
    arcs, core, rooted = _folded(names, settled(arcs.where("src <> dst")))
    # A node of the core stands for all that were folded into it: pairs weigh as many as they stand for.
    levels = [settled(core.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths"), F.col("w").alias("from"), F.col("w").alias("to")))]
    seen = levels[0].select("s", "node")
    while True:
        ahead = levels[-1].join(arcs, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"), F.first("from").alias("from"))
        new = settled(ahead.join(seen, ["s", "node"], "left_anti").join(core.withColumnRenamed("w", "to"), "node").select("s", "node", "paths", "from", "to"))
        if not new.limit(1).count():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("s", "node"))
    # Back from the farthest level: what a node hands on to those before it, by its paths.
    shares, below = [], levels[-1].withColumn("share", F.lit(0.0))
    for level in reversed(levels[:-1]):
        shares.append(below)
        hands = below.select("s", F.col("node").alias("dst"), ((F.col("to") + F.col("share")) / F.col("paths")).alias("x")).join(arcs, "dst").groupBy("s", F.col("src").alias("node")).agg(F.sum("x").alias("x"))
        below = settled(level.join(hands, ["s", "node"], "left").select("s", "node", "paths", "from", "to", (F.col("paths") * F.coalesce("x", F.lit(0.0))).alias("share")))
    through = [part.select("node", (F.col("from") * F.col("share")).alias("share")) for part in shares]
    # How many nodes a core node reaches and is reached by, itself and what was folded into it included.
    reach = [x for level in levels for x in (level.select(F.col("s").alias("root"), F.col("to").alias("met")), level.select(F.col("node").alias("root"), F.col("from").alias("met")))]
    both = lambda parts: reduce(DataFrame.unionByName, parts)
    met = both(reach).groupBy("root").agg(F.sum("met").alias("met"))
    # Pairs of which one or both lie in different branches of a node.
    branches = F.col("w") - 1
    own = rooted.join(met, "root").select("node", (branches * branches - F.col("sq") + branches * (F.col("met") - 2 * F.col("w"))).alias("share"))
    n = names.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return both([own, *through]).groupBy("node").agg((F.sum("share") * scale).alias("betweenness"))


def _betweenness_of_few(arcs: DataFrame) -> DataFrame:
    pairs = sorted((r["src"], r["dst"]) for r in arcs.collect())  # a checked number
    names = sorted({x for p in pairs for x in p})
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    spark = arcs.sparkSession

    def run(batches):
        for pdf in batches:
            total = dict.fromkeys(names, 0.0)
            for s in pdf["node"]:
                order, before, paths, dist = [], {}, {s: 1.0}, {s: 0}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for u in out.get(v, ()):
                        if u not in dist:
                            dist[u] = dist[v] + 1
                            queue.append(u)
                        if dist[u] == dist[v] + 1:
                            paths[u] = paths.get(u, 0.0) + paths[v]
                            before.setdefault(u, []).append(v)
                share = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in before.get(v, ()):
                        share[u] += paths[u] / paths[v] * (1 + share[v])
                    if v != s:
                        total[v] += share[v]
            yield pd.DataFrame({"node": names, "b": [total[v] for v in names]})

    n = len(names)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if not names:
        return spark.createDataFrame([], "node string, betweenness double")
    parts = spark.createDataFrame([(x,) for x in names], "node string").mapInPandas(run, "node string, b double")
    return parts.groupBy("node").agg((F.sum("b") * scale).alias("betweenness"))
