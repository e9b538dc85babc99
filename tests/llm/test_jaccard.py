import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaweave.llm import jaccard, queries, setjoin

SF = "/root/testdata/sf0.001"


def sets_of(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent=80):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    low = {k: min([x for x in v if x is not None], default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(df, **k):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df, **k).collect()), key=str)


@pytest.mark.parametrize("bits", [4, 18])
def test_matches_brute_force(spark, docs, bits):
    r, rows = random.Random(bits), []
    words = [f"w{i}" for i in range(400)]
    shared = [r.choice(words) for _ in range(30)]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 20, 60, 120]))] + (shared if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(t))
                t[at : at + 1] = r.choice([[], [r.choice(words)], [t[at], "x"]])
            rows.append((len(rows) + 1, r.choice([" ", "\n", "  "]).join(t)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (None, "one two"), (1005, "É one"), (1006, "é one"), (7, rows[0][1]), (7, rows[0][1])]
    rows.append((2000, "long text here " * 5000))
    assert run(docs(rows).withColumn("n_shingles", F.lit("clash")), sketch_bits=bits) == brute(rows)


def test_chain_and_empty(spark, docs):
    assert jaccard.classes(docs([])).count() == 0
    w = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w[i * 4 : i * 4 + 100])) for i in range(30)]
    assert run(docs(rows), sketch_bits=10) == brute(rows)


def test_keep_one_and_names_used_inside(spark, docs):
    names = ["_text", "_t1", "_t2", "_id", "_file", "_at", "_n", "node"]
    w = [f"w{i}" for i in range(60)]
    rows = [(4, " ".join(w)), (2, " ".join(w[:-1])), (None, " ".join(w)), (2, " ".join(w[:-1])), (9, None), (8, None), (7, ""), (6, "other words")]
    got = jaccard.keep_one(docs(rows).withColumns({c: F.lit(c) for c in names}))
    assert got.columns[-len(names) :] == names
    assert sorted((str(r.doc_id), r["_at"]) for r in got.collect()) == [(x, "_at") for x in ("2", "6", "7", "8", "9")]
    assert jaccard.keep_one(docs([])).count() == 0


def test_large_group_of_near_copies_that_mostly_do_not_link(spark, docs):
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        t = list(base)
        for at in r.sample(range(200), r.choice([2, 5, 6])):
            t[at] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert run(docs(rows)) == brute(rows)


def test_prefix_is_long_enough():
    for n in range(1, 300):
        p = setjoin.prefix_length(n, 80)
        # n - p further shingles alone are too few for the least overlap that is needed.
        assert n - p < np.ceil(n * 80 / 100) <= n - p + 1


def test_op2_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op2_ngram_jaccard(spark, SF).collect()), key=str)
    assert got == brute(rows)


def near_copies(n, seed=3):
    r = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(n):
        t = list(base)
        for at in r.sample(range(200), r.choice([3, 4, 4, 4])):
            t[at] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    return rows


def test_group_of_near_copies_that_just_do_not_link_costs_few_pairs(spark, docs, monkeypatch):
    rows, seen, check = near_copies(150), [], jaccard.check

    def counted(pairs, *more):
        seen.append(pairs.count())
        return check(pairs, *more)

    monkeypatch.setattr(jaccard, "check", counted)
    assert run(docs(rows)) == brute(rows)
    assert sum(seen) < 8 * len(rows)  # of 11,175


@pytest.mark.parametrize("best", [True, False])
def test_blocks_of_a_common_element_meet_each_other(spark, best):
    r = np.random.default_rng(1)
    rows, bits = [], []
    base = r.choice(1 << 20, 100, replace=False)
    for node in range(60):
        s = np.sort(np.where(r.random(100) < 0.08, r.integers(1 << 20, 1 << 21, 100), base)).astype(np.uint64)
        rows += [(int(x), node, 100, 100, at) for at, x in enumerate(s[:21])]
        bits.append((node, bytearray(setjoin.parities(s)) if node % 7 else None))
    lists = spark.createDataFrame(rows, "s long, node long, n long, e long, at int")
    spread = spark.createDataFrame([(i, i // 3 if i < 30 else i, i // 3 if i < 30 else i + i % 2) for i in range(60)], "node long, lo long, hi long")
    parity = spark.createDataFrame(bits, "node long, bits binary")

    def met(block_rows):
        out = setjoin.meetings(lists, spread, parity, 80, best, block_rows).collect()
        return {(x.node1, x.apart if best else x.node2) for x in out}

    assert met(4) == met(4096) and len(met(4096)) > 20
