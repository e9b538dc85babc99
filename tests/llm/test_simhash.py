import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chromaweave.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def edit(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 2
        out[i] = t[: len(t) - k] + nxt[:k]
    return out


def test_op1_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()]
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}
    want = edit(rows)
    assert len(got) == len(rows)
    by_text = {}
    for i, t in rows:
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    ids = sorted(got)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b, e = (int(x, 16) for x in (got[i].fingerprint, got[j].fingerprint, got[i].edited_fingerprint))
        assert got[i].near_next == 1 - (a ^ b).bit_count() / 128 and got[i].near_edited == 1 - (a ^ e).bit_count() / 128
    assert sum(g.near_edited > g.near_next for g in got.values()) > 0.9 * len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_next_in_small_tables(spark, docs, n):
    rows = [(i * 10**6, f"wörd{i} and some \U0001d518 more {i * 7}") for i in range(n)]
    got = {r.doc_id: r.edited_sha256 for r in simhash.fingerprint_edits(docs(rows).withColumn("hi", F.lit(1))).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edit(rows).items()}


def test_votes_match_brute_force(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a bb ccc dddd eeeee " * 300), (5, "Tie tie"), (5, "Tie tie"), (None, "null id")]
    df = docs([r for r in rows if r[0] not in (5, None)])
    hashes = {w: (r.a, r.b) for w in "a bb ccc dddd eeeee".split() for r in spark.sql(f"select xxhash64('{w}', 1) a, xxhash64('{w}', 2) b").collect()}
    votes = [0] * 128
    for w, (a, b) in hashes.items():
        for j in range(128):
            h = a if j < 64 else b
            votes[j] += (max(len(w) - 3, 0) * 4 + 1) * (1 if h >> (j % 64) & 1 else -1)
    got = {r.doc_id: r for r in simhash.fingerprints(df, ["doc_id"], "text").collect()}
    want = [sum((1 << j) for j in range(64) if votes[j + k] > 0) for k in (0, 64)]
    assert [got[4].hi % 2**64, got[4].lo % 2**64] == want
    assert [(got[i].hi, got[i].lo) for i in (1, 2, 3)] == [(0, 0)] * 3
    assert simhash.fingerprint_edits(docs(rows)).count() == len(rows)


def test_block_tables_find_all(spark):
    r, rows = random.Random(5), []
    for i in range(60):
        x = r.getrandbits(128)
        for j in range(6):
            y = x
            for b in r.sample(range(128), j):
                y ^= 1 << b
            rows.append((i * 10 + j, y))
    rows += [(9000, rows[0][1]), (9001, rows[0][1])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(y >> 64), signed(y & (2**64 - 1))) for i, y in rows] + [(None, None, None)], "id long, hi long, lo long")
    got = simhash.near(df, df, "id", "id").collect()
    want = {(i, j, (a ^ b).bit_count()) for i, a in rows for j, b in rows if (a ^ b).bit_count() <= 3}
    assert len(got) == len(want) and {(g.query_id, g.row_id, g.distance) for g in got} == want
