import hashlib
import random
import re

from pyspark.sql import functions as F

from chromaweave.llm import queries, secrets

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def base(spans):
    return [f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in secrets.BASE]


def test_matches_brute_force(spark, docs):
    r, parts = random.Random(3), ["password", "TOKEN", "api_key", ":", "=", " ", '"', "'", "abc123", "AKIA" + "Z9" * 8, "deadbeef" * 3, "é\U0001d518", "secret", "\x01", "\n", "tok", "x"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "password: token: abcdefgh"), (1003, ("secret=abcdef1 " + "x" * 50) * 3000), (None, "token=abcdefg"), (None, "token=abcdefg")]
    df = docs(rows).withColumn("spans", F.lit("clash"))
    got = secrets.scan_secrets(df, keep=("doc_id",)).collect()
    assert sorted((str(g.doc_id), base(g.spans)) for g in got) == sorted((str(i), brute(t)) for i, t in rows)
    assert secrets.scan_secrets(docs([])).count() == 0


def test_ownership_tells_examples_from_live(spark, docs):
    copied, own, blob = "token = Example9Key", "token = pR1vate8Key", "x Zz9" + "aB3" * 9 + " y"
    rows = [(i, copied, "en", f"org{i}/repo") for i in range(6)] + [(i, own, "en", f"org0/repo{i % 2}") for i in range(10, 14)]
    rows += [(20, blob, "en", None), (21, "a " + blob, "en", "org1/r")]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs(rows)).collect()}
    assert [s["class"] for s in got[0]] == ["example"] and got[0][0].n_owners == 6
    assert [s["class"] for s in got[10]] == ["live"] and (got[10][0].n_owners, got[10][0].n_repositories) == (1, 2)
    assert [(s.kind, s.start) for s in got[21]] == [("blob", 4)]


def test_op7_whole_table(spark):
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, SF).collect()}
    rows = queries.documents(spark, SF).collect()
    assert len(got) == len(rows) and sum(len(brute(r.text)) for r in rows) > 0
    for r in rows:
        want = brute(r.text)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in secrets.BASE)
        assert set(want) <= set(g.spans.split(",") if g.spans else [])
