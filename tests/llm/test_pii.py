import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chromaweave.llm import pii, queries

SF = "/root/testdata/sf0.01"


def brute(text):
    out, text = [], text or ""
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = lo <= len(d) <= hi and (kind == "phone" or sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0)
            if ok:
                out.append((kind, *m.span()))
    return out


def test_patterns_match_the_plain_ones():
    r = random.Random(1)
    parts = list("aZ09._%+-@@@  ().,é١") + ["4736962573099581", "1.2.3.4", "+1 (243) 555-5526", ".com", "256", "007", "@b.c"]
    for _ in range(30000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 18)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == brute(t), t
    long = "a" * 200_000 + "1" * 200_000 + "@" * 1000 + "+1" * 1000
    assert pii.base_spans(long) == []


def corpus():
    # "bluecastle" stands with one address only; "and" stands everywhere.
    rows = [(i, f"mail bluecastle and friend{i} at joe@x.org now") for i in range(6)]
    rows += [(i, f"some other mail words and more{i} here at hand now, none of it private") for i in range(10, 200)]
    rows += [(300, None), (301, ""), (302, "1.2.3.4 " * 20000), (None, "tie +1 (243) 555-5526"), (None, "tie +1 (243) 555-5526"), (303, "bluecastle alone")]
    return rows


@pytest.mark.parametrize("limit", [10**6, 0])
def test_terms_that_disclose(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", limit)
    df = docs(corpus()).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in pii.protect(df, disclosure=0.9).where("doc_id is not null").collect()}
    # 6 of the 7 texts with the word hold the address.
    assert [(s.kind, s.start, s.end) for s in got[0].spans] == [("email", 31, 40), ("term", 5, 15)]
    assert got[0].sanitised.__eq__("mail <term> and friend0 at <email> now")
    assert got[303].spans == [] and got[12].sanitised == got[12].text
    assert got[300].sanitised is None and got[301].sanitised == ""
    assert len(got[302].spans) == 20000


def test_repeats_and_empty(spark, docs):
    assert pii.protect(docs(corpus())).where("doc_id is null").count() == 2
    assert pii.protect(docs([])).count() == 0
    # Copies of one text are no evidence.
    rows = [(i, "castle joe@x.org") for i in range(50)] + [(99, "x y z")]
    assert all(s.kind != "term" for r in pii.protect(docs(rows)).collect() for s in r.spans)


def test_op5_whole_table(spark):
    got = {r.doc_id: r for r in queries.op5_pii(spark, SF).collect()}
    rows = queries.documents(spark, SF).collect()
    assert len(got) == len(rows)
    for r in rows:
        want = [f"{k}:{a}:{b}" for k, a, b in brute(r.text)]
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.BASE]
        assert g.spans.split(",")[: len(want)] == (want or g.spans.split(",")[:0])
