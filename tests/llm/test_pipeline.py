import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from chromaweave.llm import langid

from test_jaccard import brute as jaccard_classes
from test_linededup import brute as kept_lines
from test_pii import brute as pii_spans

SF = "/root/testdata/sf0.001"


def text_of(pieces):
    out = {}
    for p in pieces:
        out.setdefault(p.doc_id, []).append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    return {d: sum((x for _, x in sorted(v, key=lambda y: y[0])), []) for d, v in out.items()}


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in cp.language_id(spark, docs, SF).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = langid.fit(docs)
    assert kept == {i for i, t in rows if (p := model.predict(t))[0] != "und" and p[1] >= cp.LEAST_SCORE}
    rows = [r for r in rows if r[0] in kept]
    stays = kept_lines(rows)
    rows = [(i, "\n".join(t.split("\n")[j] for j in s)) for (i, t), s in zip(rows, stays, strict=True)]
    rows = [(i, t) for i, t in rows if t.strip(" \t\n\x0b\f\r")]
    rows = [(i, t) for (i, t), (d, _, c) in zip(rows, sorted(jaccard_classes(rows)), strict=True) if d == c]
    want = {}
    for i, t in rows:
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in pii_spans(t)):
            if a >= at:
                out += [t[at:a], f"<{k}>"]
            at = max(at, b)
        want[i] = "".join([*out, t[at:]])
    hf = Tokenizer.from_file(cp.public_tokenizers.path("byte_bpe_50k.json"))
    got = text_of(cp.run(spark, SF).collect())
    ids = {i: hf.encode(t, add_special_tokens=False).ids + [1] for i, t in want.items()}
    # MinHash may miss a near line in a hundred.
    differ = {i for i in ids.keys() | got.keys() if ids.get(i) != got.get(i)}
    assert len(differ) <= 0.02 * len(ids)


def test_stages_on_odd_rows(spark, docs):
    rows = [(None, None, None), (1, "", "en"), (2, "the cat and the dog sat here", None), (2, "the cat and the dog sat here", None), (3, "12 34", "en"), (4, "a word " * 30000, "en")]
    rows += [(i, t, x) for i, (t, x) in enumerate([("the dog and the cat run", "en"), ("der hund und die katze", "de")] * 10, 10)]
    for table in (docs(rows), docs([])):
        out = table
        for name, stage in cp.STAGES:
            out = stage(spark, out, SF)
            if name != "packing":
                assert out.columns == table.columns
        out.collect()


def test_columns_called_like_the_stages_own_stay(spark, docs):
    from pyspark.sql import functions as F

    table = docs([(i, t, x) for i, (t, x) in enumerate([("the dog and the cat run", "en"), ("der hund und die katze", "de")] * 10)])
    table = table.withColumns({"_lang": F.lit("keep"), "_score": F.lit("s"), "_spans": F.lit(7)})
    for stage in (cp.language_id, cp.protect_pii):
        out = stage(spark, table, SF)
        assert out.columns == table.columns and out.select("_lang", "_score", "_spans").distinct().collect() == [("keep", "s", 7)]
