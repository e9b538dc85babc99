import numpy as np
from pyspark.sql import functions as F

from chromaweave.llm import langid, queries

SF = "/root/testdata/sf0.001"


def test_blocks_count_like_one_piece(monkeypatch):
    text = "Über den Wolken, 123 muss die Freiheit -- grenzenlos sein! " * 9
    whole = langid.slot_counts(text)
    for n in (5, 17, 64):
        monkeypatch.setattr(langid, "BLOCK_CHARS", n)
        assert (langid.slot_counts(text) == whole).all()


def test_counts_match_brute_force():
    text, seen = "aB c", {}
    padded = ["", "a", "b", "", "c", ""]
    for n in langid.GRAMS:
        for i in range(len(padded) - n + 1):
            g = tuple(padded[i : i + n])
            if any(g):
                seen[g] = seen.get(g, 0) + 1
    assert langid.slot_counts(text).sum() == sum(seen.values())
    assert langid.slot_counts("12 -- ?").sum() == 0


def test_elastic_net_gives_zeros():
    rng = np.random.default_rng(0)
    rows = [(i % 2, np.array([i % 2, 5 + rng.integers(100)]), np.array([3, 1])) for i in range(200)]
    rows = [(y, np.sort(s), c) for y, s, c in rows]
    m = langid.fit_ftrl(rows, ["a", "b"], np.ones(langid.SLOTS), l1=0.5)
    assert (m.weights[:2] != 0).any() and (m.weights[200:] == 0).all()
    assert 0.05 <= langid.fit_temperature(m, rows) <= 20


def test_odd_rows(spark, docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12345 !!", None), (None, "the dog", None), (103, "und der hund " * 20000, None), (103, "und der hund " * 20000, None)]
    df = docs(rows).withColumn("score", F.lit("clash"))
    model = langid.fit(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0.0
    assert by[None].lang_pred == "en" and by[103].lang_pred == "de"
    empty = docs([])
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit(empty)).collect()} == {"und"}


def test_op10_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, SF).collect()}
    truth = queries.documents(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in truth if got[r.doc_id].held_out]
    assert 0.15 < len(held) / len(truth) < 0.35
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_the_sample_is_bounded_whatever_the_texts(spark, docs, monkeypatch):
    seen, fit = [], langid.fit_ftrl

    def spy(rows, labels, idf, **k):
        seen.append((len(rows), labels))
        return fit(rows, labels, idf, **k)

    monkeypatch.setattr(langid, "fit_ftrl", spy)
    rows = [(i, "the very same text", "en") for i in range(3000)] + [(i, f"und das ist der text {chr(97 + i % 26)}", "de") for i in range(3000, 3200)] + [(9000, "123", "xx")]
    model = langid.fit(docs(rows), sample_rows=300)
    # A third of the rows for each label; one in five is held back; a label without letters is not learned.
    assert seen == [(160, ["de", "en"])] and model.labels == ["de", "en"]
    assert model.predict("das ist der")[0] == "de" and model.predict("the same")[0] == "en"
