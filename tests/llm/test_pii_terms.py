"""Terms with digits disclose like any others, at production parameters."""

from chromaweave.llm import pii


def test_planted_terms_with_digits_are_found(spark, docs):
    rows = [(i, f"note {i}x from user jdoe42 order ACME-4711, at joe@x.org or +1 (243) 555-5526 today") for i in range(50)]
    rows += [(i, f"some other note {i}x from user smith7 of today at hand") for i in range(100, 5000)]
    got = {r.doc_id: r for r in pii.protect(docs(rows)).collect()}
    for i in range(50):
        text = rows[i][1]
        words = [text[s.start : s.end] for s in got[i].spans if s.kind == "term"]
        assert "jdoe42" in words and "ACME-4711" in words
        assert not {"joe@x.org", "+1", "243", "555-5526", "smith7", "note", "today", f"{i}x"} & set(words)
    assert all(s.kind != "term" for i in range(100, 5000) for s in got[i].spans)


def test_words_in_base_spans_are_no_terms():
    text = "a1 joe@x.org, b2 +1 - 555-5526-77 - c3 1.2.3.4"
    assert [text[a:b] for _, a, b in pii.terms(text, pii.base_spans(text))] == ["a1", "b2", "-", "c3"]
    assert all(pii.may_overlap(w) for w in ("joe@x.org,", "+1", "-", "555-5526-77", "1.2.3.4")) and not pii.may_overlap("word")
