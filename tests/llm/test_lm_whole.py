"""Scores do not depend on how many words are broadcast, nor on a bounded part of the corpus."""

import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from chromaweave.llm import lm

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_score_is_the_same_for_any_broadcast_table(spark, docs):
    rows = [(0, None), (1, "the cat sat on the mat"), (2, "rare  x   thing"), (3, "the end"), (4, "the cat and the thing"), (5, "never seen before")]
    score = lambda top: {r.doc_id: r.score for r in lm.score(docs(rows), PATH, F.col("doc_id") != 5, top_words=top).collect()}
    want = score(10**6)
    for top in (3, 0):
        got = score(top)
        assert all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want), (top, got, want)


def test_later_subwords_see_at_least_half_a_window():
    # Position p of a window sees p + 1 subwords; windows score positions from WINDOW - STRIDE on.
    assert lm.WINDOW - lm.STRIDE >= lm.WINDOW // 2 >= 16


def test_the_sample_grows_with_the_corpus():
    assert lm.sample_size(10) == lm.sample_size(10**5) == lm.SAMPLE_DOCS
    assert lm.sample_size(10**7) == 10 * lm.sample_size(10**6) > lm.SAMPLE_DOCS


def test_the_sample_is_bounded_whatever_the_texts(spark, docs):
    rows = docs(["the very same text"] * 2000 + [f"other text {i}" for i in range(30)])
    got = lm.sampled(rows, "doc_id", "text", F.lit(True), rows.count(), 100, PATH)
    assert len(got) == 100 and sum(ws[0] == b"the" for ws in got) > 80
    again = lm.sampled(rows.repartition(7), "doc_id", "text", F.lit(True), rows.count(), 100, PATH)
    assert got == again


def test_subword_frequencies_cover_all_training_texts(spark, docs, monkeypatch):
    texts = ["the cat sat", "x\u00a0 y\u3000 z \u00a0", "it's 'tis ununhearable", None, "the the end", " \n"] * 3
    seen, train = {}, lm.train

    def spy(sample, n_ids, begins, **more):
        seen.update(more, size=n_ids, sampled=len(sample))
        return train(sample, n_ids, begins, **more)

    monkeypatch.setattr(lm, "train", spy)
    lm.score(docs(texts), PATH, F.lit(True), sample_docs=0).count()
    want = np.zeros(seen["size"] + 1)
    for t in texts:
        np.add.at(want, lm.ids_of(lm.words_of(t), PATH), 1)
        want[-1] += 1
    assert seen["sampled"] == 0 and (seen["totals"] == want).all()


def test_ids_of_remembered_words_are_those_of_whole_texts():
    import numpy as np
    import public_tokenizers

    from chromaweave.llm import lm

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["Plain words, don't split; x=1234567", "a  b    c d ", "naïve 漢字 漢 \U0001f600\U0001f600 'll 's", "� \x00 \x1f \x85 é", "", "words, words, again again"]
    words = lm.WordIds(path)
    for text in texts:
        split = lm.words_of(text)
        words.learn([w for w in dict.fromkeys(split) if w not in words.number])
        assert words.of(np.array([words.number[w] for w in split], np.int64)).tolist() == lm.ids_of(split, path).tolist()


def test_large_exponents_score_as_small_ones():
    import numpy as np

    from chromaweave.llm import lm

    begins = np.arange(50) % 2 == 0
    texts = [np.random.default_rng(i).integers(0, 50, 5 + 9 * i) for i in range(12)]
    net = lm.train(texts, 50, begins)
    net.p["b"] += 0.1
    own = net.score_flat(texts)[0]
    net.p["b"] += 500  # the same for all classes
    assert np.isfinite(own).all() and np.allclose(own, net.score_flat(texts)[0], atol=1e-3)
