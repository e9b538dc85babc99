import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from chromaweave.llm import lm, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def small_network(seed=0):
    size, begins = lm.subwords(PATH)[1:]
    texts = [lm.ids_of(lm.words_of(t), PATH) for t in ["the cat sat on the mat", "a dog and the cat", "ununhearable antidotes, here"] * 5]
    return lm.train(texts, size, begins, seed), texts


def test_gradients_match_differences():
    net, _ = small_network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, len(net.p["E"]), (3, lm.WINDOW)), rng.integers(0, len(net.p["b"]), (3, lm.STRIDE))
    y[2, 5:] = -1
    first = np.array([False, True, False])
    loss = lambda: -net.log_classes(x, first)[np.flatnonzero(y.ravel() >= 0), y[y >= 0]].mean()
    grads = lm._gradients(net, x, y, first)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g.ravel()))[:3]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert math.isclose((up - down) / 2e-5, g.ravel()[i], rel_tol=2e-2, abs_tol=1e-6), name


def test_each_subword_is_scored_once_with_its_window():
    net, texts = small_network()
    long = np.concatenate(texts)[:70]
    texts = [long, long[:5], np.empty(0, np.int64), long[:16], long[:29]]
    for ids, (own, _) in zip(texts, net.score(texts), strict=True):
        x = np.append(len(net.p["E"]) - 1, net.input_of[ids])
        t = np.append(ids, len(net.class_of) - 1)
        for i in range(len(t)):
            at = i // lm.STRIDE * lm.STRIDE  # the window begins half a window before
            part = np.zeros(lm.WINDOW, np.int64)
            here = x[max(0, at - lm.STRIDE) : i + 1]  # what comes later is not seen
            put = lm.STRIDE if at == 0 else 0
            part[put : put + len(here)] = here
            z = net.log_classes(part[None], np.array([at == 0]))[i - at]
            assert math.isclose(own[i], z[net.class_of[t[i]]] + net.inside[t[i]], abs_tol=1e-4)


def test_mixture_weights_are_those_of_most_likelihood():
    rng = np.random.default_rng(3)
    network, frequency, levels = rng.normal(-6, 2, 4000), rng.normal(-7, 1, 4000), rng.integers(0, 3, 4000)
    mix = lm.fit_mix(network, frequency, levels, steps=400)
    likelihood = lambda w, k: np.logaddexp(network + np.log(w), frequency + np.log1p(-w))[levels == k].sum()
    for k in range(3):
        grid = np.linspace(0.01, 0.99, 99)
        assert abs(mix[k] - grid[np.argmax([likelihood(w, k) for w in grid])]) < 0.03
    assert lm.mix_level(np.array([0, 1, 2, 3, 4, 10**9])).tolist() == [0, 1, 2, 2, 3, lm.MIX_LEVELS - 1]


def test_classes_are_distributions():
    net, _ = small_network()
    total = np.bincount(net.class_of, np.exp(net.inside.astype(float)))
    assert np.allclose(total[total > 0], 1, atol=1e-3)


def brute(rows, train):
    words = {i: [*(t or "").encode().lower().split(), None] for i, (_, t) in enumerate(rows)}
    counts = Counter(w for i in words if train[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws in words.values()]


def check(got, rows, want):
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, want, strict=True):
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3] and math.isclose(g.base_score, w[3], rel_tol=1e-9)
        assert math.isfinite(g.score) and g.score < 0


def test_odd_rows_and_shuffled_words(spark, docs):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "The the THE é É word"), (4, "rare  x   thing"), (5, "a b " * 20000), (6, "the end"), (7, "the end")]
    df = docs(rows).withColumn("score", F.lit("clash"))
    for top in (10**6, 0):
        got = {r.doc_id: r for r in lm.score(df, PATH, F.col("doc_id") != 6, top_words=top).collect()}
        check(got, rows, brute(rows, [i != 6 for i, _ in rows]))
    assert lm.score(docs([]), PATH, F.lit(True)).count() == 0
    assert lm.score(df, PATH, F.lit(False)).count() == len(rows)


def test_op3_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()]
    got = {r.doc_id: r for r in queries.op3_lm_score(spark, SF).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    check(got, rows, brute(rows, [not x for x in held]))
    out = [got[i] for (i, _), h in zip(rows, held, strict=True) if h]
    assert out and all(r.held_out for r in out)


def test_scores_of_held_out_texts_beat_word_frequencies(spark):
    out = [r for r in queries.op3_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_network_beats_subword_frequencies(spark):
    rows = [r.text for r in queries.documents(spark, SF).collect()]
    ids = [lm.ids_of(lm.words_of(t), PATH) for t in rows]
    size, begins = lm.subwords(PATH)[1:]
    trained, held = ids[: len(ids) * 4 // 5], ids[len(ids) * 4 // 5 :]
    net = lm.train(trained, size, begins)
    counts = np.bincount(np.concatenate(trained), minlength=size) + 0.05
    plain = sum(np.log(counts / counts.sum())[t].sum() for t in held)
    own = sum(float(x[:-1].sum()) for x, _ in net.score(held))
    assert own / sum(map(len, held)) > plain / sum(map(len, held)) + 0.3
