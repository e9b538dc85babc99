"""The network, its classes and the mixture are learnt from all training texts; the driver holds a bounded number."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from chromaweave.llm import lm

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def small_network():
    size, begins = lm.subwords(PATH)[1:]
    texts = [lm.ids_of(lm.words_of(t), PATH) for t in ["the cat sat on the mat", "a dog and the cat", "ununhearable antidotes, here"] * 5]
    return lm.train(texts, size, begins), texts


def test_every_training_text_trains_once_and_the_driver_takes_few(spark, docs, monkeypatch):
    texts = [f"text {i} of the cat" for i in range(400)] + ["a copy"] * 30
    trained, started, train, by = [], [], lm.train, lm.trained_by

    def spy_train(texts, *a, **more):
        started.append(len(texts))
        return train(texts, *a, **more)

    def spy_by(network, docs, *a):
        trained.append([r.t for r in docs.collect()])
        return by(network, docs, *a)

    monkeypatch.setattr(lm, "train", spy_train)
    monkeypatch.setattr(lm, "trained_by", spy_by)
    # As if the share for the driver were that of a very large table.
    monkeypatch.setattr(lm, "sample_size", lambda rows, least: rows)
    lm.score(docs(texts), PATH, F.col("doc_id") != 7, sample_docs=50).count()
    assert sorted(t for part in trained for t in part) == sorted(t for i, t in enumerate(texts) if i != 7)
    assert len(trained) == lm.PARTS and all(trained) and started == [50]


def test_texts_that_the_driver_never_saw_train_the_network(spark, docs):
    size, begins = lm.subwords(PATH)[1:]
    texts = [" ".join(["so", "it", "goes", "on", f"w{i % 7}"] * 400) for i in range(60)]
    ids = [lm.ids_of(lm.words_of(t), PATH) for t in texts]
    totals = np.bincount(np.concatenate([np.append(x, size) for x in ids]), minlength=size + 1)
    near = lm.neighbours(ids, lm.common_subwords(totals), size)
    before = lm.train([], size, begins, totals=totals, near=near)
    after = lm.trained_by(before, docs(texts).select(F.col("doc_id").alias("place"), F.col("text").alias("t")), 2, 1.0, PATH)
    assert after.score_flat(ids[:3])[0].mean() > before.score_flat(ids[:3])[0].mean() + 0.05


def test_tasks_networks_are_averaged_by_what_they_read(spark, docs):
    net, _ = small_network()
    texts = ["the cat", "a dog and the cat sat", "ununhearable mat " * 9, "", None, "dog " * 40]
    rows = docs(texts).select(F.col("doc_id").alias("place"), F.col("text").alias("t"))
    got = lm.trained_by(net, rows, 3, 0.5, PATH)
    shard = {r.place: r.s for r in rows.select("place", F.pmod(F.xxhash64("place"), F.lit(3)).alias("s")).collect()}
    own = []
    for s in sorted(set(shard.values())):
        mine = lm.replace(net, p={k: w.copy() for k, w in net.p.items()})
        read = lm.train_on(mine, lm.Adam(mine.p), [lm.ids_of(lm.words_of(t), PATH) for i, t in enumerate(texts) if shard[i] == s], lm.SHARD_RATE * 0.5)
        own.append((mine.p, read))
    for name, w in net.p.items():
        by = [r[:, None] if name == "E" else r.sum() for _, r in own]
        want = w + sum((p[name] - w) * n for (p, _), n in zip(own, by, strict=True)) / np.maximum(sum(by), 1)
        assert np.allclose(got.p[name], want, atol=1e-6), name
    assert len(own) > 1 and any((got.p[k] != w).any() for k, w in net.p.items())
    again = lm.trained_by(net, rows.repartition(5), 3, 0.5, PATH)
    assert all((again.p[k] == w).all() for k, w in got.p.items())


def test_neighbours_are_those_of_all_training_texts(spark, docs):
    size = lm.subwords(PATH)[1]
    texts = ["the cat sat", "the the cat's end", None, "", "naïve 漢字 cat", "not this"] * 2
    ids = [lm.ids_of(lm.words_of(t), PATH) for t in texts if t != "not this"]
    stream = np.concatenate([np.append(x, size) for x in ids])
    common = lm.common_subwords(np.bincount(stream, minlength=size + 1))
    got = lm.all_neighbours(docs(texts), "text", F.col("text").isNull() | (F.col("text") != "not this"), common, size, PATH)
    assert (got == lm.neighbours([stream], common, size)).all() and got.sum() > 10


def test_mixture_weights_follow_from_counted_odds():
    rng = np.random.default_rng(5)
    network, frequency, levels = rng.normal(-6, 2, 3000), rng.normal(-7, 1, 3000), rng.integers(0, 4, 3000)
    table = np.zeros((lm.MIX_LEVELS, 2 * lm.ODDS * lm.ODDS_STEPS))
    np.add.at(table, (levels, lm.odds_bin(frequency - network)), 1)
    level, at = np.nonzero(table)
    got = lm.fit_mix(np.zeros(len(level)), (at + 0.5) / lm.ODDS_STEPS - lm.ODDS, level, times=table[level, at])
    assert np.abs(got - lm.fit_mix(network, frequency, levels)).max() < 1e-3
    assert lm.odds_bin(np.array([-1e9, 1e9])).tolist() == [0, 2 * lm.ODDS * lm.ODDS_STEPS - 1]
