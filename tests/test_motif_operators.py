"""Motif generation, shuffles, text, and guards that the catalogue does not run."""

from itertools import product
from math import log2

import pytest
from pyspark.sql import functions as F

from chromaweave.functions import scalars
from chromaweave.operators import graph, motifs, sequences


def test_emitted_words_follow_the_motif_and_repeat(spark):
    m = motifs.from_text(spark, {"a": "WANG", "b": "TT"})
    got = motifs.emit(m, 400, seed=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, motifs.emit(m, 400, seed=3).collect()))
    a = [r.word for r in got if r.motif == "a"]
    assert len(a) == 400 and all(w[0] in "AT" and w[1] == "A" and w[3] == "G" for w in a)
    for x in "ACGT":
        assert 60 < sum(w[2] == x for w in a) < 140
    assert {r.word for r in got if r.motif == "b"} == {"TT"}


def test_shuffled_positions_are_a_permutation(spark):
    m = motifs.from_text(spark, {"a": "ACGTNW"})
    columns = lambda df: {p: tuple(sorted((r.letter, r.p) for r in rows)) for p, rows in _by_pos(df).items()}
    before, after = columns(m), columns(motifs.shuffle_positions(m, 1))
    assert sorted(before) == sorted(after) and sorted(before.values()) == sorted(after.values())


def _by_pos(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.pos, []).append(r)
    return out


def test_merged_motifs_average_their_overlap(spark):
    a, b = motifs.from_text(spark, {"a": "AC"}), motifs.from_text(spark, {"b": "GT"})
    got = {(r.pos, r.letter): r.p for r in motifs.merged(a, b, 1, "ab").collect()}
    assert got[0, "A"] == 1 and got[1, "C"] == got[1, "G"] == 0.5 and got[2, "T"] == 1 and len({p for p, _ in got}) == 3


def test_best_words_equal_all_words(spark):
    m = motifs.from_text(spark, {"x": "WAN", "y": "GATR"}).withColumn("p", (F.col("p") + 0.05) / 1.2).withColumn("ll", F.log2("p") + 2)
    ll = {(r.motif, r.pos, r.letter): r.ll for r in m.collect()}
    want = {(k, "".join(w)) for k, n in (("x", 3), ("y", 4)) for w in product("ACGT", repeat=n) if sum(ll[k, i, c] for i, c in enumerate(w)) > 1.0}
    got = motifs.best_words(m, 1.0).collect()
    assert {(r.motif, r.word) for r in got} == want and len(got) == len(want)
    assert motifs.best_words(m.where("false"), 1.0).count() == 0


def test_rows_and_summary(spark):
    m = motifs.from_text(spark, {"a": "AC"})
    assert [r.p["A"] for r in motifs.as_rows(m).orderBy("pos").collect()] == [1.0, 0.0]
    assert motifs.summary(m).first().line.startswith("AC width=2 bits=4.000 max=4.000")


def test_window_scores_skip_what_has_none(spark):
    m = motifs.from_text(spark, {"a": "NC"})
    seqs = spark.createDataFrame([("a", "ACGG"), ("a", "ACGG"), ("a", "A"), ("a", "AN"), ("a", ""), ("b", "AC")], "motif string, seq string")
    assert [(r.seq, r.score) for r in motifs.window_scores(seqs, m).collect()] == [("ACGG", log2(0.25) + 2 + 2)] * 2


def test_split_is_exact(spark):
    rows = spark.range(101).withColumnRenamed("id", "k")
    for fraction, n in ((0.0, 0), (0.25, 25), (1.0, 101)):
        got = sequences.random_split(rows, "k", fraction)
        assert got.where("part = 0").count() == n and got.count() == 101
    assert sequences.random_split(rows.where("false"), "k", 0.5).count() == 0


def test_prizes_outside_the_network_are_guarded(spark):
    edges = spark.createDataFrame([("a", "b", 0.5, "U")], "src string, dst string, weight double, dir string")
    prizes = lambda names: spark.createDataFrame([(n, 1.0) for n in names], "node string, prize double")
    assert graph.guarded_prizes(prizes("axyz"), edges).count() == 1
    with pytest.raises(ValueError):
        graph.guarded_prizes(prizes("xyz"), edges)
    assert graph.guarded_prizes(prizes("a").where("false"), edges).count() == 0


def test_affinity_of_rows_equals_affinity_of_lists(spark):
    rows = spark.createDataFrame([(g, (i * 7 % 10) / 10) for g in range(3) for i in range(5 + g)], "g int, x double")
    got = rows.groupBy("g").agg(scalars.affinity(F.collect_list("x"), 0.5, 0.5, 3.0).alias("a"), scalars.affinity_of_rows(F.col("x"), 0.5, 0.5, 3.0).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b, rel=1e-12) for r in got)
