"""Line deduplication against brute force over all character runs, in cases where a cheaper rule fails."""

import random

from chromaweave.llm import linededup


def runs(line, n=9):
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def jaccard(a, b):
    return len(runs(a) & runs(b)) / len(runs(a) | runs(b))


def kept(lines, docs):
    rows = linededup.dedup_lines(docs(list(enumerate(lines))), kept="kept").collect()
    return {r.doc_id for r in rows if r.kept}


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(8))


def test_all_members_of_large_buckets_are_compared(spark, docs):
    # Copies of a template of median similarity about 0.6; each second one has one near partner.
    r = random.Random(5)
    template = [word(r) for _ in range(24)]
    lines = []
    for _ in range(250):
        own = [word(r) if i % 6 == 2 else w for i, w in enumerate(template)]
        lines += [" ".join(own), " ".join([*own[:-1], word(r)])]
    assert 0.5 < jaccard(lines[0], lines[2]) < 0.75 and jaccard(lines[0], lines[1]) > 0.85
    assert len(kept(lines, docs) ^ set(range(0, 500, 2))) <= 3


def test_what_follows_the_first_letters_of_words_counts(spark, docs):
    sessions = [f"username={u} location={c} sessionid={s} timestamp={t} requestid={q} operation={o}" for u, c, s, t, q, o in (("alice", "paris", "abc1", 1001, 77, "get"), ("robert", "oslo", "xyz9", 2417, 31, "delete"))]
    stems = ["electroen", "counterre", "internati", "interdisc", "photosynt", "transcont", "misunders", "overwhelm"]
    longer = [" ".join(s + e for s, e in zip(stems, ends, strict=True)) for ends in (["cephalogram", "volutionary", "onalisation", "iplinarity", "hetically", "inentally", "tandings", "ingness"], ["qqqqqqqq", "wwwwwwww", "eeeeeeee", "rrrrrrrr", "tttttttt", "yyyyyyyy", "uuuuuuuu", "iiiiiiii"])]
    lines = sessions + longer
    assert all(len(x) >= 64 for x in lines) and max(jaccard(lines[0], lines[1]), jaccard(lines[2], lines[3])) < 0.8
    assert kept(lines, docs) == {0, 1, 2, 3}


def test_long_lines_are_signed_by_all_shingles(spark, docs):
    # Near lines on both sides of 240 code points, and long ones of very few shingles.
    r = random.Random(8)
    lines = []
    for _ in range(60):
        x = " ".join(word(r) for _ in range(26))
        lines += [x + "z", x + "z " + word(r)]
        assert len(lines[-2]) < 240 <= len(lines[-1])
    for _ in range(60):
        x = word(r)[:5] * 60
        lines += [x, x + x[:5]]
    assert len(kept(lines, docs) ^ set(range(0, len(lines), 2))) <= 1


def test_bands_of_the_same_lines_are_compared_once(spark, docs, monkeypatch):
    seen, band_links = [], linededup._band_links

    def spy(placed, *more):
        seen.extend(r.key for r in placed.select("key").collect())
        return band_links(placed, *more)

    monkeypatch.setattr(linededup, "_band_links", spy)
    r = random.Random(12)
    x = " ".join(word(r) for _ in range(40))
    assert kept([x, x[:-1] + "z"], docs) == {0}
    assert len(seen) == 2
