import random

from pyspark.sql import functions as F

from chromaweave.llm import linededup, queries
from chromaweave.llm.components import components

SF = "/root/testdata/sf0.001"


def shingles(line, n=linededup.SHINGLE):
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def brute(rows):
    """rows: (order, text) in order; kept line numbers of each."""
    places, firsts = [], {}
    for d, (_, text) in enumerate(rows):
        for i, raw in enumerate(text.split("\n") if text is not None else []):
            line = raw.replace("\r", "").strip(" ")
            if line:
                places.append((d, i, line))
                firsts.setdefault(line, (d, i))
    lines = list(firsts)
    sets = [shingles(x) for x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = {firsts[lines[find(i)]] for i in range(len(lines))}
    numbers = {x: i for i, x in enumerate(lines)}
    drop = {(d, i) for d, i, line in places if (d, i) not in kept or firsts[lines[find(numbers[line])]] != (d, i)}
    return [None if t is None else [i for i in range(len(t.split("\n"))) if (d, i) not in drop] for d, (_, t) in enumerate(rows)]


def test_components(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(300):03}", f"n{r.randrange(300):03}") for _ in range(220)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("x", "x"), (None, "y")]
    given = spark.createDataFrame(edges, "a string, b string")
    ways = [{}, {"part": 20}, {"part": 20, "broadcast_rows": 0}]
    got, *others = ({x.node: x.root for x in components(given, **k).collect()} for k in ways)
    assert all(x == got for x in others)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert got == {x: find(x) for x in root}


def test_matches_brute_force(spark, docs):
    r = random.Random(4)
    base = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(3, 60))) for _ in range(40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(1, 5)):
            x = r.choice(base)
            if r.random() < 0.5:
                at = r.randrange(len(x))
                x = x[:at] + "Z" + x[at + 1 :]
            lines.append(x + r.choice(["", "\r", " "]))
        rows.append((i, "\n".join(lines + r.choice([[], [""], ["short"]]))))
    long = "lorem ipsum é\U0001d518 dolor " * 400
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, long + "A"), (204, long + "B\nother line here"), (205, rows[3][1]), (206, rows[3][1])]
    got = linededup.dedup_lines(docs(rows).withColumns({c: F.lit("clash") for c in ("_at", "_file", "drop", "_drop", "key", "kept")}), kept="kept").orderBy("doc_id").collect()
    want = brute(rows)
    wrong = [i for i, (g, w) in enumerate(zip(got, want, strict=True)) if g.kept != w]
    assert len(wrong) <= 0.03 * len(rows), [(rows[i], got[i].kept, want[i]) for i in wrong[:3]]
    assert got[120].text is None and [g.text for g in got[121:123]] == ["", "\n\n"] and got[-1].text == ""


def test_empty_and_null_ids(spark, docs):
    assert linededup.dedup_lines(docs([])).count() == 0
    rows = [(None, "the very same line\nxx"), (5, "the very same line\nyy"), (5, "the very same line\nyy")]
    got = sorted((str(r.doc_id), r.text) for r in linededup.dedup_lines(docs(rows)).collect())
    assert got == [("5", ""), ("5", "the very same line\nyy"), ("None", "xx")]


def test_columns_with_the_names_used_inside_stay(spark, docs):
    names = ["_at", "_file", "drop", "_drop", "_stay", "key", "file", "at", "order"]
    got = linededup.dedup_lines(docs(["one line of text", "one line of text"]).withColumns({c: F.lit(c) for c in names}))
    assert got.columns[-len(names) :] == names
    assert all(r[c] == c for r in got.collect() for c in names)


def test_shuffled_tables_give_the_same(spark, docs):
    r = random.Random(6)
    base = ["".join(r.choice("abcdef ") for _ in range(60)) for _ in range(12)]
    rows = [(i, "\n".join(x[:at] + "Z" + x[at + 1 :] if (at := r.randrange(80)) < 60 else x for x in r.sample(base, 3))) for i in range(60)]
    got = [sorted((x.doc_id, x.text) for x in linededup.dedup_lines(docs(rows), **k).collect()) for k in ({}, {"broadcast_rows": 0}, {"task_elements": 100})]
    assert got[0] == got[1] == got[2]


def test_signing_in_blocks(monkeypatch):
    lines = ["x", "abcdefghi", "é\U0001d518" * 3, *("".join(random.Random(i).choices("abc ", k=40 + 17 * i)) for i in range(30))]
    want = linededup.sign(lines)
    monkeypatch.setattr(linededup, "BLOCK", 32)
    assert (linededup.sign(lines) == want).all()
    assert all(len(linededup.shingle_hashes(x)) == len(shingles(x)) for x in lines)
    for k, x in enumerate(lines):
        h = linededup._runs(linededup._points(x.ljust(9, "\0")), 9)
        assert (want[k] == [(h ^ t).min() for t in linededup._TURNS]).all()


def test_op4_recall_on_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in queries.documents(spark, SF).collect())
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    got = {r.doc_id: [int(x) for x in r.kept_lines.split(",") if x] for r in queries.op4_line_dedup(spark, SF).collect()}
    assert got.keys() == want.keys()
    wrong = sum(len(set(got[i]) ^ set(want[i])) for i in want)
    assert wrong <= 0.005 * sum(map(len, want.values()))
