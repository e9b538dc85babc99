"""Alignment of two tokenizers against a plain version: whole texts, byte by byte."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chromaweave.llm import crossalign
from chromaweave.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain(rows):
    """(doc_id, ...) of (doc_id, text) rows, with the tokenizers' own libraries."""
    hf, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    hf.encode_special_tokens = True
    stand_in = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    stand_in |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(stand_in.values()))}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    done = []
    for doc_id, text in rows:
        a = hf.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(stand_in[c] for c in hf.id_to_token(i)) for i in a]
        bytes_b = [piece(i) for i in b]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a = b = bytes_a = bytes_b = []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        place_a, place_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = place_a[e] + 1, place_b[e] + 1
            groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
            i, j = p, q
        # Who owns each byte on either side; tokens overlap where they own a byte together.
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = [(a[x], b[y]) for x, y in dict.fromkeys(zip(owner_a, owner_b, strict=True))]
        done.append((doc_id, len(a), len(b), len(groups), ";".join(groups), links))
    held = Counter(p for d in done for p in set(d[5]))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return {(d[0], *d[1:4], len(d[5]), sum(held[p] == most[p[0]] for p in d[5]), sum(held[p] for p in d[5]), d[4]) for d in done}


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

ODD = [
    None, "", " ", "a", "  a  b ", "a\nb \n c", "x▁y stays out", "▁", "naïve café 日本語 text", "👩‍🚀 rocket", "<|endoftext|> is text", "<s> </s> <unk> <0x41> <0x0A>",
    "don't can't we'll", "\x00 nul \x00x", "a\x1cb \x1c c", "tab\tand nbsp here　wide", "ﬁ ligature é", "word " * 300, "x" * 3000, "1234567890 3.14159", "a\r\nb\r\n\r\nc", " lead", "trail ",
]


def test_equals_the_plain_version_on_odd_texts(spark, docs):
    out = crossalign.align(docs(ODD + ODD[:10]), A, B)
    assert out.columns == COLUMNS
    got = {tuple(r) for r in out.collect()}
    assert got == plain([(i, t) for i, t in enumerate(ODD + ODD[:10])])


def test_blocks_of_any_size_say_the_same(spark, docs, monkeypatch):
    want = {tuple(r) for r in crossalign.align(docs(ODD), A, B).collect()}
    known = crossalign.Known(crossalign.tokenizers(A, B))
    parts = []
    monkeypatch.setattr(crossalign, "KEPT_CHARS", 5)
    for t in ODD:
        parts.append(crossalign.align_block(known, [t], digest=False))
    for i, p in enumerate(parts):
        (mine,) = [w for w in want if w[0] == i]
        assert (p["n_a"][0], p["n_b"][0], p["n_groups"][0], p["n_links"][0], p["groups"][0]) == (*mine[1:5], mine[7])
        assert p["mult"].sum() == mine[4] and (p["df"] == 1).all() and (np.diff(p["pair"]) > 0).all()


def test_whole_query_equals_the_plain_version(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    got = {tuple(r) for r in QUERIES["op13_cross_align"](spark, SF).select(*COLUMNS[:-1], "groups_sha256").collect()}
    want = plain(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    assert got == {(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want}


def test_empty_tables_extra_and_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    assert crossalign.align(docs(["a"]).where("false"), A, B).count() == 0
    assert crossalign.align(docs([None, ""]), A, B).select("n_links", "groups").distinct().collect() == [(0, "")]
    odd = docs(["one two", "three"]).withColumns({"block": F.lit("b"), "_text": F.lit(7), "n_a": F.lit(-1)})
    out = crossalign.align(odd, A, B, keep=("doc_id", "block", "_text"))
    assert {(r.doc_id, r.block, r["_text"], r.n_b) for r in out.collect()} == {(0, "b", 7, 2), (1, "b", 7, 1)}
    with pytest.raises(ValueError, match="names of new"):
        crossalign.align(odd, A, B, keep=("doc_id", "n_a"))


def test_stabbing_and_gaps():
    a, b = [(0, 4), (4, 5), (5, 9)], [(0, 2), (2, 5), (5, 6), (6, 9)]
    lo, hi = crossalign.stab(*np.array(a).T, *np.array(b).T)
    assert list(zip(lo, hi, strict=True)) == [(0, 2), (1, 2), (2, 4)]
    assert crossalign.unspanned(lo, hi, 4).tolist() == [False, True, False, True]
