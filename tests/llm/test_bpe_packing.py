import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaweave.llm import bpe, packing, queries

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "it's we'll  they'RE 'tis", "x" * 5000 + "  \t y", "日本語 ́é \U0001d518", "a" * 70 + "é" * 70, "tie", "tie"]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_random_texts_match_the_library(tik):
    own, r = bpe.ByteBPE(RANKS, cache_pieces=50), random.Random(7)
    letters = " '  \n\t stmdrevlaé1２!?中"
    for _ in range(3000):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        ids = own.encode(x)
        assert ids == tik.encode_ordinary(x), x
        assert own.decode(ids).decode() == x
        assert own.offsets(np.array(ids, np.int64)).tolist() == [len(own.decode(ids[:i])) for i in range(len(ids))]


def test_every_code_point_splits_alike(tik):
    own = bpe.ByteBPE(RANKS)
    for c in range(0, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            x = f"a{chr(c)}1{chr(c)}!{chr(c)}"
            assert own.encode(x) == tik.encode_ordinary(x), hex(c)


def test_encode_decode_tables(spark, docs, tik):
    df = docs([(i, t) for i, t in enumerate(ODD)]).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, RANKS), RANKS).orderBy("doc_id").collect()
    assert [r.ids for r in out] == [tik.encode_ordinary(t or "") for t in ODD]
    assert [bytes(r.decoded).decode() for r in out] == [t or "" for t in ODD]
    assert bpe.encode(docs([]), RANKS).count() == 0
    holes = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "k int, ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in bpe.decode(holes, RANKS).orderBy("k").collect()] in ([None, bytearray(), b'!"'], [None, b"", b'!"'])


def test_op8_whole_table(spark, tik):
    got = {r.doc_id: r for r in queries.op8_byte_bpe(spark, SF).collect()}
    rows = queries.documents(spark, SF).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = tik.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def whole(pieces):
    """Checks the layout; gives each document's ids."""
    docs, seqs = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length > 0
        docs.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    sizes = {}
    for k, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        sizes[k] = at
    assert sorted(sizes) == list(range(len(sizes)))
    return docs, sizes


@pytest.mark.parametrize("length", [4, 64, 2048])
def test_pack_is_gapless(spark, docs, length):
    hf = Tokenizer.from_file(JSON)
    rows = [(i, t) for i, t in enumerate(ODD)]
    found, sizes = whole(packing.pack(docs(rows), JSON, length=length).collect())
    for i, t in rows:
        ids, at = [], 0
        for start, part, n in sorted(found[i], key=lambda x: x[0]):
            assert start == at
            at += len(part)
            ids += part.tolist()
        assert ids == hf.encode(t or "", add_special_tokens=False).ids + [1] and at == n
    assert all(n == length or n & (n - 1) == 0 for n in sizes.values())


def test_pack_repeats_nulls_and_empty(spark, docs):
    assert packing.pack(docs([]), JSON).count() == 0
    out = packing.pack(docs([(None, "a b"), (None, "a b"), (1, None)]), JSON, length=2).collect()
    assert sum(p.length for p in out) == 7
    with pytest.raises(ValueError):
        packing.pack(docs(["a"]).withColumn("ids", F.lit(1)), JSON, keep=("doc_id", "ids"))


def test_op9_whole_table(spark):
    hf = Tokenizer.from_file(JSON)
    out = queries.op9_pack_sequences(spark, SF).collect()
    ids = {r.doc_id: np.array(hf.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in queries.documents(spark, SF).collect()}
    covered = dict.fromkeys(ids, 0)
    for p in out:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += p.length
    assert covered == {k: len(v) for k, v in ids.items()}
