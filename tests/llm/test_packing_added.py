import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from chromaweave.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_in_texts_match_the_library(spark, docs):
    hf = Tokenizer.from_file(JSON)
    end = "<|endoftext|>"
    texts = [end, f"one{end}two", f"one {end} two", f"{end}{end}  \n{end}", f"  {end}\n\n x{end}", "<|endoftext|", "<|ENDOFTEXT|>", f"é{end}日本 it's{end}'s"]
    out = packing.pack(docs(texts), JSON).orderBy("doc_id", "start").collect()
    for i, t in enumerate(texts):
        ids = [int(x) for p in out if p.doc_id == i for x in np.frombuffer(bytes(p.ids), "<u4")]
        assert ids == hf.encode(t, add_special_tokens=False).ids + [1], t
