"""Against the tiktoken library, and an exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from kvframe.llm import byte_bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library():
    rng = random.Random(2)
    own, lib = byte_bpe.codec(PATH, P.PATTERN), library()
    texts = ["", " ", "\n\n  a", "it's they'll <|endoftext|>", "a" * 3000, "ab" * 777 + "é" * 500, "日本語 テキスト", "x" * 33 + " " * 70 + "y"]
    texts += ["".join(rng.choice("abcdeé ñ 'st1,\n　😀") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    for _ in range(2):  # the second time from the cache
        for t, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == lib.encode_ordinary(t)
            assert own.decode(ids).decode() == t


def test_rows(spark):
    rows = [(1, None, "z"), (None, "", "z"), (2, "Hello  world", "z"), (2, "Hello  world", "z")]
    got = byte_bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in got) == [(0, 0, ""), (1, 0, ""), (2, 3, "Hello  world"), (2, 3, "Hello  world")]
    assert byte_bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_query_on_table(spark):
    sf, lib = "/root/testdata/sf0.001", library()
    want = []
    for r in queries.documents(spark, sf).collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op8_byte_bpe(spark, sf).collect())) == sorted(want)
