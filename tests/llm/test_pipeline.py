"""Each stage against a brute-force version on what its predecessor kept."""

import math
import re
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers as P
from test_byte_bpe import library
from test_jaccard import brute as alike
from test_mixing import brute as copies

from kvframe.llm import queries, quality_classifier, simhash, substring_dedup


def without_repeats(rows, window=50):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in rows}
    first, out = {}, {}
    for d in sorted(words):
        for a in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][a : a + window]), d)
    for d, t in rows:
        gone = set()
        for a in range(len(words[d]) - window + 1):
            if first[tuple(words[d][a : a + window])] < d:
                gone |= set(range(a, a + window))
        out[d] = " ".join(w for j, w in enumerate(words[d]) if j not in gone) if gone else t
    return out


def test_stages(spark, tmp_path):
    sf, docs, held = "/root/testdata/sf0.001", None, []
    docs = queries.documents(spark, sf)
    held.append(docs.collect())
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held.append(docs.collect())
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
    start, good, single, cut, mixed, last = held
    verdict = {r.doc_id: r.kept for r in quality_classifier.quality_classifier(queries.documents(spark, sf)).collect()}
    assert sorted(good) == sorted(r for r in start if verdict[r.doc_id]) and 0 < len(good) < len(start)
    heads = set(alike([(r.doc_id, r.text) for r in good]))  # stages take five words and a similarity of 0.8
    assert sorted(single) == sorted(r for r in good if r.doc_id in heads)
    texts = without_repeats([(r.doc_id, r.text) for r in single])
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in cut) == sorted((r.doc_id, texts[r.doc_id], r.lang, r.source, len(texts[r.doc_id])) for r in single)
    n = Counter(r.source for r in cut)
    want = Counter()
    for r in cut:
        want[r] = copies(r.doc_id, r.text, 1 / len(n) * len(cut) / n[r.source])
    assert Counter(mixed) == +want and math.isclose(len(mixed), len(cut), rel_tol=0.3)
    lib = library()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in last) == Counter((r.doc_id, len(ids := lib.encode_ordinary(r.text)), tuple(ids), r.text) for r in mixed)
    assert P.PATTERN
    whole = pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole) == Counter((r.doc_id, tuple(r.ids)) for r in last)


def test_repeated_and_null_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    passage = " ".join(f"word{k}" for k in range(70))
    rows = [(1, passage, "en", "a", 1), (1, passage, "en", "a", 1), (None, passage, None, None, None), (None, "other text", "en", "b", 2), (2, "x " + passage + " y", "en", "a", 3), (3, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, kind)
    kept = simhash.keep_one(df).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) in (sorted([(1, passage), (None, "other text"), (3, None)], key=str), sorted([(1, passage), (None, "other text"), (2, "x " + passage + " y"), (3, None)], key=str))
    got = sorted(((r.doc_id, r.text, r.source) for r in substring_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, passage, "a"), (1, passage, "a"), (None, "", None), (None, "other text", "b"), (2, "x y", "a"), (3, None, "a")], key=str)
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], kind), "").collect() == []
