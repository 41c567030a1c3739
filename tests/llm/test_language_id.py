"""Held-out accuracy, and what rows without text, letters or labels get."""

import zlib

from kvframe.llm import language_id, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in queries.documents(spark, sf).collect()}
    got = queries.op5_language_id(spark, sf).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.95 * len(held)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "fr"), (3, "12 34 !?", "en"), (None, "the that of and", None), (7, "le la les des", "fr"), (7, "le la les des", "fr"), (8, "the of and that with", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language_id(df).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.lang_pred in ("en", "fr") for r in got if r.doc_id in (None, 7, 8))
    blank = language_id.language_id(spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in blank] == [("und", 0.0)]
    assert language_id.language_id(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
