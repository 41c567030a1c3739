"""Against a plain inversion, the SQL, and the shares asked for."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from kvframe.llm import mixing, queries


def brute(doc_id, text, mean, seed=42):
    ident = f"{doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
    parts, total = max(1, math.ceil(mean / 16)), 0
    for j in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}:{ident}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-mean / parts)
        c = p
        while u > c:
            k += 1
            p *= mean / parts / k
            c += p
        total += k
    return total


def test_copies_and_shares(spark):
    rows = [(i, f"t{i}", "ab"[i % 9 == 0]) for i in range(900)] + [(1000 + i, "", None) for i in range(3)] + [(None, "n", "a"), (1, "t1", "b")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, copy int")
    weights, size = {"a": 1.0, "b": 2.0, None: 1.0, "nowhere": 0.0}, 2000
    got = mixing.mix_sources(docs, weights, size).collect()
    n = Counter(r[2] for r in rows)
    want = Counter()
    for d, t, s in rows:
        want[d, t, s] += brute("null" if d is None else d, t, weights[s] / 4 * size / n[s])
    assert Counter((r.doc_id, r.text, r.source) for r in got) == +want
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys)
    share = Counter(r.source for r in got)
    assert abs(share["b"] / len(got) - 0.5) < 0.05 and max(r.copies for r in got) > 16 * 8


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).collect() == []
    one = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], docs.schema)
    assert {r.source for r in mixing.mix_sources(one, {"a": 1}, 40).collect()} == {"a"}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    got = sorted(map(tuple, queries.op9_mixing(spark, f"/root/testdata/{sf}").collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    assert got == sorted(db.sql(queries.ORACLE_SQL["op9_mixing"]).fetchall())


def test_one_document_that_comes_often(spark):
    rows = [(1, "often", "a"), *[(k, f"t{k}", "b") for k in range(2, 40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs, {"a": 100.0, "b": 1.0}, 101_000)
    got = found.select("doc_id", "copy", "copies").collect()
    assert sum(r.doc_id == 1 for r in got) == brute(1, "often", 100_000) > 99_000
    assert {r.copy for r in got if r.doc_id == 1} == set(range(1, brute(1, "often", 100_000) + 1))
    assert {r.copies for r in got if r.doc_id == 1} == {brute(1, "often", 100_000)}
    sizes = [len(x) for x in found.select("doc_id").rdd.glom().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    runs = mixing._dealt(docs.where("doc_id = 1").selectExpr("*", "'42:1:x' AS __ident", "6250 AS __parts", "array(0.5D) AS __chances"), docs.columns, 8, mixing.Scratch(spark, "test"))
    assert sum(n > 0 for n in map(len, runs.rdd.glom().collect())) > 4


def test_sizes_of_frames_without_files(spark):
    from kvframe.llm.shared import input_bytes

    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert input_bytes(frame) < 1 << 20
    assert input_bytes(files.join(files.select("doc_id"), "doc_id").join(frame.select("doc_id"), "doc_id")) < 10 << 20
