"""Against a brute-force version, with the planted cases small texts allow."""

import hashlib
import random
import re

import duckdb

from kvframe.llm import queries, substring_dedup


def brute(rows, window=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, t) in enumerate(rows)}
    first = {}
    for i, (d, _) in enumerate(rows):
        for a in range(len(words[i]) - window + 1):
            key = tuple(words[i][a : a + window])
            first[key] = min(first.get(key, 1 << 62), d)
    out = []
    for i, (d, _) in enumerate(rows):
        gone = set()
        for a in range(len(words[i]) - window + 1):
            if first[tuple(words[i][a : a + window])] < d:
                gone |= set(range(a, a + window))
        kept = " ".join(w for j, w in enumerate(words[i]) if j not in gone)
        out.append((d, len(words[i]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def digest(df):
    texts = substring_dedup.substring_dedup(df).collect()
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in texts)


def cases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.choice([49, 50, 51, 74, 75, 130]))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "x"), (4, "a " * 120)]
    for d in range(5, 90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            passage = list(rng.choice(base))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = word()
            parts += [word() for _ in range(rng.randint(0, 30))] + passage
        rows.append((d, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(90, rows[20][1]), (91, rows[20][1]), (91, rows[20][1]), (92, "b " * 400), (93, "b " * 90)]


def test_against_brute_force(spark):
    rows = cases()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digest(df) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(df).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    clash = spark.createDataFrame([(None, long, 1, b"x"), (7, long, 2, b"y"), (8, None, 3, None)], "doc_id long, text string, key_id int, spans binary")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(clash).collect()}
    assert got == {None: 60, 7: 0, 8: 0}


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op2_substring_dedup(spark, sf).collect())) == brute(rows)
    assert sorted(against_sql(sf)) == brute(rows)


def against_sql(sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return db.sql(queries.ORACLE_SQL["op2_substring_dedup"]).fetchall()


def test_words_that_polynomial_hashes_confuse(spark):
    from test_quality_rules import thue_morse

    rows, d = [], 0
    for n, letters in ((1024, "!a"), (2048, "ab")):
        for odd in thue_morse(n, *letters):
            rows.append((d := d + 1, " ".join([f"w{n}{k}" for k in range(30)] + [odd] + [f"v{n}{k}" for k in range(29)])))
    rows.append((9, "x " + rows[0][1]))
    got = digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and [r[2] for r in got] == [0, 0, 0, 0, 60]


def test_very_long_text(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(80))
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(300_000))
    rows = [(1, passage), (2, long + " " + passage + " " + long[:9000])]
    assert digest(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
