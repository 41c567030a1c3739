"""Against a brute-force version."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kvframe.llm import queries, suffix_dedup


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[a : a + length] for r in raws for a in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for a in range(len(r) - length + 1):
            if count[r[a : a + length]] > 1:
                gone[a : a + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=str)


def make_rows(rng, letters, length, docs):
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [piece(rng.choice([length - 1, length, length + 1, 2 * length, 150, 10 * length])) for _ in range(10)]
    rows = []
    for d in range(6, docs):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = rng.choice("xyz")
            parts += [piece(rng.randint(0, 60)), "".join(p)]
        rows.append((d, "".join(parts)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(8)
    for length in (24, 40, 100):
        rows = [(0, None), (1, ""), (2, "a" * 39), (3, "a" * 200), (4, "ab" * 60), (None, "ab" * 25), (5, "x"), *make_rows(rng, "abcdefé \n", length, 70)]
        rows += [rows[20], (70, rows[21][1])]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert digest(suffix_dedup.suffix_dedup(df, length)) == brute(rows, length)


def test_edges(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert suffix_dedup.anchor_places(np.array([5, 3, 3, 9, 1], np.uint64) << np.uint64(40), 3).tolist() == [1, 1, 4]


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    assert sorted(map(tuple, queries.op6_suffix_array_dedup(spark, sf).collect()), key=str) == brute(rows, 400)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(db.sql(queries.ORACLE_SQL["op6_suffix_array_dedup"]).fetchall(), key=str) == brute(rows, 400)


def doubled_ranks(spark, texts, length):
    """For each round the bytes and ranks of the suffixes that share their first bytes, from all texts as one open stretch each."""
    ladder = suffix_dedup.Ladder(length)
    spans = lambda n: np.array([0, n - length], np.int32).tobytes()
    rows = [(k, k, t, bytearray(spans(len(t)))) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key_id long, key_text long, text string, spans binary").repartition(3)
    held = suffix_dedup.Scratch(spark, "test").keep(df.mapInArrow(suffix_dedup.regions(ladder), suffix_dedup._REGIONS), "regions")
    columns, width = -(-ladder.grid // 8), ladder.grid
    bodies = {r.block: bytes(r.body) for r in held.collect()}
    while width <= ladder.top:
        back = suffix_dedup.ranked(held, columns).toArrow()
        found = []
        for r in held.toArrow().to_pylist():
            own = back.filter(pc.equal(back.column("block"), r["block"]))
            places, ranks = suffix_dedup.answered(pa.Table.from_pylist([r]), own)
            found += [(bodies[r["block"]][a : a + width], int(k)) for a, k in zip(places.tolist(), ranks.tolist(), strict=True)]
        yield width, found
        held = held.select("block", "state").groupBy("block").cogroup(suffix_dedup.ranked(held, columns).groupBy("block")).applyInArrow(suffix_dedup.next_round(width), suffix_dedup._STATE)
        columns, width = 2, 2 * width


def test_ranks_order_suffixes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE_PAIRS", 20)
    rng = random.Random(6)
    base = "".join(rng.choice("ab") for _ in range(300))
    texts = [base, "xyz" + base[:200], base[37:290], "ab" * 90, base[5:130] + "q" + base[131:]]
    rounds = dict(doubled_ranks(spark, texts, 48))
    assert sorted(rounds) == [4, 8, 16, 32]
    for found in rounds.values():
        assert len(found) > 20
        order = sorted(set(found))
        assert [k for _, k in order] == sorted({k for _, k in found})  # a rank for each string, in their order
        assert min(Counter(x for x, _ in found).values()) > 1  # what occurs once has dropped out


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE_PAIRS", 50)
    rng = random.Random(9)
    rows = make_rows(rng, "abc", 60, 90)
    assert digest(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 60)) == brute(rows, 60)


def test_verdicts_in_any_order_of_rows(spark, monkeypatch):
    """Of equal covers in several blocks one stands for all, which must be one whose own starts go on, not one that another stretch's grid passes by chance."""
    plain = suffix_dedup.verdicts

    def backwards(core):
        judge = plain(core)
        return lambda bucket, rows, several: judge(bucket, [x[::-1] for x in rows], several[::-1])[::-1]

    monkeypatch.setattr(suffix_dedup, "verdicts", backwards)
    rng = random.Random(0)
    piece = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    base, rows = [piece(192) for _ in range(10)], []
    for d in range(400):
        parts = [piece(rng.randint(0, 48))]
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(0, 96)
            parts += [rng.choice(base)[at : at + rng.randint(46, 96)], piece(rng.choice([0, 1, 2, 48]))]
        rows.append((d, "".join(parts)))
    rows += [(d, rows[rng.randrange(400)][1]) for d in range(400, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)  # a block each
    assert digest(suffix_dedup.suffix_dedup(df, 48)) == brute(rows, 48)


def test_strings_that_polynomial_hashes_confuse(spark):
    from test_quality_rules import thue_morse

    a, b = thue_morse(4096)
    rows = [(1, "p" * 300 + a + "q" * 300), (2, "r" * 300 + b + "s" * 300), (3, a[:700])]
    for length in (400, 680):
        assert digest(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length)) == brute(rows, length)


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, long[:500]), (2, long + long[:5000] + "\0" * 3000)]
    df = spark.createDataFrame([(*r, 1, b"x", "y") for r in rows], "doc_id long, text string, n_bytes int, spans binary, state string")
    assert digest(suffix_dedup.suffix_dedup(df)) == brute(rows, 400)
