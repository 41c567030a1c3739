"""Against brute force on small texts."""

import random
import re

import duckdb
import numpy as np

from kvframe.llm import quality_rules, queries


def brute(t, least=quality_rules.LEAST):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, lines, dups, seen = len(words), t.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    count, again = {}, set()
    for i in range(n - 2):
        count.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in count.values():
        if len(at) > 1:
            again |= {i + k for i in at for k in range(3)}
    longest, cover, places = 0, set(), {}
    for i in range(n - least + 1):
        places.setdefault(tuple(words[i : i + least]), []).append(i)
    for at in places.values():
        for i in at if len(at) > 1 else []:
            best = max(next((k for k in range(n) if max(i, j) + k == n or words[i + k] != words[j + k]), n) for j in at if j != i)
            longest = max(longest, best)
            cover |= set(range(i, i + best))
    failed = n < 50 or 100 * len(again) > 50 * n
    kept = not failed and len(cover) <= quality_rules.MOST_COVERED * n and longest <= quality_rules.MOST_REPEAT
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(again), failed, kept, len(cover), longest)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abé#") for _ in range(rng.randint(1, k)))
    rows = [(0, None), (1, ""), (2, " \n \n"), (3, "a " * 90), (4, "a b\na b\n\na b \n\x0b"), (None, "x|y " * 3)]
    for d in range(5, 120):
        words = [word(rng.choice([1, 3, 6])) for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(0, 3)):
            a, k, b = rng.randrange(len(words)), rng.randint(1, 40), rng.randrange(len(words) + 1)
            words[b:b] = words[a : a + k]
        rows.append((d, "".join(w + rng.choice([" ", "\n", " \t"]) for w in words)))
    rows += rows[-3:]
    got = rows_of(quality_rules.quality_rules(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")))
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_suffix_order():
    rng = random.Random(7)
    for _ in range(50):
        sizes = [rng.randint(1, 30) for _ in range(4)]
        group = np.repeat(np.arange(4), sizes)
        symbols = np.array([rng.randint(0, 2) for _ in group], np.uint64)
        order, levels = quality_rules.suffix_ranks(symbols, group)
        ends = np.cumsum(sizes)[group]
        want = sorted(range(len(group)), key=lambda i: (group[i], symbols[i : ends[i]].tolist()))
        assert order.tolist() == want


def test_query_on_table(spark):
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    sf = "/root/testdata/sf0.001"
    want = [(r.doc_id, *brute(r.text)) for r in queries.documents(spark, sf).collect()]
    assert rows_of(quality_rules.quality_rules(queries.documents(spark, sf))) == sorted(want, key=str)
    contract = sorted((r[:8] for r in want), key=str)
    assert rows_of(queries.op10_quality_rules(spark, sf)) == contract
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(db.sql(queries.ORACLE_SQL["op10_quality_rules"]).fetchall(), key=str) == contract


def thue_morse(n, one="!", two="a"):
    """Two words of n letters that polynomials modulo 2**64 cannot tell apart once n is 1,024."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join((one, two)[b] for b in bits), "".join((two, one)[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    for n, letters in ((1024, "!a"), (2048, "ab"), (4096, "ab")):
        a, b = thue_morse(n, *letters)
        filler = " ".join(f"w{k}" for k in range(60))
        t = f"p {a} q {filler} p {b} q"
        got = quality_rules.quality_rules(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
        assert tuple(got)[1:] == brute(t) and got.n_repeat_words == 0


def test_neighbours_cover_what_the_intervals_cover():
    rng = random.Random(3)
    for _ in range(60):
        s = [rng.randint(0, 2) for _ in range(rng.randint(2, 60))]
        least, spans = rng.randint(1, 4), set()
        order, levels = quality_rules.suffix_ranks(np.array(s), np.zeros(len(s), np.int64))
        lcp = quality_rules.common_prefixes(order, levels).tolist()
        for i in range(1, len(s)):  # every LCP interval of at least `least`: [lo, hi] with lcp > its neighbours'
            if lcp[i] < least:
                continue
            lo, hi = i, i
            while lcp[lo - 1] >= lcp[i]:
                lo -= 1
            while hi + 1 < len(s) and lcp[hi + 1] >= lcp[i]:
                hi += 1
            for at in order[lo - 1 : hi + 1].tolist():
                spans |= set(range(at, at + lcp[i]))
        best = quality_rules.longest_repeats(np.array(s), np.zeros(len(s), np.int64))
        assert set(np.flatnonzero(quality_rules.spans_covered(best, least)).tolist()) == spans
