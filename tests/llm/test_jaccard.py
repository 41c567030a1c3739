"""The pipeline's near-dedup against brute force: all pairs of 5-word Jaccard similarity 0.8 or more."""

import random
import re

import numpy as np
import pytest

from kvframe.llm import jaccard, simhash


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least doc_id of each component of (doc_id, text) rows."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old = label[i]
                label = [label[j] if k == old else k for k in label]
    return sorted(min(d for (d, _), k in zip(rows, label, strict=True) if k == own) for own in set(label))


def texts(seed=5):
    """Texts with a common first line, and copies of some with one to many words changed, appended or cut."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    line, out = [f"line{k}" for k in range(12)], [None, "", " \t", "one two", "One  two", "one two three four five"]
    for k in range(60):
        base = line * (k % 3 > 0) + [word() for _ in range(rng.choice((4, 6, 20, 60, 200)))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            own = list(base)
            for _ in range(rng.randint(1, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = word()
            own += [word() for _ in range(rng.randint(0, len(own) // 12))]
            out.append(" ".join(own[rng.randint(0, len(own) // 20) :]))
    return out


@pytest.mark.parametrize("chunk", [1024, 5])
def test_all_pairs(spark, chunk, monkeypatch):
    monkeypatch.setattr(jaccard.grouped, "__defaults__", (chunk, None, None))
    rows = list(enumerate(texts()))
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute(rows)
    assert got == want and len(want) < len(rows) - 30


def borderline(n):
    """Texts of one base with some words changed, of which pairs are a little above or below the threshold."""
    rng = random.Random(11)
    out = []
    for k in range(n):
        own = [f"base{j}" for j in range(120)]
        for at in rng.sample(range(12), 2 + k % 3):
            own[at * 10] = f"own{k}x{at}"
        out.append(" ".join(own))
    return out


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    """Tables of pairs (a, b) hold no more rows than links of some forests, however many of a group's pairs are candidates."""
    keep, made = jaccard.Scratch.keep, {}

    def counted(self, df, name):
        out = keep(self, df, name)
        if out.columns == ["a", "b"] and not name.startswith("edges"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard.Scratch, "keep", counted)
    rows = list(enumerate(borderline(240)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 1 < len(want) < len(rows)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want
    assert made and max(made.values()) <= 10 * len(rows), made
    made.clear()
    rooted = jaccard.grouped(df, jaccard.Scratch(spark, "test")).groupBy("root").agg(jaccard.F.min("doc_id").alias("d"))  # nothing proposed
    assert sorted(r.d for r in rooted.collect()) == want
    assert max(made.values()) <= 10 * len(rows), made


def test_chunks_by_members(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 300)
    rows = list(enumerate(texts(6)))
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_forest():
    sets = jaccard.shingle_sets([t.encode() for t in [*borderline(60), *(t for t in texts(4) if (t or "").split())]])
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard.similar(sets[i], sets[j])}

    def joined(links, roots):
        label = list(roots)
        for i, j in links:
            label = [label[j] if k == label[i] else k for k in label]
        return {frozenset(i for i, k in enumerate(label) if k == own) for own in set(label)}

    for some in (range(len(sets)), [i // 3 for i in range(len(sets))], [i % 7 for i in range(len(sets))]):
        roots = np.array(list(some), np.int64)
        edges = jaccard.forest(sets, roots)
        assert len(edges) < len(sets) and all((max(e), min(e)) in pairs for e in edges)
        assert joined(edges, some) == joined(pairs, some)


def test_threshold_itself():
    a = " ".join(f"w{k}" for k in range(14))  # ten shingles
    inside, outside = f"{a} x y", f"{a} x y z"  # ten of twelve, ten of thirteen
    x, y, z = jaccard.shingle_sets([t.encode() for t in (a, inside, outside)])
    assert jaccard.similar(x, y) and not jaccard.similar(x, z)
    eight = jaccard.shingle_sets([" ".join(f"w{k}" for k in range(12)).encode()])[0]
    assert jaccard.similar(x, eight) and jaccard.similar(eight, x)  # eight of ten: the threshold itself


def test_marks_rule_out_no_similar_pair():
    sets = jaccard.shingle_sets([(t or "").encode() for t in texts(9)])
    for x in sets:
        for y in sets:
            assert jaccard.apart(jaccard.mark(x), jaccard.mark(y)) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_table_pairs_beyond_four_bits(spark):
    """Pairs of the table at similarity 0.83 to 0.86 whose SimHashes differ in 8 to 11 bits."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id IN (2566, 7725, 8421, 9728, 1, 2926)")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2566, 8421]
