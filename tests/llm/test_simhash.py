"""Against brute force over all pairs."""

import random
import re

import xxhash

from kvframe.llm import queries, simhash


def print_of(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """{row: component} of (doc_id, fingerprint) rows."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if label[i] != label[j] and (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                old = label[i]
                label = [label[j] if k == old else k for k in label]
    ids = {}
    for (d, _), k in zip(prints, label, strict=True):
        ids.setdefault(k, []).append(d)
    return sorted((d, f"{f:016x}", min((x for x in ids[k] if x is not None), default=None)) for (d, f), k in zip(prints, label, strict=True))


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, print_of(r.text)) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op7_simhash_near_dedup(spark, sf).collect())) == brute(rows)


def test_links_lose_nothing(spark, tmp_path):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            for _ in range(rng.randint(1, 6)):
                at ^= 1 << rng.randrange(64)
    prints |= {0, 15, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for chunk in (1024, 7):
        scratch = simhash.Scratch(spark, "test")
        roots = {r.node: r.root for r in simhash.connected_components(simhash.links(df, scratch, chunk), scratch).collect()}
        named = {}
        for x in signed:
            named.setdefault(roots.get(x, x), []).append(x)
        want = {}
        for i, _, c in brute([(i, x) for i, x in enumerate(prints)]):
            want.setdefault(c, []).append(signed[i])
        assert sorted(map(sorted, named.values())) == sorted(map(sorted, want.values()))


def test_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(5, None, 1), (3, "", 2), (None, " \t", 3), (9, "One two", 4), (8, "one  TWO", 5), (8, "one two", 6), (None, "alone and unlike the rest", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert len(got) == 7 and {(d, c) for d, _, c in got} == {(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None)}


def test_longer_keys_find_the_same(spark):
    rng = random.Random(12)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << bit
            prints.add(p)
    prints = sorted(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")

    def components(edges):
        label = {p: p for p in map(signed, prints)}
        for a, b in edges:
            old, new = label[a], label[b]
            label = {k: new if v == old else v for k, v in label.items()}
        return {frozenset(k for k, v in label.items() if v == own) for own in set(label.values())}

    want = components((signed(a), signed(b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4)
    for chain in (2, 3, 4, 5):
        got = simhash.links(df, simhash.Scratch(spark, "test"), chain=chain).collect()
        assert components((r.a, r.b) for r in got) == want
    assert [simhash.chain_for(n) for n in (1, 1 << 20, 1 << 21, 1 << 30, 1 << 40)] == [2, 2, 3, 4, 5]
