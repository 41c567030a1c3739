"""Against the labels that the classifier never sees, and a plain expectation-maximisation."""

import numpy as np

from kvframe.llm import quality_classifier, queries


def test_against_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op3_quality_classifier(spark, sf).collect()
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    side = {q: [r.kept for r in got if labels.get(r.doc_id) == q] for q in (0, 1)}
    assert np.mean(side[1]) > 0.99 and np.mean(side[0]) < 0.25


def test_posteriors_like_plain_em():
    rng = np.random.default_rng(0)
    votes = rng.integers(0, 3, (40, len(quality_classifier.LABELLERS)))
    votes = np.unique(votes, axis=0)
    counts = rng.integers(1, 50, len(votes)).astype(float)
    good, rates = quality_classifier.posteriors(votes, counts, 7)
    q = [0.1 if 2 in v else 0.95 for v in votes.tolist()]
    weight = quality_classifier.PRIOR_WEIGHT * counts.sum() + 1
    for _ in range(7):
        table = [[[weight * quality_classifier.PRIOR[y][v] for v in range(3)] for y in range(2)] for _ in range(votes.shape[1])]
        for p, n, v in zip(q, counts, votes.tolist(), strict=True):
            for k, x in enumerate(v):
                table[k][0][x] += n * p
                table[k][1][x] += n * (1 - p)
        table = [[[x / sum(side) for x in side] for side in row] for row in table]
        for i, v in enumerate(votes.tolist()):
            odds = quality_classifier.BALANCE / (1 - quality_classifier.BALANCE)
            for k, x in enumerate(v):
                odds *= table[k][0][x] / table[k][1][x] if x != 1 else 1
            q[i] = odds / (1 + odds)
    assert np.allclose(good, q, atol=1e-9) and np.allclose(rates, table)


def test_edges(spark):
    kind = "doc_id long, text string, kept string"
    assert quality_classifier.quality_classifier(spark.createDataFrame([], kind)).collect() == []
    prose = " ".join(["It is the way of all of us to go on."] * 2 + [f"And so did w{k} too." for k in range(9)])
    rows = [(1, None, "a"), (2, "", "b"), (None, prose, "c"), (3, prose, "d"), (3, prose, "d"), (4, "A### B$$$ " * 40, "e")]
    df = spark.createDataFrame(rows, kind)
    got = sorted((r.doc_id or 0, r.kept) for r in quality_classifier.quality_classifier(df).collect())
    assert got == [(0, True), (1, False), (2, False), (3, True), (3, True), (4, False)]
    assert sorted(quality_classifier.keep_good(df).collect(), key=str) == sorted([r for r in df.collect() if r.kept in "cd"], key=str)
