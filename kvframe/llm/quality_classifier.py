"""Quality classifier: a weak-label model over overlapping heuristics, and a hashed linear scorer trained on its posteriors.

Heuristic labellers vote good, bad or abstain on every text. Expectation-maximisation over the counts of all vote
patterns (at most 3**len(LABELLERS), whatever the number of documents) estimates how often each labeller casts each
vote on good and on bad texts, and so a posterior for every pattern. A logistic scorer over hashed features of the
whole text (word shapes, pairs of shapes, word ends, lengths, words said twice) learns these posteriors on a bounded sample, at most
SAMPLE_DOCS texts of each side; it then scores all texts, and those under 0.5 are rejected.

Null and empty texts, and texts without words, score 0 and are rejected. Extra columns are ignored; repeated rows
give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .shared import Scratch, bounded_batches

LABELLERS = ("symbols", "capitals", "marks", "bars", "repetition", "length", "lines", "short_words")
SIZE = 1 << 12
SAMPLE_DOCS = 2000
EM_ROUNDS, STEPS, RATE, DECAY = 100, 250, 0.05, 1e-4
GOOD, ABSTAIN, BAD = 0, 1, 2
#: Votes (good, abstain, bad) expected on good and on bad texts.
PRIOR, PRIOR_WEIGHT = ((0.49, 0.5, 0.01), (0.35, 0.45, 0.2)), 0.02
#: Share of good texts before any vote.
BALANCE = 0.85
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>~^=")] = True
_LETTER = (_CLASS == 65) | (_CLASS == 97)


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def vote(block: text.Block) -> np.ndarray:
    """Rows x labellers of GOOD, ABSTAIN or BAD."""
    starts, ends, first = block.words()
    n = np.maximum(np.diff(first), 1).astype(float)
    buf, row = block.buf, np.repeat(np.arange(len(block)), np.diff(first))
    count = lambda flags: _per_row(flags, block.start)
    capitals = count(_CLASS[buf] == 65) / np.maximum(count(_LETTER[buf]), 1)
    marks = count(np.append((buf[1:] == buf[:-1]) & ((buf[1:] == 33) | (buf[1:] == 63)), False)) / n
    alone = np.zeros(len(starts), bool)
    if len(starts):
        alone = (ends - starts == 1) & (buf[starts] == 124)
    share = np.zeros(len(block))
    if len(starts) > 2:
        fits = np.flatnonzero(first[row + 1] - np.arange(len(starts)) >= 3)
        words = block.word_hashes()
        windows = text.SpanHash(words).of(fits, fits + 3) ^ text.mix(row[fits].astype(np.uint64) + np.uint64(1))
        _, which, size = np.unique(windows, return_inverse=True, return_counts=True)
        twice = fits[size[which] > 1]
        share = _per_row(text.covered(len(starts), twice, twice + 3), first) / n
    lines = np.zeros(len(block))
    for r, raw in enumerate(block.texts):
        held = [x for x in raw.split(b"\n") if x.strip()]
        lines[r] = 1 - len(set(held)) / len(held) if held else 0
    short = _per_row((ends - starts <= 3) & _LETTER[buf[starts]], first) / n
    rules = (  # value, at most this is good, over this is bad; the absence of a fault is no vote for good
        (count(_SYMBOL[buf]) / n, -1, 0.4),
        (capitals, -1, 0.5),
        (marks, -1, 0.3),
        (_per_row(alone, first) / n, -1, 0.2),
        (share, -1, 0.4),
        (-np.diff(first), -30, -4),
        (lines, -1, 0.4),
        (np.where(n < 25, -0.1, -short), -0.15, -0.03),
    )
    return np.stack([np.where(x <= good, GOOD, np.where(x > bad, BAD, ABSTAIN)) for x, good, bad in rules], 1)


def posteriors(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each vote pattern; labellers x (good, bad) x votes, how often each vote is cast.

    Starts from: a text is bad if any labeller says so. Votes are independent given the side, and an
    abstention says nothing. PRIOR says that a
    labeller seldom calls a good text bad, and weighs as much as PRIOR_WEIGHT of the texts; without it, and
    with a free BALANCE, the two sides may settle on any other split of the corpus.
    """
    good = np.where((votes == BAD).any(1), 0.1, 0.95)
    prior = np.array(PRIOR) * (PRIOR_WEIGHT * counts.sum() + 1)
    rates = np.full((votes.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([good, 1 - good]) * counts
        for v in range(3):
            rates[:, :, v] = (weight @ (votes == v)).T + prior[:, v]
        rates /= rates.sum(2, keepdims=True)
        odds = np.log(BALANCE / (1 - BALANCE)) + sum(np.where(votes[:, k] == ABSTAIN, 0, np.log(rates[k, 0, votes[:, k]] / rates[k, 1, votes[:, k]])) for k in range(votes.shape[1]))
        good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return good, rates


def features(block: text.Block) -> tuple[np.ndarray, np.ndarray]:
    """For each word five hashed features (words x 5 of 0 .. SIZE - 1), and each row's first word (one more at the end)."""
    starts, ends, first = block.words()
    kinds = _CLASS[block.buf]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    place = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
    shape = text.SpanHash(kinds[keep]).of(place[starts], place[ends])
    before = np.concatenate([np.zeros(1, np.uint64), shape])[: len(shape)]
    opening = first[:-1][np.diff(first) > 0]
    before[opening] = 0  # a text's first word has none before it
    tail = text.SpanHash(kinds).of(np.maximum(starts, ends - 3), ends)
    length = np.minimum(ends - starts, 30).astype(np.uint64)
    word = block.word_hashes()
    again = np.zeros(len(word), np.uint64)
    again[1:] = word[1:] == word[:-1]
    again[opening] = 0
    parts = [shape, text.mix(shape + text.mix(before)), tail ^ np.uint64(0x5BD1E995), text.mix(length + np.uint64(7919)), text.mix(again + np.uint64(104729))]
    return (np.stack(parts, 1) % np.uint64(SIZE)).astype(np.int32), first


def fit(rows: np.ndarray, index: np.ndarray, value: np.ndarray, target: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer by Adam on all of a sample's rows; triples row, feature, value."""
    n = len(target)
    x = np.zeros((n, SIZE), np.float32)
    x[rows, index] = value
    w, b = np.zeros(SIZE, np.float32), 0.0
    first, second = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    even = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    for t in range(1, steps + 1):
        score = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        d = ((score - target) * even).astype(np.float32)
        grad = np.append(x.T @ d + DECAY * w, d.sum())
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        step = RATE * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * first / (np.sqrt(second) + 1e-8)
        w -= step[:-1].astype(np.float32)
        b -= float(step[-1])
    return w, b


def weak_labels(docs: DataFrame) -> DataFrame:
    """doc_id, key_text (hash of the text) and votes (a digit for each of LABELLERS: 0 good, 1 abstain, 2 bad) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            digits = (vote(block) + 48).astype(np.uint8)
            yield pa.record_batch([pa.array(block.columns["doc_id"], pa.int64()), pa.array(block.columns["key_text"], pa.int64()), pa.array([r.tobytes().decode() for r in digits])], names=["doc_id", "key_text", "votes"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_text"), "text")
    return rows.mapInArrow(run, "doc_id long, key_text long, votes string")


def train(docs: DataFrame, per_side: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """The scorer's weights and bias, learnt from votes on all of `docs` and the texts of a bounded sample."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    labels = scratch.keep(weak_labels(docs), "votes")
    patterns = sorted((r.votes, r.n) for r in labels.groupBy("votes").agg(F.count("*").alias("n")).collect())
    if not patterns:
        return np.zeros(SIZE, np.float32), 0.0
    votes = np.array([[int(c) for c in p] for p, _ in patterns])
    counts = np.array([n for _, n in patterns], float)
    good, _ = posteriors(votes, counts)
    total = [counts[good < 0.5].sum(), counts[good >= 0.5].sum()]
    share = [min(1.0, per_side / max(1, total[int(g >= 0.5)])) for g in good]
    table = spark.createDataFrame([(p, float(g), int(s * (1 << 20))) for (p, _), g, s in zip(patterns, good, share, strict=True)], "votes string, good double, share long")
    chosen = labels.join(F.broadcast(table), "votes").where(F.pmod(F.xxhash64("doc_id", "key_text", F.lit(3)), F.lit(1 << 20)) < F.col("share"))  # one row for each pattern
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("key_text").alias("key"), "good").distinct().limit(3 * per_side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            hashed, first = features(block)
            index, value = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                k, n = np.unique(hashed[a:b], return_counts=True)
                index.append(k)
                value.append((n / max(1, b - a)).astype(np.float32))
            yield pa.record_batch([pa.array(block.columns["key"], pa.int64()), pa.array(block.columns["good"]), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["key", "good", "index", "value"])

    texts = docs.select("doc_id", "text").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (texts.key == chosen.key)).select("text", texts.key, "good").limit(6 * per_side)
    rows = sorted(rows.mapInArrow(run, "key long, good double, index array<int>, value array<float>").collect(), key=lambda r: r.key)
    sizes = [len(r["index"]) for r in rows]
    if not rows:
        return np.zeros(SIZE, np.float32), 0.0
    index = np.concatenate([np.array(r["index"], np.int64) for r in rows])
    value = np.concatenate([np.array(r.value, np.float32) for r in rows])
    return fit(np.repeat(np.arange(len(rows)), sizes), index, value, np.array([r.good for r in rows]))


def score(block: text.Block, w: np.ndarray, b: float) -> np.ndarray:
    """P(good) of each row."""
    hashed, first = features(block)
    n = np.diff(first)
    odds = _per_row(w[hashed].sum(1), first) / np.maximum(n, 1) + b
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(odds, -40, 40))), 0.0)


def quality_classifier(docs: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and kept (score of 0.5 or more) for every row of `docs`."""
    w, b = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            good = score(block, w, b)
            yield pa.record_batch([pa.array(block.columns["doc_id"], pa.int64()), pa.array(good), pa.array(good >= 0.5)], names=["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with the same columns."""
    w, b = train(docs)

    @F.pandas_udf("double")
    def good(texts):
        parts = [score(block, w, b) for block in text.blocks(iter([pa.record_batch([pa.array(texts, pa.string())], names=["text"])]))]
        import pandas as pd

        return pd.Series(np.concatenate([*parts, np.zeros(0)]))

    return docs.where(good(F.col("text")) >= 0.5)
