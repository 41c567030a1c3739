"""Language ID: a bidirectional gated recurrent network over bytes.

The text is read in chunks of SPAN bytes; at every byte the states of both directions give label probabilities, and
their mean over all bytes of the text is the document's. Training is by backpropagation through time on the driver,
on windows drawn at random places of a bounded sample: at most SAMPLE_DOCS documents of each language and
SAMPLE_WINDOWS windows of each document, however long; everything else covers all rows and bytes.

A text that is null or has no letter is `und` with score 0. Without any labelled row all texts are `und`. Extra
columns are ignored, repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru, text
from .shared import bounded_batches

SPAN, HIDDEN = 64, 6
SAMPLE_DOCS, SAMPLE_WINDOWS = 500, 16
BATCH, STEPS, RATE = 256, 220, 0.02
#: Languages to learn at most; more is an error, as a model for each byte's language grows with them.
MOST_LABELS = 1000
#: Chunks scored at once.
COLUMNS = 4096
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def sample(docs: DataFrame, per_label: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels in order, windows (n x SPAN bytes, 0 past the end) and each one's label, of `docs` (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} languages to learn")
    labels = sorted(counts)
    if not labels:
        return [], np.zeros((0, SPAN), np.uint8), np.zeros(0, np.int64)
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, int(min(1.0, per_label / counts[k]) * (1 << 20)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 20)) < share[F.col("lang")]).limit(2 * per_label * len(labels))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            out, names = [], []
            for raw, name, seed in zip(block.texts, block.columns["lang"], block.columns["seed"], strict=True):
                rng = np.random.default_rng(seed & ((1 << 63) - 1))
                for at in rng.integers(0, max(1, len(raw) - SPAN + 1), min(windows, 1 + len(raw) // SPAN)):
                    out.append(raw[at : at + SPAN])
                    names.append(name)
            yield pa.record_batch([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["window", "lang"])

    rows = chosen.select("text", "lang", F.xxhash64("doc_id", "text").alias("seed")).mapInArrow(cut, "window binary, lang string").collect()
    rows = sorted((bytes(r.window), r.lang) for r in rows if r.window)
    data = np.frombuffer(b"".join(w.ljust(SPAN, b"\0") for w, _ in rows), np.uint8).reshape(-1, SPAN)
    return labels, data, np.array([labels.index(k) for _, k in rows], np.int64)


def train(data: np.ndarray, label: np.ndarray, classes: int, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"O": np.zeros((classes, 2 * hidden), gru.FLOAT), "o": np.zeros((classes, 1), gru.FLOAT)}
    for side in "fb":
        own = gru.cell(hidden, rng)
        p |= {f"U{side}": own["U"], f"c{side}": own["c"], f"E{side}": (rng.standard_normal((3 * hidden, 256)) * 0.3).astype(gru.FLOAT)}
    adam = gru.Adam(p, RATE)
    if not len(data):
        return p
    for turn in range(steps):
        adam.rate = RATE * (1 - 0.9 * turn / steps)
        at = rng.integers(0, len(data), BATCH)
        x, y = data[at].T, label[at]
        mask = (x > 0)[:, None, :]
        both, kept = [], []
        for side in "fb":
            seen = x if side == "f" else x[::-1]
            states, k = gru.forward({"U": p[f"U{side}"], "c": p[f"c{side}"]}, p[f"E{side}"][:, seen].transpose(1, 0, 2))
            both.append(states if side == "f" else states[::-1])
            kept.append((seen, k))
        h = np.concatenate(both, 1)
        logits = p["O"] @ h + p["o"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        prob[:, y, np.arange(BATCH)] -= 1
        prob *= mask / gru.FLOAT(BATCH * SPAN)
        grads = {"O": np.einsum("tcb,thb->ch", prob, h), "o": prob.sum((0, 2))[:, None]}
        dh = p["O"].T @ prob
        for side, (seen, k), d in zip("fb", kept, (dh[:, :hidden], dh[::-1, hidden:]), strict=True):
            dx, own = gru.backward({"U": p[f"U{side}"], "c": p[f"c{side}"]}, k, np.ascontiguousarray(d))
            table = np.zeros((256, 3 * hidden), gru.FLOAT)
            np.add.at(table, seen.ravel(), dx.transpose(0, 2, 1).reshape(-1, 3 * hidden))
            grads |= {f"E{side}": table.T, f"U{side}": own["U"], f"c{side}": own["c"]}
        adam.step(grads)
    return p


class Labeller:
    """Probabilities of the labels for whole texts."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.out, self.bias = np.ascontiguousarray(p["O"]), p["o"]
        self.sides = [gru.Scorer({"U": p[f"U{s}"], "c": p[f"c{s}"]}) for s in "fb"]
        self.tables = [s.table(p[f"E{k}"]) for s, k in zip(self.sides, "fb", strict=True)]

    def positions(self, index: np.ndarray) -> np.ndarray:
        """T x labels x columns, probabilities at every byte of chunks (T x columns)."""
        hidden = self.sides[0].hidden
        h = [np.empty((len(index), hidden, index.shape[1]), gru.FLOAT) for _ in self.sides]
        self.sides[0].run(self.tables[0], index, h[0])
        self.sides[1].run(self.tables[1], index, h[1], reverse=True)
        prob = np.matmul(self.out[:, :hidden], h[0])
        prob += np.matmul(self.out[:, hidden:], h[1])
        prob += self.bias
        np.exp(prob, out=prob)
        prob /= prob.sum(1, keepdims=True)
        return prob

    def documents(self, block: text.Block) -> np.ndarray:
        """Rows x labels, the mean over all bytes of each text (0 for an empty one)."""
        chunks = -(-block.size // SPAN)
        owner = np.repeat(np.arange(len(block)), chunks)
        start = text.ranges(np.zeros(len(block), np.int64), chunks) * SPAN
        length = np.minimum(block.size[owner] - start, SPAN)
        start += block.start[owner]
        total = np.zeros((len(block), len(self.out)))
        for at in range(0, len(owner), COLUMNS):
            part = slice(at, at + COLUMNS)
            place = start[part] + np.arange(SPAN)[:, None]
            inside = np.arange(SPAN)[:, None] < length[part]
            index = np.where(inside, block.buf[np.minimum(place, len(block.buf) - 1)], 0).astype(np.intp)
            prob = self.positions(index)
            np.add.at(total, owner[part], (prob * inside[:, None, :]).sum(0).T)
        return total / np.maximum(block.size, 1)[:, None]


def language_id(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from the rows that aren't held out and have a lang."""
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    held_out = F.coalesce(held_out, F.lit(False))
    bounded_batches(docs.sparkSession)
    labels, data, label = sample(docs.select("doc_id", "text", "lang").where(~held_out))
    p = train(data, label, len(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(p)
        for block in text.blocks(batches):
            worded = np.array([any(map(str.isalpha, t.decode())) for t in block.texts], bool)
            names, score = np.full(len(block), "und", object), np.zeros(len(block))
            if labels:
                prob = own.documents(block)
                names = np.where(worded, np.array(labels, object)[prob.argmax(1)], "und")
                score = np.where(worded, np.clip(prob.max(1), 0, 1), 0)
            columns = [pa.array(block.columns["doc_id"], pa.int64()), pa.array(block.columns["held_out"], pa.bool_()), pa.array(names, pa.string()), pa.array(score)]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(run, OUT)
