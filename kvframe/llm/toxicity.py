"""Toxicity: a bidirectional gated recurrent network with attention pooling over characters and words.

A word's vector joins the last states of a bidirectional GRU over its bytes (characters) with an embedding of the
word, which common words of the sample have of their own. A window is SPAN consecutive words; a bidirectional GRU over its word vectors, pooled by attention,
gives its score. Windows overlap by half and cover the whole text; a text's score is that of its highest window.

Training is in numpy on the driver by backpropagation through time through all of it. Labels are known for texts
only, so rounds alternate: score the windows of the sample, then learn from each toxic text's highest window as
positive and from the highest and random windows of the other texts as negative; last the bias is set so that fewest
texts of the sample are on the wrong side of a score of 0.5. The sample is bounded: SAMPLE_DOCS texts
of each label and SAMPLE_WINDOWS windows of each text, at random places of the whole text.

Null and empty texts have one window without words, which is scored like any other. Without labels of both kinds
all scores are 0. Extra columns are ignored; repeated rows give repeated rows, and of a doc_id's repeated labels
the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru, text
from .shared import Scratch, bounded_batches

SPAN, STRIDE = 32, 16
CHARS, WORDS, EMBED = 8, 6, 6
#: Words with an embedding of their own: at most VOCABULARY, in at least LEAST_TEXTS texts of the sample; others share one.
VOCABULARY, LEAST_TEXTS = 4096, 8
#: Share of the words whose own embedding is hidden from a training step, so that their characters are learnt too.
HIDDEN = 0.3
#: A longer run counts as overlapping words of at most LETTERS bytes, one every half of it, that begin at a character.
LETTERS = 32
SAMPLE_DOCS, SAMPLE_WINDOWS = 1500, 24
BATCH, ROUNDS, STEPS, RATE = 128, 5, 60, 0.02
COLUMNS = 4096
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Bytes that belong to words: letters, digits and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def pieces(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of runs first .. last - 1; they cover every byte."""
    stride = LETTERS // 2
    many = np.where(last - first > LETTERS, 1 - (LETTERS - 4 - last + first) // stride, 1)  # to begin at a character takes up to 3 bytes
    low, high = np.repeat(first, many), np.repeat(last, many)
    start = text.ranges(np.zeros(len(first), np.int64), many) * stride + low
    for _ in range(3):
        start = start - ((start > low) & ((buf[start] & 0xC0) == 0x80))
    return start, np.minimum(start + LETTERS, high)


def words_of(raw: bytes) -> list[bytes]:
    """The words of one text in order."""
    buf = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], _WORD[buf].view(np.int8), [0]])))
    return [raw[a:b] for a, b in zip(*(x.tolist() for x in pieces(buf, edge[0::2], edge[1::2])), strict=True)]


class Words:
    """The distinct lower-cased words of texts, and for each text the numbers of its words in order (0: no word)."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
        buf = _LOWER.astype(np.uint8)[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = np.concatenate([[False], _WORD[buf], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = pieces(buf, edge[0::2], edge[1::2])
        hashes = text.SpanHash(buf).of(first, last)
        unique, sample, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.hash = np.concatenate([np.zeros(1, np.uint64), unique])
        a, b = first[sample], last[sample]
        place = np.arange(LETTERS)
        letters = buf[np.minimum(a[:, None] + place, len(buf) - 1)].astype(np.int64)
        self.length = np.concatenate([[1], b - a])
        letters[place >= self.length[1:, None]] = 0
        self.letters = np.concatenate([np.zeros((1, LETTERS), np.int64), letters])
        self.number = number + 1
        self.bounds = np.searchsorted(first, starts)

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers SPAN x windows of all texts, and each window's text."""
        counts = np.diff(self.bounds)
        many = 1 + np.maximum(0, -(-(counts - SPAN) // stride))
        owner = np.repeat(np.arange(len(counts)), many)
        start = text.ranges(np.zeros(len(counts), np.int64), many) * stride
        place = start + np.arange(SPAN)[:, None]
        held = np.concatenate([self.number, np.zeros(1, np.int64)])
        return np.where(place < counts[owner], held[np.minimum(self.bounds[owner] + place, len(held) - 1)], 0), owner


def slots(vocabulary: np.ndarray, words: Words) -> np.ndarray:
    """Embedding number of every distinct word, 0 for one that isn't in the vocabulary (ascending hashes)."""
    at = np.searchsorted(vocabulary, words.hash)
    known = np.append(vocabulary, np.uint64(0))[at] == words.hash
    return np.where(known & (words.hash > 0), at + 1, 0)


def initial(known: int, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(gru.FLOAT)
    p = {"E": normal(EMBED, known + 1), "a": normal(2 * WORDS, 1), "w": normal(2 * WORDS, 1), "b": np.zeros((1, 1), gru.FLOAT)}
    for side in "fb":
        for name, hidden in (("l", CHARS), ("w", WORDS)):
            own = gru.cell(hidden, rng)
            p |= {f"U{name}{side}": own["U"], f"c{name}{side}": own["c"]}
        p |= {f"L{side}": normal(3 * CHARS, 256), f"I{side}": normal(3 * WORDS, 2 * CHARS + EMBED), f"i{side}": np.zeros((3 * WORDS, 1), gru.FLOAT)}
    return p


def _cell(p: dict, name: str, side: str) -> dict:
    return {"U": p[f"U{name}{side}"], "c": p[f"c{name}{side}"]}


def learn(p: dict, slot: np.ndarray, words: Words, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of windows (SPAN x n word numbers) with targets 0 or 1."""
    used, index = np.unique(windows, return_inverse=True)
    index = index.reshape(windows.shape)
    steps = int(words.length[used].max())
    letters = words.letters[used, :steps].T
    mask = (np.arange(steps)[:, None] < words.length[used]).astype(gru.FLOAT)
    kept, ends = {}, []
    for side in "fb":
        seen, m = (letters, mask) if side == "f" else (letters[::-1], mask[::-1])
        states, k = gru.forward(_cell(p, "l", side), p[f"L{side}"][:, seen].transpose(1, 0, 2), m)
        kept["l", side] = seen, m, k
        ends.append(states[-1])
    vector = np.concatenate([*ends, p["E"][:, slot[used]]])
    both = []
    for side in "fb":
        seen = index if side == "f" else index[::-1]
        states, k = gru.forward(_cell(p, "w", side), (p[f"I{side}"] @ vector + p[f"i{side}"])[:, seen].transpose(1, 0, 2))
        kept["w", side] = seen, k
        both.append(states if side == "f" else states[::-1])
    h = np.concatenate(both, 1)
    e = (p["a"].T @ h)[:, 0]
    e -= e.max(0)
    alpha = np.exp(e)
    alpha /= alpha.sum(0)
    pooled = (alpha[:, None] * h).sum(0)
    score = gru._sigmoid(p["w"].T @ pooled + p["b"])[0]
    d = ((score - target) / len(target)).astype(gru.FLOAT)
    grads = {"w": (pooled * d).sum(1, keepdims=True), "b": d.sum().reshape(1, 1)}
    dp = p["w"] * d
    dh = alpha[:, None] * dp
    da = (dp * h).sum(1)
    de = alpha * (da - (alpha * da).sum(0))
    grads["a"] = np.einsum("tn,thn->h", de, h)[:, None]
    dh = dh + p["a"] * de[:, None]
    dv = np.zeros((len(used), len(vector)), gru.FLOAT)
    for side, part in zip("fb", (dh[:, :WORDS], dh[::-1, WORDS:]), strict=True):
        seen, k = kept["w", side]
        dx, own = gru.backward(_cell(p, "w", side), k, np.ascontiguousarray(part))
        table = np.zeros((len(used), 3 * WORDS), gru.FLOAT)
        np.add.at(table, seen.ravel(), dx.transpose(0, 2, 1).reshape(-1, 3 * WORDS))
        grads |= {f"I{side}": table.T @ vector.T, f"i{side}": table.sum(0)[:, None], f"Uw{side}": own["U"], f"cw{side}": own["c"]}
        dv += table @ p[f"I{side}"]
    embed = np.zeros((p["E"].shape[1], EMBED), gru.FLOAT)
    np.add.at(embed, slot[used], dv[:, 2 * CHARS :])
    grads["E"] = embed.T
    for n, side in enumerate("fb"):
        seen, m, k = kept["l", side]
        end = np.zeros((len(seen), CHARS, len(used)), gru.FLOAT)
        end[-1] = dv[:, n * CHARS : (n + 1) * CHARS].T
        dx, own = gru.backward(_cell(p, "l", side), k, end, m)
        table = np.zeros((256, 3 * CHARS), gru.FLOAT)
        np.add.at(table, seen.ravel(), dx.transpose(0, 2, 1).reshape(-1, 3 * CHARS))
        grads |= {f"L{side}": table.T, f"Ul{side}": own["U"], f"cl{side}": own["c"]}
    return grads


class Model:
    """Scores of windows and of whole texts."""

    def __init__(self, p: dict, vocabulary: np.ndarray):
        self.p, self.vocabulary = p, vocabulary
        self.letter = {s: gru.Scorer(_cell(p, "l", s)) for s in "fb"}
        self.word = {s: gru.Scorer(_cell(p, "w", s)) for s in "fb"}

    def tables(self, words: Words) -> dict[str, np.ndarray]:
        """Projections of every distinct word for both directions."""
        n = len(words.hash)
        vector = np.empty((2 * CHARS + EMBED, n), gru.FLOAT)
        vector[2 * CHARS :] = self.p["E"][:, slots(self.vocabulary, words)]
        order = np.argsort(words.length, kind="stable")  # words of like length together: little is masked
        for at in range(0, n, COLUMNS):
            part = order[at : at + COLUMNS]
            steps = int(words.length[part].max())
            index = words.letters[part, :steps].T
            mask = np.arange(steps)[:, None] < words.length[part]
            out = np.empty((steps, CHARS, len(part)), gru.FLOAT)
            for k, side in enumerate("fb"):
                own = self.letter[side]
                own.run(own.table(self.p[f"L{side}"]), index, out, side == "b", mask)
                vector[k * CHARS : (k + 1) * CHARS, part] = out[-1 if side == "f" else 0]
        return {s: self.word[s].table(self.p[f"I{s}"] @ vector + self.p[f"i{s}"]) for s in "fb"}

    def windows(self, tables: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
        score = np.empty(windows.shape[1], gru.FLOAT)
        for at in range(0, windows.shape[1], COLUMNS):
            index = np.ascontiguousarray(windows[:, at : at + COLUMNS])
            h = [np.empty((SPAN, WORDS, index.shape[1]), gru.FLOAT) for _ in "fb"]
            self.word["f"].run(tables["f"], index, h[0])
            self.word["b"].run(tables["b"], index, h[1], reverse=True)
            e = sum(np.einsum("h,thn->tn", self.p["a"][k * WORDS : (k + 1) * WORDS, 0], h[k]) for k in (0, 1))
            e -= e.max(0)
            np.exp(e, out=e)
            e /= e.sum(0)
            v = sum(np.einsum("h,thn->tn", self.p["w"][k * WORDS : (k + 1) * WORDS, 0], h[k]) for k in (0, 1))
            score[at : at + COLUMNS] = gru._sigmoid((e * v).sum(0) + self.p["b"][0, 0])
        return score

    def texts(self, texts: list[bytes]) -> np.ndarray:
        words = Words(texts)
        windows, owner = words.windows()
        scores = self.windows(self.tables(words), windows)
        best = np.zeros(len(texts), gru.FLOAT)
        np.maximum.at(best, owner, scores)
        return best


def train(texts: list[list[bytes]], toxic: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 1) -> Model:
    """Learns from the windows drawn of each text (strings of at most SPAN words) and the texts' labels."""
    rng = np.random.default_rng(seed)
    flat = [w for t in texts for w in t]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    words = Words(flat)
    windows, of = words.windows(SPAN)
    windows = windows[:, np.unique(of, return_index=True)[1]]
    label = toxic[owner]
    seen = np.unique(np.stack([np.broadcast_to(owner, windows.shape).ravel(), windows.ravel()]), axis=1)[1]
    count = np.bincount(seen, minlength=len(words.hash))
    count[0] = 0
    common = np.argsort(-count, kind="stable")[:VOCABULARY]
    vocabulary = np.sort(words.hash[common[count[common] >= LEAST_TEXTS]])
    slot, p = slots(vocabulary, words), initial(len(vocabulary), seed)
    good, bad = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    adam, turn = gru.Adam(p, RATE), 0
    for k in range(rounds):
        positive, negative = bad, good
        if k:
            model = Model(p, vocabulary)
            score = model.windows(model.tables(words), windows)
            order = np.lexsort((-score, owner))
            top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            sure = bad[score[bad] > 0.8]  # further windows of toxic texts that are beyond doubt by now
            positive = np.union1d(top[label[top] == 1], sure)
            hard = good[np.argsort(-score[good], kind="stable")[: max(BATCH, len(good) // 20)]]
            negative = np.concatenate([good, np.repeat(hard, 40)])
        for _ in range(steps):
            adam.rate = RATE * (1 - 0.9 * turn / (rounds * steps))
            turn += 1
            chosen = np.concatenate([rng.choice(positive, BATCH // 4), rng.choice(negative, BATCH - BATCH // 4)])
            seen = np.where(rng.random(len(slot)) < HIDDEN, 0, slot)
            adam.step(learn(p, seen, words, windows[:, chosen], label[chosen].astype(gru.FLOAT)))
    model = Model(p, vocabulary)
    score = model.windows(model.tables(words), windows)
    best = np.zeros(len(texts), gru.FLOAT)
    np.maximum.at(best, owner, score)
    p["b"] -= _threshold(best.astype(np.float64), toxic)
    return model


def _threshold(best: np.ndarray, toxic: np.ndarray) -> np.float32:
    """The log odds between the texts' highest windows at which fewest are on the wrong side, in the middle of the gap."""
    odds = np.log(np.clip(best, 1e-6, 1 - 1e-6) / (1 - np.clip(best, 1e-6, 1 - 1e-6)))
    order = np.argsort(odds, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(toxic[order])]) + np.concatenate([np.cumsum((1 - toxic[order])[::-1])[::-1], [0]])
    edges = np.concatenate([odds[order][:1], odds[order], odds[order][-1:]])
    least = np.flatnonzero(wrong == wrong.min())
    gap = edges[least + 1] - edges[least]
    k = least[int(np.argmax(gap))]
    return gru.FLOAT((edges[k] + edges[k + 1]) / 2)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> tuple[list[list[bytes]], np.ndarray]:
    """Windows of a bounded sample of `docs` (doc_id, text) with `labels` (doc_id, toxic), and their texts' labels.

    The sample is drawn from the ids alone; only its few ids then meet the texts, which are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = scratch.keep(docs.select("doc_id").join(labels, "doc_id"), "known")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return [], np.zeros(0, np.int64)
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, int(min(1.0, per_label / counts[k]) * (1 << 20)))])
    ids = scratch.keep(known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share[F.col("toxic")]).distinct().limit(4 * per_label), "ids")
    chosen = docs.join(F.broadcast(ids), "doc_id").limit(4 * per_label)  # at most 4 * per_label ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            out, toxic, seeds = [], [], []
            for raw, label, seed in zip(block.texts, block.columns["toxic"], block.columns["seed"], strict=True):
                words = words_of(raw)
                rng = np.random.default_rng(seed & ((1 << 63) - 1))
                most = -(-len(words) // SPAN)
                starts = [SPAN * k for k in range(most)] if most <= windows else rng.integers(0, len(words) - SPAN + 1, windows)
                out.append([b" ".join(words[a : a + SPAN]) for a in starts] or [b""])
                toxic.append(label)
                seeds.append(seed)
            yield pa.record_batch([pa.array(out, pa.list_(pa.binary())), pa.array(toxic, pa.int32()), pa.array(seeds, pa.int64())], names=["windows", "toxic", "seed"])

    rows = chosen.select("text", "toxic", F.xxhash64("doc_id", "text").alias("seed")).mapInArrow(cut, "windows array<binary>, toxic int, seed long").collect()
    rows.sort(key=lambda r: (r.seed, r.toxic))
    return [[bytes(w) for w in r.windows] for r in rows], np.array([r.toxic for r in rows], np.int64)


def toxicity(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; learns from `labels` (doc_id, toxic) of rows that aren't held out."""
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    held_out = F.coalesce(held_out, F.lit(False))
    bounded_batches(docs.sparkSession)
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows, toxic = sample(docs.select("doc_id", "text").where(~held_out & F.col("text").isNotNull()), known)
    own = train(rows, toxic) if len(rows) and len(set(toxic.tolist())) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches, 1 << 20):
            score = own.texts(block.texts).astype(np.float64) if own else np.zeros(len(block))
            columns = [pa.array(block.columns["doc_id"], pa.int64()), pa.array(block.columns["held_out"], pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
