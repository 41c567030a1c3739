"""Whole texts scored in blocks against a plain pass, one text, one byte or word at a time."""

import random

import numpy as np

from kvframe.llm import language_id, quality_classifier, text, toxicity


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def gru_states(u, c, inputs):
    """States of one sequence from projections of its inputs."""
    hidden, h, out = len(c), np.zeros(len(c)), []
    for x in inputs:
        a = u @ h
        z, r = sigmoid(x[:hidden] + a[:hidden]), sigmoid(x[hidden : 2 * hidden] + a[hidden : 2 * hidden])
        n = np.tanh(x[2 * hidden :] + r * (a[2 * hidden :] + c[:, 0]))
        h = z * h + (1 - z) * n
        out.append(h)
    return out


def both_ways(p, name, inputs, table=None):
    """Forward and backward states of a sequence, in its order."""
    ahead = gru_states(p[f"U{name}f"], p[f"c{name}f"], [x["f"] for x in inputs])
    back = gru_states(p[f"U{name}b"], p[f"c{name}b"], [x["b"] for x in inputs][::-1])[::-1]
    return ahead, back


def random_params(p, seed):
    rng = np.random.default_rng(seed)
    return {k: (rng.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in p.items()}


def samples():
    rng = random.Random(4)
    words = ["idiot", "the", "réeuxpa", "Ünï", "x" * 70, "日本語" * 30, "a1", "!!", "\n"]
    return [b"", b"!", "".encode(), *(" ".join(rng.choice(words) + rng.choice("abc") for _ in range(n)).encode() for n in (1, 5, 31, 32, 33, 100, 400))]


def test_language_of_whole_texts():
    p = random_params(language_id.train(np.zeros((0, language_id.SPAN), np.uint8), np.zeros(0, np.int64), 3), 1)
    block = text.Block(samples(), {})
    got = language_id.Labeller(p).documents(block)
    for raw, own in zip(block.texts, got, strict=True):
        total = np.zeros(3)
        for at in range(0, len(raw), language_id.SPAN):
            chunk = raw[at : at + language_id.SPAN].ljust(language_id.SPAN, b"\0")
            ahead, back = both_ways(p, "", [{s: p[f"E{s}"][:, b] for s in "fb"} for b in chunk])
            for k in range(min(language_id.SPAN, len(raw) - at)):
                logit = p["O"] @ np.concatenate([ahead[k], back[k]]) + p["o"][:, 0]
                total += np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        assert np.allclose(own, total / max(1, len(raw)), atol=1e-4)


def test_toxicity_of_whole_texts():
    texts = samples()
    held = toxicity.Words(texts)
    vocabulary = np.sort(held.hash[1:8:2])
    p = random_params(toxicity.initial(len(vocabulary)), 2)
    got = toxicity.Model(p, vocabulary).texts(texts)

    def vector(word):
        letters = list(word) or [0]
        ahead, back = both_ways(p, "l", [{s: p[f"L{s}"][:, b] for s in "fb"} for b in letters])
        own = toxicity.Words([word]).hash
        at = np.searchsorted(vocabulary, own[1]) if word else len(vocabulary)
        slot = at + 1 if at < len(vocabulary) and vocabulary[at] == own[1] else 0
        return np.concatenate([ahead[-1], back[0], p["E"][:, slot]])

    for raw, own in zip(texts, got, strict=True):
        words, best = toxicity.words_of(raw.lower()), 0.0
        for at in range(0, max(1, len(words) - toxicity.SPAN + toxicity.STRIDE), toxicity.STRIDE):
            window = (words[at : at + toxicity.SPAN] + [b""] * toxicity.SPAN)[: toxicity.SPAN]
            inputs = [{s: p[f"I{s}"] @ v + p[f"i{s}"][:, 0] for s in "fb"} for v in map(vector, window)]
            ahead, back = both_ways(p, "w", inputs)
            h = [np.concatenate(x) for x in zip(ahead, back, strict=True)]
            weight = np.exp([p["a"][:, 0] @ x for x in h])
            pooled = sum(w * x for w, x in zip(weight / weight.sum(), h, strict=True))
            best = max(best, sigmoid(p["w"][:, 0] @ pooled + p["b"][0, 0]))
        assert abs(own - best) < 1e-4


def test_quality_of_whole_texts():
    rng = np.random.default_rng(3)
    w = rng.standard_normal(quality_classifier.SIZE).astype(np.float32)
    texts = [*samples(), b"It is IT 12 12 a-b a-b", b"x " * 5000]
    got = quality_classifier.score(text.Block(texts, {}), w, 0.25)

    def one(values):
        return int(text.SpanHash(np.array(values, np.uint8)).of(np.array([0]), np.array([len(values)]))[0]) if values else 0

    mix = lambda n: int(text.mix(np.array([n % (1 << 64)], np.uint64))[0])
    kind = lambda b: 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
    for raw, own in zip(texts, got, strict=True):
        odds, words, before, last = [], raw.split(), 0, None
        for word in words:
            kinds = [kind(b) for b in word]
            shape = one([k for j, k in enumerate(kinds) if not j or kinds[j - 1] != k])
            parts = [shape, mix(shape + mix(before)), one(kinds[-3:]) ^ 0x5BD1E995, mix(min(len(word), 30) + 7919), mix((word == last) + 104729)]
            odds.append(sum(float(w[x % quality_classifier.SIZE]) for x in parts))
            before, last = shape, word
        want = sigmoid(np.mean(odds) + 0.25) if odds else 0.0
        assert abs(own - want) < 1e-4
