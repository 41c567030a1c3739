"""Held-out accuracy, gradients, and what rows without words or labels get."""

import zlib

import numpy as np

from kvframe.llm import gru, queries, toxicity


def test_gradients(monkeypatch):
    monkeypatch.setattr(gru, "FLOAT", np.float64)
    words = toxicity.Words([b"the and moron of", b"clown is a the", b"", b"of of of"])
    windows, owner = words.windows()
    vocabulary = np.sort(words.hash[2:5])
    slot = toxicity.slots(vocabulary, words)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(len(vocabulary)).items()}
    target = np.array([1.0, 1, 0, 0])
    assert owner.tolist() == [0, 1, 2, 3]

    def loss():
        used, index = np.unique(windows, return_inverse=True)
        index = index.reshape(windows.shape)
        steps = int(words.length[used].max())
        letters, mask = words.letters[used, :steps].T, (np.arange(steps)[:, None] < words.length[used]).astype(float)
        ends = []
        for side in "fb":
            flip = slice(None) if side == "f" else slice(None, None, -1)
            ends.append(gru.forward(toxicity._cell(p, "l", side), p[f"L{side}"][:, letters[flip]].transpose(1, 0, 2), mask[flip])[0][-1])
        vector = np.concatenate([*ends, p["E"][:, slot[used]]])
        both = []
        for side in "fb":
            flip = slice(None) if side == "f" else slice(None, None, -1)
            both.append(gru.forward(toxicity._cell(p, "w", side), (p[f"I{side}"] @ vector + p[f"i{side}"])[:, index[flip]].transpose(1, 0, 2))[0][flip])
        h = np.concatenate(both, 1)
        e = np.exp((p["a"].T @ h)[:, 0])
        pooled = (e / e.sum(0))[:, None] * h
        s = gru._sigmoid(p["w"].T @ pooled.sum(0) + p["b"])[0]
        return -np.mean(target * np.log(s) + (1 - target) * np.log(1 - s))

    grads, rng = toxicity.learn(p, slot, words, windows, target), np.random.default_rng(0)
    assert set(grads) == set(p)
    for name, grad in grads.items():
        strong = np.argsort(-np.abs(grad).ravel())[:3]
        for flat in [*strong, *rng.integers(0, grad.size, 3)]:
            at = np.unravel_index(flat, grad.shape)
            held = p[name][at]
            p[name][at] = held + 1e-5
            up = loss()
            p[name][at] = held - 1e-5
            down = loss()
            p[name][at] = held
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-7 + 1e-4 * abs(grad[at]), name


def test_windows_cover_all_words():
    texts = [b" ".join(b"w%d" % k for k in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 200)]
    words = toxicity.Words(texts)
    windows, owner = words.windows()
    for r, t in enumerate(texts):
        want = words.number[words.bounds[r] : words.bounds[r + 1]]
        own = windows[:, owner == r]
        assert set(want) <= set(own.ravel()) and own[:, 0][: len(want)].tolist() == want[: toxicity.SPAN].tolist()
        assert own.shape[1] == 1 + max(0, -(-(len(want) - toxicity.SPAN) // toxicity.STRIDE))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op1_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a for a, b in held if b) > 0.8 * sum(b for _, b in held)
    assert sum(a for a, b in held if not b) < 0.05 * len(held)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a clown", "z"), (2, "", "y")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs, labels).collect()) == 4
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.0, 0)] * 4
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
