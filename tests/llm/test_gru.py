"""Gradients against differences, and the lean forward pass against the full one."""

import numpy as np

from kvframe.llm import gru


def test_gradients(monkeypatch):
    monkeypatch.setattr(gru, "FLOAT", np.float64)
    rng = np.random.default_rng(0)
    p = gru.cell(3, rng)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, weight = rng.standard_normal((5, 9, 4)), rng.standard_normal((5, 3, 4))
    mask = rng.integers(0, 2, (5, 4)).astype(np.float64)
    for m in (None, mask):
        value = lambda: float((gru.forward(p, x, m)[0] * weight).sum())  # noqa: B023, E731
        _, kept = gru.forward(p, x, m)
        dx, own = gru.backward(p, kept, weight, m)
        for array, grad in ((x, dx), (p["U"], own["U"]), (p["c"], own["c"])):
            for _ in range(12):
                at = tuple(rng.integers(0, s) for s in array.shape)
                held = array[at]
                array[at] = held + 1e-5
                up = value()
                array[at] = held - 1e-5
                down = value()
                array[at] = held
                assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_scorer_is_forward():
    rng = np.random.default_rng(1)
    p, values = gru.cell(4, rng), rng.standard_normal((12, 50)).astype(np.float32)
    index, mask = rng.integers(0, 50, (7, 6)), rng.integers(0, 2, (7, 6)).astype(bool)
    scorer, out = gru.Scorer(p), np.empty((7, 4, 6), np.float32)
    for m in (None, mask):
        for reverse in (False, True):
            scorer.run(scorer.table(values), index, out, reverse, m)
            x, seen = values[:, index].transpose(1, 0, 2), m
            if reverse:
                x, seen = x[::-1], None if m is None else m[::-1]
            want = gru.forward(p, x, seen)[0]
            assert np.allclose(out, want[::-1] if reverse else want, atol=1e-5)
