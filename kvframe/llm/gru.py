"""Gated recurrent units in numpy: forward, backpropagation through time, Adam, and a lean forward pass for scoring.

Arrays are feature-major (features x columns), one column for each sequence. A cell has U (3H x H) and c (H);
its input comes as projections X (T x 3H x columns) for update gate, reset gate and candidate:
z = s(Xz + Uz h), r = s(Xr + Ur h), n = tanh(Xn + r (Un h + c)), h' = z h + (1 - z) n.
"""

from __future__ import annotations

import numpy as np

FLOAT = np.float32


def cell(hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {"U": (rng.standard_normal((3 * hidden, hidden)) * 0.5 / np.sqrt(hidden)).astype(FLOAT), "c": np.zeros((hidden, 1), FLOAT)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict, x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """States T x H x columns and what backward() needs; where mask (T x columns) is 0 the state stays."""
    hidden = p["U"].shape[1]
    h = np.zeros((hidden, x.shape[2]), FLOAT)
    states, kept = np.empty((len(x), *h.shape), FLOAT), []
    for t in range(len(x)):
        a = p["U"] @ h
        zr = _sigmoid(x[t, : 2 * hidden] + a[: 2 * hidden])
        z, r, q = zr[:hidden], zr[hidden:], a[2 * hidden :] + p["c"]
        n = np.tanh(x[t, 2 * hidden :] + r * q)
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t], new, h)
        kept.append((h, z, r, q, n))
        states[t] = h = new
    return states, kept


def backward(p: dict, kept: list, grad: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Gradients of X and of the cell from those of the states."""
    hidden, columns = grad.shape[1:]
    dx, du, dc = np.empty((len(grad), 3 * hidden, columns), FLOAT), np.zeros_like(p["U"]), np.zeros_like(p["c"])
    carry = np.zeros((hidden, columns), FLOAT)
    for t in range(len(grad) - 1, -1, -1):
        h, z, r, q, n = kept[t]
        total = carry + grad[t]
        d = total if mask is None else total * mask[t]
        dn = d * (1 - z) * (1 - n * n)
        dz, dr, dq = d * (h - n) * z * (1 - z), dn * q * r * (1 - r), dn * r
        gates = np.concatenate([dz, dr, dq])
        du += gates @ h.T
        dc += dq.sum(1, keepdims=True)
        dx[t, : 2 * hidden], dx[t, 2 * hidden :] = gates[: 2 * hidden], dn
        carry = d * z + p["U"].T @ gates
        if mask is not None:
            carry += total * (1 - mask[t])
    return dx, {"U": du, "c": dc}


class Scorer:
    """The same forward pass for scoring, with gates by scaled tanh and no new arrays."""

    def __init__(self, p: dict):
        hidden = self.hidden = p["U"].shape[1]
        self.u = np.ascontiguousarray(p["U"] * FLOAT(0.5))  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2; q comes halved
        self.c = p["c"] * FLOAT(0.5)
        self.scale = np.repeat(np.array([0.5, 0.5, 1], FLOAT), hidden)[:, None]

    def table(self, x: np.ndarray) -> np.ndarray:
        """Projections (3H x values) as run() takes them."""
        return np.ascontiguousarray(x * self.scale, FLOAT)

    def run(self, table: np.ndarray, index: np.ndarray, out: np.ndarray, reverse: bool = False, mask: np.ndarray | None = None) -> None:
        """States of T x columns sequences of column numbers of `table` into out (T x H x columns)."""
        steps, columns = index.shape
        hidden = self.hidden
        h, d = np.zeros((hidden, columns), FLOAT), np.empty((hidden, columns), FLOAT)
        x, a = np.empty((3 * hidden, columns), FLOAT), np.empty((3 * hidden, columns), FLOAT)
        zr, n, q = a[: 2 * hidden], x[2 * hidden :], a[2 * hidden :]
        for t in range(steps - 1, -1, -1) if reverse else range(steps):
            np.take(table, index[t], axis=1, out=x, mode="clip")
            np.matmul(self.u, h, out=a)
            zr += x[: 2 * hidden]
            np.tanh(zr, out=zr)
            q += self.c
            r = a[hidden : 2 * hidden]
            r += 1
            q *= r
            n += q
            np.tanh(n, out=n)
            np.subtract(h, n, out=d)
            d *= a[:hidden]
            d += h
            d += n
            d *= FLOAT(0.5)
            if mask is None:
                h, d = d, h
            else:
                np.copyto(h, d, where=mask[t])
            out[t] = h


class Adam:
    """Steps for a dict of arrays, which change in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.turn = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        shrink = min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * shrink
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            size = self.rate * np.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn)
            self.params[k] -= (size * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)).astype(FLOAT)
