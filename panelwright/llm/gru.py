"""A gated recurrent layer in numpy: forward over index sequences, backpropagation through time.

Inputs are rows of a projection table, one row of 3 * H values per symbol, so a step gathers rows
and needs only the two recurrent products. Squashing is x / (1 + |x|), scaled to 0..1 for gates.
"""

from __future__ import annotations

import numpy as np


def squash(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x)
    scale += 1
    return np.divide(x, scale, out=scale)


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of squash, from its value."""
    return (1 - np.abs(y)) ** 2


def initial(rng: np.random.Generator, symbols: int, hidden: int, scale: float = 0.3) -> dict[str, np.ndarray]:
    return {
        "table": (rng.normal(size=(symbols, 3 * hidden)) * scale).astype(np.float32),
        "gates": (rng.normal(size=(hidden, 2 * hidden)) * hidden**-0.5).astype(np.float32),
        "state": (rng.normal(size=(hidden, hidden)) * hidden**-0.5).astype(np.float32),
    }


def forward(table: np.ndarray, gates: np.ndarray, state: np.ndarray, x: np.ndarray, saved: list | None = None) -> np.ndarray:
    """States (T, N, H) for the sequences in the columns of x (T, N), starting from zero.

    saved, if given, gets what backward() needs.
    """
    hidden = len(state)
    h = np.zeros((x.shape[1], hidden), dtype=np.float32)
    out = np.empty((*x.shape, hidden), dtype=np.float32)
    for t, symbols in enumerate(x):
        g = np.take(table, symbols, axis=0)
        a = g[:, : 2 * hidden]
        a += h @ gates
        a = squash(a)
        a *= 0.5
        a += 0.5
        z, r = a[:, :hidden], a[:, hidden:]
        c = g[:, 2 * hidden :]
        c += (r * h) @ state
        c = squash(c)
        if saved is not None:
            saved.append((h, z, r, c))
        change = c - h
        change *= z
        h = h + change
        out[t] = h
    return out


def backward(gates: np.ndarray, state: np.ndarray, saved: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the gathered rows (T, N, 3H), of gates and of state, for those of the states."""
    d_rows = np.empty((*d_out.shape[:2], 3 * d_out.shape[2]), dtype=np.float32)
    d_gates, d_state = np.zeros_like(gates), np.zeros_like(state)
    carried = np.zeros_like(d_out[0])
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, c = saved[t]
        d = d_out[t] + carried
        d_c = d * z * slope(c)
        d_rh = d_c @ state.T
        d_z = d * (c - h) * 0.5 * slope(2 * z - 1)
        d_r = d_rh * h * 0.5 * slope(2 * r - 1)
        d_a = np.concatenate([d_z, d_r], axis=1)
        d_rows[t] = np.concatenate([d_a, d_c], axis=1)
        d_gates += h.T @ d_a
        d_state += (r * h).T @ d_c
        carried = d * (1 - z) + d_rh * r + d_a @ gates.T
    return d_rows, d_gates, d_state


def gathered(symbols: int, x: np.ndarray, d_rows: np.ndarray) -> np.ndarray:
    """Sum gradients of gathered rows by symbol."""
    flat, rows = x.reshape(-1), d_rows.reshape(-1, d_rows.shape[-1])
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    out = np.zeros((symbols, rows.shape[1]), dtype=np.float32)
    out[names] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.n = weights, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray], norm: float = 1.0) -> None:
        size = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        shrink = min(1.0, norm / (size + 1e-12))
        self.n += 1
        for k, g in grads.items():
            g = g * shrink
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            m, v = self.first[k] / (1 - 0.9**self.n), self.second[k] / (1 - 0.99**self.n)
            self.weights[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
