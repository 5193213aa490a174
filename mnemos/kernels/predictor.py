"""A gated one-step transition model: forward pass, loss and gradients in NumPy."""

from __future__ import annotations

import numpy as np

LOW, HIGH = -4.0, 2.0


def init(inputs: int, hidden: int, latent: int, seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda a, b: r.uniform(-1, 1, size=(a, b)) / np.sqrt(a)
    return {"wp": draw(inputs, hidden), "bp": np.zeros(hidden), "wg": draw(inputs, hidden), "bg": np.zeros(hidden), "wm": draw(hidden, latent), "bm": np.zeros(latent), "ws": draw(hidden, latent), "bs": np.zeros(latent)}


def forward(m: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Mean and log variance of what comes next, with no memory of earlier steps (h0 = 0)."""
    gate, prop = 1 / (1 + np.exp(-(x @ m["wg"] + m["bg"]))), np.tanh(x @ m["wp"] + m["bp"])
    h = gate * prop
    raw = h @ m["ws"] + m["bs"]
    return h @ m["wm"] + m["bm"], np.clip(raw, LOW, HIGH), (gate, prop, h, raw)


def nll(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over dimensions of half the squared error by variance plus log variance, without the constant."""
    mu, ls, _ = forward(m, x)
    return 0.5 * ((y - mu) ** 2 * np.exp(-ls) + ls).sum(axis=1)


def gradient(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Sums over rows, so that those of partitions add up."""
    mu, ls, (gate, prop, h, raw) = forward(m, x)
    inv = np.exp(-ls)
    dmu = (mu - y) * inv
    dls = 0.5 * (1 - (y - mu) ** 2 * inv) * ((raw > LOW) & (raw < HIGH))
    dh = dmu @ m["wm"].T + dls @ m["ws"].T
    dp, dg = dh * gate * (1 - prop**2), dh * prop * gate * (1 - gate)
    return {"wp": x.T @ dp, "bp": dp.sum(0), "wg": x.T @ dg, "bg": dg.sum(0), "wm": h.T @ dmu, "bm": dmu.sum(0), "ws": h.T @ dls, "bs": dls.sum(0)}, float(nll(m, x, y).sum())
