"""Signed feature hashing of byte windows."""

from __future__ import annotations

import hashlib

import numpy as np

WINDOW = 4
DIGEST = 8


def encode_batch(texts: list[str | None], dim: int) -> np.ndarray:
    """A unit vector for each text; a null or empty one is zero.

    Each byte offset starts a window of up to 4 bytes. Its 8-byte BLAKE2b digest gives the slot (first 4 bytes, big
    endian, modulo dim), the sign (parity of byte 4) and the weight 1 + byte 5 / 255. Distinct windows are hashed once.
    """
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    windows: dict[bytes, int] = {}
    spans = []
    for raw in raws:
        spans.append([windows.setdefault(raw[i : i + WINDOW], len(windows)) for i in range(len(raw))])
    slots, values = np.empty(len(windows), dtype=np.int64), np.empty(len(windows))
    for w, k in windows.items():
        d = hashlib.blake2b(w, digest_size=DIGEST).digest()
        slots[k] = int.from_bytes(d[:4], "big") % dim
        values[k] = (1.0 if d[4] % 2 == 0 else -1.0) * (1.0 + d[5] / 255.0)
    out = np.zeros((len(texts), dim))
    for row, span in zip(out, spans):
        if span:
            np.add.at(row, slots[span], values[span])
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norms > 0, out / np.maximum(norms, 1e-300), out)
