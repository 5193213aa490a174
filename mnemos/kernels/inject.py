"""One session's ordered inject loop: candidates, action by objective, update, settled workspace, edges, frame.

Stated limits: what is predicted next is the session's last workspace summary with unit variance (no recurrent model), and
a session keeps no posterior groups; groups are proposed and updated by the set-shaped operators.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np

from mnemos.config import EDGE_KIND_COST, EPS, FIELD, FieldConfig
from mnemos.kernels import folds
from mnemos.kernels.settle import SettleConfig, settle

WINDOW = 12
_VECTORS = ("z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag")


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v if n < EPS else v / n


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), EPS))


def new_trace(trace_id: str, x: np.ndarray, c: np.ndarray, ts: float, anchor_id: str, var: np.ndarray | None = None, ctx_var: np.ndarray | None = None) -> dict:
    t = {"trace_id": trace_id, "z_mu": x.copy(), "z_sigma_diag": np.full_like(x, 0.40) if var is None else var, "ctx_mu": c.copy(), "ctx_sigma_diag": np.full_like(c, 0.60) if ctx_var is None else ctx_var.copy(), "evidence": 1.0, "stability": 0.0, "pred_loss_ema": 0.0, "access_ema": 1.0, "last_access_ts": ts, "anchor_reservoir": [anchor_id]}
    return t | {"uncertainty": folds.uncertainty(t["z_sigma_diag"], 1.0, 0.0)}


def logit(t: dict, x: np.ndarray, c: np.ndarray) -> float:
    prior = math.log(t["evidence"] + EPS) + 0.75 * t["stability"] - 0.50 * t["uncertainty"]
    return prior + folds.log_density(c, t["ctx_mu"], t["ctx_sigma_diag"]) + folds.log_density(x, t["z_mu"], t["z_sigma_diag"])


class Session:
    """The state of a session; to_json and from_json carry it between micro-batches."""

    def __init__(self, session_id: str, dim: int, config: FieldConfig = FIELD) -> None:
        self.id, self.dim, self.f = session_id, dim, config
        self.traces: dict[str, dict] = {}
        self.edges: dict[tuple[str, str, str], float] = {}
        self.frontier: dict[str, float] = {}
        self.summary = np.zeros(dim)
        self.recent: list[dict] = []  # the last frames' x, c and touched traces
        self.last: str | None = None
        self.seq = 0

    def to_json(self) -> str:
        plain = lambda t: {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in t.items()}
        return json.dumps({"id": self.id, "dim": self.dim, "traces": [plain(t) for t in self.traces.values()], "edges": [[*k, w] for k, w in self.edges.items()], "frontier": self.frontier, "summary": self.summary.tolist(), "recent": [plain(r) for r in self.recent], "last": self.last, "seq": self.seq})

    @staticmethod
    def from_json(text: str) -> Session:
        d = json.loads(text)
        s = Session(d["id"], d["dim"])
        s.traces = {t["trace_id"]: t | {k: np.array(t[k]) for k in _VECTORS} for t in d["traces"]}
        s.edges = {(a, b, k): w for a, b, k, w in d["edges"]}
        s.frontier, s.summary, s.last, s.seq = d["frontier"], np.array(d["summary"]), d["last"], d["seq"]
        s.recent = [r | {"x": np.array(r["x"]), "c": np.array(r["c"])} for r in d["recent"]]
        return s

    def frontier_vector(self, now: float) -> np.ndarray:
        rows = [(self.traces[t], w) for t, w in self.frontier.items() if t in self.traces]
        if not rows:
            return np.zeros(self.dim)
        w = np.array([w * math.exp(-max(now - t["last_access_ts"], 0.0) / 10) * (1 + t["uncertainty"]) for t, w in rows])
        m = np.stack([t["z_mu"] for t, _ in rows])
        return m.mean(axis=0) if w.sum() <= EPS else (w[:, None] * m).sum(axis=0) / w.sum()

    def candidates(self, x: np.ndarray, c: np.ndarray) -> list[str]:
        score = lambda t: 0.60 * cosine(x, t["z_mu"]) + 0.20 * cosine(c, t["ctx_mu"]) + 0.15 * t["evidence"] - 0.10 * t["uncertainty"] + 0.25 * bool(self.id)
        ranked = sorted(((score(t), i) for i, t in self.traces.items()), reverse=True)
        return [i for _, i in ranked[: self.f.candidate_size]]

    def choose(self, x: np.ndarray, c: np.ndarray, ids: list[str], ts: float, anchor_id: str) -> tuple[str, str | None, float, float]:
        """The action of least objective, first wins: BIRTH, then ASSIMILATE, ATTACH and SPLIT of each candidate; its
        trace, its objective, and the objective of doing nothing (0 without candidates)."""
        own = [self.traces[i] for i in ids]
        wanted = set(ids)
        seen = [(x, c)] + [(r["x"], r["c"]) for r in self.recent if wanted & set(r["touched"])][-WINDOW:]
        base = np.array([[logit(t, a, b) for t in own] for a, b in seen]).reshape(len(seen), len(own))
        null = np.array([folds.log_density(a, np.zeros(self.dim), np.full(self.dim, 1.2)) + folds.log_density(b, np.zeros(self.dim), np.full(self.dim, 1.2)) for a, b in seen])
        touching = [k for k in self.edges if k[0] in wanted or k[1] in wanted]
        degree = sum(math.log1p(sum(i in (k[0], k[1]) for k in touching)) for i in ids)
        storage = float(len(own)) + sum(0.1 * EDGE_KIND_COST[k[2]] for k in touching)

        def total(shadow: dict | None, at: int | None, extra: float, plasticity: float) -> float:
            column = None if shadow is None else np.array([logit(shadow, a, b) for a, b in seen])
            if shadow is None:
                scores, mus, n = base, [t["z_mu"] for t in own], 0.0
            elif at is None:
                scores, mus, n = np.hstack([base, column[:, None]]), [*(t["z_mu"] for t in own), shadow["z_mu"]], 1.0
            else:
                scores, mus, n = base.copy(), [t["z_mu"] for t in own], 0.0
                scores[:, at], mus[at] = column, shadow["z_mu"]
            top = np.maximum(scores.max(axis=1), null)
            surprise = float(-(top + np.log(np.exp(scores - top[:, None]).sum(axis=1) + np.exp(null - top))).mean())
            resp = np.exp(scores[0] - scores[0].max())
            mean = (resp / resp.sum()) @ np.stack(mus)
            align = -folds.log_density(self.summary, mean, np.ones(self.dim)) / self.dim
            return surprise + 0.05 * (storage + n + extra) + 0.03 * (degree + 0.05 * len(touching)) + 0.10 * plasticity + 0.18 * align + 0.08 * plasticity

        best = ("BIRTH", None, total(new_trace("", x, c, ts, anchor_id), None, 1.0, 0.0))
        for at, (i, t) in enumerate(zip(ids, own)):
            for action in ("ASSIMILATE", "ATTACH", "SPLIT"):
                if action == "SPLIT":
                    value = total(new_trace("", x, t["ctx_mu"], ts, anchor_id, np.minimum(0.40, 0.5 * t["z_sigma_diag"]), t["ctx_sigma_diag"]), None, 1.1, 0.0)
                else:
                    shadow = folds.apply_action(t, {"action": action, "x": x, "c": c, "ts": ts, "anchor_id": anchor_id}, self.f) | {"stability": t["stability"]}
                    value = total(shadow, at, 0.0, t["stability"] * float(np.mean((shadow["z_mu"] - t["z_mu"]) ** 2)))
                if value < best[2]:
                    best = (action, i, value)
        return *best, total(None, None, 0.0, 0.0) if own else 0.0

    def touch(self, src: str, dst: str, kind: str, delta: float) -> None:
        old = self.edges.get((src, dst, kind))
        self.edges[src, dst, kind] = delta if old is None else self.f.edge_decay * old + delta

    def inject(self, anchor_id: str, x: np.ndarray, ts: float) -> dict:
        """Folds one anchor in and gives its frame."""
        frontier = self.frontier_vector(ts)
        c = unit(unit(x) + 0.35 * unit(frontier) + 0.25 * unit(self.summary))
        ids = self.candidates(x, c)
        action, target, energy, _ = self.choose(x, c, ids, ts, anchor_id)
        if action in ("BIRTH", "SPLIT"):
            own = "trace_" + hashlib.sha256(f"{self.id}|{anchor_id}|{self.seq}".encode()).hexdigest()[:32]
            parent = self.traces.get(target) if target else None
            self.traces[own] = new_trace(own, x, c, ts, anchor_id) if parent is None else new_trace(own, x, parent["ctx_mu"], ts, anchor_id, np.minimum(0.40, 0.5 * parent["z_sigma_diag"]), parent["ctx_sigma_diag"])
            if parent is not None:
                self.traces[target] = folds.apply_action(parent, {"action": "SPLIT", "x": x, "c": c, "ts": ts, "anchor_id": anchor_id}, self.f)
        else:
            own = target
            self.traces[own] = folds.apply_action(self.traces[own], {"action": action, "x": x, "c": c, "ts": ts, "anchor_id": anchor_id}, self.f)
        self.traces[own]["access_ema"] = 0.99 * self.traces[own]["access_ema"] + 1.0
        ids = self.candidates(x, c)
        at = {i: k for k, i in enumerate(ids)}
        bias = np.array([math.log(t["evidence"] + EPS) + 0.75 * t["stability"] - 0.5 * t["uncertainty"] + cosine(x, t["z_mu"]) + 0.35 * cosine(frontier, t["z_mu"]) + 0.25 * cosine(self.summary, t["z_mu"]) + 0.2 * folds.log_density(c, t["ctx_mu"], t["ctx_sigma_diag"]) / self.dim + 0.08 + 0.25 * bool(self.id) for t in (self.traces[i] for i in ids)])
        links = [(at[a], at[b], k, w) for (a, b, k), w in self.edges.items() if a in at and b in at]
        s = settle(bias, links, [], SettleConfig(steps=4))
        active = [i for i, a in zip(ids, s.activation) if a > 0]
        weight = {i: float(s.activation[at[i]]) for i in active}
        self.summary = sum(weight[i] * self.traces[i]["z_mu"] for i in active) / sum(weight.values())
        self.frontier = dict(sorted(weight.items(), key=lambda kv: (-kv[1], kv[0]))[: self.f.frontier_size])
        for n, a in enumerate(active):
            for b in active[n + 1 :]:
                for src, dst in ((a, b), (b, a)):
                    self.touch(src, dst, "assoc", 0.10 * math.sqrt(weight[a] * weight[b]))
        if self.last is not None:
            self.touch(self.last, own, "temporal", 0.10)
        self.last = own
        self.recent = [*self.recent, {"x": x, "c": c, "touched": [own, *active]}][-WINDOW:]
        self.seq += 1
        return {"session_id": self.id, "anchor_id": anchor_id, "seq": self.seq, "ts": ts, "action": action, "trace_id": own, "objective": float(energy), "active_ids": active, "weights": [weight[i] for i in active]}
