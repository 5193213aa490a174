"""The objective of one patch under each action, from one set of base logits; arrays only, no Spark.

Actions replace one trace by a moved copy (ASSIMILATE, ATTACH) or add a child (BIRTH, SPLIT). A sum over traces without
the replaced one is kept for each (log domain, so nothing cancels), and an action adds its one new term to it: 1 + 3N
objectives cost O(observations * N * N) after the 4N densities, and no shadow state is ever built as rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from mnemos.config import EPS, FIELD, FieldConfig

INIT_VAR, INIT_CTX_VAR = 0.40, 0.60
#: Weights of the objective's terms, and of the terms an inhibiting edge adds.
SURPRISE, STORAGE, COMPLEXITY, PLASTICITY, ALIGNMENT, DRIFT, GROUP, FIDELITY, ROLE = 1.0, 0.05, 0.03, 0.10, 0.18, 0.08, 0.25, 0.05, 0.03
INHIBIT_GAIN, CONTINUATION = 0.30, 0.50
NAMES = ("surprise", "storage", "complexity", "plasticity", "slow_alignment", "drift", "group_kl", "fidelity", "role", "inhibit_bonus")
_WEIGHTS = np.array([SURPRISE, STORAGE, COMPLEXITY, PLASTICITY, ALIGNMENT, DRIFT, GROUP, FIDELITY, ROLE, 1.0])
KINDS = ("ASSIMILATE", "ATTACH", "SPLIT")


@dataclass
class Patch:
    """N candidates (rows of arrays), O observations of which the anchor is the first, and what edges and groups charge."""

    z: np.ndarray
    var: np.ndarray
    ctx: np.ndarray
    ctx_var: np.ndarray
    evidence: np.ndarray
    stability: np.ndarray
    uncertainty: np.ndarray
    pred_loss: np.ndarray
    fidelity: np.ndarray
    storage: np.ndarray
    fidelity_cost: np.ndarray
    role_cost: np.ndarray
    alignment: np.ndarray
    drift: np.ndarray
    x: np.ndarray
    c: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    target_var: np.ndarray
    has_target: np.ndarray
    extra_storage: float = 0.0
    extra_complexity: float = 0.0
    extra_drift: float = 0.0
    groups: tuple[dict, ...] = ()


def _density(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log densities (O, N) of x (O, d) under N diagonal Gaussians, as matrix products."""
    v = np.clip(var, 1e-4, 1e4)
    w = 1.0 / v
    far = (x * x) @ w.T - 2 * x @ (mu * w).T + (mu * mu * w).sum(1)
    return -0.5 * (far + np.log(v).sum(1) + x.shape[1] * math.log(2 * math.pi))


def _isotropic(x: np.ndarray, var: float) -> np.ndarray:
    return -0.5 * ((x * x).sum(1) / var + x.shape[1] * (math.log(var) + math.log(2 * math.pi)))


def _prior(evidence, stability, uncertainty) -> np.ndarray:
    return np.log(evidence + EPS) + 0.75 * stability - 0.50 * uncertainty


def _uncertainty(var: np.ndarray, evidence, loss, f: FieldConfig) -> np.ndarray:
    return np.clip(var, f.sigma_floor, f.sigma_ceiling).mean(-1) + f.kappa_evidence / (evidence + EPS) + f.kappa_pred * loss


def _without(logits: np.ndarray) -> np.ndarray:
    """logsumexp of each row without each of its entries: (O, N), -inf where nothing is left."""
    o, n = logits.shape
    if n == 1:
        return np.full((o, 1), -np.inf)
    first = logits.argmax(1)
    top = logits[np.arange(o), first]
    rest = np.exp(logits - top[:, None])
    out = top[:, None] + np.log(np.maximum(rest.sum(1, keepdims=True) - rest, 1e-300))
    others = np.where(np.arange(n) == first[:, None], -np.inf, logits)
    second = others.max(1)
    out[np.arange(o), first] = second + np.log(np.exp(others - second[:, None]).sum(1))
    return out


def _kl(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, q = np.clip(p, EPS, 1.0), np.clip(q, EPS, 1.0)
    p, q = p / p.sum(-1, keepdims=True), q / q.sum(-1, keepdims=True)
    return (p * (np.log(p) - np.log(q))).sum(-1)


def _slice(scores: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((scores - scores.max(-1, keepdims=True)) / max(temperature, 1e-4))
    return e / e.sum(-1, keepdims=True)


def log_bayes_factor(p: Patch, i: int, j: int) -> float:
    """Evidence for two traces against their merger, at the anchor."""
    x, c, e, pair = p.x[:1], p.c[:1], p.evidence[[i, j]], [i, j]
    own = _prior(e, p.stability[pair], p.uncertainty[pair]) + _density(c, p.ctx[pair], p.ctx_var[pair])[0] + _density(x, p.z[pair], p.var[pair])[0]
    total = max(e.sum(), EPS)
    share = (e / total)[:, None]
    joined = lambda mu, var: (m := (share * mu).sum(0), (share * (var + (mu - m) ** 2)).sum(0))
    (z, v), (k, kv) = joined(p.z[pair], p.var[pair]), joined(p.ctx[pair], p.ctx_var[pair])
    merged = math.log(total + EPS) + _density(c, k[None], kv[None])[0, 0] + _density(x, z[None], v[None])[0, 0]
    return float(np.logaddexp(*own) - merged)


class Scores:
    """Objectives of a patch's actions: BIRTH at 0, then ASSIMILATE, ATTACH and SPLIT of each candidate in turn.

    terms is (1 + 3N, terms); base is the objective without any action; pair and inhibit say which traces an action would
    also set against each other.
    """

    def __init__(self, p: Patch, f: FieldConfig = FIELD) -> None:
        self.patch, n = p, len(p.z)
        x, c = p.x, p.c
        null = _isotropic(x, f.null_sigma) + _isotropic(c, f.null_sigma)
        w = np.maximum(p.weight, EPS)
        self.w = w / w.sum()
        own_x, own_c = x[0], c[0]
        # the four kinds of shadows
        eta = (f.eta_mu / (1 + f.lambda_stability * p.stability))[:, None]
        z1 = p.z + eta * (own_x - p.z)
        v1 = np.clip((1 - eta) * p.var + eta * (own_x - p.z) ** 2, f.sigma_floor, f.sigma_ceiling)
        c1 = p.ctx + f.eta_ctx * (own_c - p.ctx)
        cv1 = np.clip((1 - f.eta_ctx) * p.ctx_var + f.eta_ctx * (own_c - c1) ** 2, f.sigma_floor, f.sigma_ceiling)
        ev1 = f.evidence_decay * p.evidence + 1.0
        sv = np.clip(np.minimum(INIT_VAR, 0.5 * p.var), f.sigma_floor, f.sigma_ceiling)
        sc = np.clip(p.ctx_var, f.sigma_floor, f.sigma_ceiling)
        near, at_x, at_c1 = _density(c, p.ctx, p.ctx_var), _density(x, p.z, p.var), _density(c, c1, cv1)
        base = _prior(p.evidence, p.stability, p.uncertainty) + near + at_x
        assimilated = _prior(ev1, p.stability, _uncertainty(v1, ev1, p.pred_loss, f)) + at_c1 + (moved := _density(x, z1, v1))
        attached = _prior(ev1, p.stability, _uncertainty(p.var, ev1, p.pred_loss, f)) + at_c1 + at_x
        born = _prior(1.0, 0.0, _uncertainty(np.full(x.shape[1], INIT_VAR), 1.0, 0.0, f)) + _density(c, own_c[None], np.full((1, c.shape[1]), INIT_CTX_VAR))[:, 0] + _density(x, own_x[None], np.full((1, x.shape[1]), INIT_VAR))[:, 0]
        child = _prior(1.0, 0.0, _uncertainty(sv, 1.0, 0.0, f)) + _density(c, p.ctx, sc) + _density(x, np.repeat(own_x[None], n, 0), sv)
        # log totals: of all, without each, and of each action
        total = np.logaddexp.reduce(base, axis=1) if n else np.full(len(x), -np.inf)
        rest = _without(base) if n else base
        with np.errstate(invalid="ignore"):
            others = np.exp(base[:, None, :] - rest[:, :, None])  # shares of s where t is left out
        others[:, np.arange(n), np.arange(n)] = 0.0
        if n == 1:
            others[:] = 0.0
        kept = np.exp(base - total[:, None]) if n else base
        sums = [np.logaddexp(rest, assimilated), np.logaddexp(rest, attached), np.logaddexp(total[:, None], child)]
        # shares of the traces (a trace's own entry is the moved one's) and of the child, by kind: (O, t, s) and (O, t)
        shares, of_child = [], []
        for s, new in zip(sums[:2], (assimilated, attached)):
            share = others * np.exp(rest - s)[:, :, None]
            share[:, np.arange(n), np.arange(n)] = np.exp(new - s)
            shares.append(share)
            of_child.append(np.zeros_like(s))
        shares.append(kept[:, None, :] * np.exp(total[:, None] - sums[2])[:, :, None])
        of_child.append(np.exp(child - sums[2]))
        birth_sum = np.logaddexp(total, born)
        birth = kept * np.exp(total - birth_sum)[:, None] if n else kept
        birth_child = np.exp(born - birth_sum)
        # stacked: (O, 1 + 3N, N) and (O, 1 + 3N), BIRTH first and the kinds of a candidate side by side
        stack = lambda one, three: np.concatenate([one[:, None], np.stack(three, axis=2).reshape(len(x), 3 * n, *three[0].shape[2:])], axis=1)
        self.shares, self.of_child = stack(birth, shares), stack(birth_child, of_child)
        logs = stack(birth_sum, sums)
        self.terms = np.zeros((1 + 3 * n, len(NAMES)))
        self.terms[:, 0] = self.w @ -np.logaddexp(logs, null[:, None])
        kind = np.arange(3 * n) % 3
        at = np.arange(3 * n) // 3
        fidelity = np.maximum(p.fidelity, 0.85)
        child_storage = f.base_trace_cost * (0.35 + 0.65 * np.clip(fidelity, 0, 1))
        split, moved_ = kind == 2, kind == 0
        self.terms[:, 1] = p.storage.sum() + p.extra_storage
        self.terms[0, 1] += 2 * f.base_trace_cost  # the child and the extra trace
        self.terms[1:, 1] += split * (child_storage[at] + f.base_trace_cost + f.base_edge_cost) if n else 0
        self.terms[:, 2] = p.extra_complexity
        plastic = p.stability * ((z1 - p.z) ** 2).mean(1) if n else np.zeros(0)
        self.terms[1:, 3] = moved_ * plastic[at] if n else 0
        future = self.w @ (self.shares @ p.alignment) if n else np.zeros(1)
        self.terms[:, 4] = self._immediate(z1, own_x) + CONTINUATION * future
        self.terms[:, 5] = self.terms[:, 3] + p.extra_drift + CONTINUATION * (self.w @ (self.shares @ p.drift) if n else 0)
        self.terms[:, 6] = self._group_kl(moved, at, moved_, f)
        self.terms[:, 7] = p.fidelity_cost.sum()
        self.terms[1:, 7] += split * np.maximum(0, 1 - fidelity)[at] if n else 0
        self.terms[:, 8] = p.role_cost.sum()
        self.base_terms = self._without_action(kept, total, null, f) if n else None
        self.pairs: list[tuple[int, int] | None] = [None] * (1 + 3 * n)
        self._inhibit(f)
        self.totals = self.terms @ _WEIGHTS
        self.base = float(self.base_terms @ _WEIGHTS) if n else None

    def _immediate(self, z1: np.ndarray, own_x: np.ndarray) -> np.ndarray:
        """Loss of the targets under the mixtures' means, over what has a target."""
        p, n, out = self.patch, len(self.patch.z), np.zeros(len(self.terms))
        counted = max(float(np.maximum(p.weight, EPS)[p.has_target].sum()), 1.0)
        for o in np.flatnonzero(p.has_target):
            mean = self.shares[o] @ p.z + self.of_child[o][:, None] * own_x if n else self.of_child[o][:, None] * own_x
            for t in range(n):
                mean[1 + 3 * t] += self.shares[o, 1 + 3 * t, t] * (z1[t] - p.z[t])
            out += max(p.weight[o], EPS) / counted * self._loss(o, mean)
        return out

    def _loss(self, o: int, mean: np.ndarray) -> np.ndarray:
        v = np.clip(self.patch.target_var[o], 1e-4, 1e4)
        far = ((self.patch.target[o] - mean) ** 2 / v).sum(-1) + np.log(v).sum() + len(v) * math.log(2 * math.pi)
        return 0.5 * far / max(len(v), 1)

    def _slices(self, g: dict, f: FieldConfig) -> np.ndarray:
        """Scores (O, members + null) of a group; a member that is gone has -inf."""
        p = self.patch
        context = np.log(g["alpha"] + EPS) + _density(p.c, g["ctx_mu"], g["ctx_var"])
        out = np.full_like(context, -np.inf)
        live = np.flatnonzero(g["live"])
        out[:, live] = context[:, live] + _density(p.x, g["z"][live], g["var"][live]) + 0.15 * np.log(g["success"][live] + EPS)
        out[:, -1] = context[:, -1] + _isotropic(p.x, f.null_sigma)
        return out

    def _group_kl(self, moved: np.ndarray, at: np.ndarray, assimilates: np.ndarray, f: FieldConfig) -> np.ndarray:
        """moved: density (O, t) of x under the assimilated trace t, which changes t's place in its groups' slices."""
        out = np.zeros(len(self.terms))
        for g in self.patch.groups:
            here = np.flatnonzero(g["at"] >= 0)
            if len(here) < 2:
                continue
            own = g["at"][here]
            scores = self._slices(g, f)
            target = np.repeat(_slice(scores, g["temperature"])[:, None], len(out), 1)
            for m, t in zip(here, own):
                other = scores.copy()
                other[:, m] += moved[:, t] - _density(self.patch.x, g["z"][m : m + 1], g["var"][m : m + 1])[:, 0]
                target[:, 1 + 3 * t] = _slice(other, g["temperature"])
            now = self.shares[:, :, own]
            now = np.concatenate([now, np.maximum(1 - now.sum(-1, keepdims=True), EPS)], axis=-1)
            out += self.w @ (_kl(now, np.concatenate([target[:, :, here], target[:, :, -1:]], axis=-1)) + g["tension"])
        return out

    def _without_action(self, kept: np.ndarray, total: np.ndarray, null: np.ndarray, f: FieldConfig) -> np.ndarray:
        p = self.patch
        out = np.zeros(len(NAMES))
        out[0] = self.w @ -np.logaddexp(total, null)
        out[1], out[2], out[7], out[8] = p.storage.sum() + p.extra_storage, p.extra_complexity, p.fidelity_cost.sum(), p.role_cost.sum()
        counted = max(float(np.maximum(p.weight, EPS)[p.has_target].sum()), 1.0)
        loss = sum(max(p.weight[o], EPS) / counted * float(self._loss(o, kept[o] @ p.z)) for o in np.flatnonzero(p.has_target))
        out[4] = loss + CONTINUATION * self.w @ (kept @ p.alignment)
        out[5] = p.extra_drift + CONTINUATION * self.w @ (kept @ p.drift)
        for g in p.groups:
            here = np.flatnonzero(g["at"] >= 0)
            if len(here) >= 2:
                now = kept[:, g["at"][here]]
                now = np.concatenate([now, np.maximum(1 - now.sum(-1, keepdims=True), EPS)], axis=-1)
                target = _slice(self._slices(g, f), g["temperature"])
                out[6] += self.w @ (_kl(now, np.concatenate([target[:, here], target[:, -1:]], axis=-1)) + g["tension"])
        return out

    def _inhibit(self, f: FieldConfig) -> None:
        """Where an action's top two traces are nearly even, setting them against each other may pay."""
        n = len(self.patch.z)
        if n < 2:
            return
        means = np.concatenate([np.einsum("o,oas->as", self.w, self.shares), (self.w @ self.of_child)[:, None]], axis=1)
        known: dict[tuple[int, int], float] = {}
        for a, row in enumerate(means):
            i, j = np.argsort(-row, kind="stable")[:2].tolist()
            if row[i] - row[j] > f.inhibit_margin or n in (i, j):
                continue
            key = (min(i, j), max(i, j))
            if key not in known:
                known[key] = -INHIBIT_GAIN * max(0.0, log_bayes_factor(self.patch, *key)) + STORAGE * f.base_edge_cost + COMPLEXITY * 0.1
            if known[key] < 0:
                self.terms[a, 9], self.pairs[a] = known[key], (i, j)

    def best(self) -> int:
        """The least objective; the first of equals."""
        return int(self.totals.argmin())
