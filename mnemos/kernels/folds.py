"""Order-dependent updates of one trace or one group, and of many traces a step at a time: plain loops over arrays, no Spark."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from mnemos.config import EPS, FIELD, FieldConfig


def uncertainty(var: np.ndarray, evidence: float, loss: float, f: FieldConfig = FIELD) -> float:
    return float(np.clip(var, f.sigma_floor, f.sigma_ceiling).mean() + f.kappa_evidence / (evidence + EPS) + f.kappa_pred * loss)


def stability(old: float, evidence: float, unc: float, loss: float, f: FieldConfig = FIELD) -> float:
    target = 1.0 / (1.0 + math.exp(-(math.log(evidence + EPS) - unc - loss)))
    return float(np.clip((1 - f.eta_stability) * old + f.eta_stability * target, 0.0, 1.0))


def _pull(mu: np.ndarray, var: np.ndarray, x: np.ndarray, rate: float, spread: float, against_old: bool, f: FieldConfig) -> tuple[np.ndarray, np.ndarray]:
    """The mean moved toward x, and the variance by the distance from the old or the new mean."""
    new = mu + rate * (x - mu)
    ref = mu if against_old else new
    return new, np.clip((1 - spread) * var + spread * (x - ref) ** 2, f.sigma_floor, f.sigma_ceiling)


def push(arr: list[str], item: str, size: int) -> list[str]:
    return [*(a for a in arr if a != item), item][-size:]


def reconsolidate(t: dict, steps: list[dict], f: FieldConfig = FIELD) -> dict:
    """A trace after replayed observations in order: r (responsibility), x, c, loss, ts, anchor_id.

    z variance is taken against the old mean, context variance against the new one.
    """
    t = dict(t)
    for s in steps:
        r = min(max(float(s["r"]), 0.0), 1.0)
        if r <= EPS:
            continue
        t["evidence"] = f.evidence_decay * t["evidence"] + r
        t["z_mu"], t["z_sigma_diag"] = _pull(t["z_mu"], t["z_sigma_diag"], s["x"], f.eta_mu * r / (1 + f.lambda_stability * t["stability"]), f.eta_sigma * r, True, f)
        t["ctx_mu"], t["ctx_sigma_diag"] = _pull(t["ctx_mu"], t["ctx_sigma_diag"], s["c"], f.eta_ctx * r, f.eta_sigma * r, False, f)
        t["pred_loss_ema"] = 0.95 * t["pred_loss_ema"] + 0.05 * max(float(s["loss"]), 0.0)
        t["uncertainty"] = uncertainty(t["z_sigma_diag"], t["evidence"], t["pred_loss_ema"], f)
        t["stability"] = stability(t["stability"], t["evidence"], t["uncertainty"], t["pred_loss_ema"], f)
        t["last_access_ts"] = float(s["ts"])
        if s["anchor_id"] is not None:
            t["anchor_reservoir"] = push(list(t["anchor_reservoir"]), s["anchor_id"], f.reservoir_size)
    return t


def apply_action(t: dict, s: dict, f: FieldConfig = FIELD) -> dict:
    """A trace after ASSIMILATE or ATTACH of s (action, x, c, ts, anchor_id); a SPLIT touches only access and reservoir."""
    t = dict(t)
    t["last_access_ts"], t["access_ema"] = float(s["ts"]), 0.99 * t["access_ema"] + 1.0
    t["anchor_reservoir"] = push(list(t["anchor_reservoir"]), s["anchor_id"], f.reservoir_size)
    if s["action"] == "SPLIT":
        return t
    if s["action"] == "ASSIMILATE":
        eta = f.eta_mu / (1 + f.lambda_stability * t["stability"])
        t["z_mu"], t["z_sigma_diag"] = _pull(t["z_mu"], t["z_sigma_diag"], s["x"], eta, eta, True, f)
    t["ctx_mu"], t["ctx_sigma_diag"] = _pull(t["ctx_mu"], t["ctx_sigma_diag"], s["c"], f.eta_ctx, f.eta_ctx, False, f)
    t["evidence"] = f.evidence_decay * t["evidence"] + 1.0
    t["uncertainty"] = uncertainty(t["z_sigma_diag"], t["evidence"], t["pred_loss_ema"], f)
    t["stability"] = stability(t["stability"], t["evidence"], t["uncertainty"], t["pred_loss_ema"], f)
    return t


def _rounds(at: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """How many traces (in order: those of more steps come first) have a first, a second, ... step, and which steps these are."""
    n, first = np.diff(at)[order], at[:-1][order]
    for k in range(int(n.max(initial=0))):
        m = int(np.searchsorted(-n, -k))
        yield m, first[:m] + k


def _judge_many(t: dict, on: slice | np.ndarray, f: FieldConfig) -> None:
    """uncertainty() and stability() of the traces at `on`."""
    loss, evidence = t["pred_loss_ema"][on], t["evidence"][on]
    t["uncertainty"][on] = unc = np.clip(t["z_sigma_diag"][on], f.sigma_floor, f.sigma_ceiling).mean(axis=1) + f.kappa_evidence / (evidence + EPS) + f.kappa_pred * loss
    target = 1.0 / (1.0 + np.exp(-(np.log(evidence + EPS) - unc - loss)))
    t["stability"][on] = np.clip((1 - f.eta_stability) * t["stability"][on] + f.eta_stability * target, 0.0, 1.0)


def pushed(arr: list[str], items: list[str], size: int) -> list[str]:
    """push() of all items in turn: the last `size` by their last place."""
    if not items:
        return arr
    if len(set(arr)) < len(arr):
        for item in items:
            arr = push(arr, item, size)
        return arr
    last: dict[str, None] = {}
    for item in reversed(items):
        last.setdefault(item)
        if len(last) == size:
            break
    else:
        for item in reversed(arr):
            last.setdefault(item)
    return list(last)[:size][::-1]


def _fold_many(t: dict, at: np.ndarray, step: Callable[[dict, int, np.ndarray], None], items: Callable[[int], list], f: FieldConfig) -> dict:
    """Traces (arrays) after their steps, of which at[i] to at[i + 1] are trace i's. step changes the first m traces by the steps i."""
    order = np.argsort(-np.diff(at), kind="stable")
    back = np.argsort(order, kind="stable")
    held = {k: v[order] for k, v in t.items() if k != "anchor_reservoir"}
    for m, i in _rounds(at, order):
        step(held, m, i)
    return {k: v[back] for k, v in held.items()} | {"anchor_reservoir": [pushed(a, items(k), f.reservoir_size) for k, a in enumerate(t["anchor_reservoir"])]}


def reconsolidate_many(t: dict, s: dict, at: np.ndarray, f: FieldConfig = FIELD) -> dict:
    """reconsolidate() of many traces (arrays, a row for each; reservoirs are lists) over their steps (arrays, in order)."""
    r = np.clip(s["r"], 0.0, 1.0)
    go = ~(r <= EPS)
    at = np.concatenate([[0], np.cumsum(go)])[at]
    r, x, c, loss, ts = (v[go] for v in (r, s["x"], s["c"], np.maximum(s["loss"], 0.0), s["ts"]))
    anchor = [a for a, g in zip(s["anchor_id"], go.tolist()) if g]

    def step(t: dict, m: int, i: np.ndarray) -> None:
        on, own = slice(m), r[i]
        t["evidence"][on] = f.evidence_decay * t["evidence"][on] + own
        t["z_mu"][on], t["z_sigma_diag"][on] = _pull(t["z_mu"][on], t["z_sigma_diag"][on], x[i], (f.eta_mu * own / (1 + f.lambda_stability * t["stability"][on]))[:, None], (f.eta_sigma * own)[:, None], True, f)
        t["ctx_mu"][on], t["ctx_sigma_diag"][on] = _pull(t["ctx_mu"][on], t["ctx_sigma_diag"][on], c[i], (f.eta_ctx * own)[:, None], (f.eta_sigma * own)[:, None], False, f)
        t["pred_loss_ema"][on] = 0.95 * t["pred_loss_ema"][on] + 0.05 * loss[i]
        _judge_many(t, on, f)
        t["last_access_ts"][on] = ts[i]

    return _fold_many(t, at, step, lambda k: [a for a in anchor[at[k] : at[k + 1]] if a is not None], f)


def apply_actions_many(t: dict, s: dict, at: np.ndarray, f: FieldConfig = FIELD) -> dict:
    """apply_action() of many traces over their steps, as reconsolidate_many."""
    action = np.array(s["action"], dtype=object)
    split, assimilate = action == "SPLIT", action == "ASSIMILATE"

    def step(t: dict, m: int, i: np.ndarray) -> None:
        t["last_access_ts"][:m], t["access_ema"][:m] = s["ts"][i], 0.99 * t["access_ema"][:m] + 1.0
        on = np.flatnonzero(assimilate[i])
        eta = (f.eta_mu / (1 + f.lambda_stability * t["stability"][on]))[:, None]
        t["z_mu"][on], t["z_sigma_diag"][on] = _pull(t["z_mu"][on], t["z_sigma_diag"][on], s["x"][i[on]], eta, eta, True, f)
        on = np.flatnonzero(~split[i])
        t["ctx_mu"][on], t["ctx_sigma_diag"][on] = _pull(t["ctx_mu"][on], t["ctx_sigma_diag"][on], s["c"][i[on]], f.eta_ctx, f.eta_ctx, False, f)
        t["evidence"][on] = f.evidence_decay * t["evidence"][on] + 1.0
        _judge_many(t, on, f)

    return _fold_many(t, at, step, lambda k: s["anchor_id"][at[k] : at[k + 1]], f)


def option_edge(weight: float, alpha: float, beta: float, exists: bool, temporal: float, successes: list[float], rate: float = 0.15, grow: float = 0.0) -> dict:
    """An option edge after successes in order. One is taken if it exceeds 0.7 and lowers the objective: storage 0.05 *
    0.115, complexity 0.03 * 0.15 and drift 0.08 * (1 - support), where support is the larger of temporal and option. grow:
    what each step adds to the temporal edge before its success is judged."""
    taken = 0
    for s in successes:
        temporal = 0.95 * temporal + grow if grow else temporal
        if s <= 0.70:
            continue
        support = min(max(temporal, alpha / max(alpha + beta, EPS) if exists else 0.0, 0.0), 1.0)
        cost = 0.0 if exists else 0.05 * 0.115 + 0.03 * 0.15
        if not cost + 0.08 * (1 - max(support, s)) < 0.08 * (1 - support):
            continue
        weight = 0.95 * weight + 0.5 * rate * s if exists else 0.5 * rate * s
        alpha, beta, exists, taken = 0.98 * alpha + s, 0.98 * beta + (1 - s), True, taken + 1
    return {"weight": weight, "success_alpha": alpha, "success_beta": beta, "exists": exists, "taken": taken}


def log_density(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> float:
    v = np.clip(var, 1e-4, 1e4)
    return float(-0.5 * (((x - mu) ** 2 / v).sum() + np.log(v).sum() + x.size * math.log(2 * math.pi)))


def group_slice(g: dict, mu: np.ndarray, var: np.ndarray, x: np.ndarray, c: np.ndarray, f: FieldConfig = FIELD) -> np.ndarray:
    """Probabilities of a group's members, and last of its null slot."""
    n = len(mu)
    s = np.array([math.log(g["alpha"][i] + EPS) + log_density(c, g["ctx_mu"][i], g["ctx_sigma_diag"][i]) for i in range(n + 1)])
    s[:n] += [log_density(x, mu[i], var[i]) + 0.15 * math.log(g["pred_success_ema"][i] + EPS) for i in range(n)]
    s[n] += log_density(x, np.zeros_like(x), np.full_like(x, f.null_sigma))
    e = np.exp((s - s.max()) / max(g["temperature"], 1e-4))
    return e / e.sum()


def update_group(g: dict, mu: np.ndarray, var: np.ndarray, x: np.ndarray, c: np.ndarray, anchor_id: str, known: bool, loss: float | None = None, f: FieldConfig = FIELD) -> tuple[dict, np.ndarray]:
    """A group after one observation, and the factor by which each member's variance grows (1: not at all).

    mu and var are the members' means and variances. known: the anchor is in the anchor table.
    """
    p, n = group_slice(g, mu, var, x, c, f), len(mu)
    g = dict(g)
    w = p[:n, None]
    ctx, sig = g["ctx_mu"].copy(), g["ctx_sigma_diag"].copy()
    ctx[:n] += 0.10 * w * (c - ctx[:n])
    sig[:n] = np.clip((1 - 0.10 * w) * sig[:n] + 0.10 * w * (c - ctx[:n]) ** 2, f.sigma_floor, f.sigma_ceiling)
    fit = np.array([math.exp(log_density(x, mu[i], var[i]) / max(x.size, 1)) for i in range(n)])
    fit = fit if loss is None else np.maximum(fit, math.exp(-loss))
    success = np.array(g["pred_success_ema"], dtype=np.float64)
    success[:n] = 0.95 * success[:n] + 0.05 * p[:n] * fit
    q = np.clip(p, EPS, 1.0)
    q = q / q.sum()
    h = float(-(q * np.log(q)).sum())
    mass = 0.95 * g["unresolved_mass"] + p[n]
    g |= {"alpha": 0.995 * np.asarray(g["alpha"]) + p, "ctx_mu": ctx, "ctx_sigma_diag": sig, "pred_success_ema": success, "unresolved_mass": float(mass)}
    if p[n] > 0.25 and known:
        g["ambiguous_buffer"] = [*g["ambiguous_buffer"], anchor_id][-16:]
        if "ambiguous_ctx_buffer" in g:
            g["ambiguous_ctx_buffer"] = [*g["ambiguous_ctx_buffer"], c.tolist()][-16:]
    if "replay_alignment_ema" in g:
        g["replay_alignment_ema"] = 0.98 * g["replay_alignment_ema"] + 0.02 * max(loss or 0.0, 0.0)
    g["temperature"] = float(np.clip(g["temperature"] + 0.05 * (h - 0.75 * math.log(n + 1)), 0.5, 2.0))
    g["replay_tension_ema"] = 0.98 * g["replay_tension_ema"] + 0.02 * (h + g["unresolved_mass"])
    return g, 1 + 0.03 * p[:n] if p[n] > 0.25 else np.ones(n)
