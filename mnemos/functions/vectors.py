"""Column functions on arrays of doubles; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemos.config import EPS, FIELD, FieldConfig


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often the body (or a lambda inside it) uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def vdot(a: Column, b: Column) -> Column:
    """Summed in index order."""
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def vadd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vscale(a: Column, k: Column | float) -> Column:
    if not isinstance(k, Column):
        return F.transform(a, lambda x: x * float(k))
    return let(k, lambda f: F.transform(a, lambda x: x * f))


def norm(a: Column) -> Column:
    return F.sqrt(vdot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unchanged where the norm is under 1e-8."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n < EPS, v).otherwise(F.transform(v, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    return vdot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_variance(a: Column, low: float = 1e-4, high: float = 1e4) -> Column:
    return F.transform(a, lambda x: clip(x, low, high))


def squared_mahalanobis(x: Column, mu: Column, var: Column) -> Column:
    diff = F.zip_with(x, mu, lambda p, q: p - q)
    return vsum(F.zip_with(diff, safe_variance(var), lambda d, v: d * d / v))


def gaussian_logpdf(x: Column, mu: Column, var: Column) -> Column:
    logs = vsum(F.transform(safe_variance(var), lambda v: F.log(v)))
    return (squared_mahalanobis(x, mu, var) + logs + F.size(x) * math.log(2 * math.pi)) * -0.5


def isotropic_logpdf(x: Column, var: float) -> Column:
    """Under a zero mean and one variance for all dimensions."""
    return (vdot(x, x) / var + F.size(x) * (math.log(var) + math.log(2 * math.pi))) * -0.5


def logsumexp(a: Column) -> Column:
    return let(F.array_max(a), lambda top: top + F.log(vsum(F.transform(a, lambda x: F.exp(x - top)))))


def softmax(a: Column, temperature: Column | float = 1.0) -> Column:
    t = F.greatest(temperature if isinstance(temperature, Column) else F.lit(float(temperature)), F.lit(EPS))
    shares = lambda e: let(vsum(e), lambda total: F.when(total <= EPS, F.transform(e, lambda _: F.lit(1.0) / F.size(e))).otherwise(F.transform(e, lambda x: x / total)))
    return let(F.array_max(a), lambda top: let(F.transform(a, lambda x: F.exp((x - top) / t)), shares))


def _probabilities(a: Column) -> Column:
    return let(F.transform(a, lambda x: clip(x, EPS, 1.0)), lambda c: let(vsum(c), lambda total: F.transform(c, lambda x: x / total)))


def entropy(a: Column) -> Column:
    return -vsum(F.transform(_probabilities(a), lambda x: x * F.log(x)))


def safe_kl(p: Column, q: Column) -> Column:
    out = vsum(F.zip_with(_probabilities(p), _probabilities(q), lambda x, y: x * (F.log(x) - F.log(y))))
    return F.when((F.size(p) == 0) | (F.size(q) == 0), 0.0).otherwise(out)


def fit_dim(a: Column, dim: int) -> Column:
    """Cut or padded with zeros."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def make_context(cue: Column, frontier: Column, predicted: Column, dim: int, config: FieldConfig = FIELD) -> Column:
    parts = vadd(vadd(vscale(l2_normalize(cue), config.cue_context_weight), vscale(l2_normalize(frontier), config.frontier_context_weight)), vscale(l2_normalize(predicted), config.predictor_context_weight))
    return fit_dim(l2_normalize(parts), dim)


def push_reservoir(arr: Column, item: Column, size: int = FIELD.reservoir_size) -> Column:
    """The item moves to the end; the last `size` stay."""
    moved = F.array_append(F.array_remove(arr, item), item)
    return F.slice(moved, F.greatest(F.size(moved) - (size - 1), F.lit(1)), size)
