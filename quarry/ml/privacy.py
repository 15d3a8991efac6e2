"""Differential privacy: noise as column expressions, accounting in plain Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian(x: Column, multiplier: float, clip: float, seed: int = 0) -> Column:
    """A value kept within +-clip, with Gaussian noise of ``multiplier`` times clip."""
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), x)) + multiplier * clip * F.randn(seed)


def laplace(x: Column, scale: float, seed: int = 0) -> Column:
    u = F.rand(seed) - 0.5
    return x - scale * F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def random_response(label: Column, eps: float, classes: int = 2, seed: int = 0) -> Column:
    """A label 0..classes-1 that stays with probability e^eps / (e^eps + classes - 1), else another one."""
    stay = math.exp(eps) / (math.exp(eps) + classes - 1)
    other = F.pmod(label + 1 + F.floor(F.rand(seed + 1) * (classes - 1)), F.lit(classes))
    return F.when(F.rand(seed) < stay, label).otherwise(other.cast("int"))


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def renyi(q: float, noise: float, steps: int, orders: list[int]) -> list[float]:
    """Renyi divergence of whole orders of the Gaussian mechanism on Poisson samples of rate ``q``."""
    out = []
    for a in orders:
        if q in (0, 1):
            out.append(steps * (a / (2 * noise**2) if q else 0.0))
            continue
        terms = [math.lgamma(a + 1) - math.lgamma(k + 1) - math.lgamma(a - k + 1) + k * math.log(q) + (a - k) * math.log1p(-q) + (k * k - k) / (2 * noise**2) for k in range(a + 1)]
        out.append(steps * _log_add(terms) / (a - 1))
    return out


def epsilon(orders: list[int], divergences: list[float], delta: float) -> float:
    """The least epsilon that the divergences allow at ``delta``."""
    return max(0.0, min(d + math.log1p(-1 / a) - math.log(delta * a) / (a - 1) for a, d in zip(orders, divergences)))


def mu_poisson(steps: int, noise: float, rows: int, batch: int) -> float:
    """mu of Gaussian differential privacy after Poisson batches."""
    return math.sqrt(math.exp(noise**-2) - 1) * math.sqrt(steps) * batch / rows


def delta_of(eps: float, mu: float) -> float:
    tail = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    return tail(-eps / mu + mu / 2) - math.exp(eps) * tail(-eps / mu - mu / 2)
