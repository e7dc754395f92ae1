"""numpy twins of the pair laws, for fits: log partition functions and means of blocks of pairs."""

from __future__ import annotations

import numpy as np

from ..schema import Family


def exponent(family: Family, layers: int, log_q: np.ndarray) -> np.ndarray:
    """u = -ln P(0) of the plain law at ln q."""
    if family == Family.ME:
        return np.exp(log_q)
    if family == Family.B:
        return layers * np.logaddexp(0.0, log_q)
    log_q = np.minimum(log_q, -1e-15)
    return -layers * np.where(log_q < -0.7, np.log1p(-np.exp(log_q)), np.log(-np.expm1(log_q)))  # 1 - q forgets a small q, q one near 1


def mean(family: Family, layers: int, log_q: np.ndarray) -> np.ndarray:
    """E[t] of the plain law."""
    if family == Family.ME:
        return np.exp(log_q)
    if family == Family.B:
        return layers / (1.0 + np.exp(-log_q))
    return layers / np.expm1(-np.minimum(log_q, -1e-15))


def variance(family: Family, layers: int, log_q: np.ndarray) -> np.ndarray:
    """Var[t] of the plain law: the mean's derivative by ln q."""
    m = mean(family, layers, log_q)
    if family == Family.ME:
        return m
    return m * (1.0 - m / layers) if family == Family.B else m * (1.0 + m / layers)


def log_growth(u: np.ndarray) -> np.ndarray:
    """ln(e^u - 1)."""
    u = np.maximum(u, 1e-300)
    return u + np.log(-np.expm1(-u))


def positive_mean(family: Family, layers: int, log_q: np.ndarray) -> np.ndarray:
    """E[t | t > 0] of the plain law."""
    u = np.maximum(exponent(family, layers, log_q), 1e-300)
    return np.maximum(mean(family, layers, log_q), 1e-300) / -np.expm1(-u)


def positive_variance(family: Family, layers: int, log_q: np.ndarray) -> np.ndarray:
    """Var[t | t > 0] of the plain law."""
    m, mu = np.maximum(mean(family, layers, log_q), 1e-300), positive_mean(family, layers, log_q)
    return np.maximum(mu * (variance(family, layers, log_q) / m + m - mu), 0.0)


def solve_positive_mean(family: Family, layers: int, target: float) -> float:
    """The q whose E[t | t > 0] is `target` (0 at 1; infinite where a binomial's layers are all taken)."""
    if target < 1 - 1e-12:
        raise ValueError("the mean of a positive weight is 1 at least")
    if target <= 1 + 1e-12:
        return 0.0
    if family == Family.B:
        if target > layers:
            raise ValueError("infeasible: the mean weight exceeds the number of layers")
        if target == layers:
            return float("inf")
    if family == Family.W and layers == 1:
        return 1.0 - 1.0 / target
    low, high = -60.0, (-1e-14 if family == Family.W else 60.0)
    for _ in range(200):
        mid = (low + high) / 2
        if positive_mean(family, layers, np.array(mid)) < target:
            low = mid
        else:
            high = mid
    return float(np.exp((low + high) / 2))
