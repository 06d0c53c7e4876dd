"""Unit-root and Granger tests on short series, one group of rows a series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares, and the inverse of x'x."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    return beta, float(e @ e), inverse


def beta_cf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for i in range(1, 300):
        for term in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def f_survival(f: float, d1: int, d2: int) -> float:
    """P(F > f) of an F distribution."""
    return beta_cf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def granger(cause: np.ndarray, effect: np.ndarray, max_lag: int) -> tuple[int, float, float]:
    """(lag, F, p) with the smallest p over lags: do past causes add to past effects?"""
    best = (0, 0.0, 1.0)
    for lag in range(1, max_lag + 1):
        y = effect[lag:]
        past = [effect[lag - k : -k] for k in range(1, lag + 1)]
        other = [cause[lag - k : -k] for k in range(1, lag + 1)]
        short = np.column_stack([*past, np.ones(len(y))])
        whole = np.column_stack([*past, *other, np.ones(len(y))])
        free = len(y) - whole.shape[1]
        if free < 1:
            break
        r0, r1 = _ols(short, y)[1], _ols(whole, y)[1]
        if r1 <= 1e-12:
            continue
        f = (r0 - r1) / lag / (r1 / free)
        p = f_survival(f, lag, free)
        if p < best[2]:
            best = (lag, f, p)
    return best


def unit_root(series: np.ndarray) -> float:
    """The augmented Dickey-Fuller t statistic, with the lag that minimises the AIC."""
    n = len(series)
    d = np.diff(series)
    best = (math.inf, 0.0)
    for lag in range(0, max(1, int(12 * (n / 100) ** 0.25)) + 1):
        y = d[lag:]
        x = np.column_stack([series[lag:-1], *[d[lag - k : -k] for k in range(1, lag + 1)], np.ones(len(y))])
        if len(y) <= x.shape[1] + 1:
            break
        beta, rss, inverse = _ols(x, y)
        sigma = rss / (len(y) - x.shape[1])
        aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * x.shape[1]
        if aic < best[0] and sigma > 0:
            best = (aic, float(beta[0] / math.sqrt(sigma * inverse[0, 0])))
    return best[1]


def stationary(series: np.ndarray, most: int = 2, critical: float = -2.86) -> np.ndarray:
    """The series, differenced until its unit-root statistic falls below the 5 % value."""
    for _ in range(most):
        if len(series) < 20 or unit_root(series) < critical:
            break
        series = np.diff(series)
    return series


def granger_group(max_lag: int, least: int):
    """A grouped-map function over rows (pair, day, cause, effect)."""

    def test(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        a, b = stationary(group["cause"].to_numpy(float)), stationary(group["effect"].to_numpy(float))
        n = min(len(a), len(b))
        lag, f, p = granger(a[-n:], b[-n:], min(max_lag, n // 3)) if n >= least else (0, 0.0, 1.0)
        return pd.DataFrame({"pair": [group["pair"].iloc[0]], "days": [n], "lag": [lag], "f": [round(f, 6)], "p": [round(p, 8)], "causes": [p < 0.05]})

    return test
