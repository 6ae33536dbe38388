"""Small numeric helpers for grouped maps: Student's t, Wilcoxon's signed ranks, ridge regression. numpy only."""

from __future__ import annotations

import math

import numpy as np

ALPHAS = np.logspace(-2, 2, 20)
FOLDS, LEAST_CV = 5, 15  # contiguous folds, from so many rows on


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The t below which a share p > 0.5 of the distribution lies."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def t_test(x: np.ndarray) -> float | None:
    """Two-sided p-value of mean 0; None below three values or without spread."""
    n = len(x)
    sd = x.std(ddof=1) if n > 1 else 0.0
    return t_two_sided(x.mean() / (sd / math.sqrt(n)), n - 1) if n >= 3 and sd > 0 else None


def wilcoxon(x: np.ndarray) -> float | None:
    """Two-sided p-value of symmetry around 0: exact for up to 50 values without ties or zeros, else normal with ties;
    zeros are left out. None below six values or if all are zero."""
    if len(x) < 6:
        return None
    d = x[x != 0]
    n = len(d)
    if not n:
        return None
    size, which, times = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(times) - (times - 1) / 2)[which]
    plus = float(ranks[d > 0].sum())
    least = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and (times == 1).all() and n == len(x):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(least) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - (times**3 - times).sum() / 48
    return math.erfc(abs(least - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean()))


def r2(y: np.ndarray, fit: np.ndarray) -> float:
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - fit) ** 2).sum() / total) if total > 0 else float("nan")


def ridge_cv(x: np.ndarray, y: np.ndarray, folds: int = 5) -> dict:
    """Standardised ridge over ALPHAS. From 15 rows on, contiguous folds choose alpha by mean R2; with fewer, each fold
    would hold one row and R2 has no meaning, so alpha is the least and cv_r2 null."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    alpha, best = float(ALPHAS[0]), None
    if len(y) >= 15:
        parts = np.array_split(np.arange(len(y)), folds)
        scores = []
        for a in ALPHAS:
            each = []
            for p in parts:
                rest = np.setdiff1d(np.arange(len(y)), p)
                m = z[rest].mean(0)
                w = ridge(z[rest] - m, y[rest], a)
                each.append(r2(y[p], (z[p] - m) @ w + y[rest].mean()))
            scores.append(np.mean(each))
        alpha, best = float(ALPHAS[int(np.argmax(scores))]), float(np.max(scores))
    w = ridge(z, y, alpha)
    return {"alpha": alpha, "cv_r2": best, "r2": r2(y, z @ w + y.mean()), "std_beta": w, "beta": w / scale}


def merged(parts: list[tuple]) -> tuple:
    """(rows, means, sums of products around the means) of several such parts together."""
    n, mean, products = parts[0]
    for n2, mean2, products2 in parts[1:]:
        d = mean2 - mean
        products = products + products2 + np.outer(d, d) * (n * n2 / (n + n2))
        mean = mean + d * (n2 / (n + n2))
        n = n + n2
    return n, mean, products


def ridge_from_moments(parts: list[tuple]) -> dict:
    """What ridge_cv returns, from (rows, means, sums of products) of each fold; the target is the last column. One part
    takes the least alpha and no cv_r2."""
    n, mean, s = merged(parts)
    scale = np.sqrt(np.diag(s)[:-1] / n)
    scale = np.append(np.where(scale > 0, scale, 1.0), 1.0)
    parts = [(k, (m - mean) / scale, p / np.outer(scale, scale)) for k, m, p in parts]
    s = s / np.outer(scale, scale)

    solve = lambda s, a: np.linalg.solve(s[:-1, :-1] + a * np.eye(len(s) - 1), s[:-1, -1])
    misfit = lambda s, w: s[-1, -1] - 2 * w @ s[:-1, -1] + w @ s[:-1, :-1] @ w
    alpha, best = float(ALPHAS[0]), None
    if len(parts) > 1:
        each = np.empty((len(parts), len(ALPHAS)))
        for i, (k, m, p) in enumerate(parts):
            _, rest, r = merged(parts[:i] + parts[i + 1 :])
            for j, a in enumerate(ALPHAS):
                w = solve(r, a)
                off = (m - rest)[-1] - (m - rest)[:-1] @ w
                each[i, j] = 1 - (misfit(p, w) + k * off * off) / p[-1, -1] if p[-1, -1] > 0 else np.nan
        scores = each.mean(0)
        alpha, best = float(ALPHAS[int(np.argmax(scores))]), float(np.max(scores))
    w = solve(s, alpha)
    fit = float(1 - misfit(s, w) / s[-1, -1]) if s[-1, -1] > 0 else float("nan")
    return {"alpha": alpha, "cv_r2": best, "r2": fit, "std_beta": w, "beta": w / scale[:-1]}
