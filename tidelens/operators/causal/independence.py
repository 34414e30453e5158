"""Conditional independence tests: each returns a statistic and a p-value for x and y given the columns of z."""

from __future__ import annotations

import math

import numpy as np

from ...functions.special import chi2_tail, digamma, normal_quantile, student_two_sided

#: Permutations, the seed of all random draws, neighbours as a share of the rows, the size of the noise against ties.
PERMUTATIONS, SEED, NEIGHBOURS, NOISE = 100, 42, 0.2, 1e-6


def _standard(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)


def correlation_p(r: float, n: int, dim: int) -> float:
    df = n - dim
    if df < 1:
        return 1.0
    return 0.0 if abs(r) >= 1 else student_two_sided(r * math.sqrt(df / (1 - r * r)), df)


def partial_correlation(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """Pearson's r of both residuals of the regression on z."""
    x, y, z = _standard(x), _standard(y), _standard(z) if z.size else z
    if z.size:
        try:
            half = np.linalg.cholesky(z.T @ z)
            fit = lambda v: v - z @ np.linalg.solve(half.T, np.linalg.solve(half, z.T @ v))
            x, y = fit(x), fit(y)
        except np.linalg.LinAlgError:
            pass  # a singular condition set leaves the variables as they are
    x, y = x - x.mean(), y - y.mean()
    size = math.sqrt(float(x @ x) * float(y @ y))
    r = max(-1.0, min(1.0, float(x @ y) / size)) if size > 1e-300 else 0.0
    return r, correlation_p(r, len(x), z.shape[1] + 2 if z.size else 2)


def partial_from_covariance(c: np.ndarray, i: int, j: int, z: list[int]) -> float:
    """The same value from a covariance matrix alone."""
    if z:
        inner = np.linalg.solve(c[np.ix_(z, z)], c[np.ix_(z, [i, j])])
        c2 = c[np.ix_([i, j], [i, j])] - c[np.ix_([i, j], z)] @ inner
    else:
        c2 = c[np.ix_([i, j], [i, j])]
    return float(c2[0, 1] / math.sqrt(c2[0, 0] * c2[1, 1])) if c2[0, 0] > 0 and c2[1, 1] > 0 else 0.0


def average_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    size = np.diff(np.append(new, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(new + (size - 1) / 2, size)
    return out


def to_normal(x: np.ndarray) -> np.ndarray:
    return np.array([normal_quantile(u) for u in (average_ranks(x) + 0.5) / len(x)])


def robust_partial_correlation(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    return partial_correlation(to_normal(x), to_normal(y), np.apply_along_axis(to_normal, 0, z) if z.size else z)


def equal_frequency(x: np.ndarray) -> np.ndarray:
    n = len(x)
    k = min(max(math.ceil(math.sqrt(n)), 2), 10)
    rank = np.empty(n, int)
    rank[np.argsort(x, kind="stable")] = np.arange(n)
    return rank * k // n


def _codes(columns: list[np.ndarray]) -> np.ndarray:
    if not columns:
        return np.zeros(0, int)
    return np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)[1].ravel()


def g_squared(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """2 sum n ln(n n_z / (n_xz n_yz)) over equal-frequency bins."""
    a, b = equal_frequency(x), equal_frequency(y)
    c = _codes([equal_frequency(v) for v in z.T]) if z.size else np.zeros(len(x), int)
    ka, kb, kc = a.max() + 1, b.max() + 1, c.max() + 1
    n = np.bincount((c * ka + a) * kb + b, minlength=ka * kb * kc).reshape(kc, ka, kb).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = n * np.log(n * n.sum(axis=(1, 2), keepdims=True) / (n.sum(axis=2, keepdims=True) * n.sum(axis=1, keepdims=True)))
    g = float(2 * np.nansum(terms))
    return g, chi2_tail(g, float((ka - 1) * (kb - 1) * kc))


def _entropy(codes: np.ndarray) -> float:
    p = np.bincount(codes) / len(codes)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def _symbolic(a: np.ndarray, b: np.ndarray, c: np.ndarray | None) -> float:
    if c is None:
        return max(0.0, _entropy(a) + _entropy(b) - _entropy(_codes([a, b])))
    return max(0.0, _entropy(_codes([a, c])) + _entropy(_codes([b, c])) - _entropy(c) - _entropy(_codes([a, b, c])))


def cmi_symbolic(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """Conditional mutual information of equal-frequency bins; p by shuffling x within the strata of z."""
    a, b = equal_frequency(x), equal_frequency(y)
    c = _codes([equal_frequency(v) for v in z.T]) if z.size else None
    value, rng, more = _symbolic(a, b, c), np.random.default_rng(SEED), 0
    strata = [np.flatnonzero(c == k) for k in range(c.max() + 1)] if c is not None else [np.arange(len(a))]
    for _ in range(PERMUTATIONS):
        shuffled = a.copy()
        for s in strata:
            shuffled[s] = a[rng.permutation(s)]
        more += _symbolic(shuffled, b, c) >= value
    return value, (more + 1) / (PERMUTATIONS + 1)


def _knn(x: np.ndarray, y: np.ndarray, z: np.ndarray, k: int) -> float:
    """Frenzel and Pompe's estimator under the maximum norm, in blocks of rows."""
    n, total = len(x), 0.0
    for lo in range(0, n, 256):
        s = slice(lo, min(n, lo + 256))
        dx, dy = np.abs(x[s, None] - x[None]), np.abs(y[s, None] - y[None])
        dz = np.abs(z[s, None, :] - z[None]).max(axis=2) if z.size else np.zeros_like(dx)
        eps = np.partition(np.maximum(np.maximum(dx, dy), dz), k, axis=1)[:, k][:, None]
        count = lambda d: (d < eps).sum(axis=1)
        for a, b, c in zip(count(np.maximum(dx, dz)), count(np.maximum(dy, dz)), count(dz) if z.size else np.full(s.stop - s.start, n), strict=True):
            total += digamma(max(c, 1)) - digamma(max(a, 1)) - digamma(max(b, 1))
    return digamma(k) + total / n


def cmi_knn(x: np.ndarray, y: np.ndarray, z: np.ndarray, permutations: int = 20) -> tuple[float, float]:
    rng = np.random.default_rng(SEED)
    noisy = lambda v: _standard(v + NOISE * rng.normal(size=v.shape))
    x, y, z = noisy(x), noisy(y), noisy(z) if z.size else z
    k = max(1, int(NEIGHBOURS * len(x)))
    value = _knn(x, y, z, k)
    more = sum(_knn(rng.permutation(x), y, z, k) >= value for _ in range(permutations))
    return value, (more + 1) / (permutations + 1)


TESTS = {"par_corr": partial_correlation, "robust_parcorr": robust_partial_correlation, "cmi_knn": cmi_knn, "gsquared": g_squared, "cmi_symb": cmi_symbolic}
