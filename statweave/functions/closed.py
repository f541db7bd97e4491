"""Closed forms of the two-sample tests on reduced rows (one row per test).

Small numpy helpers behind pandas UDFs; Spark has already reduced the data to the
counts, sums and moments that come in. NaN stands for "undefined".
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from statweave.functions.tails import (
    fisher_upper, normal_quantile, student_two_sided, vectorized,
)

# Sample sizes at which the choice of test changes.
MIN_SAMPLE = 3
MIN_FOR_NORMALITY = 8
SHAPIRO_LIMIT = 300


def k2(n, g1, g2):
    """D'Agostino–Pearson K² and p from n, skewness and excess kurtosis."""
    with np.errstate(all="ignore"):
        y = g1 * np.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
        beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = np.sqrt(2 * (beta - 1)) - 1
        z1 = np.arcsinh(y / np.sqrt(2 / (w2 - 1))) / np.sqrt(0.5 * np.log(w2))
        sd = np.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
        x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / sd
        q = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * np.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        a = 6 + 8 / q * (2 / q + np.sqrt(1 + 4 / (q * q)))
        d = 1 + x * np.sqrt(2 / (a - 4))
        root = np.sign(d) * ((1 - 2 / a) / np.abs(d)) ** (1 / 3)
        z2 = (1 - 2 / (9 * a) - root) / np.sqrt(2 / (9 * a))
        stat = np.where(n >= MIN_FOR_NORMALITY, z1 * z1 + z2 * z2, np.nan)
        return stat, np.exp(-stat / 2)


def student(r: pd.DataFrame):
    """(t, df, p) with pooled variance."""
    n1, n2 = r.n_a.to_numpy(float), r.n_b.to_numpy(float)
    with np.errstate(all="ignore"):
        df = n1 + n2 - 2
        pooled = ((n1 - 1) * r.var_a.to_numpy(float) + (n2 - 1) * r.var_b.to_numpy(float)) / df
        t = (r.mean_a.to_numpy(float) - r.mean_b.to_numpy(float)) / np.sqrt(pooled * (1 / n1 + 1 / n2))
    return t, df, vectorized(student_two_sided, t, df)


def welch(r: pd.DataFrame):
    """(t, df, p) with Satterthwaite degrees of freedom."""
    n1, n2 = r.n_a.to_numpy(float), r.n_b.to_numpy(float)
    with np.errstate(all="ignore"):
        s1, s2 = r.var_a.to_numpy(float) / n1, r.var_b.to_numpy(float) / n2
        t = (r.mean_a.to_numpy(float) - r.mean_b.to_numpy(float)) / np.sqrt(s1 + s2)
        df = (s1 + s2) ** 2 / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))
    return t, df, vectorized(student_two_sided, t, df)


def cohen(r: pd.DataFrame):
    n1, n2 = r.n_a.to_numpy(float), r.n_b.to_numpy(float)
    with np.errstate(all="ignore"):
        pooled = np.sqrt(((n1 - 1) * r.var_a.to_numpy(float) + (n2 - 1) * r.var_b.to_numpy(float)) / (n1 + n2 - 2))
        return np.where(pooled == 0, 0.0, (r.mean_a.to_numpy(float) - r.mean_b.to_numpy(float)) / pooled)


def mann_whitney(r: pd.DataFrame):
    """(U of A, p): normal approximation with tie and continuity correction."""
    n1, n2 = r.n_a.to_numpy(float), r.n_b.to_numpy(float)
    n = n1 + n2
    with np.errstate(all="ignore"):
        u = r.rank_a.to_numpy(float) - n1 * (n1 + 1) / 2
        s = np.sqrt(n1 * n2 / 12 * (n + 1 - r.ties.to_numpy(float) / (n * (n - 1))))
        z = (np.abs(u - n1 * n2 / 2) - 0.5) / s
    p = np.array([1.0 if not v > 0 else math.erfc(v / math.sqrt(2.0)) for v in z])
    return u, np.where(n1 * n2 > 0, p, np.nan)


def rank_biserial(u, r: pd.DataFrame):
    product = r.n_a.to_numpy(float) * r.n_b.to_numpy(float)
    with np.errstate(all="ignore"):
        return np.where(product == 0, 0.0, 1 - 2 * u / product)


def levene(r: pd.DataFrame):
    """(F, N − 2, p) from sums of |x − median| (z1) and their squares (z2)."""
    n1, n2 = r.n_a.to_numpy(float), r.n_b.to_numpy(float)
    a, b = r.z1_a.to_numpy(float), r.z1_b.to_numpy(float)
    with np.errstate(all="ignore"):
        n, centre = n1 + n2, (a + b) / (n1 + n2)
        between = n1 * (a / n1 - centre) ** 2 + n2 * (b / n2 - centre) ** 2
        within = r.z2_a.to_numpy(float) - a * a / n1 + r.z2_b.to_numpy(float) - b * b / n2
        f = np.where(within > 0, (n - 2) * between / within, np.nan)
    return f, n - 2, vectorized(fisher_upper, f, np.ones_like(f), n - 2)


# Royston (1995) polynomials, lowest power first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_C3 = (0.544, -0.39978, 0.025054, -0.0006714)
_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_C6 = (-0.4803, -0.082676, 0.0030302)


def shapiro(n, smx, smm, x1, x2, xm, xn, ss) -> tuple[float, float]:
    """Shapiro–Wilk W and p of one sample.

    smx = Σ m·x and smm = Σ m² over the normal scores m; x1, x2, xm, xn are the two
    smallest and two largest values, all measured from the mean; ss = Σ x².
    """
    poly = np.polynomial.polynomial.polyval
    if not n >= 3:
        return math.nan, math.nan
    if not ss > 0:
        return 1.0, 1.0
    if n == 3:
        w = min(1.0, max(0.75, 0.5 * (xn - x1) ** 2 / ss))
        return w, min(1.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    last, before = normal_quantile(np.array([n - 0.375, n - 1.375]) / (n + 0.25))
    u = 1.0 / math.sqrt(n)
    a_n = poly(u, _C1) + last / math.sqrt(smm)
    if n > 5:
        a_m = poly(u, _C2) + before / math.sqrt(smm)
        phi = (smm - 2 * last**2 - 2 * before**2) / (1 - 2 * a_n**2 - 2 * a_m**2)
        middle = smx - last * (xn - x1) - before * (xm - x2)
        total = middle / math.sqrt(phi) + a_n * (xn - x1) + a_m * (xm - x2)
    else:
        phi = (smm - 2 * last**2) / (1 - 2 * a_n**2)
        total = (smx - last * (xn - x1)) / math.sqrt(phi) + a_n * (xn - x1)
    w = min(1.0, total * total / ss)
    if w >= 1.0:
        return 1.0, 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return w, 0.0
        y, mu, sigma = -math.log(gamma - y), poly(n, _C3), math.exp(poly(n, _C4))
    else:
        mu, sigma = poly(math.log(n), _C5), math.exp(poly(math.log(n), _C6))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2.0))


def shapiro_of_counts(values, counts) -> tuple[float, float]:
    """W and p of a small sorted sample given as values with counts."""
    v = np.repeat(np.asarray(values, dtype=float), np.asarray(counts, dtype=np.int64))
    n = len(v)
    if n < 3:
        return math.nan, math.nan
    d = v - v.mean()
    m = normal_quantile((np.arange(n) + 0.625) / (n + 0.25))
    return shapiro(n, float(m @ d), float(m @ m), d[0], d[1], d[-2], d[-1], float(d @ d))


def decide(r: pd.DataFrame) -> pd.DataFrame:
    """The decision tree: normality, equal variances, then Student, Welch or Mann–Whitney."""
    alpha = r.alpha.to_numpy(float)
    n_a, n_b = r.n_a.to_numpy(float), r.n_b.to_numpy(float)
    tiny = (n_a < MIN_FOR_NORMALITY) | (n_b < MIN_FOR_NORMALITY)
    large = (n_a > SHAPIRO_LIMIT) | (n_b > SHAPIRO_LIMIT)
    none = (n_a < MIN_SAMPLE) | (n_b < MIN_SAMPLE)
    out = {"norm_test": np.where(tiny, None, np.where(large, "k2", "shapiro"))}
    normal = {}
    for tag, n in (("a", n_a), ("b", n_b)):
        stat, p = k2(n, r[f"g1_{tag}"].to_numpy(float), r[f"g2_{tag}"].to_numpy(float))
        small = np.array([shapiro_of_counts(x, c) for x, c in zip(r.sample_x, r[f"sample_{tag}"])]).reshape(-1, 2)
        stat, p = np.where(large, stat, small[:, 0]), np.where(large, p, small[:, 1])
        out[f"norm_{tag}_stat"], out[f"norm_{tag}_p"] = np.where(tiny, np.nan, stat), np.where(tiny, np.nan, p)
        normal[tag] = out[f"norm_{tag}_p"] >= alpha
    f, _, levene_p = levene(r)
    out["levene_stat"], out["levene_p"] = np.where(tiny, np.nan, f), np.where(tiny, np.nan, levene_p)
    equal, both = out["levene_p"] >= alpha, normal["a"] & normal["b"]
    test = np.where(none, None, np.where(both, np.where(equal, "student", "welch"), "mann_whitney"))
    (t1, _, p1), (t2, _, p2), (u, pu) = student(r), welch(r), mann_whitney(r)
    picks = [test == "student", test == "welch", test == "mann_whitney"]
    out["test"] = test
    out["statistic"] = np.select(picks, [t1, t2, u], np.nan)
    out["p_value"] = np.select(picks, [p1, p2, pu], np.nan)
    out["effect_size"] = np.select(picks, [cohen(r)] * 2 + [rank_biserial(u, r)], np.nan)
    out["effect_metric"] = np.select(picks, ["cohens_d", "cohens_d", "rank_biserial"], None)
    reason = np.where(none, "insufficient_data", np.where(tiny, "small_sample", np.where(
        both, "both_normal", np.where(normal["b"], "a_not_normal", np.where(
            normal["a"], "b_not_normal", "both_not_normal")))))
    variance = np.select(picks[:2], ["equal_variance", "unequal_variance"], None)
    out["decision"] = [[s for s in steps if s is not None] for steps in zip(reason, variance, test)]
    return pd.DataFrame(out)
