"""Tail probabilities of test statistics.

Spark has no erf, log-gamma or incomplete beta, and spelling them out as Columns makes plans of
many thousand nodes. They are small vectorised functions over Arrow batches instead, applied to
result tables (one row per group), never to the measurements. The cost per row grows with the square
root of the sample size behind it at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Rational approximation of the normal tail (highest power first).
NORMAL_NUMERATOR = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
NORMAL_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
LARGE_DF = 20_000


def _normal_tail(z):
    """P(Z > z) for an array, NaN where z is."""
    a = np.abs(z)
    bell = np.exp(-a * a / 2)
    near = bell * np.polyval(NORMAL_NUMERATOR, a) / np.polyval(NORMAL_DENOMINATOR, a)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + k / tail
    upper = np.where(a < 7.07106781186547, near, bell / tail / math.sqrt(2 * math.pi))
    return np.where(np.isnan(z), np.nan, np.where(z > 0, upper, 1 - upper))


def _log_gamma(x):
    """ln Gamma for x > 0 by a shifted Stirling series."""
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    rising = np.ones_like(z)
    for k in range(7):
        rising = rising * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(rising)


def _beta_inc(a, b, x):
    """Regularised incomplete beta by its continued fraction, for arrays with 0 < x < 1."""
    swap = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)

    def solid(v):
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    c, d = np.ones_like(y), 1 / solid(1 - (p + q) * y / (p + 1))
    value = d
    for m in range(1, 1_000_000):
        for step in (m * (q - m) / ((p + 2 * m - 1) * (p + 2 * m)),
                     -(p + m) * (p + q + m) / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / solid(1 + step * y * d)
            c = solid(1 + step * y / c)
            value = value * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    front = _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)
    part = np.exp(front) * value / p
    return np.where(swap, 1 - part, part)


def _student_p2(t, df):
    out = np.full(t.shape, np.nan)
    usable = ~np.isnan(t) & (df >= 1)
    small, large = usable & (df <= LARGE_DF), usable & (df > LARGE_DF)
    s, n = t[small], df[small]
    x = np.clip(n / (n + s * s), 1e-300, 1 - 1e-16)
    out[small] = np.where(s == 0, 1.0, _beta_inc(n / 2, np.full_like(n, 0.5), x)) if s.size else s
    half = df[large] - 0.5
    b = 48 * half * half
    y = half * np.log1p(t[large] ** 2 / df[large])
    z = (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * np.sqrt(y)
    out[large] = 2 * _normal_tail(z)
    return out


def _doubles(*series):
    return [s.to_numpy(dtype="float64", na_value=np.nan) for s in series]


@pandas_udf(DoubleType())
def _normal_sf_udf(z: pd.Series) -> pd.Series:
    return pd.Series(_normal_tail(*_doubles(z)))


@pandas_udf(DoubleType())
def _student_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    with np.errstate(all="ignore"):
        return pd.Series(_student_p2(*_doubles(t, df)))


@pandas_udf(DoubleType())
def _student_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    p, df = _doubles(p, df)
    lo, hi = np.zeros_like(p), np.full_like(p, 16.0)
    with np.errstate(all="ignore"):
        for _ in range(1000):
            short = (_student_p2(hi, df) > p) & (hi < 1e300)
            if not short.any():
                break
            hi = np.where(short, hi * 4, hi)
        for _ in range(1100):
            if not (np.nextafter(lo, np.inf) < hi).any():
                break
            middle = (lo + hi) / 2
            wide = _student_p2(middle, df) > p
            lo, hi = np.where(wide, middle, lo), np.where(wide, hi, middle)
    return pd.Series(np.where(np.isnan(df), np.nan, (lo + hi) / 2))


@pandas_udf(DoubleType())
def _binomial_udf(positive: pd.Series, negative: pd.Series) -> pd.Series:
    pos, neg = _doubles(positive, negative)
    n, k = pos + neg, np.minimum(pos, neg)
    with np.errstate(all="ignore"):
        exact = 2 * _beta_inc(np.maximum(n - k, 1), k + 1, np.full_like(n, 0.5))
    p = np.minimum(1.0, exact)
    return pd.Series(np.where(n == 0, np.nan, np.where(pos == neg, 1.0, p)))


@pandas_udf(DoubleType())
def _fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    tables = np.stack(_doubles(a, b, c, d))
    return pd.Series(_fisher_p2(*tables))


def _fisher_p2(a, b, c, d):
    """Sums of the probabilities of all tables with the same margins that are no likelier than the observed one.

    From the observed cell outward each probability follows from its neighbour by a ratio, and they rise to the
    mode and then fall: each side is followed until its terms vanish, for all rows at once.
    """
    row, col, n = a + b, a + c, a + b + c + d

    def choose(m, j):
        return _log_gamma(m + 1.0) - _log_gamma(j + 1.0) - _log_gamma(m - j + 1.0)

    with np.errstate(all="ignore"):
        log_here = choose(col, a) + choose(n - col, row - a) - choose(n, row)
        mode = np.floor((row + 1) * (col + 1) / (n + 2))
        log_mode = choose(col, mode) + choose(n - col, row - mode) - choose(n, row)
        total = np.zeros_like(a)
        for step in (1.0, -1.0):
            k, p = mode.copy(), np.exp(log_mode)
            if step < 0:
                p, k = p * k * (n - row - col + k) / ((row - k + 1) * (col - k + 1)), k - 1
            limit = np.exp(log_here + 1e-7)
            while True:
                live = (k >= np.maximum(0, row + col - n)) & (k <= np.minimum(row, col)) & (p > 0)
                total = np.where(live & (p <= limit), total + p, total)
                live &= ~((p <= limit) & (p < total * 1e-17))
                if not live.any():
                    break
                up = (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))
                down = k * (n - row - col + k) / ((row - k + 1) * (col - k + 1))
                p = np.where(live, p * (up if step > 0 else down), 0.0)
                k = k + step
    return np.minimum(1.0, total)


def rank_sum_tail(u: int, n1: int, n2: int) -> float:
    """P(U <= u) of the Mann-Whitney U of samples without ties.

    Arrangements by U are the coefficients of a Gaussian binomial, built up one member of the smaller sample at a
    time; those up to u need none beyond u.
    """
    small, large = sorted((n1, n2))
    ways = np.zeros(u + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        if large + i <= u:
            ways[large + i :] -= ways[: u + 1 - large - i].copy()
        wide = np.zeros(-(-(u + 1) // i) * i)
        wide[: u + 1] = ways
        ways = wide.reshape(-1, i).cumsum(axis=0).ravel()[: u + 1]
    return float(ways.sum() / math.comb(n1 + n2, small))


def signed_rank_tail(w: int, n: int) -> float:
    """P(W <= w) of the Wilcoxon signed-rank sum of n differences without ties: subsets of 1..n by their sum."""
    ways = np.zeros(w + 1)
    ways[0] = 1.0
    for i in range(1, min(n, w) + 1):
        ways[i:] += ways[: w + 1 - i].copy()
    return float(ways.sum() / 2.0**n)


def path_exit(reach: int, n: int, m: int) -> float:
    """Chance that a random order of n and m members leaves |i m - j n| < reach: the exact Kolmogorov-Smirnov p.

    Walks go diagonal by diagonal from no members to all; what leaves is summed, so that small chances keep their digits.
    """
    inside, out = np.zeros(n + 2), 0.0  # inside[i + 1]: i members of the first sample so far
    inside[1] = 1.0
    i = np.arange(n + 1)
    for t in range(n + m):
        j = t - i
        moved = (inside[1:] * np.maximum(m - j, 0) + inside[:-1] * (n - i + 1)) / (n + m - t)
        gone = np.abs(i * m - (j + 1) * n) >= reach
        out += moved[gone].sum()
        moved[gone] = 0.0
        inside[1:] = moved
    return float(out)


def _each(f, *series: pd.Series) -> pd.Series:
    """f of every row; rows alike are computed once, and rows with a null are null."""
    rows = pd.DataFrame(dict(enumerate(series))).astype("float64")
    known: dict[tuple, float] = {}
    return pd.Series([known.setdefault(r, f(*map(int, r))) if r not in known and not any(map(math.isnan, r)) else known.get(r) for r in rows.itertuples(index=False, name=None)], dtype="float64")


@pandas_udf(DoubleType())
def _rank_sum_udf(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _each(rank_sum_tail, u, n1, n2)


@pandas_udf(DoubleType())
def _signed_rank_udf(w: pd.Series, n: pd.Series) -> pd.Series:
    return _each(signed_rank_tail, w, n)


@pandas_udf(DoubleType())
def _path_exit_udf(reach: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return _each(path_exit, reach, n, m)


#: Where the exact distributions are used: as in the usual statistics library, and where a table of U stays small.
EXACT_RANK_SUM, EXACT_RANK_SUM_CELLS, EXACT_SIGNED_RANK, EXACT_PATHS = 8, 1 << 22, 50, 10_000


def rank_sum_p2(u: Column, n1: Column, n2: Column, ties: Column, otherwise: Column) -> Column:
    """Exact two-sided p of U where there are no ties and one sample has at most 8 members, else `otherwise`.

    Beyond 4 million possible values of U the normal p is used whatever the samples.
    """
    exact = (ties == 0) & (F.least(n1, n2) <= EXACT_RANK_SUM) & (F.least(n1, n2) > 0) & (n1 * n2 <= EXACT_RANK_SUM_CELLS)
    low = F.least(u, n1 * n2 - u)
    tail = _rank_sum_udf(*[F.when(exact, x.cast("double")) for x in (low, n1, n2)])
    return F.when(exact, F.least(F.lit(1.0), 2 * tail)).otherwise(otherwise)


def signed_rank_p2(w: Column, n: Column, plain: Column, otherwise: Column) -> Column:
    """Exact two-sided p of the smaller signed-rank sum for up to 50 differences, `plain` where none is tied or zero."""
    exact = plain & (n <= EXACT_SIGNED_RANK) & (n > 0)
    tail = _signed_rank_udf(*[F.when(exact, x.cast("double")) for x in (w, n)])
    return F.when(exact, F.least(F.lit(1.0), 2 * tail)).otherwise(otherwise)


def kolmogorov_p2(ks: Column, n: Column, m: Column) -> Column:
    """Two-sided p of a Kolmogorov-Smirnov distance: exact for samples of up to 10,000, else the limit."""
    exact = F.greatest(n, m) <= EXACT_PATHS
    reach = F.round(ks * n * m)
    p = _path_exit_udf(*[F.when(exact, x.cast("double")) for x in (reach, n, m)])
    limit = kolmogorov_sf(ks * F.sqrt(n * m / (n + m)))
    return F.when(exact, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).otherwise(limit)


def _null(p: Column) -> Column:
    return F.nanvl(p, F.lit(None).cast("double"))


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    return _null(_normal_sf_udf(z.cast("double")))


def normal_p2(z: Column) -> Column:
    """Two-sided normal p-value."""
    return 2 * normal_sf(F.abs(z))


def student_p2(t: Column, df: Column) -> Column:
    """Two-sided Student t p-value; above LARGE_DF by a normal transform of t."""
    return _null(_student_udf(t.cast("double"), df.cast("double")))


def student_quantile(p: Column, df: Column) -> Column:
    """t with two-sided tail probability `p`, by bisection."""
    return _null(_student_quantile_udf(p.cast("double"), df.cast("double")))


def chi2_2_sf(w: Column) -> Column:
    """Chi-squared tail with two degrees of freedom."""
    return F.exp(-w / 2)


def binomial_half_p2(positive: Column, negative: Column) -> Column:
    """Exact two-sided binomial test of positive against negative at p = 1/2."""
    return _null(_binomial_udf(positive.cast("double"), negative.cast("double")))


def fisher_exact_p2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher exact p of the 2x2 table [[a, b], [c, d]]."""
    return _null(_fisher_udf(*[v.cast("double") for v in (a, b, c, d)]))


def kolmogorov_sf(lam: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov tail; 1 where the series has not converged (tiny lambda)."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * lam * lam),
    )
    return F.when(lam < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
