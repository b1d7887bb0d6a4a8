"""Special functions: Column expressions where a formula serves, NumPy elsewhere (neither Spark nor this box has SciPy's)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chebyshev coefficients of erfc (Numerical Recipes), relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def erfc_col(x: Column) -> Column:
    """erfc of a column; Spark and DuckDB evaluate the same polynomial (see erfc_sql)."""

    def tail(z: Column) -> Column:
        def poly(t: Column) -> Column:
            out = F.lit(ERFC[-1])
            for c in reversed(ERFC[:-1]):
                out = F.lit(c) + t * out
            return t * F.exp(-z * z + out)

        return let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * F.abs(z)), poly)

    return let(x, lambda z: F.when(z >= 0, tail(z)).otherwise(F.lit(2.0) - tail(z)))


def erfc_sql(x: str) -> str:
    """The same as SQL text for x >= 0."""
    t = f"(1e0/(1e0+0.5e0*({x})))"
    poly = f"{ERFC[-1]}e0"
    for c in reversed(ERFC[:-1]):
        poly = f"({c}e0+{t}*{poly})"
    return f"({t}*exp(-({x})*({x})+{poly}))"


def normal_two_sided(z: Column) -> Column:
    """P(|N(0,1)| >= |z|)."""
    return F.least(erfc_col(F.abs(z) / F.lit(math.sqrt(2.0))), F.lit(1.0))


def chi2_1_tail(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return F.least(erfc_col(F.sqrt(F.greatest(x, F.lit(0.0)) / 2.0)), F.lit(1.0))


#: Terms of Stirling's series of the log gamma function, from 1/x to 1/x^9.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lgamma_col(x: Column) -> Column:
    """Log gamma of x > 0: Stirling's series eight steps further on."""

    def series(z: Column) -> Column:
        out = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi))
        for k, c in enumerate(STIRLING):
            out = out + F.lit(c) / F.pow(z, F.lit(2 * k + 1.0))
        return out

    def shifted(v: Column) -> Column:
        steps = v
        for k in range(1, 8):
            steps = steps * (v + float(k))
        return let(v + 8.0, series) - F.log(steps)

    return let(x.cast("double"), shifted)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _beta_series(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta below its turning point, 400 terms of the hypergeometric series."""
    front = F.exp(a * F.log(x) + b * F.log(1 - x) + lgamma_col(a + b) - lgamma_col(a) - lgamma_col(b)) / a
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("all"))

    def step(s: Column, k: Column) -> Column:
        return let(s["term"] * (a + b + k) / (a + 1 + k) * x, lambda t: F.struct(t.alias("term"), (s["all"] + t).alias("all")))

    return front * F.aggregate(F.sequence(F.lit(0), F.lit(399)), start, step)["all"]


def t_p(t, df) -> Column:
    """Two-sided tail of Student's t; null, NaN or no degrees of freedom: 1.

    From 20 degrees of freedom on by Hill's expansion (see t_p_sql), below by the incomplete beta series."""
    t, df = F.abs(_col(t)).cast("double"), _col(df).cast("double")
    a = df - 0.5
    b = 48 * a * a
    y = a * F.log1p(t * t / df)
    hill = let(y, lambda y: (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * F.sqrt(y))
    x = df / (df + t * t)
    few = F.when(x < (df / 2 + 1) / (df / 2 + 2.5), _beta_series(df / 2, F.lit(0.5), x)).otherwise(1 - _beta_series(F.lit(0.5), df / 2, 1 - x))
    tail = F.when(t == 0, 1.0).when(df >= 20, erfc_col(hill / math.sqrt(2.0))).otherwise(few)
    return F.when((df > 0) & t.isNotNull() & ~F.isnan(t), F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)


def t_p_sql(t: str, df: str) -> str:
    """The same as SQL text from 20 degrees of freedom on."""
    a = f"({df}-0.5e0)"
    b, y = f"(48e0*{a}*{a})", f"({a}*ln(1e0+({t})*({t})/{df}))"
    hill = f"(((((-0.4e0*{y}-3.3e0)*{y}-24e0)*{y}-85.5e0)/(0.8e0*{y}*{y}+100e0+{b})+{y}+3e0)/{b}+1e0)*sqrt({y})"
    return f"least({erfc_sql(f'({hill}/sqrt(2e0))')},1e0)"


def fisher_p(a, b, c, d) -> Column:
    """Two-sided Fisher p of [[a, b], [c, d]]: the tables no likelier than the one seen."""
    a, b, c, d = (_col(x).cast("long") for x in (a, b, c, d))
    r1, r2, c1 = a + b, c + d, a + c
    log = lambda x: -lgamma_col(x + 1) - lgamma_col(r1 - x + 1) - lgamma_col(c1 - x + 1) - lgamma_col(r2 - c1 + x + 1)
    all_ = lgamma_col(r1 + 1) + lgamma_col(r2 + 1) + lgamma_col(c1 + 1) + lgamma_col(r1 + r2 - c1 + 1) - lgamma_col(r1 + r2 + 1)
    logs = F.transform(F.sequence(F.greatest(F.lit(0).cast("long"), c1 - r2), F.least(r1, c1)), log)
    tail = let(log(a), lambda seen: _sum(F.transform(logs, lambda x: F.when(x <= seen + 1e-7, F.exp(x + all_)).otherwise(0.0))))
    return F.least(tail, F.lit(1.0))


def poisson_p(k, mu) -> Column:
    """P(X <= k)."""
    k, mu = _col(k).cast("long"), _col(mu).cast("double")
    return F.least(_sum(F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: F.exp(i * F.log(mu) - mu - lgamma_col(i + 1)))), F.lit(1.0))


def hwe_p(het, hom_minor, n) -> Column:
    """Exact Hardy-Weinberg p: the heterozygote counts no likelier than the one seen; no samples: 1."""
    het, aa, n = (_col(x).cast("long") for x in (het, hom_minor, n))
    minor = F.least(2 * aa + het, 2 * n - 2 * aa - het)
    log = lambda k: k * math.log(2.0) - lgamma_col((minor - k) / 2 + 1) - lgamma_col(k + 1) - lgamma_col(n - k - (minor - k) / 2 + 1)
    logs = F.transform(F.sequence(minor % 2, minor, F.lit(2).cast("long")), log)

    def share(x: Column) -> Column:
        top = F.array_max(x)
        e = F.transform(x, lambda v: F.exp(v - top))
        return let(F.exp(log(het) - top), lambda seen: _sum(F.transform(e, lambda v: F.when(v <= seen * (1 + 1e-9), v).otherwise(0.0))) / _sum(e))

    return F.when(n > 0, F.least(let(logs, share), F.lit(1.0))).otherwise(1.0)


def _each(f, x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([f(v) for v in x.ravel()]).reshape(x.shape)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def normal_sf(x):
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2.0))


def normal_isf(p):
    """Inverse of normal_sf; p in (0, 1), else infinities."""
    d = NormalDist()
    return np.array([math.inf if q <= 0 else -math.inf if q >= 1 else -d.inv_cdf(q) for q in np.atleast_1d(np.asarray(p, float))])


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d or 1e-300)
            c = 1.0 + term / c or 1e-300
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def betainc_inv(a: float, b: float, p: float) -> float:
    """Beta quantile by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if betainc(a, b, mid) < p else (lo, mid)
    return 0.5 * (lo + hi)


def t_two_sided(t: float, df: float) -> float:
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else 1.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(log_front)


def chi2_sf(x: float, df: float) -> float:
    return gammainc_upper(df / 2.0, x / 2.0)


def poisson_cdf(k: float, mu: float) -> float:
    """P(X <= k)."""
    return gammainc_upper(math.floor(k) + 1.0, mu) if k >= 0 else 0.0


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2x2 table: the tables no likelier than the one seen."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    lo, hi = max(0, c1 - r2), min(r1, c1)
    x = np.arange(lo, hi + 1)
    lg = lambda v: _lgamma(np.asarray(v, float) + 1.0)
    logs = lg(r1) - lg(x) - lg(r1 - x) + lg(r2) - lg(c1 - x) - lg(r2 - c1 + x) - (lg(n) - lg(c1) - lg(n - c1))
    seen = logs[a - lo]
    return float(min(1.0, np.exp(logs[logs <= seen + 1e-7]).sum()))


def hwe_exact(het: int, hom_minor: int, n: int) -> float:
    """Exact Hardy-Weinberg test: the sum of probabilities of heterozygote counts no likelier than the one seen."""
    if n <= 0:
        return 1.0
    minor = min(2 * hom_minor + het, 2 * n - 2 * hom_minor - het)
    k = np.arange(minor & 1, minor + 1, 2, dtype=float)
    aa = (minor - k) / 2
    rest = n - k - aa
    logs = k * math.log(2.0) - _lgamma(aa + 1) - _lgamma(k + 1) - _lgamma(rest + 1)
    p = np.exp(logs - logs.max())
    p /= p.sum()
    seen = p[int((het - (minor & 1)) // 2)] if het <= minor else 0.0
    return float(min(1.0, p[p <= seen * (1 + 1e-12)].sum()))


def rounded_to(x: Column, digits: int) -> Column:
    """F.round of a double, with 0 for -0. F.round makes a decimal of every value; it is left to those that may be halves, are very
    large or no numbers."""
    y = x * 10.0**digits
    plain = (F.abs(y) < 1e11) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(plain, F.floor(y + 0.5).cast("double") / 10.0**digits).otherwise(F.round(x, digits) + F.lit(0.0))
