"""Distribution functions without SciPy, as plain functions and as vectorised columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_N = NormalDist()


def normal_cdf_value(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def beta_continued(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_continued(b, a, 1 - x) / b


def incomplete_gamma_upper(a: float, x: float) -> float:
    """Regularised Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, dof: float) -> float:
    tail = 0.5 * incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))
    return tail if t >= 0 else 1 - tail


def f_sf(x: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def chi2_sf(x: float, dof: float) -> float:
    return incomplete_gamma_upper(dof / 2, x / 2)


def beta_pdf(x: float, a: float, b: float) -> float:
    if not 0 < x < 1:
        return 0.0
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x))


def hypergeom_cdf(d: int, total: int, marked: int, draws: int) -> float:
    """P(at most d marked among ``draws`` of ``total``, without replacement)."""
    return sum(math.comb(marked, i) * math.comb(total - marked, draws - i) for i in range(min(d, draws) + 1)) / math.comb(total, draws)


def binom_cdf(d: int, n: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(d, n) + 1))


def gwas_power(effect: float, maf: float, n: int, var_y: float = 1.0, alpha: float = 5e-8) -> float:
    """Two-sided power of an additive dosage effect."""
    shift = abs(effect) * math.sqrt(n * 2 * maf * (1 - maf) / var_y)
    z = _N.inv_cdf(1 - alpha / 2)
    return normal_cdf_value(shift - z) + normal_cdf_value(-shift - z)


def dirichlet_pdf(x: list[float], alpha: list[float]) -> float:
    if any(v <= 0 for v in x):
        return 0.0
    return math.exp(math.lgamma(sum(alpha)) - sum(map(math.lgamma, alpha)) + sum((a - 1) * math.log(v) for a, v in zip(alpha, x, strict=True)))


@F.pandas_udf(DoubleType())
def _ppf(q: pd.Series) -> pd.Series:
    return q.map(lambda v: _N.inv_cdf(v) if v is not None and 0 < v < 1 else None)


@F.pandas_udf(DoubleType())
def _cdf(x: pd.Series) -> pd.Series:
    return x.map(normal_cdf_value, na_action="ignore")


@F.pandas_udf(DoubleType())
def _beta(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([beta_pdf(*v) for v in zip(x, a, b, strict=True)])


def normal_ppf(q):
    return _ppf(q)


def normal_cdf(x):
    return _cdf(x)


def beta_density(x, a: float, b: float):
    return _beta(x, F.lit(float(a)), F.lit(float(b)))


def gradient_gap(f, gradient, x, step: float = 1e-6) -> float:
    """Largest relative gap between a gradient and central differences of its function at x."""
    x = [float(v) for v in x]
    g, worst = gradient(x), 0.0
    for i in range(len(x)):
        up, down = list(x), list(x)
        up[i] += step
        down[i] -= step
        d = (f(up) - f(down)) / (2 * step)
        worst = max(worst, abs(d - g[i]) / max(1.0, abs(d), abs(g[i])))
    return worst


def barycentric(x, y):
    """Weights of the corners (0, 0), (1, 0), (1/2, sqrt(3)/2) at a point, as columns."""
    c = y / F.lit(math.sqrt(3) / 2)
    b = x - c / 2
    return 1 - b - c, b, c


def uniform_product_pdf(x, n: int = 2):
    """Density of the product of n uniforms on (0, 1)."""
    return F.when((x > 0) & (x <= 1), F.pow(-F.ln(x), F.lit(float(n - 1))) / math.factorial(n - 1)).otherwise(F.lit(0.0))


def uniform_product_cdf(x, n: int = 2):
    """x times the sum of (-ln x) ** k / k! for k below n."""
    s = F.lit(0.0)
    for k in range(n):
        s = s + F.pow(-F.ln(x), F.lit(float(k))) / math.factorial(k)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(x * s)
