"""Number parsing, rounding and rendering rules, and special functions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def round_half_up(x: Column) -> Column:
    """Ties go up on the exact value; NaN gives 0; what is beyond a long gives the nearest one."""
    inside = F.when(F.abs(x) < 2.0**62, x).otherwise(0.0)
    rounded = F.floor(inside) + F.when(inside - F.floor(inside) >= 0.5, 1).otherwise(0)
    return (F.when(F.isnan(x), 0).when(x >= 2.0**63, (1 << 63) - 1).when(x < -(2.0**63), F.expr("-9223372036854775807L - 1L")).when(F.abs(x) >= 2.0**62, x.try_cast("long")).otherwise(rounded)).cast("long")


def integer_tag_type(x: Column) -> Column:
    """The narrowest binary tag type that holds an integer: signed is tried before unsigned at each width."""
    out = F.lit(None).cast("string")
    for low, high, code in ((-(1 << 31), (1 << 31) - 1, "i"), (0, 65535, "S"), (-32768, 32767, "s"), (0, 255, "C"), (-128, 127, "c")):
        out = F.when((x >= low) & (x <= high), code).otherwise(out)
    return F.when((x > (1 << 31) - 1) & (x < 1 << 32), "I").otherwise(out)


def _tie_goes_down(x: Column, seven: Column) -> Column:
    """Whether |x|'s shortest decimal ends in a 5 at the seventh place (``seven`` is its text there) and the double itself lies at it or below.

    Only the parts behind the point are compared (they are exact); the product
    with 10 ** 7 is taken with its rounding error, from halves of the digits.
    """
    scale = 1e7  # fits in the upper half of a double's digits
    part = x - F.floor(x)
    wide = part * 134217729.0
    high = wide - (wide - part)
    product = part * scale
    rest = (high * scale - product) + (part - high) * scale
    digits = F.substring_index(seven, ".", -1).try_cast("double")
    tie = seven.endswith("5") & (seven.try_cast("double") == x) & (x >= 1e-6) & (x < 2.0**53)
    return tie & ((product - digits) + rest <= 0)


def metric_text(x: Column) -> Column:
    """Up to six decimals, no padding; ``?`` for null, NaN and infinity, ``-?`` for minus infinity.

    What is rounded is the shortest decimal that reads as the double. A 5 with
    nothing behind it goes up only if the double lies above it.
    """
    size = F.abs(x)
    seven = F.format_string("%.7f", size)
    six = F.when(_tie_goes_down(size, seven), F.expr("''")).otherwise(F.format_string("%.6f", size))
    text = F.when(six == "", F.substr(seven, F.lit(1), F.length(seven) - 1)).otherwise(six)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    plain = F.concat(sign, F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", ""))
    return F.when(x.isNull() | F.isnan(x) | (x == float("inf")), "?").when(x == float("-inf"), "-?").otherwise(plain)


def metric_flag(x: Column) -> Column:
    return F.when(x, "Y").otherwise("N")


def _over(function, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    f = np.vectorize(function, otypes=[float])
    for batch in batches:
        yield pd.Series(f(batch.to_numpy(float)) if len(batch) else np.zeros(0))


@F.pandas_udf(DoubleType())
def erf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Error function."""
    return _over(math.erf, batches)


@F.pandas_udf(DoubleType())
def log_gamma(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """log |gamma(x)|; infinite at poles."""
    return _over(lambda x: math.inf if x <= 0 and x == math.floor(x) else math.lgamma(x), batches)


def normal_cdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    return (erf((x - mean) / (sd * math.sqrt(2.0))) + 1) / 2


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


#: Errors of Stirling's formula for log(z!) at z = 0, 1/2, 1, ... below 15.
_STIRLING = np.array([0.0] + [math.lgamma(z / 2 + 1) - (z / 2 + 0.5) * math.log(z / 2) + z / 2 - 0.5 * math.log(2 * math.pi) for z in range(1, 30)])


def _stirling_error(z: np.ndarray) -> np.ndarray:
    """log(z!) less Stirling's formula, for whole and half z: from a table below 15, by its series from there."""
    far = np.maximum(z, 15.0)
    w = far * far
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / w) / w) / w) / w) / far
    return np.where(z < 15, _STIRLING[np.clip(z * 2, 0, 29).astype(int)], series)


def _deviance(x: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """x log(x / mu) + mu - x, by a series where x is near mu (each term is under a hundredth of the one before, so eleven are enough)."""
    d, v = x - mu, (x - mu) / (x + mu)
    total, term = v * d, 2 * x * v
    for j in range(1, 12):
        term = term * v * v
        total = total + term / (2 * j + 1)
    return np.where(np.abs(d) < 0.1 * (x + mu), total, x * np.log(x / mu) + mu - x)


@F.pandas_udf(DoubleType())
def _binomial(xs: pd.Series, ns: pd.Series, ps: pd.Series, qs: pd.Series) -> pd.Series:
    x, n, p, q = (s.to_numpy(float) for s in (xs, ns, ps, qs))
    with np.errstate(all="ignore"):
        inner = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
        inner = inner - 0.5 * np.log(2 * math.pi * x * (n - x) / n)
        none = np.where(p < 0.1, -_deviance(n, n * q) - n * p, n * np.log(q))
        every = np.where(q < 0.1, -_deviance(n, n * p) - n * q, n * np.log(p))
        return pd.Series(np.select([n == 0, x == 0, x == n], [0.0, none, every], inner))


def binomial_log(x: Column, n: Column, p: Column, q: Column) -> Column:
    """log probability of x successes in n trials of probability p (q = 1 - p), by the saddle-point expansion; by formulas of their own at both ends. Null where an argument is."""
    given = x.isNotNull() & n.isNotNull() & p.isNotNull() & q.isNotNull()
    return F.when(given, _binomial(*(c.cast("double") for c in (x, n, p, q))))


def hypergeometric_log(k: Column, draws: Column, successes: Column, total: Column) -> Column:
    """log probability of k successes among ``draws`` without replacement, from three binomial ones; minus infinity where k cannot be."""
    p, q = draws / total, (total - draws) / total
    parts = binomial_log(k, successes, p, q) + binomial_log(draws - k, total - successes, p, q) - binomial_log(draws, total, p, q)
    outside = (k < F.greatest(F.lit(0), draws - (total - successes))) | (k > F.least(successes, draws))
    return F.when(outside, float("-inf")).otherwise(parts)


def _quantile(p: float) -> float:
    if not 0 < p < 1:
        return {0.0: -math.inf, 1.0: math.inf}.get(p, math.nan)
    return NormalDist().inv_cdf(p)


@F.pandas_udf(DoubleType())
def normal_quantile(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Inverse of the standard normal distribution; infinite at 0 and 1, null outside."""
    return _over(_quantile, batches)


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    if not (a > 0 and x >= 0):
        return math.nan
    if x == 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = 0
        while abs(term) > abs(total) * 1e-16 and n < 10_000:
            n += 1
            term *= x / (a + n)
            total += term
        return front * total
    value = 0.0
    for k in range(200 + int(10 * math.sqrt(a)), 0, -1):  # evaluated from the inside
        value = k * (a - k) / (x + 2 * k + 1 - a + value)
    return 1 - front / (x + 1 - a + value)


@F.pandas_udf(DoubleType())
def regularized_gamma(shapes: pd.Series, points: pd.Series) -> pd.Series:
    """P(a, x); null for a <= 0 or x < 0."""
    return pd.Series([_gamma_p(float(a), float(x)) for a, x in zip(shapes, points)], dtype=float)
