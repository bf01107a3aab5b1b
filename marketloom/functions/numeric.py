"""Column helpers for the numerics contract: no raise on x/0, explicit bias choices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """NULL instead of an error when the denominator is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rounded(c, places: int) -> Column:
    """The scaled value to the next whole number, halves away from zero, as SQL's round does.

    The built-in ``round`` takes the printed decimal: 108.16499999999999 to two places is 108.16 there and 108.17 in SQL.
    """
    c, unit, inf = col(c).cast("double"), F.lit(10.0 ** places), F.lit(float("inf"))
    scaled = c * unit
    whole = F.when(F.abs(scaled - F.rint(scaled)) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(F.rint(scaled))
    return F.when(F.abs(scaled) == inf, c).otherwise(whole / unit)


def clip(c, lo, hi) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def let(value: Column, body) -> Column:
    """Bind a value once for use inside higher-order functions.

    A plain column alias would be inlined by the optimizer and recomputed for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).when(~cond, F.lit(0.0))


def ratio_change(a, b) -> Column:
    """a / b - 1, as the SQL has it: (a - b) / b ends in other last digits, and some ratios lie on half a unit of the sixth place."""
    return div(a, b) - 1


def weighted_mean(value, weight) -> Column:
    v, w = col(value), col(weight)
    return div(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def correlation(a, b, frame=None) -> Column:
    """Correlation of the pairs without nulls (over a window frame, if given); NULL where a side is constant.

    The built-in ``corr`` divides by zero there, which is an error in ANSI mode.
    """
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    parts = F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)
    cov, sa, sb = (p.over(frame) for p in parts) if frame is not None else parts
    return F.try_divide(cov, sa * sb)


def finite(c) -> Column:
    """NULL for NaN and the infinities."""
    c = col(c)
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (c != inf) & (c != -inf), c)


def corrected_skew(skew: Column, n: Column) -> Column:
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def corrected_kurt(kurt: Column, n: Column) -> Column:
    return F.when(n > 3, ((n + 1) * kurt + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def normal_cdf(z: Column) -> Column:
    """Zelen-Severo rational approximation of the normal distribution (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def unit_hash(seed: int, *cols) -> Column:
    """Reproducible number in (0, 1) from whole numbers, by modular arithmetic that any SQL engine can repeat."""
    m = 2147483647
    h = F.lit(seed).cast("long")
    for c in cols:
        h = F.pmod((h * 48271 + F.pmod(col(c).cast("long"), F.lit(m))) * 16807 + 12345, F.lit(m))
    return (F.pmod(h * 69621, F.lit(m)) + 1) / F.lit(2147483649.0)


def normal_hash(seed: int, *cols) -> Column:
    """Reproducible standard normal number (Box-Muller over two unit hashes)."""
    return F.sqrt(-2 * F.ln(unit_hash(seed, *cols))) * F.cos(6.283185307179586 * unit_hash(seed + 1, *cols))


PRIME = 2147483647


def mixed_hash(seed: int, *parts) -> np.ndarray:
    """Repeatable numbers in (0, 1) from arrays of whole numbers: fifth powers modulo a prime, which any SQL engine can repeat.

    Unlike ``unit_hash`` it is not linear in its parts, so rows and repetitions are not shifts of each other.
    """
    x = np.int64(seed % PRIME)
    for p in parts:
        x = (x * 48271 + np.asarray(p, dtype=np.int64) % PRIME) % PRIME
        square = x * x % PRIME
        x = square * square % PRIME * x % PRIME
    return (x + 0.5) / PRIME
