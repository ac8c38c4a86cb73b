"""Column expressions shared by the operators (all stay inside codegen)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """num/den, NULL instead of an ANSI error when the denominator is zero."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def exact_mean(x: str | Column) -> Column:
    """Mean from an exact sum, rounded once: the same bits whatever order the rows meet in.

    A plain sum of doubles depends on its order, so equal series get unequal means and compare
    as different. A value is split into three whole numbers (multiples of 2^-12, 2^-36 and 2^-60),
    whose sums carry no rounding. Groups with a value beyond 2^20 or not finite use the plain mean.
    """
    x = col(x).cast("double")
    fits = F.abs(x) < F.lit(2.0 ** 20)  # false for NaN
    v = F.when(fits, x) * F.lit(2.0 ** 12)
    hi = F.floor(v)
    rest = (v - hi.cast("double")) * F.lit(2.0 ** 24)
    mid = F.floor(rest)
    lo = F.rint((rest - mid.cast("double")) * F.lit(2.0 ** 24)).cast("long")
    low = F.lit(2 ** 24 - 1).cast("long")
    s_lo = F.sum(lo)
    s_mid = F.sum(mid) + F.shiftright(s_lo, 24)
    s_hi = F.sum(hi) + F.shiftright(s_mid, 24)
    part = F.shiftleft(s_mid.bitwiseAND(low), 24) + s_lo.bitwiseAND(low)
    total = (s_hi.cast("double") + part.cast("double") * F.lit(2.0 ** -48)) * F.lit(2.0 ** -12)
    return F.when(F.count_if(~fits) > 0, F.avg(x)).otherwise(total / F.nullif(F.count(x), F.lit(0)))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def r(x: str | Column, digits: int = 9) -> Column:
    """Final-projection rounding; adding zero removes negative zero."""
    return F.round(col(x), digits) + F.lit(0.0)


def clean(x: str | Column) -> Column:
    """NaN becomes NULL: an undefined statistic has one representation."""
    c = col(x)
    return F.when(F.isnan(c), None).otherwise(c)


def wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Wilson score bounds; exact 0 and 1 at the ends, NULL without trials."""
    n_ = F.nullif(n.cast("double"), F.lit(0.0))
    p = k.cast("double") / n_
    z2 = z * z
    den = F.lit(1.0) + F.lit(z2) / n_
    mid = (p + F.lit(z2) / (n_ * 2.0)) / den
    half = F.lit(z) / den * F.sqrt(p * (F.lit(1.0) - p) / n_ + F.lit(z2) / (n_ * n_ * 4.0))
    lo = F.when(n == 0, None).when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half))
    hi = F.when(n == 0, None).when(k == n, 1.0).otherwise(F.least(F.lit(1.0), mid + half))
    return lo, hi


def excludes_zero(lo: Column, hi: Column) -> Column:
    """Strict on both sides: an interval touching zero does not exclude it."""
    return (lo > 0.0) | (hi < 0.0)


def t_log_density_gap(x: Column, loc1: float, loc0: float, scale2: Column, nu: float) -> Column:
    """log t(x; loc1) - log t(x; loc0) for a common squared scale.

    Both densities share degrees of freedom and scale, so the normalising
    constants cancel and only two log1p terms remain.
    """
    d1 = x - F.lit(loc1)
    d0 = x - F.lit(loc0)
    k = F.lit(-(nu + 1.0) / 2.0)
    return k * (F.log1p(d1 * d1 / (scale2 * nu)) - F.log1p(d0 * d0 / (scale2 * nu)))


def pair_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both members exist.

    NULL below three pairs or when either side is constant. `covar_pop` and
    `var_pop` update centred sums, so nothing cancels and a constant series
    gives an exact zero instead of an ANSI division error.
    """
    ok = a.isNotNull() & b.isNotNull()
    a_, b_ = F.when(ok, a), F.when(ok, b)
    den = F.sqrt(F.var_pop(a_) * F.var_pop(b_))
    return F.when(F.count(a_) >= 3, F.covar_pop(a_, b_) / F.nullif(den, F.lit(0.0)))


def unpivot(df: DataFrame, ids: Iterable[str], cols: Iterable[str], name: str, value: str) -> DataFrame:
    """Wide to long without a join; a narrow, per-row expansion."""
    cols = list(cols)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols
    ]))
    return df.select(*ids, pairs.alias("_kv")).select(*ids, f"_kv.{name}", f"_kv.{value}")
