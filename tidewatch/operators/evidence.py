"""Sequential evidence statistics: ordered, causal, one series per entity.

A panel has one row per (keys, day) with a dense 1-based `day` and a return
`ret`. Larger statistics mean more evidence that the entity is still valid, and
NULL marks days on which a statistic is not defined yet. All built-in methods
share one window specification, so any set of them costs one shuffle and one
sort; only the truncated variance leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import MonitorConfig
from tidewatch.functions.expr import expit, t_log_density_gap, unpivot
from tidewatch.operators.capped import with_capped_variance

KEYS = ("scenario", "path_set", "entity")


def by_day(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys).orderBy("day")


def running(keys: Sequence[str] = KEYS):
    return by_day(keys).rowsBetween(Window.unboundedPreceding, 0)


# --- increments -----------------------------------------------------------------

def standardised(ret: Column, cfg: MonitorConfig) -> Column:
    return ret / F.lit(cfg.sigma_daily)


def gaussian_step(ret: Column, cfg: MonitorConfig) -> Column:
    s = cfg.sharpe_valid
    return standardised(ret, cfg) * F.lit(s / cfg.sqrt_days) - F.lit(s * s / (2.0 * cfg.days_per_year))


def student_step(ret: Column, cfg: MonitorConfig) -> Column:
    nu = cfg.student_t_df
    return t_log_density_gap(standardised(ret, cfg), cfg.sharpe_valid / cfg.sqrt_days, 0.0,
                             F.lit((nu - 2.0) / nu), nu)


def variance_gaussian_step(ret: Column, var: Column, cfg: MonitorConfig) -> Column:
    return F.lit(cfg.drift_valid - cfg.drift_invalid) * (ret - F.lit(cfg.midpoint)) / var


def variance_student_step(ret: Column, var: Column, cfg: MonitorConfig) -> Column:
    nu = cfg.ewma_df
    return t_log_density_gap(ret, cfg.drift_valid, cfg.drift_invalid,
                             var * F.lit((nu - 2.0) / nu), nu)


# --- variance forecasts ---------------------------------------------------------

def _block_days(cfg: MonitorConfig) -> int:
    """Days over which the decay stays far inside the range of a double."""
    decay = -math.log(cfg.ewma_lambda)
    return 1 << 30 if decay == 0.0 else max(1, int(min(300.0 / decay, 1 << 30)))


def with_ewma_variance(panel: DataFrame, cfg: MonitorConfig, keys: Sequence[str] = KEYS,
                       name: str = "v_ewma") -> DataFrame:
    """Adds the forecast for day t made from days before t only, for series of any length.

    The recursion is linear, so inside a block of days it unrolls to a running sum of scaled
    squared residuals. A block starts from the sum over the block before it; what lies
    further back has decayed by e^-300, which no double can show. Both sums are windows
    over the series' own partition: no Python and no further shuffle.
    """
    lam, s2, size = cfg.ewma_lambda, cfg.sigma_daily ** 2, _block_days(cfg)
    d = panel.withColumn("_b", F.floor((F.col("day") - 1) / size)).withColumn("_o", ((F.col("day") - 1) % size).cast("double"))
    e2 = F.pow(F.col("ret") - F.lit(cfg.midpoint), F.lit(2.0))
    inside = Window.partitionBy(*keys, "_b").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
    run = F.coalesce(F.sum(e2 * F.pow(F.lit(lam), -F.col("_o") - 1.0)).over(inside), F.lit(0.0))
    last = F.coalesce(F.sum(e2 * F.pow(F.lit(lam), F.lit(size - 1.0) - F.col("_o"))).over(before), F.lit(0.0))
    first = F.when(F.col("_b") == 0, F.lit(s2)).when(F.col("_b") == 1, F.lit(s2 * lam ** size)).otherwise(F.lit(0.0))
    v = F.pow(F.lit(lam), F.col("_o")) * (first + F.lit(1.0 - lam) * (last + run))
    floor = cfg.variance_floor_factor * s2
    raw = d.withColumn(name, v).drop("_b", "_o")
    return (raw.withColumn(f"{name}_floored", F.col(name) < F.lit(floor))
            .withColumn(name, F.greatest(F.col(name), F.lit(floor))))


def with_truncated_variance(panel: DataFrame, cfg: MonitorConfig, keys: Sequence[str] = KEYS,
                            name: str = "v_trunc") -> DataFrame:
    """Adds the forecast whose update caps the squared residual at c^2 times itself."""
    return with_capped_variance(panel, cfg, keys, name)


# --- registry -------------------------------------------------------------------

@dataclass(frozen=True)
class Detector:
    """A method: its per-day increment (or rolling kind) and protocol facts."""

    name: str
    step: Callable[[MonitorConfig], Column] | None
    is_log_odds: bool
    role: str = "baseline"
    rolling: str | None = None
    needs: tuple[str, ...] = field(default_factory=tuple)
    custom: Callable[[MonitorConfig, Sequence[str]], Column] | None = None
    eligible: Callable[[MonitorConfig], int] | None = None

    def first_eligible_day(self, cfg: MonitorConfig) -> int:
        if self.eligible is not None:
            return self.eligible(cfg)
        return cfg.window if self.rolling else 1


DETECTORS: dict[str, Detector] = {d.name: d for d in (
    Detector("binary_gaussian", lambda c: gaussian_step(F.col("ret"), c), True),
    Detector("binary_student_t", lambda c: student_step(F.col("ret"), c), True),
    Detector("trailing_sharpe", None, False, rolling="sample"),
    Detector("known_vol_rolling", None, False, "diagnostic control", rolling="known"),
    Detector("ewma_gaussian", lambda c: variance_gaussian_step(F.col("ret"), F.col("v_ewma"), c),
             True, needs=("v_ewma",)),
    Detector("ewma_student_t", lambda c: variance_student_step(F.col("ret"), F.col("v_ewma"), c),
             True, needs=("v_ewma",)),
    Detector("ewma_trunc_gaussian",
             lambda c: variance_gaussian_step(F.col("ret"), F.col("v_trunc"), c),
             True, needs=("v_trunc",)),
    Detector("ewma_trunc_student_t",
             lambda c: variance_student_step(F.col("ret"), F.col("v_trunc"), c),
             True, needs=("v_trunc",)),
    Detector("known_variance", lambda c: variance_gaussian_step(F.col("ret"), F.col("true_var"), c),
             True, "diagnostic control"),
)}

#: methods that stay inside the JVM
JVM_METHODS = ("binary_gaussian", "binary_student_t", "trailing_sharpe", "known_vol_rolling",
               "ewma_gaussian", "ewma_student_t")
ALL_METHODS = JVM_METHODS + ("ewma_trunc_gaussian", "ewma_trunc_student_t")
GRID_2X2 = ("ewma_gaussian", "ewma_student_t", "ewma_trunc_gaussian", "ewma_trunc_student_t")


def resolve(methods: Iterable[str | Detector]) -> list[Detector]:
    out = []
    for m in methods:
        if isinstance(m, Detector):
            out.append(m)
        elif m in DETECTORS:
            out.append(DETECTORS[m])
        else:
            raise ValueError(f"unknown method {m!r}; known: {sorted(DETECTORS)}")
    return out


def wide_statistics(panel: DataFrame, methods: Iterable[str | Detector], cfg: MonitorConfig,
                    keys: Sequence[str] = KEYS, keep: Sequence[str] = ()) -> DataFrame:
    """One column per method next to the keys and the day."""
    dets = resolve(methods)
    needs = {n for d in dets for n in d.needs}
    base = panel
    if "v_trunc" in needs:
        base = with_truncated_variance(base, cfg, keys)
    if "v_ewma" in needs:
        base = with_ewma_variance(base, cfg, keys)
    run, order = running(keys), by_day(keys)
    rolling = [d for d in dets if d.rolling]
    if rolling:
        base = (base.withColumn("_s1", F.sum("ret").over(run))
                .withColumn("_s2", F.sum(F.col("ret") * F.col("ret")).over(run)))
    w = cfg.window
    full = F.col("day") >= w
    s1 = F.col("_s1") - F.coalesce(F.lag("_s1", w).over(order), F.lit(0.0))
    s2 = F.col("_s2") - F.coalesce(F.lag("_s2", w).over(order), F.lit(0.0))
    cols = []
    for d in dets:
        if d.custom is not None:
            c = d.custom(cfg, keys)
        elif d.rolling == "known":
            c = F.when(full, F.lit(cfg.sqrt_days / w / cfg.sigma_daily) * s1)
        elif d.rolling == "sample":
            mean = s1 / F.lit(float(w))
            ss = F.greatest(s2 - F.lit(float(w)) * mean * mean, F.lit(0.0))
            sd = F.sqrt(ss / F.lit(float(w - 1)))
            c = F.when(full, F.lit(cfg.sqrt_days) * mean / F.nullif(sd, F.lit(0.0)))
        else:
            c = F.lit(cfg.prior_log_odds) + F.sum(d.step(cfg)).over(run)
        cols.append(c.alias(d.name))
    return base.select(*keys, "day", *keep, *cols)


def long_statistics(panel: DataFrame, methods: Iterable[str | Detector], cfg: MonitorConfig,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, day, method, stat, first_eligible_day), every method in one pass."""
    dets = resolve(methods)
    wide = wide_statistics(panel, dets, cfg, keys)
    long = unpivot(wide, [*keys, "day"], [d.name for d in dets], "method", "stat")
    return long.withColumn("first_eligible_day", eligible_day(dets, cfg))


def eligible_day(methods: Iterable[str | Detector], cfg: MonitorConfig,
                 col: str = "method") -> Column:
    """First eligible day as a function of the method column."""
    out = None
    for d in resolve(methods):
        cond, val = F.col(col) == d.name, F.lit(d.first_eligible_day(cfg))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.cast("int")


def record_lows(panel: DataFrame, methods: Iterable[str | Detector], cfg: MonitorConfig,
                horizon: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The days on which a statistic makes a new low.

    A first passage below any threshold happens on one of these days, and the
    minimum over any prefix is the last of them. The ledger is therefore all
    that calibration, first passage, nested horizons and resampling need: a few
    dozen rows per entity and method instead of every day, computed once.
    An undefined statistic inside the eligible window is an error, not a gap.
    """
    dets = resolve(methods)
    h = horizon or cfg.horizon
    wide = wide_statistics(panel.where(F.col("day") <= h), dets, cfg, keys)
    before = by_day(keys).rowsBetween(Window.unboundedPreceding, -1)
    prev = [F.min(d.name).over(before).alias(f"_p_{d.name}") for d in dets]
    rows = wide.select(*keys, "day", *[d.name for d in dets], *prev)
    cells = F.explode(F.array(*[
        F.struct(F.lit(d.name).alias("method"),
                 F.when(F.isnan(d.name) | F.col(d.name).isNull(),
                        F.when(F.col("day") >= d.first_eligible_day(cfg), F.raise_error(
                            F.lit(f"undefined {d.name} inside the eligible window"))
                            .cast("double")))
                 .otherwise(F.col(d.name)).alias("stat"),
                 F.col(f"_p_{d.name}").alias("_prev")) for d in dets]))
    return (rows.select(*keys, "day", cells.alias("_c"))
            .select(*keys, "_c.method", "day", F.col("_c.stat").alias("stat"), "_c._prev")
            .where(F.col("stat").isNotNull() & (F.col("_prev").isNull() | (F.col("stat") < F.col("_prev"))))
            .drop("_prev"))


# --- panel transforms and diagnostics -------------------------------------------

def drift_overlay(panel: DataFrame, cfg: MonitorConfig, last_valid: str = "t_last_valid") -> DataFrame:
    """Adds the valid drift up to the last valid day and the invalid one after.

    NULL in `last_valid` means the entity never fails. The noise is untouched.
    """
    valid = F.col(last_valid).isNull() | (F.col("day") <= F.col(last_valid))
    return panel.withColumn("ret", F.col("ret") + F.when(valid, F.lit(cfg.drift_valid))
                            .otherwise(F.lit(cfg.drift_invalid)))


def failure_probability(log_odds: Column) -> Column:
    return expit(-log_odds)


def qlike(true_var: Column, forecast: Column) -> Column:
    x = true_var / forecast
    return x - F.ln(x) - F.lit(1.0)


def qlike_table(panel: DataFrame, cfg: MonitorConfig, group: Sequence[str] = ("scenario",)) -> DataFrame:
    """Forecast loss per entity first, then mean and standard error across entities."""
    d = with_ewma_variance(panel, cfg).withColumn("_b", F.lit(cfg.sigma_daily ** 2))
    per = d.groupBy(*KEYS).agg(
        F.avg(qlike(F.col("true_var"), F.col("v_ewma"))).alias("q_ewma"),
        F.avg(qlike(F.col("true_var"), F.col("_b"))).alias("q_const"))
    long = unpivot(per, [*group, "entity"], ["q_ewma", "q_const"], "forecast", "qlike")
    return long.groupBy(*group, "forecast").agg(
        F.count("qlike").alias("n_entities"), F.avg("qlike").alias("mean_qlike"),
        (F.stddev_samp("qlike") / F.sqrt(F.count("qlike"))).alias("se_qlike"))


def information_days(panel: DataFrame, cfg: MonitorConfig) -> DataFrame:
    """Running sum of base variance over true variance."""
    return panel.withColumn("info_days", F.sum(F.lit(cfg.sigma_daily ** 2) / F.col("true_var"))
                            .over(running()))


def variance_trace(panel: DataFrame, cfg: MonitorConfig) -> DataFrame:
    """Day-level trace of return, true and forecast variance (filter for one entity)."""
    d = with_ewma_variance(panel, cfg)
    return d.select(*KEYS, "day", "ret", "true_var", F.col("v_ewma").alias("forecast_var"),
                    (F.col("true_var") / F.col("v_ewma")).alias("variance_ratio"),
                    qlike(F.col("true_var"), F.col("v_ewma")).alias("qlike"))


def shock_variants(panel: DataFrame, cfg: MonitorConfig, day: int, sigmas: float) -> DataFrame:
    """Three copies of every series: unchanged, and shocked up or down on one day."""
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(a).alias("amp")) for n, a in (
        ("base", 0.0), ("down", -sigmas * cfg.sigma_daily), ("up", sigmas * cfg.sigma_daily))]))
    return (panel.withColumn("_v", v)
            .withColumn("variant", F.col("_v.variant"))
            .withColumn("ret", F.col("ret") + F.when(F.col("day") == day, F.col("_v.amp")).otherwise(0.0))
            .drop("_v"))
