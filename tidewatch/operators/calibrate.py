"""Threshold calibration against a cumulative false-alarm budget.

Thresholds are order statistics of per-entity minima over valid calibration
entities. Selection is exact and distributed (see `functions.ranking`), so the
number of entities in one cell is not bounded by a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import MonitorConfig
from tidewatch.functions.expr import expit, ratio, wilson
from tidewatch.functions.ranking import _bucket_totals, _bucketed, order_statistics
from tidewatch.functions.small import small
from tidewatch.operators.evidence import DETECTORS, KEYS, resolve, wide_statistics

CALIBRATION = "calibration_valid"


def path_minima(lows: DataFrame, horizon: int | None = None) -> DataFrame:
    """Minimum over the eligible days 1..H per entity and method."""
    m = F.col("stat") if horizon is None else F.when(F.col("day") <= horizon, F.col("stat"))
    return lows.groupBy(*KEYS, "method").agg(F.min(m).alias("min_stat"))


def prefix_minima(lows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Minima for nested horizons from one pass over the ledger."""
    per = lows.groupBy(*KEYS, "method").agg(*[
        F.min(F.when(F.col("day") <= h, F.col("stat"))).alias(f"_h{h}") for h in horizons])
    cells = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("min_stat")) for h in horizons]))
    return (per.select(*KEYS, "method", cells.alias("_c"))
            .select(*KEYS, "method", "_c.horizon", "_c.min_stat").where(F.col("min_stat").isNotNull()))


def window_minima(panel: DataFrame, methods: Sequence[str], cfg: MonitorConfig,
                  windows: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Minimum inside named day windows, +inf where nothing is eligible."""
    wide = wide_statistics(panel, methods, cfg)
    per = wide.groupBy(*KEYS).agg(*[
        F.coalesce(F.min(F.when(F.col("day").between(max(lo, d.first_eligible_day(cfg)), hi), F.col(d.name))),
                   F.lit(math.inf)).alias(f"{d.name}__{w}")
        for d in resolve(methods) for w, (lo, hi) in windows.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), *[
        F.col(f"{m}__{w}").alias(w) for w in windows]) for m in methods]))
    return per.select(*KEYS, cells.alias("_c")).select(*KEYS, "_c.*")


def nominal_rank(n: Column, alpha: float) -> Column:
    """1-based rank of the floor(alpha N)-th order statistic counted from zero."""
    return F.least(F.floor(F.lit(alpha) * n), n - 1) + 1


def buffered_rank(n: int, alpha: float, delta: float) -> int | None:
    """Largest rank k with P{Binomial(n, alpha) <= k-1} <= delta, None if there is none.

    Log-pmf recurrence; terms far below the mean are skipped once they cannot
    change the sum.
    """
    if n <= 0:
        return None
    mean, sd = n * alpha, math.sqrt(n * alpha * (1.0 - alpha))
    j = max(0, int(mean - 40.0 * sd - 40.0))
    logp = (math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
            + j * math.log(alpha) + (n - j) * math.log1p(-alpha))
    odds = math.log(alpha) - math.log1p(-alpha)
    cdf, best = 0.0, None
    while j < n:
        cdf += math.exp(logp)
        if cdf > delta:
            break
        best = j + 1
        logp += math.log(n - j) - math.log(j + 1) + odds
        j += 1
    return best


def _buffered(n: Column, alpha: float, delta: float) -> Column:
    @F.pandas_udf("bigint")
    def rank_of(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: buffered_rank(int(s), alpha, delta)).astype("Int64")
    return rank_of(n)


def _long_thresholds(wide: DataFrame, by: Sequence[str], alphas: Sequence[float], tags: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(
        F.lit(float(a)).alias("far_target"),
        *[F.col(f"{t}_{i}").alias(t) for t in tags]) for i, a in enumerate(alphas)]))
    return wide.select(*by, "n_paths", cells.alias("_c")).select(*by, "n_paths", "_c.*")


def thresholds(minima: DataFrame, cfg: MonitorConfig, by: Sequence[str] = ("method",)) -> DataFrame:
    """Nominal threshold per group and budget, from calibration entities only."""
    cal = minima.where(F.col("path_set") == CALIBRATION)
    ranks = {f"threshold_{i}": (lambda n, a=a: nominal_rank(n, a)) for i, a in enumerate(cfg.far_targets)}
    wide = order_statistics(cal, by, "min_stat", ranks, count_as="n_paths")
    long = _long_thresholds(wide, by, cfg.far_targets, ["threshold"])
    return long.withColumn("rank", nominal_rank_of(F.col("n_paths"), F.col("far_target")).cast("bigint"))


def nominal_rank_of(n: Column, alpha: Column) -> Column:
    return F.least(F.floor(alpha * n), n - 1) + 1


def with_achieved_rate(thr: DataFrame, minima: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Adds the share of calibration minima strictly below each threshold."""
    cal = minima.where(F.col("path_set") == CALIBRATION).select(*by, "min_stat")
    hits = cal.join(small(thr.select(*by, "far_target", "threshold")), list(by)).groupBy(*by, "far_target").agg(
        F.count_if(F.col("min_stat") < F.col("threshold")).alias("n_alarms"))
    return thr.join(hits, [*by, "far_target"]).withColumn(
        "achieved_far", ratio(F.col("n_alarms"), F.col("n_paths")))


def buffered_thresholds(minima: DataFrame, cfg: MonitorConfig, by: Sequence[str], delta: float) -> DataFrame:
    """Nominal and buffered thresholds; `delta` is the budget of one cell."""
    cal = minima.where(F.col("path_set") == CALIBRATION)
    ranks = {}
    for i, a in enumerate(cfg.far_targets):
        ranks[f"threshold_{i}"] = lambda n, a=a: nominal_rank(n, a)
        ranks[f"buffered_threshold_{i}"] = lambda n, a=a: _buffered(n, a, delta)
    wide = order_statistics(cal, by, "min_stat", ranks, count_as="n_paths")
    long = _long_thresholds(wide, by, cfg.far_targets, ["threshold", "buffered_threshold"])
    rank = None
    for a in cfg.far_targets:
        cond, val = F.col("far_target") == a, _buffered(F.col("n_paths"), a, delta)
        rank = F.when(cond, val) if rank is None else rank.when(cond, val)
    return (long.withColumn("rank", nominal_rank_of(F.col("n_paths"), F.col("far_target")).cast("bigint"))
            .withColumn("buffered_rank", rank))


def unified(thr: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """Lowest threshold over the covered scenarios, which one binds, and each value."""
    return thr.groupBy("method", "far_target").agg(
        F.min("threshold").alias("threshold"),
        F.min_by("scenario", F.struct("threshold", "scenario")).alias("binding_scenario"),
        *[F.max(F.when(F.col("scenario") == s, F.col("threshold"))).alias(f"threshold_{s}") for s in scenarios])


def working_probability(thr: DataFrame) -> DataFrame:
    """expit(-threshold) where the statistic is a log-odds, blank elsewhere."""
    log_odds = [d.name for d in DETECTORS.values() if d.is_log_odds]
    return thr.withColumn("working_prob", F.when(F.col("method").isin(*log_odds), expit(-F.col("threshold"))))


def matched_pre_failure(lows: DataFrame, methods: Sequence[str], cfg: MonitorConfig, days: Sequence[int],
                        target: float) -> DataFrame:
    """Threshold that hits a target alarm rate on days 1..T; -inf when nothing is eligible by T."""
    m = prefix_minima(lows, days).where(F.col("path_set") == CALIBRATION)
    got = order_statistics(m, ["method", "horizon"], "min_stat",
                           {"threshold": lambda n: nominal_rank(n, target)}, count_as="n_paths")
    want = lows.sparkSession.createDataFrame(
        [(d.name, int(t)) for d in resolve(methods) for t in days], "method string, horizon int")
    return want.join(got, ["method", "horizon"], "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(-math.inf)))


GRID_LOW, GRID_HIGH, GRID_POINTS = 0.0005, 0.6, 3000


def _quantile_grid(values: DataFrame, key: str, value: str, points: int) -> DataFrame:
    """Linear quantiles at evenly spaced probabilities, long: (key, i, c).

    Each distinct value covers a range of ranks; the grid indices falling into
    it follow by arithmetic, so no group is ever sorted as a whole.
    """
    vc = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("_w"))
    b = _bucketed(vc, [key], value, "_w", 64)
    lo = _bucket_totals(b, [key], "_w").select(key, "_b", "_lo", "_n")
    inside = Window.partitionBy(key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = (b.drop("_n").join(lo, [key, "_b"]).withColumn("_c", F.col("_lo") + F.sum("_w").over(inside))
         .withColumn("_a", F.col("_c") - F.col("_w")))
    step = (GRID_HIGH - GRID_LOW) / (points - 1)
    span = F.greatest(F.col("_n") - 1, F.lit(1)).cast("double")

    def index(rank: Column) -> Column:
        return (rank.cast("double") / span - GRID_LOW) / step
    first = F.greatest(F.lit(0).cast("bigint"), F.floor(index(F.col("_a") - 2)) - 1)
    last = F.least(F.lit(points - 1).cast("bigint"), F.ceil(index(F.col("_c"))) + 1)
    cand = c.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    h = (F.col("_n") - 1) * (F.lit(GRID_LOW) + F.col("i") * F.lit(step))
    lo_rank, hi_rank = F.floor(h) + 1, F.least(F.floor(h) + 2, F.col("_n"))

    def holds(rank: Column) -> Column:
        return (rank > F.col("_a")) & (rank <= F.col("_c"))
    g = cand.where(holds(lo_rank) | holds(hi_rank)).groupBy(key, "i").agg(
        F.max(F.when(holds(lo_rank), F.col(value))).alias("_lo_v"),
        F.max(F.when(holds(hi_rank), F.col(value))).alias("_hi_v"), F.first(h - F.floor(h)).alias("_f"))
    return g.select(key, "i", (F.col("_lo_v") + F.col("_f") * (F.col("_hi_v") - F.col("_lo_v"))).alias("c"))


def matched_continuation(pre_post: DataFrame, target: float, floor: float = 0.5,
                         points: int = GRID_POINTS) -> DataFrame:
    """Threshold matched on the alarm rate after T among entities still alive at T.

    `pre_post` has `pre` and `post` minima per entity. An entity counts as a
    continuation alarm for candidates in (post, pre], so it adds +1 at the first
    grid index above `post` and -1 behind the last one up to `pre`; running sums
    over the grid replace the candidate-by-entity comparison.
    """
    v = pre_post.select("method", F.explode(F.array("pre", "post")).alias("v"))
    grid = _quantile_grid(v, "method", "v", points)
    arr = small(grid.groupBy("method").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("g")))
    block = 64

    def position(x: str) -> Column:
        """Number of grid points <= x, by a coarse and a fine search."""
        coarse = F.size(F.filter(F.sequence(F.lit(1), F.lit(points), F.lit(block)),
                                 lambda k: F.element_at("g", k) <= F.col(x)))
        start = F.greatest(coarse - 1, F.lit(0)) * block
        fine = F.size(F.filter(F.slice("g", start + 1, F.lit(block)), lambda y: y <= F.col(x)))
        return F.when(coarse == 0, 0).otherwise(start + fine)
    p = pre_post.join(arr, "method").select(
        "method", position("pre").alias("alive"), position("post").alias("from"))
    # indices are 0-based: c_i <= pre for i < alive, c_i > post for i >= from
    marks = p.select("method", F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.lit(1).alias("s"), F.lit(0).alias("a"), F.lit(1).alias("t")),
        F.struct(F.col("alive").alias("i"), F.lit(-1).alias("s"),
                 F.when(F.col("from") < F.col("alive"), -1).otherwise(0).alias("a"), F.lit(0).alias("t")),
        F.struct(F.col("from").alias("i"), F.lit(0).alias("s"),
                 F.when(F.col("from") < F.col("alive"), 1).otherwise(0).alias("a"), F.lit(0).alias("t")),
    )).alias("m")).groupBy("method", F.col("m.i").alias("i")).agg(
        F.sum("m.s").alias("s"), F.sum("m.a").alias("a"), F.sum("m.t").alias("t"))
    w = Window.partitionBy("method").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("t").over(Window.partitionBy("method"))
    scored = (grid.join(marks, ["method", "i"], "full")
              .withColumn("_alive", F.sum(F.coalesce("s", F.lit(0))).over(w))
              .withColumn("_alarm", F.sum(F.coalesce("a", F.lit(0))).over(w))
              .withColumn("_n", n)
              .withColumn("rate", ratio(F.col("_alarm"), F.col("_alive")))
              .withColumn("ok", ratio(F.col("_alive"), F.col("_n")) >= floor))
    scored = scored.where(F.col("c").isNotNull())
    fits = F.col("ok") & (F.col("rate") <= target)
    best = F.struct(F.col("rate").alias("rate"), (-F.col("i")).alias("k"), F.col("c").alias("c"),
                    (1.0 - F.col("_alive") / F.col("_n")).alias("pre_fa"))
    out = scored.groupBy("method").agg(
        F.max(F.when(fits, best)).alias("b"), F.min_by("c", "i").alias("c0"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("rate"))), F.lit(0.0)).alias("max_reachable"))
    return out.select(
        "method", F.coalesce("b.c", "c0").alias("threshold"),
        F.coalesce("b.rate", F.lit(0.0)).alias("achieved_continuation_fa"),
        F.coalesce("b.pre_fa", F.lit(0.0)).alias("pre_failure_fa"),
        "max_reachable", (F.col("max_reachable") >= target).alias("feasible"))


def validate_frozen(lows: DataFrame, thr: DataFrame, cfg: MonitorConfig, t: int, post: int,
                    on: Sequence[str] = ("method",)) -> DataFrame:
    """Frozen thresholds re-measured per role: alarms up to T, survivors, alarms after.

    A survivor alarms in the window exactly when its minimum over the whole span
    falls below the threshold, so the ledger of lows is enough.
    """
    per = lows.where(F.col("day") <= t + post).groupBy(*KEYS, "method").agg(
        F.min(F.when(F.col("day") <= t, F.col("stat"))).alias("pre"), F.min("stat").alias("full"))
    j = per.join(small(thr.select(*on, "far_target", "threshold")), list(on))
    early = F.coalesce(F.col("pre") < F.col("threshold"), F.lit(False))
    out = j.groupBy("path_set", *on, "far_target", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(early).alias("n_pre"),
        F.count_if(~early & (F.col("full") < F.col("threshold"))).alias("n_cont"))
    out = out.withColumn("n_survived", F.col("n") - F.col("n_pre"))
    plo, phi = wilson(F.col("n_pre"), F.col("n"), cfg.wilson_z)
    clo, chi = wilson(F.col("n_cont"), F.col("n_survived"), cfg.wilson_z)
    return out.select("path_set", *on, "far_target", "threshold", "n", "n_pre", "n_survived", "n_cont",
                      ratio(F.col("n_pre"), F.col("n")).alias("pre_fa"), plo.alias("pre_fa_lo"), phi.alias("pre_fa_hi"),
                      ratio(F.col("n_cont"), F.col("n_survived")).alias("cont_fa"),
                      clo.alias("cont_fa_lo"), chi.alias("cont_fa_hi"))


def replication_study(minima: DataFrame, cfg: MonitorConfig, replicate: str = "replicate") -> DataFrame:
    """Spread of the realised rate over replicate blocks, against binomial noise."""
    by = [replicate, "method"]
    thr = thresholds(minima, cfg, by)
    test = minima.where(F.col("path_set") == "test_valid")
    far = test.join(small(thr), by).groupBy(*by, "far_target", "threshold").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("min_stat") < F.col("threshold")) / F.count(F.lit(1))).alias("far"))
    g = far.groupBy("method", "far_target").agg(
        F.count(F.lit(1)).alias("n_replications"), F.sum("n").alias("_n"), F.avg("far").alias("mean_far"),
        F.stddev_samp("far").alias("sd_far"), F.min("far").alias("min_far"), F.max("far").alias("max_far"),
        F.avg((F.col("far") > F.col("far_target")).cast("double")).alias("share_above_target"),
        F.stddev_samp("threshold").alias("sd_threshold"), F.avg("threshold").alias("mean_threshold"))
    se = F.sqrt(F.col("far_target") * (1.0 - F.col("far_target")) / (F.col("_n") / F.col("n_replications")))
    excess = F.col("sd_far") * F.col("sd_far") - F.col("binomial_se") * F.col("binomial_se")
    return (g.withColumn("binomial_se", se)
            .withColumn("sd_far_se", F.col("sd_far") / F.sqrt(2.0 * (F.col("n_replications") - 1)))
            .withColumn("sd_inflation", ratio(F.col("sd_far"), F.col("binomial_se")))
            .withColumn("calibration_sd", F.sqrt(F.greatest(excess, F.lit(0.0))))
            .withColumn("excess_negative", excess < 0).drop("_n"))


def compare_thresholds(rebuilt: DataFrame, frozen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Exact equality and the distance in units in the last place of the rebuilt value."""
    j = rebuilt.select(*on, F.col("threshold").alias("rebuilt")).join(
        frozen.select(*on, F.col("threshold").alias("frozen")), list(on), "full")
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(F.nullif(F.col("rebuilt"), F.lit(0.0))))) - 52)
    return j.withColumn("exact", F.coalesce(F.col("rebuilt") == F.col("frozen"), F.lit(False))).withColumn(
        "ulps", F.when(F.col("exact"), F.lit(0)).otherwise(
            F.round((F.col("frozen") - F.col("rebuilt")) / ulp)).cast("bigint"))
