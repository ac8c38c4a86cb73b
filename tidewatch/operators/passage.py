"""First passage below a threshold and what follows from it.

Rules kept everywhere: an alarm needs `stat < threshold` strictly, an undefined
statistic never alarms, the first alarm is absorbing, and an entity that never
alarms (tau = -1) is a survivor that stays in every denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import MonitorConfig
from tidewatch.functions.expr import expit, ratio, wilson
from tidewatch.functions.temporal import latest_before
from tidewatch.operators.evidence import KEYS, by_day, wide_statistics

NEVER = -1


def first_passage(lows: DataFrame, thresholds: DataFrame, on: Sequence[str], *,
                  budget: Sequence[str] = ("far_target",), horizon: int | Column | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """First alarm day per entity and rule, from the ledger of new lows.

    `thresholds` has one row per rule. Every entity has at least one ledger row
    per method, so the conditional minimum keeps those that never alarm.
    """
    t = thresholds.select(*on, *budget, "threshold", *keep)
    j = lows.join(t, list(on))
    below = F.col("stat") < F.col("threshold")
    if horizon is not None:
        below = below & (F.col("day") <= horizon)
    keys = [*KEYS, "method", *[b for b in (*budget, *keep) if b not in (*KEYS, "method")]]
    return j.groupBy(*keys).agg(
        F.first("threshold").alias("threshold"),
        F.coalesce(F.min(F.when(below, F.col("day"))), F.lit(NEVER)).cast("int").alias("tau"))


def alarmed(tau: Column = None) -> Column:
    return (F.col("tau") if tau is None else tau) != NEVER


def alarmed_by(day: int | Column) -> Column:
    return alarmed() & (F.col("tau") <= day)


def truncated(horizon: int | Column) -> Column:
    """min(tau, H); a survivor is scored at the cap."""
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    return F.when(alarmed_by(h), F.col("tau")).otherwise(h)


def alarm_counts(fp: DataFrame, group: Sequence[str]) -> DataFrame:
    """Alarms per day and group size: at most one row per group and day."""
    n = fp.groupBy(*group, "tau").agg(F.count(F.lit(1)).alias("n_at"))
    return n.withColumn("n", F.sum("n_at").over(Window.partitionBy(*group)))


def cumulative_curve(fp: DataFrame, group: Sequence[str], horizon: int) -> DataFrame:
    """P(tau <= t) for every t = 1..horizon."""
    counts = alarm_counts(fp, group)
    groups = counts.groupBy(*group).agg(F.first("n").alias("n"))
    grid = groups.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    hits = counts.where(alarmed()).select(*group, F.col("tau").alias("day"), "n_at")
    w = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (grid.join(hits, [*group, "day"], "left")
            .withColumn("n_alarmed", F.sum(F.coalesce("n_at", F.lit(0))).over(w))
            .select(*group, "day", "n", "n_alarmed", ratio(F.col("n_alarmed"), F.col("n")).alias("cum_rate")))


def median_day(fp: DataFrame, group: Sequence[str], horizon: int, share: float = 0.5,
               name: str = "median_day") -> DataFrame:
    """First day the share over ALL entities reaches the level; NULL when never."""
    counts = alarm_counts(fp, group)
    w = Window.partitionBy(*group).orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)
    live = alarmed() & (F.col("tau") <= horizon)
    c = counts.withColumn("_c", F.sum(F.when(live, F.col("n_at")).otherwise(0)).over(w))
    return c.groupBy(*group).agg(
        F.min(F.when(live & (F.col("_c") / F.col("n") >= share), F.col("tau"))).alias(name))


def rates_at_days(fp: DataFrame, group: Sequence[str], days: Sequence[int], cfg: MonitorConfig) -> DataFrame:
    """k, n, rate and Wilson interval at each day, one pass without a row explosion."""
    per = fp.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                                 *[F.count_if(alarmed_by(d)).alias(f"_k{d}") for d in days])
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"_k{d}").alias("k")) for d in days]))
    out = per.select(*group, "n", cells.alias("_c")).select(*group, "_c.day", "_c.k", "n")
    lo, hi = wilson(F.col("k"), F.col("n"), cfg.wilson_z)
    return out.select(*group, "day", "k", "n", ratio(F.col("k"), F.col("n")).alias("rate"),
                      lo.alias("lo"), hi.alias("hi"))


def truncated_mean(fp: DataFrame, group: Sequence[str], cfg: MonitorConfig, horizon: int) -> DataFrame:
    t = truncated(horizon).cast("double")
    se = F.stddev_samp(t) / F.sqrt(F.count(F.lit(1)))
    return fp.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(t).alias("mean_days"), se.alias("se_days"),
        (F.avg(t) / cfg.days_per_year).alias("mean_years"), (se / cfg.days_per_year).alias("se_years"))


def metric_rows(fp: DataFrame, group: Sequence[str], cfg: MonitorConfig,
                days: Sequence[int] | None = None, horizon: int | None = None) -> DataFrame:
    """Wide metric row per rule: false-alarm and detection side by side.

    `fp` holds both test roles and is read once: entities are counted by role and alarm day,
    and that table, which the horizon bounds, gives rates, means and the median.
    """
    days = days or cfg.report_days
    h = horizon or cfg.horizon
    c = fp.groupBy(*group, "path_set", "tau").agg(F.count(F.lit(1)).alias("_k"), F.max("threshold").alias("threshold"))
    late, run = F.col("path_set") == "test_invalid", Window.partitionBy(*group).orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)
    live = late & alarmed_by(h)
    c = (c.withColumn("_c", F.sum(F.when(live, F.col("_k")).otherwise(0)).over(run))
         .withColumn("_n", F.sum(F.when(late, F.col("_k"))).over(Window.partitionBy(*group))))
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0))
    k, t = F.col("_k"), truncated(h).cast("bigint")
    aggs = [F.min(F.when(live & (F.col("_c") >= 0.5 * F.col("_n")), F.col("tau"))).alias("median_detect_day")]
    for role, tag in (("test_valid", "far"), ("test_invalid", "detect")):
        mine = F.col("path_set") == role
        aggs.append(total(mine, k).alias(f"n_{role}"))
        aggs += [total(mine & alarmed_by(d), k).alias(f"_{tag}_{d}") for d in days]
        aggs.append(total(mine & alarmed_by(h), k).alias(f"_{tag}_H"))
        aggs += [total(mine, k * t).cast("double").alias(f"_{tag}_s1"), total(mine, k * t * t).cast("double").alias(f"_{tag}_s2")]
    wide = c.groupBy(*group).agg(F.max("threshold").alias("threshold"), *aggs)
    for role, tag in (("test_valid", "far"), ("test_invalid", "detect")):
        n, s1 = F.col(f"n_{role}").cast("double"), F.col(f"_{tag}_s1")
        var = F.greatest(ratio(F.col(f"_{tag}_s2") - ratio(s1 * s1, n), n - 1.0), F.lit(0.0))
        wide = wide.withColumn(f"trunc_mean_{tag}", ratio(s1, n)).withColumn(f"trunc_se_{tag}", F.when(n > 1, F.sqrt(var) / F.sqrt(n)))
    cols: list[Column] = [F.col(c) for c in (*group, "threshold", "n_test_valid", "n_test_invalid")]
    for role, tag in (("test_valid", "far"), ("test_invalid", "detect")):
        n = F.col(f"n_{role}")
        for d in days:
            k = F.col(f"_{tag}_{d}")
            lo, hi = wilson(k, n, cfg.wilson_z)
            cols += [ratio(k, n).alias(f"{tag}_d{d}"), lo.alias(f"{tag}_d{d}_lo"), hi.alias(f"{tag}_d{d}_hi")]
    miss, n = F.col("n_test_invalid") - F.col("_detect_H"), F.col("n_test_invalid")
    lo, hi = wilson(miss, n, cfg.wilson_z)
    note = F.when(F.col("median_detect_day").isNull(), F.lit(f"not reached within {h}d")).otherwise("")
    return wide.select(
        *cols, ratio(miss, n).alias("undetected_at_H"), lo.alias("undetected_lo"), hi.alias("undetected_hi"),
        F.col("trunc_mean_detect"), F.col("trunc_se_detect"),
        F.col("trunc_mean_far").alias("trunc_mean_valid"), F.col("trunc_se_far").alias("trunc_se_valid"),
        F.col("median_detect_day"), note.alias("median_note"))


# --- evidence at the failure day -------------------------------------------------

def evidence_increments(panel: DataFrame, method: str, cfg: MonitorConfig) -> DataFrame:
    """U = -L per day and its increment since the last valid day, per entity first."""
    wide = wide_statistics(panel, [method], cfg, keep=["t_last_valid"])
    u = wide.select(*KEYS, "day", "t_last_valid", (-F.col(method)).alias("u"))
    at_t = F.max(F.when(F.col("day") == F.col("t_last_valid"), F.col("u"))).over(
        Window.partitionBy(*KEYS))
    return u.withColumn("inc", F.col("u") - F.coalesce(at_t, F.lit(-cfg.prior_log_odds)))


def evidence_at_failure(panel: DataFrame, methods: Sequence[str], cfg: MonitorConfig) -> DataFrame:
    """U at the last valid day, long over methods; the prior when T = 0.

    An entity that never fails has no such day and is rejected.
    """
    wide = wide_statistics(panel, methods, cfg, keep=["t_last_valid"])
    t = F.when(F.col("t_last_valid").isNull(), F.raise_error(
        F.lit("evidence at the failure day is undefined for an entity that never fails")).cast("int")
    ).otherwise(F.col("t_last_valid"))
    wide = wide.withColumn("t_last_valid", t)
    prior = F.lit(-cfg.prior_log_odds)
    per = wide.groupBy(*KEYS, "t_last_valid").agg(*[
        F.coalesce(-F.max(F.when(F.col("day") == F.col("t_last_valid"), F.col(m))), prior).alias(m)
        for m in methods])
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("u")) for m in methods]))
    return (per.select(*KEYS, "t_last_valid", cells.alias("_c"))
            .select(*KEYS, "t_last_valid", "_c.method", "_c.u").withColumn("q", expit(F.col("u"))))


# --- probability read-outs --------------------------------------------------------

def probability_highs(lows: DataFrame) -> DataFrame:
    """q = expit(-L) at each new low of L, which is each new high of q."""
    return lows.withColumn("q", expit(-F.col("stat")))


def threshold_hits(lows: DataFrame, levels: Sequence[float], horizon: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """First day q >= b per entity; -1 when the level is never reached.

    The first crossing of any level happens on a new high, so the ledger of lows
    of the log-odds answers it for every level at once.
    """
    q = expit(-F.col("stat"))
    per = lows.groupBy(*keys, "method").agg(*[
        F.coalesce(F.min(F.when((q >= b) & (F.col("day") <= horizon), F.col("day"))), F.lit(NEVER)).cast("int").alias(f"_b{i}")
        for i, b in enumerate(levels)])
    cells = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("level"), F.col(f"_b{i}").alias("tau"))
                                for i, b in enumerate(levels)]))
    return per.select(*keys, "method", cells.alias("_c")).select(*keys, "method", "_c.*")


def hit_table(hits: DataFrame, group: Sequence[str], horizon: int, coverage: float = 0.8) -> DataFrame:
    g = hits.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(alarmed()).alias("n_reached"))
    med = median_day(hits, group, horizon, name="median_first_hit")
    cov = median_day(hits, group, horizon, share=coverage, name="days_to_coverage")
    return (g.join(med, list(group), "left").join(cov, list(group), "left")
            .withColumn("frac_reached", ratio(F.col("n_reached"), F.col("n"))))


def reliability_bins(p: Column, n_bins: int) -> Column:
    """0-based bin by comparison with the evenly spaced edges; the last bin is closed."""
    edges = [i / n_bins for i in range(1, n_bins)]
    idx = F.lit(0)
    for e in edges:
        idx = idx + F.when(p >= F.lit(e), 1).otherwise(0)
    return idx


def brier_summary(q: DataFrame, group: Sequence[str]) -> DataFrame:
    """`q` has the probability `q` and the outcome `y` (1 = really invalid)."""
    y = F.col("y").cast("double")
    g = q.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("q") - y, F.lit(2.0))).alias("brier"),
        F.var_pop(y).alias("brier_base_rate"), F.avg("q").alias("mean_q"), F.avg(y).alias("observed_frac"))
    return g.withColumn("brier_skill", 1.0 - ratio(F.col("brier"), F.col("brier_base_rate")))


def reliability_table(q: DataFrame, group: Sequence[str], n_bins: int = 10) -> DataFrame:
    b = q.withColumn("bin", reliability_bins(F.col("q"), n_bins))
    return b.groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean_q"), F.avg(F.col("y").cast("double")).alias("observed_frac"))


# --- paired comparisons ------------------------------------------------------------

def paired(fp: DataFrame, pairs: Sequence[tuple[str, str]], cfg: MonitorConfig, horizon: int,
           group: Sequence[str] = ("far_target",)) -> DataFrame:
    """Per-entity differences between two methods on the same entities.

    `pairs` lists (method_a, method_b). Detection counts use the invalid role,
    false alarms the valid one; intervals are normal, over entities.
    """
    base = fp.select("scenario", "path_set", "entity", "method", *[g for g in group if g != "scenario"],
                     alarmed_by(horizon).cast("double").alias("hit"), truncated(horizon).cast("double").alias("t"))
    ids = list(dict.fromkeys([*group, "scenario", "path_set", "entity"]))
    # all methods of an entity in one row; a pair looks up its two, so nothing is joined with itself
    per = base.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("method", F.struct("hit", "t")))).alias("_m"))
    listed = F.explode(F.array(*[F.struct(F.lit(x).alias("method_a"), F.lit(y).alias("method_b")) for x, y in pairs])).alias("_p")
    j = per.select(*ids, "_m", listed).select(*ids, "_m", "_p.*").where(F.map_contains_key("_m", F.col("method_a")) & F.map_contains_key("_m", F.col("method_b")))
    at = lambda m, c: F.col("_m")[F.col(m)][c]
    j = j.select(*ids, "method_a", "method_b", at("method_a", "hit").alias("ha"), at("method_a", "t").alias("ta"), at("method_b", "hit").alias("hb"), at("method_b", "t").alias("tb"))
    inv, val = F.col("path_set") == "test_invalid", F.col("path_set") == "test_valid"
    d, dt = F.when(inv, F.col("ha") - F.col("hb")), F.when(inv, F.col("ta") - F.col("tb"))
    n = F.count(d)
    ha, hb = F.when(inv, F.col("ha")), F.when(inv, F.col("hb"))
    g = j.groupBy(*group, "method_a", "method_b").agg(
        n.alias("n_paired"), F.avg(ha).alias("detect_a"), F.avg(hb).alias("detect_b"),
        F.avg(F.when(val, F.col("ha"))).alias("far_a"), F.avg(F.when(val, F.col("hb"))).alias("far_b"),
        F.avg(d).alias("detect_diff"), (F.stddev_samp(d) / F.sqrt(n)).alias("_se"),
        F.count_if(d > 0).alias("discordant_a_only"), F.count_if(d < 0).alias("discordant_b_only"),
        F.avg(F.when(inv, F.col("ta"))).alias("time_a"), F.avg(F.when(inv, F.col("tb"))).alias("time_b"),
        F.avg(dt).alias("time_diff"), (F.stddev_samp(dt) / F.sqrt(n)).alias("_set"),
        F.sqrt(F.var_samp(ha) / n + F.var_samp(hb) / n).alias("_un"))
    z = cfg.wilson_z
    return (g.withColumn("detect_diff_lo", F.col("detect_diff") - z * F.col("_se"))
            .withColumn("detect_diff_hi", F.col("detect_diff") + z * F.col("_se"))
            .withColumn("time_diff_lo", F.col("time_diff") - z * F.col("_set"))
            .withColumn("time_diff_hi", F.col("time_diff") + z * F.col("_set"))
            .withColumn("se_ratio", ratio(F.col("_se"), F.col("_un")))
            .drop("_se", "_set", "_un"))


# --- alarms relative to events ------------------------------------------------------

def event_classes(fp: DataFrame, panel: DataFrame, window: int, keep: Sequence[str] = ("method", "far_target")) -> DataFrame:
    """1 on an event day, 2 within `window` days after the latest earlier event, 3 elsewhere, 0 none.

    As-of lookup of the alarm day among the entity's event days, by bins of time: events after
    the alarm are invisible, and days without an event do not take part.
    """
    events = panel.where(F.col("event_count") >= 1).select(*KEYS, F.col("day").alias("tau"))
    j = latest_before(fp, events, KEYS, "tau", previous="prev_event", same="on_event")
    recent = F.col("prev_event").isNotNull() & (F.col("tau") - F.col("prev_event") <= window)
    return j.select(*KEYS, *keep, "tau", F.when(~alarmed(), 0).when(F.col("on_event"), 1)
                    .when(recent, 2).otherwise(3).alias("event_class"))


def event_timing(classes: DataFrame, group: Sequence[str], cfg: MonitorConfig) -> DataFrame:
    """Counts, shares and the chance baseline averaged over the observed alarm days."""
    import math
    p = -math.expm1(-cfg.event_rate_annual / cfg.days_per_year)
    look = F.least(F.lit(cfg.event_window), F.col("tau") - 1).cast("double")
    c2 = F.lit(1.0 - p) * (1.0 - F.pow(F.lit(1.0 - p), look))
    names = {1: "on_event_day", 2: "within_window", 3: "elsewhere"}
    g = classes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(alarmed()).alias("n_alarms"),
        *[F.count_if(F.col("event_class") == k).alias(f"n_{v}") for k, v in names.items()],
        F.avg(F.when(alarmed(), look)).alias("mean_lookback"), F.avg(F.when(alarmed(), c2)).alias("_c2"))
    n, na = F.col("n"), F.col("n_alarms")
    theory = {"on_event_day": F.when(na > 0, F.lit(p)), "within_window": F.col("_c2"), "elsewhere": 1.0 - F.lit(p) - F.col("_c2")}
    cols = [F.col(c) for c in (*group, "n", "n_alarms", "mean_lookback")]
    for v in names.values():
        k = F.col(f"n_{v}")
        cols += [k, ratio(k, na).alias(f"share_{v}"), ratio(k, n).alias(f"prob_{v}"),
                 theory[v].alias(f"share_{v}_theory"), (theory[v] * ratio(na, n)).alias(f"prob_{v}_theory")]
    return g.select(*cols)


# --- horizon arms, subgroups, laws ---------------------------------------------------

def horizon_arms(lows: DataFrame, thr: DataFrame, cutoffs: Sequence[int], cfg: MonitorConfig) -> DataFrame:
    """Arm A reads the longest horizon's threshold early, arm B uses each cutoff's own.

    `thr` is keyed (method, horizon, far_target). The first passage of the long
    threshold is computed once and truncated at each cutoff.
    """
    longest = max(cutoffs)
    fp = first_passage(lows, thr, ["method"], budget=["horizon", "far_target"])
    c = F.explode(F.array(*[F.lit(h) for h in cutoffs]))
    a = fp.where(F.col("horizon") == longest).withColumn("cutoff", c).withColumn("arm", F.lit("A"))
    b = fp.withColumn("cutoff", F.col("horizon")).withColumn("arm", F.lit("B"))
    both = a.unionByName(b).withColumn(
        "tau", F.when(alarmed() & (F.col("tau") <= F.col("cutoff")), F.col("tau")).otherwise(NEVER))
    v, i = F.col("path_set") == "test_valid", F.col("path_set") == "test_invalid"
    t = F.when(i, F.when(alarmed(), F.col("tau")).otherwise(F.col("cutoff")).cast("double"))
    key = ["arm", "method", "far_target", "cutoff"]
    g = both.groupBy(*key).agg(
        F.first("threshold").alias("threshold"), F.count_if(v).alias("n_valid"), F.count_if(i).alias("n_invalid"),
        F.count_if(v & alarmed()).alias("k_far"), F.count_if(i & alarmed()).alias("k_detect"),
        F.avg(t).alias("mean_min_tau"), (F.stddev_samp(t) / F.sqrt(F.count(t))).alias("mean_min_tau_se"))
    med = median_day(both.where(i), key, longest, name="median_first_alarm")
    fl, fh = wilson(F.col("k_far"), F.col("n_valid"), cfg.wilson_z)
    dl, dh = wilson(F.col("k_detect"), F.col("n_invalid"), cfg.wilson_z)
    det = ratio(F.col("k_detect"), F.col("n_invalid"))
    return g.join(med, key, "left").select(
        *key, "threshold", "n_valid", "n_invalid", ratio(F.col("k_far"), F.col("n_valid")).alias("far"),
        fl.alias("far_lo"), fh.alias("far_hi"), det.alias("detect"), dl.alias("detect_lo"), dh.alias("detect_hi"),
        "mean_min_tau", "mean_min_tau_se", (1.0 - det).alias("undetected"), "median_first_alarm")


def out_of_horizon(lows: DataFrame, thr: DataFrame, days: Sequence[int]) -> DataFrame:
    """Short-horizon thresholds kept running: rates at each later day."""
    fp = first_passage(lows, thr, ["method"], budget=["horizon", "far_target"])
    v, i = F.col("path_set") == "test_valid", F.col("path_set") == "test_invalid"
    g = fp.groupBy("method", "horizon", "far_target").agg(
        F.first("threshold").alias("threshold"), F.count_if(v).alias("n_valid"), F.count_if(i).alias("n_invalid"),
        *[F.count_if(v & alarmed_by(d)).alias(f"_f{d}") for d in days],
        *[F.count_if(i & alarmed_by(d)).alias(f"_d{d}") for d in days])
    return g.select("method", F.col("horizon").alias("src_horizon"), "far_target", "threshold", "n_valid", "n_invalid",
                    *[ratio(F.col(f"_f{d}"), F.col("n_valid")).alias(f"far_d{d}") for d in days],
                    *[ratio(F.col(f"_d{d}"), F.col("n_invalid")).alias(f"detect_d{d}") for d in days])


def subgroups(fp: DataFrame, attributes: DataFrame, cfg: MonitorConfig, horizon: int) -> DataFrame:
    """A frozen rule read back on a 2x2 of attributes plus the margins of the cube.

    NULL in an attribute flag marks the margin over it.
    """
    j = fp.join(attributes, "entity")
    v, i = F.col("path_set") == "test_valid", F.col("path_set") == "test_invalid"
    hit = alarmed_by(horizon)
    g = (j.groupBy("method", "far_target", "a_high", "k_high", "path_set")
         .agg(F.count(F.lit(1)).alias("_n"), F.count_if(hit).alias("_k"))
         .cube("method", "far_target", "a_high", "k_high")
         .agg(F.sum(F.when(v, F.col("_n")).otherwise(0)).alias("n_valid"), F.sum(F.when(v, F.col("_k")).otherwise(0)).alias("k_far"),
              F.sum(F.when(i, F.col("_n")).otherwise(0)).alias("n_invalid"), F.sum(F.when(i, F.col("_k")).otherwise(0)).alias("k_detect"))
         .where(F.col("method").isNotNull() & F.col("far_target").isNotNull()))
    fl, fh = wilson(F.col("k_far"), F.col("n_valid"), cfg.wilson_z)
    dl, dh = wilson(F.col("k_detect"), F.col("n_invalid"), cfg.wilson_z)
    return g.select("method", "far_target", "a_high", "k_high", "n_valid", "n_invalid",
                    ratio(F.col("k_far"), F.col("n_valid")).alias("far"), fl.alias("far_lo"), fh.alias("far_hi"),
                    ratio(F.col("k_detect"), F.col("n_invalid")).alias("detect"), dl.alias("detect_lo"), dh.alias("detect_hi"))


def evidence_law(panel: DataFrame, cfg: MonitorConfig, days: Sequence[int]) -> DataFrame:
    """Empirical mean and sd of U = -L against the Gaussian law, per role and day."""
    wide = wide_statistics(panel.where(F.col("day") <= max(days)), ["binary_gaussian"], cfg)
    u = wide.where(F.col("day").isin(*days)).select("path_set", "day", (-F.col("binary_gaussian")).alias("u"))
    g = u.groupBy("path_set", "day").agg(F.count("u").alias("n"), F.avg("u").alias("mean_u"), F.stddev_samp("u").alias("sd_u"))
    s, D = cfg.sharpe_valid, float(cfg.days_per_year)
    true_s = F.when(F.col("path_set") == "test_invalid", F.lit(cfg.sharpe_invalid)).otherwise(F.lit(cfg.sharpe_valid))
    law = F.lit(-cfg.prior_log_odds) + F.col("day") * (s * (s - 2.0 * true_s) / (2.0 * D))
    sd = F.sqrt(F.col("day") * F.lit(s * s / D))
    return g.select("path_set", "day", "n", "mean_u", "sd_u", law.alias("law_mean"), sd.alias("law_sd"),
                    ((F.col("mean_u") - law) / (sd / F.sqrt("n"))).alias("z_mean"))


def headroom(observed: DataFrame, bound: DataFrame, on: Sequence[str]) -> DataFrame:
    """Observed detection against a supplied bound: gap, fraction, violation."""
    j = observed.join(bound, list(on))
    return (j.withColumn("gap", F.col("bound") - F.col("observed"))
            .withColumn("fraction_of_bound", ratio(F.col("observed"), F.col("bound")))
            .withColumn("violates", F.col("observed") > F.col("bound")))


def gain_ladder(metrics: DataFrame, steps: Sequence[tuple[str, str, str]], group: Sequence[str], value: str) -> DataFrame:
    """What each added treatment contributes: differences along a ladder of methods."""
    methods = list(dict.fromkeys(m for _, a, b in steps for m in (a, b)))
    wide = metrics.groupBy(*group).pivot("method", methods).agg(F.max(value))
    cells = F.explode(F.array(*[F.struct(
        F.lit(name).alias("step"), F.col(a).alias("before"), F.col(b).alias("after"),
        ((F.col(b) - F.col(a)) * 100.0).alias("gain_points")) for name, a, b in steps]))
    return wide.select(*group, cells.alias("_c")).select(*group, "_c.*")
