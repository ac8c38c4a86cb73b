"""Queries for first passage, rates, detection time and survival."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewatch.config import SUPPLIER as CFG
from tidewatch.config import USER
from tidewatch.functions.expr import excludes_zero, r
from tidewatch.functions.ranking import quantiles
from tidewatch.functions.small import small
from tidewatch.operators import calibrate as cal
from tidewatch.operators import evidence as ev
from tidewatch.operators import passage as pa
from tidewatch.operators import survival as sv
from tidewatch.plans import fixtures as fx
from tidewatch.plans import q_calibrate as qc
from tidewatch.plans import sqlgen as sg
from tidewatch.plans.catalog import query
from tidewatch.sources.tables import handoff, table

M, KEYS, H, DAYS = qc.M, ev.KEYS, CFG.horizon, CFG.report_days
RULE = ["path_set", "method", "far_target"]
SQL_FP = qc.SQL_FP
Z = CFG.wilson_z
AL = f"(tau <> -1 AND tau <= {H})"
TR = f"(CASE WHEN {AL} THEN tau ELSE {H} END)"
NOT_CAL = "path_set <> 'calibration_valid'"


def passages(spark, sf, methods=M):
    """First passage of the test roles under thresholds frozen on the calibration role."""
    lw = qc.lows(spark, sf, methods)
    thr = small(cal.thresholds(cal.path_minima(lw), CFG))
    return pa.first_passage(lw.where(F.col("path_set") != cal.CALIBRATION), thr, ["method"])


def rr(df, keep, nine=(), seven=()):
    return df.select(*keep, *[r(c).alias(c) for c in nine], *[r(c, 7).alias(c) for c in seven])


def R(*cols, d=9):
    return ", ".join(f"{sg.rnd(c, d)} AS {c}" for c in cols)


@query("first_passage", f"""{SQL_FP}
SELECT scenario, path_set, entity, method, far_target, {sg.rnd('threshold', 7)} AS threshold, tau <> -1 AS alarmed, tau AS first_alarm_day,
  CASE WHEN tau = -1 THEN {H} ELSE tau END AS truncated_days FROM fp WHERE {NOT_CAL}""")
def first_passage(spark, sf):
    fp = passages(spark, sf)
    return fp.select(*KEYS, "method", "far_target", r("threshold", 7).alias("threshold"), pa.alarmed().alias("alarmed"),
                     F.col("tau").alias("first_alarm_day"), pa.truncated(H).alias("truncated_days"))


@query("per_path_outcome_table", f"""{SQL_FP}
SELECT path_set, entity AS path_id, CASE WHEN path_set = 'test_valid' THEN 'valid' ELSE 'invalid' END AS true_state, method AS detector, far_target,
  {sg.rnd('threshold', 7)} AS threshold, CAST(CASE WHEN method IN ('trailing_sharpe','known_vol_rolling') THEN {CFG.window} ELSE 1 END AS INTEGER) AS first_eligible_day,
  tau <> -1 AS alarmed, tau AS first_alarm_day, CASE WHEN tau = -1 THEN {H} ELSE tau END AS truncated_days FROM fp WHERE {NOT_CAL}""")
def per_path_outcome_table(spark, sf):
    fp = passages(spark, sf)
    return fp.select("path_set", F.col("entity").alias("path_id"),
                     F.when(F.col("path_set") == "test_valid", "valid").otherwise("invalid").alias("true_state"),
                     F.col("method").alias("detector"), "far_target", r("threshold", 7).alias("threshold"),
                     ev.eligible_day(M, CFG).alias("first_eligible_day"), pa.alarmed().alias("alarmed"),
                     F.col("tau").alias("first_alarm_day"), pa.truncated(H).alias("truncated_days"))


@query("cumulative_alarm_curve", f"""{SQL_FP}
SELECT f.path_set, f.method, f.far_target, CAST(d AS INTEGER) AS day, count(*) AS n, count(*) FILTER (WHERE tau <> -1 AND tau <= d) AS n_alarmed,
  {sg.rnd('count(*) FILTER (WHERE tau <> -1 AND tau <= d) / count(*)')} AS cum_rate
FROM fp f CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS d) g WHERE {NOT_CAL} GROUP BY f.path_set, f.method, f.far_target, d""")
def cumulative_alarm_curve(spark, sf):
    return rr(pa.cumulative_curve(passages(spark, sf), RULE, H), [*RULE, "day", "n", "n_alarmed"], ["cum_rate"])


_WK = sg.wilson("k", "n", Z)


@query("rate_at_days", f"""{SQL_FP},
c AS (SELECT path_set, method, far_target, CAST(d AS INTEGER) AS day, count(*) AS n, count(*) FILTER (WHERE tau <> -1 AND tau <= d) AS k
  FROM fp CROSS JOIN (VALUES {', '.join(f'({d})' for d in DAYS)}) g(d) WHERE {NOT_CAL} GROUP BY path_set, method, far_target, d)
SELECT path_set, method, far_target, day, k, n, {sg.rnd('k / n')} AS rate, {sg.rnd(_WK[0])} AS lo, {sg.rnd(_WK[1])} AS hi FROM c""")
def rate_at_days(spark, sf):
    return rr(pa.rates_at_days(passages(spark, sf), RULE, DAYS, CFG), [*RULE, "day", "k", "n"], ["rate", "lo", "hi"])


@query("median_first_passage", f"""{SQL_FP},
c AS (SELECT path_set, method, far_target, d, count(*) FILTER (WHERE tau <> -1 AND tau <= d) / count(*) AS cum
  FROM fp CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS d) g WHERE {NOT_CAL} GROUP BY path_set, method, far_target, d)
SELECT path_set, method, far_target, CAST(min(d) FILTER (WHERE cum >= 0.5) AS INTEGER) AS median_day,
  CASE WHEN max(cum) >= 0.5 THEN '' ELSE 'not reached within {H}d' END AS note FROM c GROUP BY ALL""")
def median_first_passage(spark, sf):
    m = pa.median_day(passages(spark, sf), RULE, H)
    return m.withColumn("note", F.when(F.col("median_day").isNull(), f"not reached within {H}d").otherwise(""))


@query("truncated_mean_time", f"""{SQL_FP},
c AS (SELECT path_set, method, far_target, count(*) AS n, avg({TR}) AS m, stddev_samp({TR}) / sqrt(count(*)) AS se FROM fp WHERE {NOT_CAL} GROUP BY ALL)
SELECT path_set, method, far_target, n, {sg.rnd('m')} AS mean_days, {sg.rnd('se')} AS se_days, {sg.rnd('m / 252')} AS mean_years, {sg.rnd('se / 252')} AS se_years FROM c""")
def truncated_mean_time(spark, sf):
    return rr(pa.truncated_mean(passages(spark, sf), RULE, CFG, H), [*RULE, "n"], ["mean_days", "se_days", "mean_years", "se_years"])


def _metric_sql(group: str, src: str = "fp") -> str:
    """Metric row over `src`, grouped by `group`."""
    parts, cols = [], []
    for role, tag in (("test_valid", "far"), ("test_invalid", "detect")):
        f = f"path_set = '{role}'"
        parts.append(f"count(*) FILTER (WHERE {f}) AS n_{role}")
        for d in DAYS:
            parts.append(f"count(*) FILTER (WHERE {f} AND tau <> -1 AND tau <= {d}) AS k_{tag}_{d}")
            lo, hi = sg.wilson(f"k_{tag}_{d}", f"n_{role}", Z)
            cols += [f"{sg.rnd(f'k_{tag}_{d} / n_{role}')} AS {tag}_d{d}", f"{sg.rnd(lo)} AS {tag}_d{d}_lo", f"{sg.rnd(hi)} AS {tag}_d{d}_hi"]
    miss = f"(n_test_invalid - k_detect_{H})"
    lo, hi = sg.wilson(miss, "n_test_invalid", Z)
    cols += [f"{sg.rnd(f'{miss} / n_test_invalid')} AS undetected_at_H", f"{sg.rnd(lo)} AS undetected_lo", f"{sg.rnd(hi)} AS undetected_hi"]
    return f""",
mr AS (SELECT {group}, max(threshold) AS threshold, {', '.join(parts)},
  avg({TR}) FILTER (WHERE path_set = 'test_invalid') AS trunc_mean_detect,
  stddev_samp({TR}) FILTER (WHERE path_set = 'test_invalid') / sqrt(count(*) FILTER (WHERE path_set = 'test_invalid')) AS trunc_se_detect,
  avg({TR}) FILTER (WHERE path_set = 'test_valid') AS trunc_mean_valid,
  stddev_samp({TR}) FILTER (WHERE path_set = 'test_valid') / sqrt(count(*) FILTER (WHERE path_set = 'test_valid')) AS trunc_se_valid
  FROM {src} WHERE {NOT_CAL} GROUP BY {group}),
md AS (SELECT {group}, min(d) FILTER (WHERE cum >= 0.5) AS median_detect_day FROM (
  SELECT {group}, d, count(*) FILTER (WHERE tau <> -1 AND tau <= d) / count(*) AS cum FROM {src} CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS d) g
  WHERE path_set = 'test_invalid' GROUP BY {group}, d) GROUP BY {group})
SELECT {', '.join('mr.' + g.strip() for g in group.split(','))}, {sg.rnd('threshold', 7)} AS threshold, n_test_valid, n_test_invalid, {', '.join(cols)},
  {R('trunc_mean_detect', 'trunc_se_detect', 'trunc_mean_valid', 'trunc_se_valid')}, CAST(median_detect_day AS INTEGER) AS median_detect_day,
  CASE WHEN median_detect_day IS NULL THEN 'not reached within {H}d' ELSE '' END AS median_note
FROM mr JOIN md USING ({group})"""


def _metric_round(m):
    return m.select(*[r(c, 7 if c == "threshold" else 9).alias(c) if t == "double" and c != "far_target" else F.col(c)
                      for c, t in m.dtypes])


@query("metric_row", f"{SQL_FP}{_metric_sql('method, far_target')}")
def metric_row(spark, sf):
    return _metric_round(pa.metric_rows(passages(spark, sf), ["method", "far_target"], CFG))


SQL_FP_S = qc.SQL_THR_S + sg.first_passage(CFG, "scenario, method")


@query("metric_row_by_scenario", f"{SQL_FP_S}{_metric_sql('scenario, method, far_target')}")
def metric_row_by_scenario(spark, sf):
    lw = qc.lows(spark, sf)
    thr = small(cal.thresholds(cal.path_minima(lw), CFG, ["scenario", "method"]))
    fp = pa.first_passage(lw.where(F.col("path_set") != cal.CALIBRATION), thr, ["scenario", "method"])
    return _metric_round(pa.metric_rows(fp, ["scenario", "method", "far_target"], CFG))


# --- probabilities ---------------------------------------------------------------

_LO = ("binary_gaussian", "binary_student_t", "ewma_gaussian", "ewma_student_t")
SQL_LO = f"WITH {fx.SQL_PANEL}{sg.statistics(CFG, _LO)}{sg.long_stats(_LO)}"


def _q_at(spark, sf, days):
    p = fx.panel_supplier(spark, sf).where((F.col("path_set") != cal.CALIBRATION) & (F.col("day") <= max(days)))
    s = ev.long_statistics(p, _LO, CFG).where(F.col("day").isin(*days))
    return s.select("path_set", "entity", "method", "day", ev.failure_probability(F.col("stat")).alias("q"))


@query("failure_probability_summary", f"""{SQL_LO},
q AS (SELECT path_set, method, day, 1.0 / (1.0 + exp(stat)) AS q FROM stat WHERE {NOT_CAL} AND day IN {DAYS})
SELECT path_set, method, day, {sg.rnd('any_value(day) / 252')} AS years, count(*) AS n, {sg.rnd('avg(q)', 7)} AS mean_q, {sg.rnd('quantile_cont(q, 0.5)', 7)} AS median_q,
 {', '.join(f"{sg.rnd(f'quantile_cont(q, {p})', 7)} AS q{int(p * 100)}" for p in (.1, .25, .75, .9))} FROM q GROUP BY path_set, method, day""")
def failure_probability_summary(spark, sf):
    q = _q_at(spark, sf, DAYS)
    g = ["path_set", "method", "day"]
    mean = q.groupBy(*g).agg(F.count("q").alias("n"), F.avg("q").alias("mean_q"))
    qs = quantiles(q, g, "q", {"q10": .1, "q25": .25, "median_q": .5, "q75": .75, "q90": .9})
    out = mean.join(qs, g).withColumn("years", F.col("day") / CFG.days_per_year)
    return rr(out, [*g, "n"], ["years"], ["mean_q", "median_q", "q10", "q25", "q75", "q90"])


_LEVELS = (0.6, 0.7, 0.8)


@query("probability_threshold_hits", f"""{SQL_LO},
hit AS (SELECT path_set, entity, method, b, coalesce(min(CASE WHEN 1.0 / (1.0 + exp(stat)) >= b THEN day END), -1) AS tau
  FROM stat CROSS JOIN (VALUES {', '.join(f'({b}::DOUBLE)' for b in _LEVELS)}) l(b) WHERE {NOT_CAL} AND day <= {H} GROUP BY path_set, entity, method, b),
c AS (SELECT path_set, method, b, d, count(*) AS n, count(*) FILTER (WHERE tau <> -1) AS n_reached, count(*) FILTER (WHERE tau <> -1 AND tau <= d) / count(*) AS cum
  FROM hit CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS d) g GROUP BY path_set, method, b, d)
SELECT path_set, method, b AS level, max(n) AS n, max(n_reached) AS n_reached, {sg.rnd('max(n_reached) / max(n)')} AS frac_reached,
  CAST(min(d) FILTER (WHERE cum >= 0.5) AS INTEGER) AS median_first_hit, CAST(min(d) FILTER (WHERE cum >= 0.8) AS INTEGER) AS days_to_coverage FROM c GROUP BY path_set, method, b""")
def probability_threshold_hits(spark, sf):
    lw = qc.lows(spark, sf, _LO).where(F.col("path_set") != cal.CALIBRATION)
    t = pa.hit_table(pa.threshold_hits(lw, _LEVELS, H), ["path_set", "method", "level"], H)
    return rr(t, ["path_set", "method", "level", "n", "n_reached", "median_first_hit", "days_to_coverage"], ["frac_reached"])


_BD = (252, 440)
_SQLB = f"""{SQL_LO},
q AS (SELECT method, day, 1.0 / (1.0 + exp(stat)) AS q, CAST(path_set = 'test_invalid' AS DOUBLE) AS y FROM stat WHERE {NOT_CAL} AND day IN {_BD})"""


def _brier_input(spark, sf):
    return _q_at(spark, sf, _BD).withColumn("y", (F.col("path_set") == "test_invalid").cast("int"))


@query("brier", f"""{_SQLB},
b AS (SELECT method, day, count(*) AS n, avg(power(q - y, 2)) AS brier, var_pop(y) AS base, avg(q) AS mean_q, avg(y) AS obs FROM q GROUP BY method, day)
SELECT method, day, n, {sg.rnd('brier', 7)} AS brier, {sg.rnd('base', 7)} AS brier_base_rate, {sg.rnd('1.0 - brier / base', 7)} AS brier_skill, {sg.rnd('mean_q', 7)} AS mean_q, {sg.rnd('obs', 7)} AS observed_frac FROM b""")
def brier(spark, sf):
    b = pa.brier_summary(_brier_input(spark, sf), ["method", "day"])
    return rr(b, ["method", "day", "n"], [], ["brier", "brier_base_rate", "brier_skill", "mean_q", "observed_frac"])


@query("brier_reliability", f"""{_SQLB},
b AS (SELECT *, {' + '.join(f'CAST(q >= {i / 10!r} AS INTEGER)' for i in range(1, 10))} AS bin FROM q)
SELECT method, day, bin, {sg.rnd('any_value(bin) / 10.0')} AS bin_low, {sg.rnd('(any_value(bin) + 1) / 10.0')} AS bin_high, count(*) AS n,
  {sg.rnd('avg(q)', 7)} AS mean_q, {sg.rnd('avg(y)', 7)} AS observed_frac, {sg.rnd('avg(q) - avg(y)', 7)} AS gap FROM b GROUP BY method, day, bin""")
def brier_reliability(spark, sf):
    t = pa.reliability_table(_brier_input(spark, sf), ["method", "day"])
    t = (t.withColumn("gap", F.col("mean_q") - F.col("observed_frac"))
         .withColumn("bin_low", F.col("bin") / 10.0).withColumn("bin_high", (F.col("bin") + 1) / 10.0))
    return rr(t, ["method", "day", "bin", "n"], ["bin_low", "bin_high"], ["mean_q", "observed_frac", "gap"])


# --- paired comparisons ------------------------------------------------------------

PAIRS = [("binary_gaussian", m) for m in M if m != "binary_gaussian"]


_SQLP = f"""{SQL_FP},
x AS (SELECT path_set, entity, method, far_target, CAST({AL} AS DOUBLE) AS hit, CAST({TR} AS DOUBLE) AS t FROM fp WHERE {NOT_CAL}),
pr AS (SELECT a.far_target, a.method AS method_a, b.method AS method_b, a.path_set,
  a.hit AS ha, b.hit AS hb, a.t AS ta, b.t AS tb FROM x a JOIN x b USING (path_set, entity, far_target) WHERE a.method = 'binary_gaussian' AND b.method <> 'binary_gaussian'),
iv AS (SELECT far_target, method_a, method_b, count(*) AS n_paired, avg(ha) AS detect_a, avg(hb) AS detect_b, avg(ha - hb) AS detect_diff,
  {Z} * stddev_samp(ha - hb) / sqrt(count(*)) AS hw, count(*) FILTER (WHERE ha > hb) AS discordant_a_only, count(*) FILTER (WHERE ha < hb) AS discordant_b_only,
  avg(ta) AS time_a, avg(tb) AS time_b, avg(ta - tb) AS time_diff, {Z} * stddev_samp(ta - tb) / sqrt(count(*)) AS hwt,
  stddev_samp(ha - hb) / sqrt(count(*)) / nullif(sqrt(var_samp(ha) / count(*) + var_samp(hb) / count(*)), 0) AS se_ratio
  FROM pr WHERE path_set = 'test_invalid' GROUP BY far_target, method_a, method_b),
vv AS (SELECT far_target, method_a, method_b, avg(ha) AS far_a, avg(hb) AS far_b FROM pr WHERE path_set = 'test_valid' GROUP BY far_target, method_a, method_b)"""


def _paired(spark, sf):
    return pa.paired(passages(spark, sf), PAIRS, CFG, H)


@query("paired_table", f"""{_SQLP}
SELECT far_target, method_a, method_b, n_paired, discordant_a_only, discordant_b_only, {R('detect_a', 'detect_b', 'detect_diff', 'time_a', 'time_b', 'time_diff', 'se_ratio')},
 {sg.rnd('detect_diff - hw')} AS detect_diff_lo, {sg.rnd('detect_diff + hw')} AS detect_diff_hi, {sg.rnd('time_diff - hwt')} AS time_diff_lo, {sg.rnd('time_diff + hwt')} AS time_diff_hi FROM iv""")
def paired_table(spark, sf):
    return rr(_paired(spark, sf), ["far_target", "method_a", "method_b", "n_paired", "discordant_a_only", "discordant_b_only"],
              ["detect_a", "detect_b", "detect_diff", "detect_diff_lo", "detect_diff_hi", "time_a", "time_b", "time_diff",
               "time_diff_lo", "time_diff_hi", "se_ratio"])


@query("paired_frozen", f"""{_SQLP}
SELECT far_target, method_a, method_b, n_paired, {R('detect_a', 'detect_b', 'far_a', 'far_b', 'detect_diff')},
 {sg.rnd('detect_diff - hw')} AS detect_diff_lo, {sg.rnd('detect_diff + hw')} AS detect_diff_hi, detect_diff - hw > 0 OR detect_diff + hw < 0 AS excludes_zero FROM iv JOIN vv USING (far_target, method_a, method_b)""")
def paired_frozen(spark, sf):
    p = _paired(spark, sf).withColumn("excludes_zero", excludes_zero(F.col("detect_diff_lo"), F.col("detect_diff_hi")))
    return rr(p, ["far_target", "method_a", "method_b", "n_paired", "excludes_zero"],
              ["detect_a", "detect_b", "far_a", "far_b", "detect_diff", "detect_diff_lo", "detect_diff_hi"])


@query("paired_truncated_time", f"""{_SQLP}
SELECT far_target, method_a, method_b, n_paired, {R('time_a', 'time_b', 'time_diff')}, {sg.rnd('time_diff - hwt')} AS time_diff_lo, {sg.rnd('time_diff + hwt')} AS time_diff_hi FROM iv""")
def paired_truncated_time(spark, sf):
    return rr(_paired(spark, sf), ["far_target", "method_a", "method_b", "n_paired"],
              ["time_a", "time_b", "time_diff", "time_diff_lo", "time_diff_hi"])


# --- horizons ------------------------------------------------------------------------

def _horizon_thr(lw):
    return small(cal.thresholds(cal.prefix_minima(lw, qc.HORIZONS), CFG, ["method", "horizon"]))


_SQLH = f"""{qc.SQL_PREFIX},
fp AS MATERIALIZED (SELECT s.path_set, s.entity, s.method, t.horizon, t.far_target, t.threshold, coalesce(min(CASE WHEN s.stat < t.threshold AND s.day <= {H} THEN s.day END), -1) AS tau
  FROM stat s JOIN thr t USING (method) WHERE {NOT_CAL} GROUP BY s.path_set, s.entity, s.method, t.horizon, t.far_target, t.threshold)"""
_FA, _DE = sg.wilson("kf", "n_valid", Z), sg.wilson("kd", "n_invalid", Z)


@query("horizon_arms", f"""{_SQLH},
arms AS (SELECT 'A' AS arm, path_set, entity, method, far_target, threshold, CAST(c AS INTEGER) AS cutoff, tau FROM fp CROSS JOIN (VALUES {', '.join(f'({h})' for h in qc.HORIZONS)}) v(c) WHERE horizon = {max(qc.HORIZONS)}
  UNION ALL SELECT 'B', path_set, entity, method, far_target, threshold, horizon, tau FROM fp),
x AS (SELECT *, tau <> -1 AND tau <= cutoff AS hit, CASE WHEN tau <> -1 AND tau <= cutoff THEN tau ELSE cutoff END AS mt FROM arms),
g AS (SELECT arm, method, far_target, cutoff, any_value(threshold) AS threshold, count(*) FILTER (WHERE path_set = 'test_valid') AS n_valid, count(*) FILTER (WHERE path_set = 'test_invalid') AS n_invalid,
  count(*) FILTER (WHERE path_set = 'test_valid' AND hit) AS kf, count(*) FILTER (WHERE path_set = 'test_invalid' AND hit) AS kd,
  avg(mt) FILTER (WHERE path_set = 'test_invalid') AS mean_min_tau, stddev_samp(mt) FILTER (WHERE path_set = 'test_invalid') / sqrt(count(*) FILTER (WHERE path_set = 'test_invalid')) AS mean_min_tau_se
  FROM x GROUP BY arm, method, far_target, cutoff),
md AS (SELECT arm, method, far_target, cutoff, min(d) FILTER (WHERE cum >= 0.5) AS med FROM (SELECT arm, method, far_target, cutoff, d, count(*) FILTER (WHERE hit AND tau <= d) / count(*) AS cum
  FROM x CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS d) q WHERE path_set = 'test_invalid' GROUP BY arm, method, far_target, cutoff, d) GROUP BY arm, method, far_target, cutoff)
SELECT arm, method, far_target, cutoff, {sg.rnd('threshold', 7)} AS threshold, n_valid, n_invalid, {sg.rnd('kf / n_valid')} AS far, {sg.rnd(_FA[0])} AS far_lo, {sg.rnd(_FA[1])} AS far_hi,
  {sg.rnd('kd / n_invalid')} AS detect, {sg.rnd(_DE[0])} AS detect_lo, {sg.rnd(_DE[1])} AS detect_hi, {R('mean_min_tau', 'mean_min_tau_se')}, {sg.rnd('1.0 - kd / n_invalid')} AS undetected,
  CAST(med AS INTEGER) AS median_first_alarm FROM g JOIN md USING (arm, method, far_target, cutoff)""")
def horizon_arms(spark, sf):
    lw = qc.lows(spark, sf)
    t = pa.horizon_arms(lw.where(F.col("path_set") != cal.CALIBRATION), _horizon_thr(lw), qc.HORIZONS, CFG)
    return _metric_round(t)


@query("out_of_horizon", f"""{_SQLH},
g AS (SELECT method, horizon AS src_horizon, far_target, any_value(threshold) AS threshold, count(*) FILTER (WHERE path_set = 'test_valid') AS n_valid, count(*) FILTER (WHERE path_set = 'test_invalid') AS n_invalid,
  {', '.join(f"count(*) FILTER (WHERE path_set = '{p}' AND tau <> -1 AND tau <= {d}) AS {t}{d}" for p, t in (('test_valid', 'kf'), ('test_invalid', 'kd')) for d in qc.HORIZONS)}
  FROM fp GROUP BY method, horizon, far_target)
SELECT method, src_horizon, far_target, {sg.rnd('threshold', 7)} AS threshold, n_valid, n_invalid, {', '.join(f"{sg.rnd(f'kf{d} / n_valid')} AS far_d{d}, {sg.rnd(f'kd{d} / n_invalid')} AS detect_d{d}" for d in qc.HORIZONS)} FROM g""")
def out_of_horizon(spark, sf):
    lw = qc.lows(spark, sf)
    return _metric_round(pa.out_of_horizon(lw.where(F.col("path_set") != cal.CALIBRATION), _horizon_thr(lw), qc.HORIZONS))


# --- events ---------------------------------------------------------------------------

SQL_USER = (f"WITH {fx.SQL_USER}{sg.statistics(USER, M)}{sg.long_stats(M)}{sg.minima(USER)}{sg.thresholds(USER)}"
            + sg.first_passage(USER))


def user_passages(spark, sf):
    lw = handoff(spark, ("user_lows", sf, M, USER), lambda: ev.record_lows(fx.panel_user(spark, sf), M, USER))
    thr = small(cal.thresholds(cal.path_minima(lw), USER))
    return pa.first_passage(lw.where(F.col("path_set") != cal.CALIBRATION), thr, ["method"])


_SQLE = f"""{SQL_USER},
evt AS (SELECT entity, day, event_count >= 1 AS on_event, max(CASE WHEN event_count >= 1 THEN day END) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM panel),
cls AS (SELECT f.path_set, f.entity, f.method, f.far_target, f.tau, CASE WHEN tau = -1 THEN 0 WHEN on_event THEN 1 WHEN tau - prev <= {USER.event_window} THEN 2 ELSE 3 END AS event_class
  FROM fp f LEFT JOIN evt e ON e.entity = f.entity AND e.day = f.tau WHERE {NOT_CAL})"""


def _classes(spark, sf):
    return pa.event_classes(user_passages(spark, sf), fx.panel_user(spark, sf), USER.event_window)


@query("event_relative_class", f"{_SQLE}\nSELECT path_set, entity, method, far_target, tau, event_class FROM cls")
def event_relative_class(spark, sf):
    return _classes(spark, sf).drop("scenario")


def _timing_sql():
    import math
    p = -math.expm1(-USER.event_rate_annual / USER.days_per_year)
    c2 = f"({1.0 - p!r} * (1.0 - power({1.0 - p!r}, least({USER.event_window}, tau - 1))))"
    out = f"""{_SQLE},
g AS (SELECT path_set, method, far_target, count(*) AS n, count(*) FILTER (WHERE tau <> -1) AS na, avg(least({USER.event_window}, tau - 1)) FILTER (WHERE tau <> -1) AS look, avg({c2}) FILTER (WHERE tau <> -1) AS c2,
  count(*) FILTER (WHERE event_class = 1) AS n1, count(*) FILTER (WHERE event_class = 2) AS n2, count(*) FILTER (WHERE event_class = 3) AS n3 FROM cls GROUP BY path_set, method, far_target)
SELECT path_set, method, far_target, n, na AS n_alarms, {sg.rnd('look')} AS mean_lookback"""
    th = {1: f"CASE WHEN na > 0 THEN {p!r}::DOUBLE END", 2: "c2", 3: f"1.0 - {p!r} - c2"}
    for k, v in ((1, "on_event_day"), (2, "within_window"), (3, "elsewhere")):
        out += (f", n{k} AS n_{v}, {sg.rnd(f'n{k} / nullif(na, 0)')} AS share_{v}, {sg.rnd(f'n{k} / n')} AS prob_{v}, "
                f"{sg.rnd(th[k])} AS share_{v}_theory, {sg.rnd(f'({th[k]}) * na / n')} AS prob_{v}_theory")
    return out + " FROM g"


@query("event_timing_table", _timing_sql())
def event_timing_table(spark, sf):
    return _metric_round(pa.event_timing(_classes(spark, sf), RULE, USER))


_SQLSUB = f"""{SQL_USER},
x AS (SELECT f.*, c.c_acctbal >= 4500.0 AS a_high, c.c_nationkey >= 12 AS k_high, tau <> -1 AND tau <= {USER.horizon} AS hit FROM fp f JOIN customer c ON c.c_custkey = f.entity WHERE {NOT_CAL}),
g AS (SELECT method, far_target, a_high, k_high, count(*) FILTER (WHERE path_set = 'test_valid') AS n_valid, count(*) FILTER (WHERE path_set = 'test_invalid') AS n_invalid,
  count(*) FILTER (WHERE path_set = 'test_valid' AND hit) AS kf, count(*) FILTER (WHERE path_set = 'test_invalid' AND hit) AS kd
  FROM x GROUP BY GROUPING SETS ((method, far_target, a_high, k_high), (method, far_target, a_high), (method, far_target, k_high), (method, far_target)))
SELECT method, far_target, a_high, k_high, n_valid, n_invalid, {sg.rnd('kf / nullif(n_valid, 0)')} AS far, {sg.rnd(_FA[0])} AS far_lo, {sg.rnd(_FA[1])} AS far_hi,
  {sg.rnd('kd / nullif(n_invalid, 0)')} AS detect, {sg.rnd(_DE[0])} AS detect_lo, {sg.rnd(_DE[1])} AS detect_hi FROM g"""


@query("subgroup_readback", _SQLSUB)
def subgroup_readback(spark, sf):
    attrs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"), (F.col("c_acctbal") >= 4500.0).alias("a_high"),
        (F.col("c_nationkey") >= 12).alias("k_high"))
    return _metric_round(pa.subgroups(user_passages(spark, sf), attrs, USER, USER.horizon))


# --- entities that fail later ----------------------------------------------------------

WINDOWS = (63, 126, 188)
_BASE = re.sub(r"\b(panel|stat|wide|st_a)\b(?= AS|$|\n| p\b| WHERE| UNION|\))(?<!min_stat)", r"\g<1>0", qc.SQL_THR).replace("min(stat0)", "min(stat)")
SQL_FAIL = (f"{_BASE}, {fx.SQL_FAILING[fx.SQL_FAILING.index('panel AS'):]}"
            f"{sg.statistics(CFG, M, extra=', t_last_valid')}{sg.long_stats(M)}{sg.first_passage(CFG)}"
            f",\nft AS (SELECT f.*, CAST(f.entity * 37 % 253 AS INTEGER) AS t FROM fp f)")


def failing_passages(spark, sf):
    """Every entity failing at its own day, scored under always-valid thresholds."""
    thr = small(cal.thresholds(qc.minima(spark, sf), CFG))
    lw = handoff(spark, ("failing_lows", sf, M, CFG), lambda: ev.record_lows(fx.failing_supplier(spark, sf), M, CFG))
    fp = pa.first_passage(lw, thr, ["method"])
    return fp.withColumn("t_last_valid", (F.col("entity") * 37 % 253).cast("int"))


def _fail_agg(windows, group):
    k = ", ".join(f"count(*) FILTER (WHERE tau > t AND tau <= t + {h}) AS k{h}" for h in windows)
    cap = max(windows)
    d = f"CASE WHEN tau > t AND tau <= t + {cap} THEN tau - t ELSE {cap} END"
    s = "NOT (tau <> -1 AND tau <= t)"
    return f""",
fg AS (SELECT {group}, count(*) AS n, avg(t) AS mean_T, min(t) AS tmin, count(*) FILTER (WHERE tau <> -1 AND tau <= t) AS n_pre, count(*) FILTER (WHERE {s}) AS s, {k},
  avg({d}) FILTER (WHERE {s}) AS md, stddev_samp({d}) FILTER (WHERE {s}) / sqrt(count(*) FILTER (WHERE {s})) AS mdse FROM ft GROUP BY {group}),
fm AS (SELECT {group}, min(q) FILTER (WHERE cum >= 0.5) AS med FROM (SELECT {group}, q, count(*) FILTER (WHERE tau > t AND tau - t <= q) / count(*) AS cum
  FROM ft CROSS JOIN (SELECT unnest(range(1, {cap + 1})) AS q) g WHERE {s} GROUP BY {group}, q) GROUP BY {group})"""


@query("switching_metrics", f"""{SQL_FAIL}{_fail_agg(WINDOWS, 'scenario, method, far_target')}
SELECT scenario, method, far_target, n, {sg.rnd('mean_T')} AS mean_T, n_pre, s AS n_survived,
  CAST(greatest(0, tmin + 188 - greatest(CASE WHEN method IN ('trailing_sharpe', 'known_vol_rolling') THEN {CFG.window} ELSE 1 END, tmin + 1) + 1) AS INTEGER) AS usable_post_days,
  {sg.rnd('n_pre / n')} AS pre_fa, {sg.rnd('s / n')} AS survival,
  {', '.join(f"k{h} AS n_detect_h{h}, {sg.rnd(f'k{h} / nullif(s, 0)')} AS cond_detect_h{h}, {sg.rnd(f'k{h} / n')} AS uncond_detect_h{h}" for h in WINDOWS)},
  {sg.rnd('md')} AS trunc_delay, {sg.rnd('mdse')} AS trunc_delay_se, {sg.rnd('1.0 - k188 / nullif(s, 0)')} AS undetected, CAST(CASE WHEN k188 / nullif(s, 0) >= 0.5 THEN med END AS INTEGER) AS median_delay
FROM fg LEFT JOIN fm USING (scenario, method, far_target)""")
def switching_metrics(spark, sf):
    return _metric_round(sv.switching_metrics(failing_passages(spark, sf), ["scenario", "method", "far_target"], WINDOWS,
                                              max(WINDOWS), ev.eligible_day(M, CFG)))


def _surv_cols():
    pl, ph = sg.wilson("n_pre", "n", Z)
    out = [f"n, n_pre, s AS n_survivors, {sg.rnd('n_pre / n')} AS pre_far, {sg.rnd(pl)} AS pre_far_lo, {sg.rnd(ph)} AS pre_far_hi, {sg.rnd('s / n')} AS survival_rate"]
    for h in WINDOWS:
        (jl, jh), (cl, ch) = sg.wilson(f"k{h}", "n", Z), sg.wilson(f"k{h}", "s", Z)
        out.append(f"{sg.rnd(f'k{h} / n')} AS joint_h{h}, {sg.rnd(jl)} AS joint_h{h}_lo, {sg.rnd(jh)} AS joint_h{h}_hi, {sg.rnd(f'k{h} / nullif(s, 0)')} AS cond_h{h}, "
                   f"{sg.rnd(cl)} AS cond_h{h}_lo, {sg.rnd(ch)} AS cond_h{h}_hi, {sg.rnd(f'abs(k{h} / n - s / n * (k{h} / nullif(s, 0)))')} AS identity_gap_h{h}")
    out.append(f"{sg.rnd('md')} AS mean_delay, {sg.rnd('mdse')} AS mean_delay_se, CAST({max(WINDOWS)} AS INTEGER) AS delay_cap, {sg.rnd(f'1.0 - k{max(WINDOWS)} / nullif(s, 0)')} AS undetected, CAST(med AS INTEGER) AS median_delay")
    return ", ".join(out)


@query("survival_metrics", f"""{SQL_FAIL}{_fail_agg(WINDOWS, 'scenario, method, far_target')}
SELECT scenario, method, far_target, {_surv_cols()} FROM fg LEFT JOIN fm USING (scenario, method, far_target)""")
def survival_metrics(spark, sf):
    return _metric_round(sv.survival_metrics(failing_passages(spark, sf), ["scenario", "method", "far_target"], WINDOWS, CFG))


EDGES = (0, 63, 126, 189, 253)


@query("bin_failure_time", f"""{SQL_FAIL.replace('AS t FROM fp f)', "AS t, CASE WHEN f.entity * 37 % 253 < 63 THEN '0-62' WHEN f.entity * 37 % 253 < 126 THEN '63-125' WHEN f.entity * 37 % 253 < 189 THEN '126-188' ELSE '189-252' END AS t_bin FROM fp f)")}{_fail_agg(WINDOWS, 't_bin, method, far_target')}
SELECT t_bin, method, far_target, {_surv_cols()} FROM fg LEFT JOIN fm USING (t_bin, method, far_target)""")
def bin_failure_time(spark, sf):
    fp = failing_passages(spark, sf).withColumn("t_bin", sv.bin_failure_time(F.col("t_last_valid"), EDGES))
    return _metric_round(sv.survival_metrics(fp, ["t_bin", "method", "far_target"], WINDOWS, CFG))


_SURV_ALPHA = 0.15


@query("evidence_at_T", f"""{SQL_FAIL},
u AS (SELECT entity, method, coalesce(-max(CASE WHEN day = entity * 37 % 253 THEN stat END), {-CFG.prior_log_odds!r}) AS u FROM stat WHERE method IN {_LO} GROUP BY entity, method),
w AS (SELECT u.method, u.u, 1.0 / (1.0 + exp(-u.u)) AS q, NOT (f.tau <> -1 AND f.tau <= f.t) AS survived FROM u JOIN ft f ON f.entity = u.entity AND f.method = u.method AND f.far_target = {_SURV_ALPHA}),
p AS (SELECT method, 'all' AS population, u, q FROM w UNION ALL SELECT method, 'survived', u, q FROM w WHERE survived)
SELECT method, population, {_SURV_ALPHA}::DOUBLE AS survivor_alpha, count(*) AS n, {sg.rnd('avg(u)', 7)} AS mean_u, {sg.rnd('avg(q)', 7)} AS mean_q, {sg.rnd('quantile_cont(u, 0.1)', 7)} AS u_q10, {sg.rnd('quantile_cont(u, 0.5)', 7)} AS u_median,
  {sg.rnd('quantile_cont(u, 0.9)', 7)} AS u_q90, {sg.rnd('quantile_cont(q, 0.5)', 7)} AS q_median FROM p GROUP BY method, population""")
def evidence_at_T(spark, sf):
    fp = failing_passages(spark, sf).where(F.col("far_target") == _SURV_ALPHA)
    surv = fp.select(*KEYS, "method", (~sv.early()).alias("survived"))
    u = pa.evidence_at_failure(fx.failing_supplier(spark, sf), _LO, CFG).join(surv, [*KEYS, "method"])
    t = sv.belief_table(u, ["method"]).withColumn("survivor_alpha", F.lit(_SURV_ALPHA))
    return rr(t, ["method", "population", "survivor_alpha", "n"], [], ["mean_u", "mean_q", "u_q10", "u_median", "u_q90", "q_median"])


_WA = sg.wilson("k", "n", Z)


@query("always_valid_control", f"""{SQL_FP},
g AS (SELECT scenario, method, far_target, any_value(threshold) AS threshold, count(*) AS n, count(*) FILTER (WHERE {AL}) AS k FROM fp WHERE path_set = 'test_valid' GROUP BY scenario, method, far_target)
SELECT scenario, method, far_target, {sg.rnd('threshold', 7)} AS threshold, n, k, {sg.rnd('k / n')} AS full_period_far, {sg.rnd(_WA[0])} AS lo, {sg.rnd(_WA[1])} AS hi FROM g""")
def always_valid_control(spark, sf):
    g = ["scenario", "method", "far_target", "threshold"]
    t = pa.rates_at_days(passages(spark, sf).where(F.col("path_set") == "test_valid"), g, [H], CFG)
    return rr(t.withColumnRenamed("rate", "full_period_far"), ["scenario", "method", "far_target", "n", "k"],
              ["full_period_far", "lo", "hi"], ["threshold"])


# --- laws, bounds, summaries --------------------------------------------------------------

@query("evidence_law_check", f"""WITH {fx.SQL_PANEL}{sg.statistics(CFG, ['binary_gaussian'])},
g AS (SELECT path_set, day, count(*) AS n, avg(-binary_gaussian) AS mean_u, stddev_samp(-binary_gaussian) AS sd_u FROM wide WHERE day IN {DAYS} GROUP BY path_set, day),
l AS (SELECT *, day * CASE WHEN path_set = 'test_invalid' THEN 1.0 / 504.0 ELSE -1.0 / 504.0 END AS law_mean, sqrt(day / 252.0) AS law_sd FROM g)
SELECT path_set, day, n, {R('mean_u', 'sd_u', 'law_mean', 'law_sd', d=7)}, {sg.rnd('(mean_u - law_mean) / (law_sd / sqrt(n))', 7)} AS z_mean FROM l""")
def evidence_law_check(spark, sf):
    t = pa.evidence_law(fx.panel_supplier(spark, sf), CFG, DAYS)
    return rr(t, ["path_set", "day", "n"], [], ["mean_u", "sd_u", "law_mean", "law_sd", "z_mean"])


#: supplied bound table: far target, day, highest detection rate of any rule
BOUND_ROWS = ((0.05, 252, 0.26), (0.15, 252, 0.49), (0.05, 440, 0.38), (0.15, 440, 0.62))


@query("headroom_vs_bound", f"""{SQL_FP},
o AS (SELECT method, far_target, CAST(d AS INTEGER) AS day, count(*) FILTER (WHERE tau <> -1 AND tau <= d) / count(*) AS observed FROM fp CROSS JOIN (VALUES (252), (440)) v(d) WHERE path_set = 'test_invalid' GROUP BY method, far_target, d),
b(far_target, day, bound) AS (VALUES {', '.join(f'({a}::DOUBLE, {d}, {x}::DOUBLE)' for a, d, x in BOUND_ROWS)})
SELECT method, far_target, day, {sg.rnd('observed')} AS observed, {sg.rnd('bound')} AS bound, {sg.rnd('bound - observed')} AS gap, {sg.rnd('observed / bound')} AS fraction_of_bound, observed > bound AS violates FROM o JOIN b USING (far_target, day)""")
def headroom_vs_bound(spark, sf):
    obs = pa.rates_at_days(passages(spark, sf).where(F.col("path_set") == "test_invalid"), ["method", "far_target"], [252, 440], CFG)
    bound = small(spark.createDataFrame(list(BOUND_ROWS), "far_target double, day int, bound double"))
    t = pa.headroom(obs.withColumnRenamed("rate", "observed"), bound, ["far_target", "day"])
    return rr(t, ["method", "far_target", "day", "violates"], ["observed", "bound", "gap", "fraction_of_bound"])


_sum_cols = ", ".join([f"far_d{d}, detect_d{d}" for d in DAYS])


@query("summary_table", f"{SQL_FP_S}{_metric_sql('scenario, method, far_target').replace('SELECT mr.scenario', 'SELECT scenario, method, far_target, threshold, n_test_valid, n_test_invalid, ' + _sum_cols + ', trunc_mean_detect, trunc_se_detect, median_detect_day, median_note, undetected_at_H FROM (SELECT mr.scenario')})")
def summary_table(spark, sf):
    m = metric_row_by_scenario(spark, sf)
    return m.select("scenario", "method", "far_target", "threshold", "n_test_valid", "n_test_invalid",
                    *[f"{t}_d{d}" for d in DAYS for t in ("far", "detect")], "trunc_mean_detect", "trunc_se_detect",
                    "median_detect_day", "median_note", "undetected_at_H")


STEPS = (("student_t", "binary_gaussian", "binary_student_t"), ("adaptive_variance", "binary_student_t", "ewma_student_t"),
         ("truncation", "ewma_student_t", "ewma_trunc_student_t"))
_LADDER = ("binary_gaussian", "binary_student_t", "ewma_student_t", "ewma_trunc_student_t")


@query("gain_ladder", f"""WITH RECURSIVE {fx.SQL_PANEL}{sg.statistics(CFG, _LADDER)}{sg.long_stats(_LADDER)}{sg.minima(CFG)}{sg.thresholds(CFG)},
d AS (SELECT m.scenario, t.far_target, m.method, count(*) FILTER (WHERE m.min_stat < t.threshold) / count(*) AS v FROM minima m JOIN thr t USING (method) WHERE path_set = 'test_invalid' GROUP BY m.scenario, t.far_target, m.method),
s(step, a, b) AS (VALUES {', '.join(str(x) for x in STEPS)})
SELECT x.scenario, x.far_target, s.step, {sg.rnd('x.v')} AS before, {sg.rnd('y.v')} AS after, {sg.rnd('100.0 * (y.v - x.v)')} AS gain_points
FROM s JOIN d x ON x.method = s.a JOIN d y ON y.method = s.b AND y.scenario = x.scenario AND y.far_target = x.far_target""")
def gain_ladder(spark, sf):
    fp = passages(spark, sf, _LADDER).where(F.col("path_set") == "test_invalid")
    d = fp.groupBy("scenario", "far_target", "method").agg((F.count_if(pa.alarmed_by(H)) / F.count(F.lit(1))).alias("detect"))
    return rr(pa.gain_ladder(d, STEPS, ["scenario", "far_target"], "detect"), ["scenario", "far_target", "step"], ["before", "after", "gain_points"])
