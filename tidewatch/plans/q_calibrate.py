"""Queries for threshold calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import SUPPLIER as CFG
from tidewatch.functions.expr import r
from tidewatch.functions.small import small
from tidewatch.operators import calibrate as cal
from tidewatch.operators import evidence as ev
from tidewatch.operators import passage as pa
from tidewatch.plans import fixtures as fx
from tidewatch.plans import sqlgen as sg
from tidewatch.plans.catalog import query
from tidewatch.sources import sinks
from tidewatch.sources.tables import handoff

M = ev.JVM_METHODS
KEYS = ev.KEYS
SQL_STAT = f"WITH {fx.SQL_PANEL}{sg.statistics(CFG, M)}{sg.long_stats(M)}"
SQL_MIN = SQL_STAT + sg.minima(CFG)
SQL_THR = SQL_MIN + sg.thresholds(CFG)
SQL_THR_S = SQL_MIN + sg.thresholds(CFG, "scenario, method")
SQL_FP = SQL_THR + sg.first_passage(CFG)


def lows(spark, sf, methods=M):
    """Ledger of new lows: a compact stage table everything after it reads."""
    return handoff(spark, ("lows", sf, tuple(methods), CFG),
                   lambda: ev.record_lows(fx.panel_supplier(spark, sf), methods, CFG))


def minima(spark, sf, methods=M):
    return cal.path_minima(lows(spark, sf, methods))


@query("path_minimum", f"""{SQL_MIN}
SELECT scenario, path_set, entity, method, {sg.rnd('min_stat', 7)} AS min_stat FROM minima""")
def path_minimum(spark, sf):
    return minima(spark, sf).select(*KEYS, "method", r("min_stat", 7).alias("min_stat"))


@query("calibrate_threshold", f"""{SQL_THR}
SELECT t.method, t.far_target, t.n_paths, CAST(t.rank AS BIGINT) AS rank, {sg.rnd('t.threshold', 7)} AS threshold,
  count(*) FILTER (WHERE m.min_stat < t.threshold) AS n_alarms,
  {sg.rnd('count(*) FILTER (WHERE m.min_stat < t.threshold) / any_value(t.n_paths)')} AS achieved_far
FROM thr t JOIN minima m ON m.method = t.method AND m.path_set = 'calibration_valid' GROUP BY t.method, t.far_target, t.n_paths, t.rank, t.threshold""")
def calibrate_threshold(spark, sf):
    m = minima(spark, sf)
    t = cal.with_achieved_rate(cal.thresholds(m, CFG), m)
    return t.select("method", "far_target", "n_paths", "rank", r("threshold", 7).alias("threshold"), "n_alarms",
                    r("achieved_far").alias("achieved_far"))


_DELTA = 0.25

SQL_BUF = SQL_THR_S + f""",
pmf AS (SELECT n, a, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(a) + (n - j) * ln(1.0 - a)) AS p
  FROM (SELECT DISTINCT n_paths AS n, far_target AS a FROM thr) c, LATERAL (SELECT unnest(range(0, CAST(n AS BIGINT))) AS j)),
cdf AS (SELECT n, a, j, sum(p) OVER (PARTITION BY n, a ORDER BY j) AS c FROM pmf),
brank AS (SELECT n, a, max(CASE WHEN c <= {_DELTA} THEN j + 1 END) AS k FROM cdf GROUP BY ALL)"""


@query("per_scenario_thresholds", f"""{SQL_BUF}
SELECT t.scenario, t.method, t.far_target, t.n_paths, CAST(t.rank AS BIGINT) AS rank, b.k AS buffered_rank, {sg.rnd('t.threshold', 7)} AS threshold,
  {sg.rnd('q.min_stat', 7)} AS buffered_threshold
FROM thr t JOIN brank b ON b.n = t.n_paths AND b.a = t.far_target
LEFT JOIN thr_r q ON q.scenario = t.scenario AND q.method = t.method AND q.rk = b.k""")
def per_scenario_thresholds(spark, sf):
    t = cal.buffered_thresholds(minima(spark, sf), CFG, ["scenario", "method"], _DELTA)
    return t.select("scenario", "method", "far_target", "n_paths", "rank", "buffered_rank",
                    r("threshold", 7).alias("threshold"), r("buffered_threshold", 7).alias("buffered_threshold"))


@query("unified_threshold", f"""{SQL_THR_S}
SELECT method, far_target, {sg.rnd('min(threshold)', 7)} AS threshold, arg_min(scenario, threshold) AS binding_scenario,
  {sg.rnd("max(threshold) FILTER (WHERE scenario = 'even')", 7)} AS threshold_even,
  {sg.rnd("max(threshold) FILTER (WHERE scenario = 'odd')", 7)} AS threshold_odd FROM thr GROUP BY ALL""")
def unified_threshold(spark, sf):
    u = cal.unified(cal.thresholds(minima(spark, sf), CFG, ["scenario", "method"]), ["even", "odd"])
    return u.select("method", "far_target", "binding_scenario", *[
        r(c, 7).alias(c) for c in ("threshold", "threshold_even", "threshold_odd")])


HORIZONS = (63, 126, 252, 440)
SQL_PREFIX = SQL_STAT + f""",
minima AS MATERIALIZED (SELECT scenario, path_set, entity, method, CAST(h AS INTEGER) AS horizon, min(stat) AS min_stat
  FROM stat CROSS JOIN (VALUES {', '.join(f'({h})' for h in HORIZONS)}) v(h) WHERE day <= h GROUP BY ALL HAVING min(stat) IS NOT NULL)
{sg.thresholds(CFG, 'method, horizon')}"""


@query("prefix_horizon_thresholds", f"""{SQL_PREFIX}
SELECT method, horizon, far_target, n_paths, CAST(rank AS BIGINT) AS rank, {sg.rnd('threshold', 7)} AS threshold FROM thr""")
def prefix_horizon_thresholds(spark, sf):
    m = cal.prefix_minima(lows(spark, sf), HORIZONS)
    t = cal.thresholds(m, CFG, ["method", "horizon"])
    return t.select("method", "horizon", "far_target", "n_paths", "rank", r("threshold", 7).alias("threshold"))


_LOG_ODDS = "('binary_gaussian','binary_student_t','ewma_gaussian','ewma_student_t')"


@query("working_probability", f"""{SQL_THR}
SELECT method, far_target, {sg.rnd('threshold', 7)} AS threshold,
  CASE WHEN method IN {_LOG_ODDS} THEN {sg.rnd('1.0 / (1.0 + exp(threshold))', 7)} END AS working_prob FROM thr""")
def working_probability(spark, sf):
    t = cal.working_probability(cal.thresholds(minima(spark, sf), CFG))
    return t.select("method", "far_target", r("threshold", 7).alias("threshold"), r("working_prob", 7).alias("working_prob"))


@query("matched_pre_failure", f"""{SQL_STAT},
m AS (SELECT entity, method, h, min(stat) AS v FROM stat CROSS JOIN (VALUES (126), (252)) v(h)
      WHERE day <= h AND path_set = 'calibration_valid' GROUP BY ALL HAVING min(stat) IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY method, h ORDER BY v) AS rk, count(*) OVER (PARTITION BY method, h) AS n FROM m)
SELECT g.method, CAST(g.h AS INTEGER) AS horizon, k.n AS n_paths, k.v IS NULL AS nothing_eligible, {sg.rnd('k.v', 7)} AS threshold
FROM (SELECT * FROM (SELECT DISTINCT method FROM stat) CROSS JOIN (VALUES (126), (252)) v(h)) g
LEFT JOIN k ON k.method = g.method AND k.h = g.h AND k.rk = least(CAST(floor(0.15 * k.n) AS BIGINT), k.n - 1) + 1""")
def matched_pre_failure(spark, sf):
    t = cal.matched_pre_failure(lows(spark, sf), M, CFG, (126, 252), 0.15)
    none = F.col("threshold") == float("-inf")
    return t.select("method", "horizon", "n_paths", none.alias("nothing_eligible"),
                    r(F.when(~none, F.col("threshold")), 7).alias("threshold"))


_T, _POST, _CONT = 252, 188, 0.1
SQL_PREPOST = f""",
pp AS MATERIALIZED (SELECT entity, method, min(CASE WHEN day <= {_T} THEN stat END) AS pre,
      min(CASE WHEN day > {_T} THEN stat END) AS post FROM stat
      WHERE path_set = 'calibration_valid' AND day <= {_T + _POST} GROUP BY ALL)"""


@query("matched_continuation", f"""{SQL_STAT}{SQL_PREPOST},
allv AS (SELECT method, list_sort(list(v)) AS vs, count(*) AS n FROM (SELECT method, pre AS v FROM pp UNION ALL SELECT method, post FROM pp) GROUP BY method),
gh AS (SELECT method, i, vs, n, (n - 1) * ({cal.GRID_LOW} + i * {(cal.GRID_HIGH - cal.GRID_LOW) / (cal.GRID_POINTS - 1)!r}) AS h
       FROM allv, LATERAL (SELECT unnest(range(0, {cal.GRID_POINTS})) AS i)),
grid AS (SELECT method, i, vs[CAST(floor(h) AS BIGINT) + 1] + (h - floor(h)) *
       (vs[least(CAST(floor(h) AS BIGINT) + 2, n)] - vs[CAST(floor(h) AS BIGINT) + 1]) AS c FROM gh),
sc AS (SELECT g.method, g.i, g.c, avg(CAST(p.pre >= g.c AS INT)) AS alive,
       count(*) FILTER (WHERE p.pre >= g.c AND p.post < g.c) / nullif(count(*) FILTER (WHERE p.pre >= g.c), 0) AS rate
       FROM grid g JOIN pp p ON p.method = g.method GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY rate DESC, i) AS rk FROM sc WHERE alive >= 0.5 AND rate <= {_CONT})
SELECT m.method, {sg.rnd('coalesce(b.c, m.c0)', 7)} AS threshold, {sg.rnd('coalesce(b.rate, 0.0)')} AS achieved_continuation_fa,
  {sg.rnd('coalesce(1.0 - b.alive, 0.0)')} AS pre_failure_fa, {sg.rnd('m.reach')} AS max_reachable, m.reach >= {_CONT} AS feasible
FROM (SELECT method, arg_min(c, i) AS c0, coalesce(max(rate) FILTER (WHERE alive >= 0.5), 0.0) AS reach FROM sc GROUP BY method) m
LEFT JOIN best b ON b.method = m.method AND b.rk = 1""")
def matched_continuation(spark, sf):
    p = fx.panel_supplier(spark, sf).where(F.col("path_set") == cal.CALIBRATION)
    pp = cal.window_minima(p, M, CFG, {"pre": (1, _T), "post": (_T + 1, _T + _POST)})
    t = cal.matched_continuation(pp, _CONT)
    return t.select("method", r("threshold", 7).alias("threshold"), r("achieved_continuation_fa").alias("achieved_continuation_fa"),
                    r("pre_failure_fa").alias("pre_failure_fa"), r("max_reachable").alias("max_reachable"), "feasible")


def _wil(k, n):
    lo, hi = sg.wilson(k, n, CFG.wilson_z)
    return sg.rnd(lo), sg.rnd(hi)


@query("validate_frozen_thresholds", f"""{SQL_THR},
e AS (SELECT s.path_set, s.entity, s.method, t.far_target, t.threshold,
   coalesce(min(CASE WHEN day <= {_T} THEN stat END) < any_value(t.threshold), false) AS early,
   coalesce(min(CASE WHEN day > {_T} THEN stat END) < any_value(t.threshold), false) AS late
   FROM stat s JOIN thr t USING (method) WHERE day <= {_T + _POST} GROUP BY s.path_set, s.entity, s.method, t.far_target, t.threshold),
a AS (SELECT path_set, method, far_target, threshold, count(*) AS n, count(*) FILTER (WHERE early) AS n_pre,
   count(*) FILTER (WHERE NOT early) AS n_survived, count(*) FILTER (WHERE NOT early AND late) AS n_cont FROM e GROUP BY ALL)
SELECT path_set, method, far_target, {sg.rnd('threshold', 7)} AS threshold, n, n_pre, n_survived, n_cont,
  {sg.rnd('n_pre / n')} AS pre_fa, {_wil('n_pre', 'n')[0]} AS pre_fa_lo, {_wil('n_pre', 'n')[1]} AS pre_fa_hi,
  {sg.rnd('n_cont / nullif(n_survived, 0)')} AS cont_fa, {_wil('n_cont', 'n_survived')[0]} AS cont_fa_lo, {_wil('n_cont', 'n_survived')[1]} AS cont_fa_hi
FROM a WHERE path_set <> 'test_invalid'""")
def validate_frozen_thresholds(spark, sf):
    lw = lows(spark, sf)
    t = cal.thresholds(cal.path_minima(lw), CFG)
    v = cal.validate_frozen(lw.where(F.col("path_set") != "test_invalid"), t, CFG, _T, _POST)
    keep = ("path_set", "method", "far_target", "n", "n_pre", "n_survived", "n_cont")
    return v.select(*keep, r("threshold", 7).alias("threshold"), *[r(c).alias(c) for c in (
        "pre_fa", "pre_fa_lo", "pre_fa_hi", "cont_fa", "cont_fa_lo", "cont_fa_hi")])


@query("calibration_replication_study", f"""{SQL_MIN.replace('minima AS', 'minima0 AS')},
minima AS (SELECT *, entity % 5 AS replicate FROM minima0)
{sg.thresholds(CFG, 'replicate, method')},
f AS (SELECT m.replicate, m.method, t.far_target, t.threshold, count(*) AS n, count(*) FILTER (WHERE m.min_stat < t.threshold) / count(*) AS far
  FROM minima m JOIN thr t USING (replicate, method) WHERE m.path_set = 'test_valid' GROUP BY ALL),
g AS (SELECT method, far_target, count(*) AS n_replications, avg(far) AS mean_far, stddev_samp(far) AS sd_far, min(far) AS min_far, max(far) AS max_far,
  avg(CAST(far > far_target AS DOUBLE)) AS share_above_target, stddev_samp(threshold) AS sd_threshold, avg(threshold) AS mean_threshold,
  sqrt(far_target * (1.0 - far_target) / (sum(n) / count(*))) AS binomial_se FROM f GROUP BY method, far_target)
SELECT method, far_target, n_replications, {', '.join(f'{sg.rnd(c)} AS {c}' for c in ('mean_far', 'sd_far', 'min_far', 'max_far', 'share_above_target', 'binomial_se'))},
 {sg.rnd('sd_threshold', 7)} AS sd_threshold, {sg.rnd('mean_threshold', 7)} AS mean_threshold,
 {sg.rnd('sd_far / sqrt(2.0 * (n_replications - 1))')} AS sd_far_se, {sg.rnd('sd_far / binomial_se')} AS sd_inflation,
 {sg.rnd('sqrt(greatest(sd_far * sd_far - binomial_se * binomial_se, 0.0))', 7)} AS calibration_sd, sd_far * sd_far - binomial_se * binomial_se < 0 AS excess_negative FROM g""")
def calibration_replication_study(spark, sf):
    m = minima(spark, sf).withColumn("replicate", F.col("entity") % 5)
    t = cal.replication_study(m, CFG)
    nine = ("mean_far", "sd_far", "min_far", "max_far", "share_above_target", "binomial_se", "sd_far_se", "sd_inflation")
    return t.select("method", "far_target", "n_replications", "excess_negative", *[r(c).alias(c) for c in nine],
                    *[r(c, 7).alias(c) for c in ("sd_threshold", "mean_threshold", "calibration_sd")])


@query("threshold_reproduction_check", f"""{SQL_THR}
SELECT method, far_target, {sg.rnd('threshold', 7)} AS rebuilt, {sg.rnd('threshold', 7)} AS frozen, true AS exact, CAST(0 AS BIGINT) AS ulps FROM thr""")
def threshold_reproduction_check(spark, sf):
    t = cal.thresholds(minima(spark, sf), CFG)
    frozen = sinks.roundtrip_thresholds(t.select("method", "far_target", "threshold"))
    c = cal.compare_thresholds(t, frozen, ["method", "far_target"])
    return c.select("method", "far_target", r("rebuilt", 7).alias("rebuilt"), r("frozen", 7).alias("frozen"), "exact", "ulps")


@query("transfer_vs_own_arms", f"""{SQL_THR_S},
arms AS (SELECT 'own' AS arm, scenario, method, far_target, threshold FROM thr UNION ALL
  SELECT 'transfer', s.scenario, t.method, t.far_target, t.threshold FROM thr t CROSS JOIN (VALUES ('even'), ('odd')) s(scenario) WHERE t.scenario = 'even')
SELECT a.arm, a.scenario, a.method, a.far_target, {sg.rnd('a.threshold', 7)} AS threshold,
  count(*) FILTER (WHERE path_set = 'test_valid') AS n_test_valid, count(*) FILTER (WHERE path_set = 'test_invalid') AS n_test_invalid,
  {sg.rnd("count(*) FILTER (WHERE path_set = 'test_valid' AND min_stat < threshold) / count(*) FILTER (WHERE path_set = 'test_valid')")} AS far_H,
  {sg.rnd("count(*) FILTER (WHERE path_set = 'test_invalid' AND min_stat < threshold) / count(*) FILTER (WHERE path_set = 'test_invalid')")} AS detect_H
FROM arms a JOIN minima m ON m.scenario = a.scenario AND m.method = a.method GROUP BY ALL""")
def transfer_vs_own_arms(spark, sf):
    lw = lows(spark, sf)
    thr = small(cal.thresholds(cal.path_minima(lw), CFG, ["scenario", "method"]))
    own = thr.select(F.lit("own").alias("arm"), "scenario", "method", "far_target", "threshold")
    scen = F.explode(F.array(F.lit("even"), F.lit("odd")))
    transfer = thr.where(F.col("scenario") == "even").select(
        F.lit("transfer").alias("arm"), scen.alias("scenario"), "method", "far_target", "threshold")
    fp = pa.first_passage(lw.where(F.col("path_set") != cal.CALIBRATION), own.unionByName(transfer),
                          ["scenario", "method"], budget=["arm", "far_target"])
    v, i = F.col("path_set") == "test_valid", F.col("path_set") == "test_invalid"
    g = fp.groupBy("arm", "scenario", "method", "far_target").agg(
        F.first("threshold").alias("threshold"), F.count_if(v).alias("n_test_valid"), F.count_if(i).alias("n_test_invalid"),
        (F.count_if(v & pa.alarmed()) / F.count_if(v)).alias("far_H"), (F.count_if(i & pa.alarmed()) / F.count_if(i)).alias("detect_H"))
    return g.select("arm", "scenario", "method", "far_target", r("threshold", 7).alias("threshold"), "n_test_valid",
                    "n_test_invalid", r("far_H").alias("far_H"), r("detect_H").alias("detect_H"))


from tidewatch.plans.catalog import ORACLES as _ORACLES  # noqa: E402

#: the study as SQL, for the comparison with a supplied law
ORACLES_REPL = _ORACLES["calibration_replication_study"]
