"""Queries for the sequential evidence statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import SUPPLIER as CFG
from tidewatch.functions.expr import r
from tidewatch.functions.ranking import quantiles
from tidewatch.operators import evidence as ev
from tidewatch.operators import passage as pa
from tidewatch.plans import fixtures as fx
from tidewatch.plans import sqlgen as sg
from tidewatch.plans.catalog import query

ID = "scenario, path_set, entity, day"
KEYS = ev.KEYS


def _single(method: str):
    """Day-level statistic of one method over the whole panel."""
    def run(spark, sf):
        wide = ev.wide_statistics(fx.panel_supplier(spark, sf), [method], CFG)
        return wide.select(*KEYS, "day", r(method, 6).alias("stat"))
    sql = (f"WITH RECURSIVE {fx.SQL_PANEL}{sg.statistics(CFG, [method])}\n"
           f"SELECT {ID}, {sg.rnd(method, 6)} AS stat FROM wide")
    return run, sql


@query("standardise_returns", f"""WITH {fx.SQL_PANEL}
SELECT {ID}, {sg.rnd(f'ret / {CFG.sigma_daily!r}')} AS z FROM panel""")
def standardise_returns(spark, sf):
    p = fx.panel_supplier(spark, sf)
    return p.select(*KEYS, "day", r(ev.standardised(F.col("ret"), CFG)).alias("z"))


for _name, _method in (("binary_gaussian", "binary_gaussian"), ("binary_student_t", "binary_student_t"),
                       ("trailing_sharpe", "trailing_sharpe"), ("known_vol_rolling", "known_vol_rolling"),
                       ("ewma_gaussian", "ewma_gaussian"), ("ewma_student_t", "ewma_student_t"),
                       ("ewma_trunc_gaussian", "ewma_trunc_gaussian"),
                       ("ewma_trunc_student_t", "ewma_trunc_student_t"),
                       ("known_variance_log_odds", "known_variance")):
    _run, _sql = _single(_method)
    query(_name, _sql)(_run)


@query("ewma_variance", f"""WITH {fx.SQL_PANEL}{sg.statistics(CFG, ['ewma_gaussian'])}
SELECT {ID}, {sg.rnd('v_ewma * 1e6')} AS v_micro, v_ewma < {CFG.variance_floor_factor * CFG.sigma_daily ** 2!r} AS floored FROM st_a""")
def ewma_variance(spark, sf):
    v = ev.with_ewma_variance(fx.panel_supplier(spark, sf), CFG)
    return v.select(*KEYS, "day", r(F.col("v_ewma") * 1e6).alias("v_micro"),
                    F.col("v_ewma_floored").alias("floored"))


@query("ewma_truncated_variance", f"""WITH RECURSIVE {fx.SQL_PANEL}{sg.truncated_variance(CFG)}
SELECT scenario, path_set, p.entity, p.day, {sg.rnd('t.v * 1e6')} AS v_micro,
       t.v < {CFG.variance_floor_factor * CFG.sigma_daily ** 2!r} AS floored
FROM panel p JOIN trunc t ON t.entity = p.entity AND t.day = p.day""")
def ewma_truncated_variance(spark, sf):
    v = ev.with_truncated_variance(fx.panel_supplier(spark, sf), CFG)
    return v.select(*KEYS, "day", r(F.col("v_trunc") * 1e6).alias("v_micro"),
                    F.col("v_trunc_floored").alias("floored"))


@query("failure_probability", f"""WITH {fx.SQL_PANEL}{sg.statistics(CFG, ['binary_gaussian'])}
SELECT {ID}, {sg.rnd('1.0 / (1.0 + exp(binary_gaussian))')} AS q FROM wide""")
def failure_probability(spark, sf):
    wide = ev.wide_statistics(fx.panel_supplier(spark, sf), ["binary_gaussian"], CFG)
    return wide.select(*KEYS, "day", r(ev.failure_probability(F.col("binary_gaussian"))).alias("q"))


_QL = "(x - ln(x) - 1.0)"


@query("qlike", f"""WITH {fx.SQL_PANEL}{sg.statistics(CFG, ['ewma_gaussian'])},
per AS (SELECT scenario, entity, avg(true_var / v_ewma - ln(true_var / v_ewma) - 1.0) AS ewma,
               avg(true_var / {CFG.sigma_daily ** 2!r} - ln(true_var / {CFG.sigma_daily ** 2!r}) - 1.0) AS const
        FROM st_a GROUP BY ALL),
long AS (SELECT scenario, 'q_ewma' AS forecast, ewma AS q FROM per UNION ALL SELECT scenario, 'q_const', const FROM per)
SELECT scenario, forecast, count(*) AS n_entities, {sg.rnd('avg(q)')} AS mean_qlike,
       {sg.rnd('stddev_samp(q) / sqrt(count(*))')} AS se_qlike FROM long GROUP BY ALL""")
def qlike(spark, sf):
    t = ev.qlike_table(fx.panel_supplier(spark, sf), CFG)
    return t.select("scenario", "forecast", "n_entities", r("mean_qlike").alias("mean_qlike"),
                    r("se_qlike").alias("se_qlike"))


_DAYS = (63, 126, 252, 440)


@query("information_days", f"""WITH {fx.SQL_PANEL},
i AS (SELECT scenario, entity, day, sum({CFG.sigma_daily ** 2!r} / true_var) OVER (PARTITION BY entity ORDER BY day) AS v FROM panel)
SELECT scenario, day, count(*) AS n_entities, {sg.rnd('avg(v)', 7)} AS mean_info,
       {sg.rnd('stddev_samp(v) / sqrt(count(*))', 7)} AS se_info, {sg.rnd('quantile_cont(v, 0.5)', 7)} AS median_info,
       {sg.rnd('quantile_cont(v, 0.1)', 7)} AS q10_info, {sg.rnd('quantile_cont(v, 0.9)', 7)} AS q90_info
FROM i WHERE day IN {_DAYS} GROUP BY ALL""")
def information_days(spark, sf):
    i = ev.information_days(fx.panel_supplier(spark, sf), CFG).where(F.col("day").isin(*_DAYS))
    i = i.select("scenario", "day", "info_days")
    mean = i.groupBy("scenario", "day").agg(
        F.count("info_days").alias("n_entities"), F.avg("info_days").alias("m"),
        (F.stddev_samp("info_days") / F.sqrt(F.count("info_days"))).alias("se"))
    qs = quantiles(i, ["scenario", "day"], "info_days", {"q10": .1, "q50": .5, "q90": .9})
    return mean.join(qs, ["scenario", "day"]).select(
        "scenario", "day", "n_entities", r("m", 7).alias("mean_info"), r("se", 7).alias("se_info"),
        r("q50", 7).alias("median_info"), r("q10", 7).alias("q10_info"), r("q90", 7).alias("q90_info"))


@query("variance_trace", f"""WITH {fx.SQL_PANEL}{sg.statistics(CFG, ['ewma_gaussian'])}
SELECT {ID}, {sg.rnd('ret')} AS ret, {sg.rnd('true_var * 1e6')} AS true_var_micro, {sg.rnd('v_ewma * 1e6')} AS forecast_micro,
       {sg.rnd('true_var / v_ewma')} AS variance_ratio, {sg.rnd('true_var / v_ewma - ln(true_var / v_ewma) - 1.0')} AS qlike FROM st_a""")
def variance_trace(spark, sf):
    t = ev.variance_trace(fx.panel_supplier(spark, sf), CFG)
    return t.select(*KEYS, "day", r("ret").alias("ret"), r(F.col("true_var") * 1e6).alias("true_var_micro"),
                    r(F.col("forecast_var") * 1e6).alias("forecast_micro"),
                    r("variance_ratio").alias("variance_ratio"), r("qlike").alias("qlike"))


def _elig_sql(methods):
    return "CASE method " + " ".join(
        f"WHEN '{d.name}' THEN {d.first_eligible_day(CFG)}" for d in ev.resolve(methods)) + " END"


@query("detector_registry", f"""WITH RECURSIVE {fx.SQL_PANEL}{sg.statistics(CFG, ev.ALL_METHODS)}{sg.long_stats(ev.ALL_METHODS)}
SELECT {ID}, method, {sg.rnd("stat", 6)} AS stat, CAST({_elig_sql(ev.ALL_METHODS)} AS INTEGER) AS first_eligible_day FROM stat""")
def detector_registry(spark, sf):
    s = ev.long_statistics(fx.panel_supplier(spark, sf), ev.ALL_METHODS, CFG)
    return s.select(*KEYS, "day", "method", r("stat", 6).alias("stat"), "first_eligible_day")


@query("drift_overlay", f"""WITH {fx.SQL_FAILING}
SELECT {ID}, t_last_valid, {sg.rnd('ret')} AS ret FROM panel""")
def drift_overlay(spark, sf):
    p = fx.failing_supplier(spark, sf)
    return p.select(*KEYS, "day", "t_last_valid", r("ret").alias("ret"))


_SHOCK_DAY, _SHOCK = 126, 8.0


@query("shock_what_if", f"""WITH {fx.SQL_PANEL.replace('panel AS', 'panel0 AS')},
panel AS MATERIALIZED (
  SELECT p.* REPLACE (p.ret + CASE WHEN day = {_SHOCK_DAY} THEN amp ELSE 0.0 END AS ret), variant
  FROM panel0 p CROSS JOIN (VALUES ('base', 0.0), ('down', {-_SHOCK * CFG.sigma_daily!r}), ('up', {_SHOCK * CFG.sigma_daily!r})) v(variant, amp)
  WHERE day <= {CFG.horizon})
{sg.statistics(CFG, ['binary_gaussian', 'binary_student_t', 'ewma_gaussian', 'ewma_student_t'], part='scenario, path_set, entity, variant')},
long AS ({' UNION ALL '.join(f"SELECT scenario, path_set, entity, variant, day, '{m}' AS method, {m} AS stat FROM wide" for m in ('binary_gaussian', 'binary_student_t', 'ewma_gaussian', 'ewma_student_t'))}),
agg AS (SELECT scenario, path_set, entity, variant, method,
   max(CASE WHEN day = {_SHOCK_DAY} THEN stat END) AS at_day, max(CASE WHEN day = {_SHOCK_DAY - 1} THEN stat END) AS before_day,
   max(CASE WHEN day = {CFG.horizon} THEN stat END) AS at_end FROM long GROUP BY ALL)
SELECT a.scenario, a.path_set, a.entity, a.variant, a.method, {sg.rnd('a.at_day', 8)} AS stat_at_shock,
  {sg.rnd('a.at_day - a.before_day', 8)} AS increment_at_shock, {sg.rnd('1.0 / (1.0 + exp(a.at_day))', 8)} AS q_at_shock,
  {sg.rnd('a.at_end - b.at_end', 8)} AS end_shift
FROM agg a JOIN agg b USING (entity, method) WHERE b.variant = 'base'""")
def shock_what_if(spark, sf):
    methods = ["binary_gaussian", "binary_student_t", "ewma_gaussian", "ewma_student_t"]
    keys = [*KEYS, "variant"]
    v = ev.shock_variants(fx.panel_supplier(spark, sf).where(F.col("day") <= CFG.horizon), CFG, _SHOCK_DAY, _SHOCK)
    wide = ev.wide_statistics(v, methods, CFG, keys)

    def at(m, d):
        return F.max(F.when(F.col("day") == d, F.col(m)))
    cells = F.explode(F.array(*[F.struct(
        F.lit(m).alias("method"), F.col(f"{m}_s").alias("s"), F.col(f"{m}_b").alias("b"),
        F.col(f"{m}_e").alias("e")) for m in methods]))
    per = wide.groupBy(*keys).agg(*[x for m in methods for x in (
        at(m, _SHOCK_DAY).alias(f"{m}_s"), at(m, _SHOCK_DAY - 1).alias(f"{m}_b"),
        at(m, CFG.horizon).alias(f"{m}_e"))]).select(*keys, cells.alias("c")).select(*keys, "c.*")
    from pyspark.sql import Window
    base = F.max(F.when(F.col("variant") == "base", F.col("e"))).over(
        Window.partitionBy(*KEYS, "method"))
    return per.select(*keys, "method", r("s", 8).alias("stat_at_shock"),
                      r(F.col("s") - F.col("b"), 8).alias("increment_at_shock"),
                      r(ev.failure_probability(F.col("s")), 8).alias("q_at_shock"),
                      r(F.col("e") - base, 8).alias("end_shift"))


@query("evidence_trace", f"""WITH {fx.SQL_FAILING}{sg.statistics(CFG, ['binary_gaussian'], extra=', t_last_valid')},
u AS (SELECT scenario, entity, day, t_last_valid, -binary_gaussian AS u FROM wide WHERE day <= {CFG.horizon}),
x AS (SELECT scenario, day, u, u - coalesce(max(CASE WHEN day = t_last_valid THEN u END) OVER (PARTITION BY entity), {-CFG.prior_log_odds!r}) AS inc FROM u)
SELECT scenario, day, {', '.join(f"{sg.rnd(f'quantile_cont({c}, {p})', 8)} AS {c}_q{int(p*100)}" for c in ('u', 'inc') for p in (.1, .5, .9))}
FROM x GROUP BY ALL""")
def evidence_trace(spark, sf):
    p = fx.failing_supplier(spark, sf).where(F.col("day") <= CFG.horizon)
    t = pa.evidence_increments(p, "binary_gaussian", CFG)
    probs = {"q10": .1, "q50": .5, "q90": .9}
    long = t.select("scenario", "day", F.explode(F.array(
        F.struct(F.lit("u").alias("k"), F.col("u").alias("v")),
        F.struct(F.lit("inc").alias("k"), F.col("inc").alias("v")))).alias("c")).select("scenario", "day", "c.*")
    q = quantiles(long, ["scenario", "day", "k"], "v", probs)
    return q.groupBy("scenario", "day").agg(*[
        F.max(F.when(F.col("k") == c, r(n, 8))).alias(f"{c}_{n}") for c in ("u", "inc") for n in probs])
