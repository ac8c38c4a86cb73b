"""Queries for resampling whole entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import SUPPLIER as CFG
from tidewatch.config import USER
from tidewatch.functions.expr import excludes_zero
from tidewatch.operators import calibrate as cal
from tidewatch.operators import contrast as ct
from tidewatch.operators import evidence as ev
from tidewatch.operators import passage as pa
from tidewatch.operators import resample as rs
from tidewatch.plans import fixtures as fx
from tidewatch.plans import q_calibrate as qc
from tidewatch.plans import q_contrast as qx
from tidewatch.plans import q_diagnostics as qd
from tidewatch.plans import q_passage as qp
from tidewatch.plans import sqlgen as sg
from tidewatch.plans.catalog import query
from tidewatch.sources.tables import handoff

rr = qd.rr
M6, GRID = ev.JVM_METHODS, ev.GRID_2X2


def _weights_sql(src: str, cell: str = "path_set", salt: str = "CASE path_set WHEN 'calibration_valid' THEN 1 WHEN 'test_valid' THEN 2 ELSE 3 END", reps: int = rs.REPS) -> str:
    """CTE `wt`: multiplicities per (cell, rep, entity); rep -1 is the plain sample."""
    def word(k):
        m, (r, d, t), (a, b, c, e, f, g) = rs.MOD[k], rs.STEPS[k], rs.MIX[k]
        one = f"((rep * {r} + i * {d} + ({salt}) * {t}) % {m} * {a}) % {m}"
        return one, f"(h{k} * (h{k} % {b}) + {c}) % {m}", f"(h{k} * {e}) % {m}", f"(h{k} * (h{k} % {f}) + {g}) % {m}"
    steps = list(zip(word(0), word(1), strict=True))
    chain = f"b1 AS (SELECT {cell}, n, rep, {steps[0][0]} AS h0, {steps[0][1]} AS h1 FROM bent, (SELECT unnest(range(0, {reps})) AS rep) r)"
    for k, (x, y) in enumerate(steps[1:], 2):
        chain += f", b{k} AS (SELECT {cell}, n, rep, {x} AS h0, {y} AS h1 FROM b{k - 1})"
    return f""",
bent AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY entity) - 1 AS i, count(*) OVER (PARTITION BY {cell}) AS n FROM (SELECT DISTINCT {cell}, entity FROM {src})),
{chain}, b5 AS (SELECT {cell}, rep, (h0 * {rs.MOD[1]} + h1) % n AS i FROM b4),
wt AS MATERIALIZED (SELECT {cell}, rep, entity, count(*) AS w FROM b5 JOIN bent USING ({cell}, i) GROUP BY {cell}, rep, entity UNION ALL SELECT {cell}, -1, entity, 1 FROM bent)"""


def _rates_sql(extra: str = "", reps: int = rs.REPS) -> str:
    """CTE `rates` from `minima`; `extra` lists further cell columns, comma-terminated."""
    al = ", ".join(f"({a!r}::DOUBLE)" for a in CFG.far_targets)
    part = f"{extra}rep, method"
    return f"""{_weights_sql('minima', f'{extra}path_set', reps=reps)},
bn AS (SELECT {extra}n FROM (SELECT DISTINCT {extra}path_set, n FROM bent) WHERE path_set = 'calibration_valid'),
bc AS (SELECT {extra}m.method, w.rep, m.min_stat, sum(w.w) OVER (PARTITION BY {part} ORDER BY m.min_stat) AS c FROM (SELECT * FROM minima WHERE path_set = 'calibration_valid') m JOIN wt w USING ({extra}path_set, entity)),
bthr AS MATERIALIZED (SELECT {extra}method, rep, far_target, min(min_stat) AS threshold FROM bc {'JOIN bn USING (' + extra.rstrip(', ') + ')' if extra else 'CROSS JOIN bn'} CROSS JOIN (VALUES {al}) v(far_target)
  WHERE c >= least(CAST(floor(far_target * n) AS BIGINT), n - 1) + 1 GROUP BY {extra}method, rep, far_target),
rates AS MATERIALIZED (SELECT {extra}m.path_set, t.rep, m.method, t.far_target, sum(CASE WHEN m.min_stat < t.threshold THEN w.w ELSE 0 END) / sum(w.w) AS rate
  FROM minima m JOIN wt w USING ({extra}path_set, entity) JOIN bthr t ON t.method = m.method AND t.rep = w.rep {''.join(f'AND t.{x.strip()} = m.{x.strip()} ' for x in extra.split(',') if x.strip())} WHERE m.path_set <> 'calibration_valid' GROUP BY {extra}m.path_set, t.rep, m.method, t.far_target)"""


def _wide_sql(methods, keys, src="rates"):
    return f"wd AS (SELECT {keys}, rep, {', '.join(f"max(rate) FILTER (WHERE method = '{m}') AS {m}" for m in methods)} FROM {src} GROUP BY {keys}, rep)"


def _expr(e):
    return " + ".join(f"{c!r} * {m}" for c, m in e)


def _interval_sql(exprs, keys, src="wd", scale="1.0"):
    body = " UNION ALL ".join(f"SELECT {keys}, rep, '{n}' AS contrast, {scale} * ({_expr(e)}) AS v FROM {src}" for n, e in exprs.items())
    return f"""dd AS ({body}), ii AS (SELECT {keys}, contrast, max(v) FILTER (WHERE rep = -1) AS point, count(v) FILTER (WHERE rep >= 0) AS n_reps, quantile_cont(v, 0.025) FILTER (WHERE rep >= 0) AS lo, quantile_cont(v, 0.975) FILTER (WHERE rep >= 0) AS hi FROM dd GROUP BY {keys}, contrast)
SELECT {keys}, contrast, {sg.rnd('point')} AS point, n_reps, {sg.rnd('lo')} AS lo, {sg.rnd('hi')} AS hi, lo > 0 OR hi < 0 AS excludes_zero FROM ii"""


PAIRS = {f"binary_gaussian-{m}": ((1.0, "binary_gaussian"), (-1.0, m)) for m in M6 if m != "binary_gaussian"}
RULE = ["path_set", "far_target"]


def rates(spark, sf, methods=M6):
    """Replicate rates, a stage table shared by the pair, budget and interaction contrasts."""
    return handoff(spark, ("replicate_rates", sf, tuple(methods), CFG, rs.REPS),
                   lambda: rs.bootstrap_rates(qc.minima(spark, sf, methods).drop("scenario"), CFG))


SQL_R = qc.SQL_MIN.replace("SELECT scenario, path_set, entity, method, min(stat)", "SELECT path_set, entity, method, min(stat)") + _rates_sql()


@query("bootstrap_pair", f"{SQL_R}, {_wide_sql(M6, 'path_set, far_target')}, {_interval_sql(PAIRS, 'path_set, far_target')}")
def bootstrap_pair(spark, sf):
    c = rs.contrasts(rates(spark, sf), PAIRS, RULE)
    return rr(rs.interval(c, [*RULE, "contrast"], "value"), 9, skip=("far_target",))


@query("frozen_vs_recalibrated", f"""{qc.SQL_MIN.replace("SELECT scenario, path_set, entity, method, min(stat)", "SELECT path_set, entity, method, min(stat)")}{_rates_sql()},
fz AS (SELECT m.entity, m.method, t.far_target, CAST(m.min_stat < t.threshold AS DOUBLE) AS hit FROM minima m JOIN bthr t ON t.method = m.method AND t.rep = -1 WHERE m.path_set = 'test_invalid'),
fi AS (SELECT a.far_target, 'binary_gaussian-' || b.method AS contrast, avg(a.hit - b.hit) AS p, {CFG.wilson_z} * stddev_samp(a.hit - b.hit) / sqrt(count(*)) AS hw FROM fz a JOIN fz b USING (entity, far_target) WHERE a.method = 'binary_gaussian' AND b.method <> 'binary_gaussian' GROUP BY a.far_target, b.method),
{_wide_sql(M6, 'path_set, far_target')}, bt AS (SELECT * FROM ({'WITH ' + _interval_sql(PAIRS, 'path_set, far_target')}) WHERE path_set = 'test_invalid')
SELECT 'frozen' AS arm, far_target, contrast, {sg.rnd('p')} AS point, {sg.rnd('p - hw')} AS lo, {sg.rnd('p + hw')} AS hi, p - hw > 0 OR p + hw < 0 AS excludes_zero FROM fi
UNION ALL SELECT 'recalibrated', far_target, contrast, point, lo, hi, excludes_zero FROM bt""")
def frozen_vs_recalibrated(spark, sf):
    p = qp._paired(spark, sf)
    fz = p.select(F.lit("frozen").alias("arm"), "far_target", F.concat_ws("-", "method_a", "method_b").alias("contrast"), F.col("detect_diff").alias("point"),
                  F.col("detect_diff_lo").alias("lo"), F.col("detect_diff_hi").alias("hi"))
    fz = fz.withColumn("excludes_zero", excludes_zero(F.col("lo"), F.col("hi")))
    c = rs.contrasts(rates(spark, sf).where(F.col("path_set") == "test_invalid"), PAIRS, ["far_target"])
    bt = rs.interval(c, ["far_target", "contrast"], "value").drop("n_reps").withColumn("arm", F.lit("recalibrated"))
    return rr(fz.unionByName(bt.select(*fz.columns)), 9, skip=("far_target",))


_CELL_MIN = qc.SQL_MIN


@query("unified_bootstrap", f"""{_CELL_MIN}{_rates_sql('scenario, ')},
un AS MATERIALIZED (SELECT method, rep, far_target, min(threshold) AS threshold, arg_min(scenario, threshold) AS binding FROM bthr GROUP BY method, rep, far_target),
ur AS (SELECT m.scenario, m.path_set, u.rep, m.method, u.far_target, sum(CASE WHEN m.min_stat < u.threshold THEN w.w ELSE 0 END) / sum(w.w) AS rate FROM minima m JOIN wt w USING (scenario, path_set, entity) JOIN un u ON u.method = m.method AND u.rep = w.rep WHERE m.path_set <> 'calibration_valid' GROUP BY m.scenario, m.path_set, u.rep, m.method, u.far_target),
sh AS (SELECT method, far_target, {', '.join(f"{sg.rnd(f"count(*) FILTER (WHERE binding = '{s}' AND rep >= 0) / count(*) FILTER (WHERE rep >= 0)")} AS binding_share_{s}" for s in ('even', 'odd'))} FROM un GROUP BY method, far_target),
ii AS (SELECT scenario, path_set, method, far_target, max(rate) FILTER (WHERE rep = -1) AS point, count(rate) FILTER (WHERE rep >= 0) AS n_reps, quantile_cont(rate, 0.025) FILTER (WHERE rep >= 0) AS lo, quantile_cont(rate, 0.975) FILTER (WHERE rep >= 0) AS hi FROM ur GROUP BY scenario, path_set, method, far_target)
SELECT scenario, path_set, method, far_target, {sg.rnd('point')} AS point, n_reps, {sg.rnd('lo')} AS lo, {sg.rnd('hi')} AS hi, binding_share_even, binding_share_odd FROM ii JOIN sh USING (method, far_target)""")
def unified_bootstrap(spark, sf):
    rates_ = rs.bootstrap_rates(qc.minima(spark, sf), CFG, cell=["scenario"], unified=True)
    keys = ["scenario", "path_set", "method", "far_target"]
    bound = [F.avg(F.when(F.col("rep") >= 0, (F.col("binding") == s).cast("double"))).alias(f"binding_share_{s}") for s in ("even", "odd")]
    return rr(rs.interval(rates_, keys, "rate", bound).drop("excludes_zero"), 9, skip=("far_target",))


INTERACTION = {
    "trunc_t-ewma_t": ((1.0, "ewma_trunc_student_t"), (-1.0, "ewma_student_t")),
    "trunc_g-ewma_g": ((1.0, "ewma_trunc_gaussian"), (-1.0, "ewma_gaussian")),
    "interaction": ((1.0, "ewma_trunc_student_t"), (-1.0, "ewma_student_t"), (-1.0, "ewma_trunc_gaussian"), (1.0, "ewma_gaussian")),
}
SQL_G = (f"WITH RECURSIVE {fx.SQL_PANEL}{sg.statistics(CFG, GRID)}{sg.long_stats(GRID)}"
         f", minima AS MATERIALIZED (SELECT path_set, entity, method, min(stat) AS min_stat FROM stat WHERE day <= {CFG.horizon} GROUP BY path_set, entity, method){_rates_sql()}")


@query("interaction_2x2", f"{SQL_G}, {_wide_sql(GRID, 'path_set, far_target')}, {_interval_sql(INTERACTION, 'path_set, far_target')}")
def interaction_2x2(spark, sf):
    c = rs.contrasts(rates(spark, sf, GRID), INTERACTION, RULE)
    return rr(rs.interval(c, [*RULE, "contrast"], "value"), 9, skip=("far_target",))


@query("cross_budget_contrast", f"""{SQL_G}, {_wide_sql(GRID, 'path_set, far_target')}, wb AS (SELECT path_set, rep, {', '.join(f'max({m}) FILTER (WHERE far_target = 0.05) - max({m}) FILTER (WHERE far_target = 0.15) AS {m}' for m in GRID)} FROM wd GROUP BY path_set, rep), {_interval_sql(INTERACTION, 'path_set', 'wb')}""")
def cross_budget_contrast(spark, sf):
    c = rs.contrasts(rates(spark, sf, GRID), INTERACTION, RULE)
    lo, hi = min(CFG.far_targets), max(CFG.far_targets)
    d = c.groupBy("path_set", "rep", "contrast").agg((F.max(F.when(F.col("far_target") == lo, F.col("value"))) - F.max(
        F.when(F.col("far_target") == hi, F.col("value")))).alias("value"))
    return rr(rs.interval(d, ["path_set", "contrast"], "value"), 9)


_BA, _BB, _BDAY = "binary_gaussian", "binary_student_t", 440


@query("paired_brier_bootstrap", f"""WITH {fx.SQL_PANEL}{sg.statistics(CFG, (_BA, _BB))},
s AS MATERIALIZED (SELECT path_set, entity, power(1.0 / (1.0 + exp({_BA})) - y, 2) AS a, power(1.0 / (1.0 + exp({_BB})) - y, 2) AS b FROM (SELECT *, CASE WHEN path_set = 'test_invalid' THEN 1.0 ELSE 0.0 END AS y FROM wide WHERE day = {_BDAY} AND path_set <> 'calibration_valid'))
{_weights_sql('s')}, d AS (SELECT rep, sum(w * a) / sum(w) - sum(w * b) / sum(w) AS v FROM s JOIN wt USING (path_set, entity) GROUP BY rep)
SELECT {sg.rnd('max(v) FILTER (WHERE rep = -1)')} AS point, count(v) FILTER (WHERE rep >= 0) AS n_reps, {sg.rnd('quantile_cont(v, 0.025) FILTER (WHERE rep >= 0)')} AS lo, {sg.rnd('quantile_cont(v, 0.975) FILTER (WHERE rep >= 0)')} AS hi,
  quantile_cont(v, 0.025) FILTER (WHERE rep >= 0) > 0 OR quantile_cont(v, 0.975) FILTER (WHERE rep >= 0) < 0 AS excludes_zero FROM d""")
def paired_brier_bootstrap(spark, sf):
    p = fx.panel_supplier(spark, sf).where((F.col("day") <= _BDAY) & (F.col("path_set") != cal.CALIBRATION))
    wide = ev.wide_statistics(p, [_BA, _BB], CFG).where(F.col("day") == _BDAY)
    y = (F.col("path_set") == "test_invalid").cast("double")

    def sq(m):
        return F.pow(ev.failure_probability(F.col(m)) - y, F.lit(2.0))
    s = wide.select("path_set", "entity", sq(_BA).alias("a"), sq(_BB).alias("b"))
    d = rs.resampled_sums(s, ["path_set"], ["a", "b"], rs.REPS).groupBy("rep").agg((F.sum("a") / F.sum("n") - F.sum("b") / F.sum("n")).alias("value"))
    return rr(rs.interval(d.withColumn("k", F.lit(1)), ["k"], "value").drop("k"), 9)


@query("conditional_rate_bootstrap", f"""{qp.SQL_FAIL}, s AS MATERIALIZED (SELECT scenario, entity, method, far_target, CAST(NOT (tau <> -1 AND tau <= t) AS INTEGER) AS surv, CAST(tau > t AND tau <= t + 126 AS INTEGER) AS det FROM ft)
{_weights_sql('s', 'scenario', '7')}, r AS (SELECT scenario, method, far_target, rep, sum(w * det * surv) / nullif(sum(w * surv), 0) AS rate FROM s JOIN wt USING (scenario, entity) GROUP BY scenario, method, far_target, rep),
{_wide_sql(M6, 'scenario, far_target', 'r')}, {_interval_sql(PAIRS, 'scenario, far_target')}""")
def conditional_rate_bootstrap(spark, sf):
    from tidewatch.operators import survival as sv
    fp = qp.failing_passages(spark, sf)
    s = fp.select("scenario", "entity", "method", "far_target", (~sv.early()).alias("base"), sv.caught(126).alias("hit"))
    g = rs.conditional_rates(s, ["scenario"], ["method", "far_target"], rs.REPS, 7)
    c = rs.contrasts(g, PAIRS, ["scenario", "far_target"])
    return rr(rs.interval(c, ["scenario", "far_target", "contrast"], "value"), 9, skip=("far_target",))


_HS = (252, 440)
_MPH = qc.SQL_STAT + f", minima AS MATERIALIZED (SELECT path_set, entity, method || '_h' || h AS method, min(stat) AS min_stat FROM stat CROSS JOIN (VALUES (252), (440)) v(h) WHERE day <= h AND method IN {qp._LO} GROUP BY path_set, entity, method, h)" + _rates_sql()
GAIN = {
    "t_gain_h252": ((1.0, "binary_student_t_h252"), (-1.0, "binary_gaussian_h252")), "t_gain_h440": ((1.0, "binary_student_t_h440"), (-1.0, "binary_gaussian_h440")),
    "t_gain_change": ((1.0, "binary_student_t_h440"), (-1.0, "binary_gaussian_h440"), (-1.0, "binary_student_t_h252"), (1.0, "binary_gaussian_h252")),
    "ewma_gain_change": ((1.0, "ewma_student_t_h440"), (-1.0, "binary_student_t_h440"), (-1.0, "ewma_student_t_h252"), (1.0, "binary_student_t_h252")),
}
_HM = tuple(sorted({m for e in GAIN.values() for _, m in e}))


@query("gain_change_bootstrap", f"{_MPH}, {_wide_sql(_HM, 'path_set, far_target')}, {_interval_sql(GAIN, 'path_set, far_target')}")
def gain_change_bootstrap(spark, sf):
    m = cal.prefix_minima(qc.lows(spark, sf).where(F.col("method").isin(*qp._LO)), _HS)
    m = m.select("path_set", "entity", F.concat("method", F.lit("_h"), F.col("horizon").cast("string")).alias("method"), "min_stat")
    c = rs.contrasts(rs.bootstrap_rates(m, CFG), GAIN, RULE)
    return rr(rs.interval(c, [*RULE, "contrast"], "value"), 9, skip=("far_target",))


_UM = (f"WITH {fx.SQL_USER}{sg.statistics(USER, M6)}{sg.long_stats(M6)}, minima AS MATERIALIZED (SELECT path_set, entity, method, min(stat) AS min_stat FROM stat WHERE day <= {USER.horizon} GROUP BY path_set, entity, method)" + _rates_sql(reps=rs.MIXTURE_REPS))


@query("mixture_bootstrap", f"{_UM}, {_wide_sql(M6, 'path_set, far_target')}, {_interval_sql(PAIRS, 'path_set, far_target', scale='100.0')}")
def mixture_bootstrap(spark, sf):
    lw = handoff(spark, ("user_lows", sf, M6, USER), lambda: ev.record_lows(fx.panel_user(spark, sf), M6, USER))
    c = rs.contrasts(rs.bootstrap_rates(cal.path_minima(lw).drop("scenario"), USER, rs.MIXTURE_REPS), PAIRS, RULE).withColumn("value", F.col("value") * 100.0)
    return rr(rs.interval(c, [*RULE, "contrast"], "value"), 9, skip=("far_target",))


#: CTEs up to `ll`, the loss of every resampled ensemble
LOSS_REPS = f"""x AS (SELECT l.period, l.scenario, l.candidate, l.statistic, w.rep, l.value, sum(w.w) OVER (PARTITION BY l.period, l.scenario, l.candidate, l.statistic, w.rep ORDER BY l.value) AS c, sum(w.w) OVER (PARTITION BY l.period, l.scenario, l.candidate, l.statistic, w.rep) AS n FROM lg l JOIN wt w ON w.scenario = l.scenario AND w.candidate = l.candidate AND w.entity = l.entity WHERE l.statistic IN {qx._TG} AND l.value IS NOT NULL AND w.rep >= 0),
md AS (SELECT period, scenario, candidate, statistic, rep, (min(value) FILTER (WHERE c >= (n - 1) // 2 + 1) + min(value) FILTER (WHERE c >= n // 2 + 1)) / 2 AS med FROM x GROUP BY period, scenario, candidate, statistic, rep),
tt AS (SELECT m.*, power(((CASE WHEN m.statistic IN {qx._RVT} THEN ln(m.med) ELSE m.med END) - rt.real) / sc.scale, 2) AS term FROM md m JOIN rt USING (period, scenario, statistic) JOIN sc USING (period, scenario, statistic)),
ll AS (SELECT period, scenario, candidate, rep, 0.5 * avg(term) FILTER (WHERE statistic IN {qx._RVT}) + 0.5 * avg(term) FILTER (WHERE statistic NOT IN {qx._RVT}) AS loss FROM tt GROUP BY period, scenario, candidate, rep)"""


@query("loss_mc_se", f"""{qx.SQL_T}, src AS (SELECT DISTINCT scenario, candidate, entity FROM pan){_weights_sql('src', 'scenario, candidate', '5', rs.LOSS_REPS)},
{LOSS_REPS}
SELECT period, scenario, candidate, count(*) AS n_reps, {sg.rnd('stddev_samp(loss)', 5)} AS loss_mc_se FROM ll GROUP BY period, scenario, candidate""")
def loss_mc_se(spark, sf):
    lg, _, real, sc = qx._loss_parts(spark, sf)
    return rr(ct.loss_error(rs.resampled_medians(lg, ["scenario", "candidate"], ["period", "statistic"], rs.LOSS_REPS, 5), real, sc, qx.CELL, qx.OBS), 5)
