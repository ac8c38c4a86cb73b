"""Queries for observed-against-candidate contrasts, selection and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import SUPPLIER as CFG
from tidewatch.functions.small import small
from tidewatch.operators import calibrate as cal
from tidewatch.operators import contrast as ct
from tidewatch.operators import diagnostics as dg
from tidewatch.plans import fixtures as fx
from tidewatch.plans import q_calibrate as qc
from tidewatch.plans import q_diagnostics as qd
from tidewatch.plans import sqlgen as sg
from tidewatch.plans.catalog import query
from tidewatch.sources.tables import deal_parts, handoff

rr, rsel = qd.rr, qd.rsel
#: the second period starts here; every day of the panel is in one of the two
SPLIT = "1998-07-01"
IDS = ["period", "scenario", "candidate", "entity"]
CELL = ["period", "scenario", "candidate"]
OBS = ["period", "scenario"]
NAMES = dg.statistic_names()
PERIODS = ("P1", "P2")

_PAN2 = f"""pan2 AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY period, entity ORDER BY date) AS INTEGER) AS day FROM (SELECT CASE WHEN date < DATE '{SPLIT}' THEN 'P1' ELSE 'P2' END AS period, scenario, candidate, entity, date, ret FROM pan))"""


def sql_l(pan2: str = _PAN2) -> str:
    """CTEs up to the long statistics `lg` and the observed ones `ob`, per period of `pan2`."""
    return f"""WITH {qd.SQL_P}, {pan2},
{qd.ms('pan2', 'period, scenario, candidate, entity', 'day')}{qd.path_stats_sql('period, scenario, candidate, entity', base='pan2')},
lg AS MATERIALIZED ({qd._unp('ps', NAMES, 'period, scenario, candidate, entity')}),
ob AS MATERIALIZED (SELECT period, scenario, statistic, arg_min_null(value, entity) AS value FROM lg GROUP BY period, scenario, statistic)"""


SQL_L = sql_l()
_TG = "(" + ", ".join(f"'{t}'" for t in ct.TARGETS) + ")"
_RVT = "(" + ", ".join(f"'{t}'" for t in ct.RV_TARGETS) + ")"
_EX = f"CASE WHEN statistic IN {_RVT} THEN ln(value) ELSE value END"
_EXL = f"CASE WHEN l.statistic IN {_RVT} THEN ln(l.value) ELSE l.value END"
_TARGETS = f""",
tv AS MATERIALIZED (SELECT period, scenario, candidate, statistic, CASE WHEN any_value(statistic) IN {_RVT} THEN ln(quantile_cont(value, 0.5)) ELSE quantile_cont(value, 0.5) END AS target FROM lg WHERE statistic IN {_TG} GROUP BY period, scenario, candidate, statistic),
rt AS MATERIALIZED (SELECT period, scenario, statistic, {_EX} AS real FROM ob WHERE statistic IN {_TG}),
sc AS MATERIALIZED (SELECT period, scenario, statistic, greatest(stddev_samp({_EX}), {ct.SCALE_FLOOR}) AS scale, stddev_samp({_EX}) < {ct.SCALE_FLOOR} AS floored FROM lg WHERE candidate = 0 AND statistic IN {_TG} GROUP BY period, scenario, statistic),
lt AS (SELECT tv.*, rt.real, sc.scale, power((target - real) / scale, 2) AS term FROM tv JOIN rt USING (period, scenario, statistic) JOIN sc USING (period, scenario, statistic)),
ls AS MATERIALIZED (SELECT *, 0.5 * rv21_component + 0.5 * acf_abs_component AS loss FROM (SELECT period, scenario, candidate, avg(term) FILTER (WHERE statistic IN {_RVT}) AS rv21_component, avg(term) FILTER (WHERE statistic NOT IN {_RVT}) AS acf_abs_component FROM lt GROUP BY period, scenario, candidate))"""
SQL_T = SQL_L + _TARGETS



def periods(spark, sf):
    """Every day of the panel with its period."""
    return qd.panel(spark, sf).select(F.when(F.col("date") < F.to_date(F.lit(SPLIT)), "P1").otherwise("P2").alias("period"),
                                      "scenario", "candidate", "entity", "date", "ret")


def stats(spark, sf):
    """Path statistics of every entity in each period of the panel."""
    return handoff(spark, ("path_statistics", sf, SPLIT, CFG), lambda: dg.path_statistics(periods(spark, sf), IDS, "date"))


def long(spark, sf, names=NAMES):
    return dg.stats_long(stats(spark, sf), IDS, names)


def observed(lg):
    """The series of the smallest entity plays the observed one."""
    return lg.groupBy(*OBS, "statistic").agg(F.min_by("value", "entity").alias("value"))


def _loss_parts(spark, sf):
    lg = long(spark, sf, ct.TARGETS)
    tv = ct.target_values(lg, CELL)
    sc = small(ct.standardising_scales(lg.where(F.col("candidate") == 0), OBS))
    return lg, tv, small(ct.observed_targets(observed(lg), OBS)), sc


def losses(spark, sf):
    _, tv, real, sc = _loss_parts(spark, sf)
    return ct.loss(ct.loss_terms(tv, real, sc, OBS), CELL)


@query("target_values", f"{SQL_T} SELECT period, scenario, candidate, statistic, {sg.rnd('target', 7)} AS target, {sg.rnd('real', 7)} AS real FROM lt")
def target_values(spark, sf):
    lg = long(spark, sf, ct.TARGETS)
    return rr(ct.target_values(lg, CELL).join(small(ct.observed_targets(observed(lg), OBS)), [*OBS, "statistic"]))


@query("standardising_scales", f"{SQL_T} SELECT period, scenario, statistic, {sg.rnd('scale', 7)} AS scale, floored FROM sc")
def standardising_scales(spark, sf):
    return rr(ct.standardising_scales(long(spark, sf, ct.TARGETS).where(F.col("candidate") == 0), OBS))


@query("two_group_loss", f"{SQL_T} SELECT period, scenario, candidate, statistic, {sg.rnd('term', 5)} AS term, {rsel(['loss', 'rv21_component', 'acf_abs_component'], 5)} FROM lt JOIN ls USING (period, scenario, candidate)")
def two_group_loss(spark, sf):
    _, tv, real, sc = _loss_parts(spark, sf)
    t = ct.loss_terms(tv, real, sc, OBS)
    return rr(t.select(*CELL, "statistic", "term").join(ct.loss(t, CELL), CELL), 5)


def _summary_sql(src="lg", name="sm"):
    return f"""{name} AS MATERIALIZED (SELECT period, scenario, candidate, statistic, count(value) AS n_paths, quantile_cont(value, 0.5) AS sim_median, quantile_cont(value, 0.025) AS sim_lo, quantile_cont(value, 0.975) AS sim_hi, {ct.MEDIAN_SE} * stddev_samp(value) / sqrt(count(value)) AS sim_median_mc_se
  FROM {src} GROUP BY period, scenario, candidate, statistic HAVING count(value) > 0)"""


SQL_IN = f"""{SQL_L}, {_summary_sql()},
ir AS MATERIALIZED (SELECT sm.*, ob.value AS real, CASE WHEN ob.value IS NOT NULL THEN ob.value BETWEEN sim_lo AND sim_hi END AS inside FROM sm LEFT JOIN ob USING (period, scenario, statistic))"""
_SM = ["sim_median", "sim_lo", "sim_hi", "sim_median_mc_se"]


def ranges(spark, sf):
    lg = long(spark, sf)
    return ct.inside_range(ct.summarise(lg, CELL), small(observed(lg)), OBS)


@query("summarise_ensemble", f"{SQL_L}, {_summary_sql()} SELECT period, scenario, candidate, statistic, n_paths, {rsel(_SM)} FROM sm")
def summarise_ensemble(spark, sf):
    return rr(ct.summarise(long(spark, sf), CELL))


@query("inside_range", f"{SQL_IN} SELECT period, scenario, candidate, statistic, n_paths, {rsel(_SM + ['real'])}, inside FROM ir")
def inside_range(spark, sf):
    return rr(ranges(spark, sf))


SQL_CT = f"""{SQL_L}, oe AS (SELECT scenario, min(entity) AS entity FROM pan GROUP BY scenario),
zo AS (SELECT period, scenario, z FROM mz JOIN oe USING (scenario, entity)),
wo AS (SELECT period, scenario, candidate, entity, '{ct.W1_OBS}' AS statistic, w1 AS value FROM ({qd.w1_sql("""SELECT period, scenario, candidate, entity, z AS x, 1 AS a, 0 AS b FROM mz
  UNION ALL SELECT p.period, p.scenario, p.candidate, p.entity, zo.z, 0, 1 FROM (SELECT DISTINCT period, scenario, candidate, entity FROM mz) p JOIN zo USING (period, scenario)""", 'period, scenario, candidate, entity')})),
ix AS (SELECT scenario, candidate, entity, row_number() OVER (PARTITION BY scenario, candidate ORDER BY entity) AS i, count(*) OVER (PARTITION BY scenario, candidate) // 2 AS h FROM (SELECT DISTINCT scenario, candidate, entity FROM pan)),
pr AS (SELECT x.scenario, x.candidate, x.entity, y.entity AS entity_b FROM ix x JOIN ix y ON y.scenario = x.scenario AND y.candidate = x.candidate AND y.i = x.i + x.h WHERE x.i <= x.h),
wr AS (SELECT period, scenario, candidate, entity, '{ct.W1_REF}' AS statistic, w1 AS value FROM ({qd.w1_sql("""SELECT mz.period, mz.scenario, mz.candidate, mz.entity, z AS x, 1 AS a, 0 AS b FROM mz JOIN pr USING (scenario, candidate, entity)
  UNION ALL SELECT mz.period, mz.scenario, mz.candidate, pr.entity, z, 0, 1 FROM mz JOIN pr ON pr.scenario = mz.scenario AND pr.candidate = mz.candidate AND pr.entity_b = mz.entity""", 'period, scenario, candidate, entity')}) WHERE w1 IS NOT NULL),
sh AS ({' UNION ALL '.join(f"SELECT period, scenario, candidate, entity, 'rv21_q{q}_over_sd' AS statistic, rv21_q{q} / (sd_daily * sqrt(252)) AS value FROM ps" for q in (10, 50, 90))}),
la AS MATERIALIZED (SELECT * FROM lg UNION ALL SELECT * FROM sh UNION ALL SELECT * FROM wo UNION ALL SELECT * FROM wr), {_summary_sql('la')},
ob2 AS (SELECT period, scenario, statistic, arg_min_null(value, entity) AS value FROM (SELECT * FROM lg UNION ALL SELECT * FROM sh) GROUP BY period, scenario, statistic),
ir AS MATERIALIZED (SELECT sm.*, ob2.value AS real, CASE WHEN ob2.value IS NOT NULL THEN ob2.value BETWEEN sim_lo AND sim_hi END AS inside FROM sm LEFT JOIN ob2 USING (period, scenario, statistic))"""


def standardised(spark, sf):
    """Standardised series of every entity in each period of the panel."""
    return handoff(spark, ("standardised", sf, SPLIT, CFG), lambda: dg.standardise(periods(spark, sf), IDS).select(*IDS, "z"))


def distances(spark, sf):
    """W1 of every series to the observed one and to its partner in the other half, per period."""
    # two samples a series: as many parts again as the panel has
    z, ids, parts = standardised(spark, sf), stats(spark, sf).select(*IDS), 2 * deal_parts(spark, sf, "lineitem")
    ent = ids.select("scenario", "candidate", "entity").distinct()
    # the observed series has a row per day, period and scenario; every entity is compared with it
    first = small(ent.groupBy("scenario").agg(F.min("entity").alias("entity")))
    obs_z = small(z.join(first, ["scenario", "entity"]).select(*OBS, "z"))
    w_obs = dg.wasserstein1(z, ids.join(obs_z, OBS), IDS, parts=parts)
    both = z.join(dg.half_sides(ent, ["scenario", "candidate"]).drop("pair"), ["scenario", "candidate", "entity"])
    both = both.select("period", "scenario", "candidate", F.col("first").alias("entity"), F.col("z").alias("_x"), "_a", "_b")
    w_ref = dg.sampled_wasserstein1(both, IDS, parts)
    w_obs, w_ref = (w.select(*IDS, F.lit(s).alias("statistic"), F.col("w1").alias("value")) for w, s in ((w_obs, ct.W1_OBS), (w_ref, ct.W1_REF)))
    return w_obs.unionByName(w_ref)


def contrast_table(spark, sf):
    """Statistics, within-path shape and distances of every candidate, per period."""
    shape = dg.rv_shape_ratio(stats(spark, sf))
    shaped = NAMES + [f"rv21_q{q}_over_sd" for q in (10, 50, 90)]
    lg = dg.stats_long(shape, IDS, shaped)
    # ranking reads its rows more than once; the distances are formed once
    w = handoff(spark, ("distances", sf, SPLIT, CFG), lambda: distances(spark, sf))
    c = ct.inside_range(ct.summarise(lg.unionByName(w), CELL), small(observed(lg)), OBS)
    return c.withColumn("comparison", ct.comparison_type(F.col("statistic")))


_CMP = f"CASE WHEN statistic = '{ct.W1_REF}' THEN 'simulation only' WHEN statistic LIKE 'w1_%' THEN 'distance' WHEN statistic LIKE '%_over_sd' THEN 'shape within path' ELSE 'range' END"


@query("contrast", f"{SQL_CT} SELECT period, scenario, candidate, statistic, n_paths, {rsel(_SM + ['real'])}, inside, {_CMP} AS comparison FROM ir")
def contrast(spark, sf):
    return rr(contrast_table(spark, sf))


_GRP = "CASE " + " ".join(f"WHEN statistic IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in ct.GROUPS.items()) + " END"


@query("gap_overview", f"""{SQL_CT}, g AS (SELECT *, {_GRP} AS grp FROM ir)
SELECT period, scenario, candidate, grp AS "group", count(*) AS statistics, count(*) FILTER (WHERE inside) AS n_inside, {sg.rnd('count(*) FILTER (WHERE inside) / count(*)')} AS coverage, CAST(NULL AS DOUBLE) AS w1_ratio FROM g WHERE grp IS NOT NULL GROUP BY period, scenario, candidate, grp
UNION ALL SELECT period, scenario, candidate, 'distance / own reference', 1, NULL, NULL, {sg.rnd(f"max(CASE WHEN statistic = '{ct.W1_OBS}' THEN sim_median END) / max(CASE WHEN statistic = '{ct.W1_REF}' THEN sim_median END)")} FROM ir WHERE statistic LIKE 'w1_%' GROUP BY period, scenario, candidate""")
def gap_overview(spark, sf):
    return rr(ct.gap_overview(contrast_table(spark, sf), CELL), 9)


@query("gap_table", f"""{SQL_IN} SELECT period, scenario, statistic, {', '.join(f"{sg.rnd(f'max({c}) FILTER (WHERE candidate = {k})', 7)} AS c{k}_{n}" for k in range(5) for c, n in (('sim_median', 'median'), ('sim_lo', 'lo'), ('sim_hi', 'hi')))}, {', '.join(f'bool_or(inside) FILTER (WHERE candidate = {k}) AS c{k}_inside' for k in range(5))} FROM ir GROUP BY period, scenario, statistic""")
def gap_table(spark, sf):
    t = ranges(spark, sf).withColumn("c", F.concat(F.lit("c"), F.col("candidate").cast("string")))
    return rr(ct.gap_table(t, [*OBS, "statistic"], "c", [f"c{k}" for k in range(5)]))


@query("candidate_screen", f"""{SQL_T}, k AS (SELECT *, row_number() OVER (PARTITION BY period, scenario ORDER BY loss, candidate) AS rk FROM ls) SELECT period, scenario, candidate, {sg.rnd('loss', 5)} AS loss, CAST(rk AS INTEGER) AS rank, candidate = 0 AS is_baseline FROM k WHERE rk <= 2 OR candidate = 0""")
def candidate_screen(spark, sf):
    s = ct.screen(losses(spark, sf), OBS, 2, F.col("candidate") == 0)
    return rr(s.select(*CELL, "loss", "rank", "is_baseline"), 5)


@query("auxiliary_coverage", f"{SQL_IN} SELECT candidate, statistic, count(inside) AS n, {sg.rnd('avg(CAST(inside AS DOUBLE))')} AS coverage FROM ir GROUP BY candidate, statistic")
def auxiliary_coverage(spark, sf):
    return rr(ct.coverage(ranges(spark, sf), ["candidate"]), 9)


@query("centre_error_change", f"""{SQL_IN}, e AS (SELECT period, scenario, statistic, candidate, abs(sim_median - real) / (sim_hi - sim_lo) AS e FROM ir WHERE statistic NOT IN {_TG} AND real IS NOT NULL AND sim_hi - sim_lo > 0),
c AS (SELECT period, scenario, statistic, a.e AS baseline_error, b.e AS selected_error, b.e - a.e AS change FROM e a JOIN e b USING (period, scenario, statistic) WHERE a.candidate = 0 AND b.candidate = 1)
SELECT period, scenario, statistic, {rsel(['baseline_error', 'selected_error', 'change'])}, CASE WHEN change > 0.02 THEN 'worse' WHEN change < -0.02 THEN 'better' ELSE 'unchanged' END AS verdict FROM c""")
def centre_error_change(spark, sf):
    return rr(ct.centre_error_change(ranges(spark, sf), OBS, F.col("candidate") == 0, F.col("candidate") == 1))


@query("flipped_verdicts", f"""{SQL_IN} SELECT a.scenario, a.candidate, a.statistic, a.inside AS inside_a, b.inside AS inside_b FROM ir a JOIN ir b USING (scenario, candidate, statistic) WHERE a.period = 'P1' AND b.period = 'P2' AND a.inside <> b.inside""")
def flipped_verdicts(spark, sf):
    return ct.flipped(ranges(spark, sf), ["scenario", "candidate"], "period", "P1", "P2")


@query("energy_score", f"""{SQL_T}, vv AS (SELECT l.period, l.scenario, l.candidate, l.entity, l.statistic, ({_EXL}) / sc.scale AS v FROM lg l JOIN sc USING (period, scenario, statistic)),
oe AS (SELECT scenario, min(entity) AS entity FROM pan GROUP BY scenario), ix AS (SELECT scenario, candidate, entity, row_number() OVER (PARTITION BY scenario, candidate ORDER BY entity) AS i, count(*) OVER (PARTITION BY scenario, candidate) // 2 AS h FROM (SELECT DISTINCT scenario, candidate, entity FROM pan)),
d AS (SELECT a.period, a.scenario, a.candidate, x.i, sqrt(sum(power(a.v - o.v, 2))) AS dy, sqrt(sum(power(a.v - b.v, 2))) AS dx FROM vv a JOIN ix x ON x.entity = a.entity JOIN ix y ON y.scenario = x.scenario AND y.candidate = x.candidate AND y.i = x.i + x.h
  JOIN vv b ON b.entity = y.entity AND b.period = a.period AND b.statistic = a.statistic JOIN oe ON oe.scenario = a.scenario JOIN vv o ON o.entity = oe.entity AND o.period = a.period AND o.statistic = a.statistic WHERE x.i <= x.h GROUP BY a.period, a.scenario, a.candidate, x.i)
SELECT period, scenario, candidate, count(*) AS n_pairs, {sg.rnd('avg(dy) - 0.5 * avg(dx)', 6)} AS energy_score FROM d GROUP BY period, scenario, candidate""")
def energy_score(spark, sf):
    lg, _, _, sc = _loss_parts(spark, sf)
    v = ct.stat_vectors(lg, sc.drop("floored"), OBS, IDS)
    obs = small(v.groupBy(*OBS).agg(F.min_by("v", "entity").alias("v")))
    return rr(ct.energy_score(v, obs, CELL, OBS), 6)


# --- recovery: every series is a pseudo-history whose generating candidate is known -----

SQL_RC = f"""{SQL_T}, pe AS (SELECT l.period, l.scenario, l.candidate AS truth, l.entity, tv.candidate, l.statistic, power((tv.target - (CASE WHEN l.statistic IN {_RVT} THEN ln(l.value) ELSE l.value END)) / sc.scale, 2) AS term
  FROM lg l JOIN tv ON tv.period = l.period AND tv.scenario = l.scenario AND tv.statistic = l.statistic JOIN sc ON sc.period = l.period AND sc.scenario = l.scenario AND sc.statistic = l.statistic),
pl AS (SELECT period, scenario, truth, entity, candidate, 0.5 * avg(term) FILTER (WHERE statistic IN {_RVT}) + 0.5 * avg(term) FILTER (WHERE statistic NOT IN {_RVT}) AS loss FROM pe GROUP BY period, scenario, truth, entity, candidate),
rec AS MATERIALIZED (SELECT period, scenario, truth, entity, arg_min(candidate, loss) AS selected, min(loss) AS loss_selected, max(CASE WHEN candidate = 0 THEN loss END) AS loss_baseline, max(CASE WHEN candidate = truth THEN loss END) AS loss_truth FROM pl GROUP BY period, scenario, truth, entity)"""


def recovered(lg, tv, sc):
    """Which candidate each series of `lg`, taken as the history, would choose, and three losses."""
    k = ["period", "scenario", "truth", "entity"]
    hist = ct.observed_targets(lg.withColumnRenamed("candidate", "truth"), k)
    terms = hist.join(small(tv), [*OBS, "statistic"]).join(sc.drop("floored"), [*OBS, "statistic"]).withColumn(
        "term", F.pow((F.col("target") - F.col("real")) / F.col("scale"), F.lit(2.0)))
    lo = ct.loss(terms, [*k, "candidate"])
    return lo.groupBy(*k).agg(F.min_by("candidate", F.struct("loss", "candidate")).alias("selected"), F.min("loss").alias("loss_selected"),
                              F.max(F.when(F.col("candidate") == 0, F.col("loss"))).alias("loss_baseline"),
                              F.max(F.when(F.col("candidate") == F.col("truth"), F.col("loss"))).alias("loss_truth"))


def recovery(spark, sf):
    lg, tv, _, sc = _loss_parts(spark, sf)
    return recovered(lg, tv, sc)


@query("recovery_errors", f"""{SQL_RC} SELECT scenario, count(*) AS n, {sg.rnd('avg(selected - truth)')} AS mean_error, {sg.rnd('stddev_samp(selected - truth) / sqrt(count(*))')} AS mean_error_mc_se, {sg.rnd('quantile_cont(CAST(selected - truth AS DOUBLE), 0.5)')} AS median_error,
 {sg.rnd('sqrt(avg(power(selected - truth, 2)))')} AS rmse, {sg.rnd('quantile_cont(CAST(selected - truth AS DOUBLE), 0.025)')} AS error_lo, {sg.rnd('quantile_cont(CAST(selected - truth AS DOUBLE), 0.975)')} AS error_hi, {sg.rnd('avg(CAST(selected IN (0, 4) AS DOUBLE))')} AS boundary_rate FROM rec GROUP BY scenario""")
def recovery_errors(spark, sf):
    return rr(ct.recovery_errors(recovery(spark, sf), ["scenario"], F.col("selected") - F.col("truth"), F.col("selected").isin(0, 4)), 9)


_PR = (("loss_selected", "loss_baseline"), ("loss_truth", "loss_baseline"), ("loss_selected", "loss_truth"))


@query("recovery_paired", f"{SQL_RC} " + " UNION ALL ".join(
    f"SELECT scenario, '{a} - {b}' AS comparison, count(*) AS n, {sg.rnd(f'avg({a} - {b})', 5)} AS paired_mean, {sg.rnd(f'stddev_samp({a} - {b}) / sqrt(count(*))', 5)} AS paired_mean_mc_se, {sg.rnd(f'quantile_cont({a} - {b}, 0.5)', 5)} AS paired_median, count(*) FILTER (WHERE {a} < {b}) AS n_better, count(*) FILTER (WHERE {a} = {b}) AS n_tied, count(*) FILTER (WHERE {a} > {b}) AS n_worse, {sg.rnd(f'quantile_cont({a}, 0.5) - quantile_cont({b}, 0.5)', 5)} AS difference_of_the_two_medians FROM rec GROUP BY scenario" for a, b in _PR))
def recovery_paired(spark, sf):
    return rr(ct.recovery_paired(recovery(spark, sf), ["scenario"], _PR), 5)


_HO = "(" + ", ".join(f"'{t}'" for t in ct.HELD_OUT) + ")"


@query("heldout_diagnostics", f"""{SQL_RC}, {_summary_sql()}, vs AS (SELECT period, scenario, entity, 'selected' AS version, selected AS candidate FROM rec UNION ALL SELECT period, scenario, entity, 'fixed_baseline', 0 FROM rec UNION ALL SELECT period, scenario, entity, 'true_shape', truth FROM rec),
h AS (SELECT v.scenario, l.statistic, v.version, s.sim_median - l.value AS e, l.value BETWEEN s.sim_lo AND s.sim_hi AS inside FROM vs v JOIN lg l ON l.period = v.period AND l.entity = v.entity JOIN sm s ON s.period = v.period AND s.scenario = v.scenario AND s.candidate = v.candidate AND s.statistic = l.statistic WHERE l.statistic IN {_HO} AND l.value IS NOT NULL)
SELECT scenario, statistic, version, count(*) AS n, count(*) FILTER (WHERE inside) AS n_inside, {sg.rnd('avg(e)', 7)} AS mean_raw_error, {sg.rnd('quantile_cont(e, 0.5)', 7)} AS median_raw_error, {sg.rnd('sqrt(avg(e * e))', 7)} AS rmse_raw FROM h GROUP BY scenario, statistic, version""")
def heldout_diagnostics(spark, sf):
    lg = long(spark, sf, ct.HELD_OUT)
    rec = recovery(spark, sf)
    ver = F.explode(F.array(*[F.struct(F.lit(n).alias("version"), c.cast("int").alias("candidate")) for n, c in (
        ("selected", F.col("selected")), ("fixed_baseline", F.lit(0)), ("true_shape", F.col("truth")))]))
    v = rec.select("period", "scenario", "entity", ver.alias("_v")).select("period", "scenario", "entity", "_v.*")
    real = lg.select("period", "scenario", "entity", "statistic", F.col("value").alias("real")).where(F.col("real").isNotNull())
    h = v.join(real, ["period", "scenario", "entity"]).join(small(ct.summarise(lg, CELL)), [*CELL, "statistic"])
    return rr(ct.heldout(h, ["scenario", "statistic", "version"]))


#: supplied analytic law: budget, sd of the realised rate, its mean
ANALYTIC = ((0.05, 0.11, 0.06), (0.15, 0.17, 0.16))


@query("replication_comparison", "WITH x AS (" + qc.ORACLES_REPL + f"""), a(far_target, analytic_sd, analytic_mean) AS (VALUES {', '.join(f'({f}::DOUBLE, {s}::DOUBLE, {m}::DOUBLE)' for f, s, m in ANALYTIC)})
SELECT x.method, far_target, x.n_replications, {sg.rnd('x.sd_far', 7)} AS sd_far, {sg.rnd('x.sd_far_se', 7)} AS sd_far_se, a.analytic_sd, {sg.rnd('(x.sd_far - a.analytic_sd) / nullif(x.sd_far_se, 0)', 5)} AS z_vs_analytic, {sg.rnd('x.mean_far', 7)} AS mean_far, a.analytic_mean FROM x JOIN a USING (far_target)""")
def replication_comparison(spark, sf):
    m = qc.minima(spark, sf).withColumn("replicate", F.col("entity") % 5)
    a = spark.createDataFrame(list(ANALYTIC), "far_target double, analytic_sd double, analytic_mean double")
    c = ct.compare_with_replications(a, cal.replication_study(m, CFG))
    return c.select("method", "far_target", "n_replications", *[F.round(x, 7).alias(x) for x in ("sd_far", "sd_far_se", "mean_far")], "analytic_sd",
                    F.round("z_vs_analytic", 5).alias("z_vs_analytic"), "analytic_mean")
