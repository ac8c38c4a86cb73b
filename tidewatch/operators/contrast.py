"""Observed series against candidate ensembles: targets, losses, selection, summaries.

Ensembles arrive as long tables of path statistics (keys, candidate, path,
statistic, value). Quantiles across paths are the distributed ones, because the
number of paths is not bounded; tables keyed by candidate are joined without a
hint unless the caller's parameters bound them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import ratio
from tidewatch.functions.ranking import dense_rank_rows, quantiles
from tidewatch.functions.small import small

# fixed values: the fitted statistics and the ones held out of the objective
RV_TARGETS = ("rv21_q10", "rv21_q50", "rv21_q90")
ACF_TARGETS = ("acf_absret_lag1", "acf_absret_lag5", "acf_absret_lag10", "acf_absret_lag21", "acf_absret_lag63")
TARGETS = RV_TARGETS + ACF_TARGETS
HELD_OUT = ("tail_below_m3_count", "tail_above_p3_count", "acf_ret_lag1", "excess_kurtosis", "concentration_max_exceed_63d")
SCALE_FLOOR = 1e-4
MEDIAN_SE = 1.2533
UNCHANGED = 0.02


def expressed(value: Column, statistic: Column) -> Column:
    """Volatility targets in logs, autocorrelations as they are."""
    return F.when(statistic.isin(*RV_TARGETS), F.ln(value)).otherwise(value)


def target_values(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median over paths per target, in its declared expression."""
    t = long.where(F.col("statistic").isin(*TARGETS))
    q = quantiles(t, [*keys, "statistic"], "value", {"med": .5}, count_as="n_paths")
    return q.select(*keys, "statistic", expressed(F.col("med"), F.col("statistic")).alias("target"))


def observed_targets(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = long.where(F.col("statistic").isin(*TARGETS))
    return t.select(*keys, "statistic", expressed(F.col("value"), F.col("statistic")).alias("real"))


def standardising_scales(baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Across-path sd of each target under the baseline, floored, the floor recorded."""
    t = baseline.where(F.col("statistic").isin(*TARGETS))
    g = t.groupBy(*keys, "statistic").agg(F.stddev_samp(expressed(F.col("value"), F.col("statistic"))).alias("_s"))
    return g.select(*keys, "statistic", F.greatest("_s", F.lit(SCALE_FLOOR)).alias("scale"), (F.col("_s") < SCALE_FLOOR).alias("floored"))


def loss_terms(sim: DataFrame, real: DataFrame, scales: DataFrame, on: Sequence[str]) -> DataFrame:
    k = [*on, "statistic"]
    j = sim.join(real, k).join(scales.select(*k, "scale"), k)
    return j.withColumn("term", F.pow((F.col("target") - F.col("real")) / F.col("scale"), F.lit(2.0)))


def loss(terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two groups with equal weight, each normalised by its own count."""
    rv, acf = F.col("statistic").isin(*RV_TARGETS), F.col("statistic").isin(*ACF_TARGETS)
    g = terms.groupBy(*keys).agg(F.avg(F.when(rv, F.col("term"))).alias("rv21_component"), F.avg(F.when(acf, F.col("term"))).alias("acf_abs_component"))
    return g.withColumn("loss", 0.5 * F.col("rv21_component") + 0.5 * F.col("acf_abs_component"))


def summarise(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, 2.5 and 97.5 percentiles across paths and the precision of the median."""
    k = [*keys, "statistic"]
    q = quantiles(long, k, "value", {"sim_median": .5, "sim_lo": .025, "sim_hi": .975}, count_as="n_paths")
    sd = long.groupBy(*k).agg((F.stddev_samp("value") * MEDIAN_SE / F.sqrt(F.count("value"))).alias("sim_median_mc_se"))
    return q.join(sd, k)


def inside_range(summary: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Blank, not false, where there is no observed counterpart."""
    j = summary.join(observed.withColumnRenamed("value", "real"), [*on, "statistic"], "left")
    return j.withColumn("inside", F.when(F.col("real").isNotNull(), F.col("real").between(F.col("sim_lo"), F.col("sim_hi"))))


def comparison_type(statistic: Column) -> Column:
    return (F.when(statistic == "w1_sim_vs_sim_reference", "simulation only").when(statistic.startswith("w1_"), "distance")
            .when(statistic.endswith("_over_sd"), "shape within path").otherwise("range"))


# fixed values: diagnostic groups of statistics
GROUPS = {
    "volatility": ("sd_daily", "rv21_q10", "rv21_q50", "rv21_q90"),
    "tails": ("skewness", "excess_kurtosis", "tail_below_m3_count", "tail_above_p3_count", "concentration_max_exceed_63d"),
    "dependence": ("acf_ret_lag1", "acf_absret_lag1", "acf_absret_lag5", "acf_absret_lag21", "acf_sqret_lag1"),
    "asymmetry": tuple(f"leadlag_ret_vs_future_sq_lag{h}" for h in (1, 5, 21)),
}
W1_OBS, W1_REF = "w1_vs_market_standardised", "w1_sim_vs_sim_reference"


def gap_overview(contrast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage per diagnostic group plus one row with the distance ratio."""
    group = None
    for name, stats in GROUPS.items():
        c = F.col("statistic").isin(*stats)
        group = F.when(c, name) if group is None else group.when(c, name)
    g = contrast.withColumn("group", group).where(F.col("group").isNotNull()).groupBy(*keys, "group").agg(
        F.count(F.lit(1)).alias("statistics"), F.count_if(F.coalesce("inside", F.lit(False))).alias("n_inside"))
    g = g.withColumn("coverage", ratio(F.col("n_inside"), F.col("statistics"))).withColumn("w1_ratio", F.lit(None).cast("double"))
    w = contrast.where(F.col("statistic").isin(W1_OBS, W1_REF)).groupBy(*keys).agg(
        F.max(F.when(F.col("statistic") == W1_OBS, F.col("sim_median"))).alias("_o"), F.max(F.when(F.col("statistic") == W1_REF, F.col("sim_median"))).alias("_r"))
    # a reference of zero (every pair holds equal series) gives the ratio that division of doubles gives
    over_zero = F.when(F.col("_o") > 0, F.lit(float("inf"))).when(F.col("_o") == 0, F.lit(float("nan")))
    w1_ratio = F.when(F.col("_r") == 0, over_zero).otherwise(ratio(F.col("_o"), F.col("_r")))
    w = w.select(*keys, F.lit("distance / own reference").alias("group"), F.lit(1).cast("bigint").alias("statistics"),
                 F.lit(None).cast("bigint").alias("n_inside"), F.lit(None).cast("double").alias("coverage"), w1_ratio.alias("w1_ratio"))
    return g.unionByName(w)


def gap_table(contrast: DataFrame, index: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    return contrast.groupBy(*index).pivot(column, list(values)).agg(
        F.max("sim_median").alias("median"), F.max("sim_lo").alias("lo"), F.max("sim_hi").alias("hi"), F.max("inside").alias("inside"))


def screen(losses: DataFrame, keys: Sequence[str], best: int, baseline: Column) -> DataFrame:
    """The best N cells per branch and always the baseline."""
    w = Window.partitionBy(*keys).orderBy("loss", "candidate")
    r = losses.withColumn("rank", F.row_number().over(w)).withColumn("is_baseline", baseline)
    return r.where((F.col("rank") <= best) | F.col("is_baseline"))


def loss_error(medians: DataFrame, real: DataFrame, scales: DataFrame, cell: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Monte-Carlo error of a loss: its sd over ensembles resampled as a whole (`medians`: cell, statistic, rep, med)."""
    k = [*cell, "rep"]
    t = medians.select(*k, "statistic", expressed(F.col("med"), F.col("statistic")).alias("target"))
    lo = loss(loss_terms(t, real, scales, on), k)
    return lo.groupBy(*cell).agg(F.count("loss").alias("n_reps"), F.stddev_samp("loss").alias("loss_mc_se"))


def select_candidate(finalists: DataFrame, keys: Sequence[str], edges: Sequence[int]) -> DataFrame:
    """Argmin of the loss, how many lie within its Monte-Carlo error, edge flag."""
    best = F.min_by(F.struct("candidate", "loss", "loss_mc_se"), F.struct("loss", "candidate")).over(Window.partitionBy(*keys))
    f = finalists.withColumn("_b", best)
    g = f.groupBy(*keys).agg(F.first("_b").alias("_b"), F.count(F.lit(1)).alias("n_finalists"),
                             F.count_if(F.col("loss") <= F.col("_b.loss") + F.col("_b.loss_mc_se")).alias("n_within_one_mc_se"))
    return g.select(*keys, F.col("_b.candidate").alias("selected"), F.col("_b.loss").alias("loss"), F.col("_b.loss_mc_se").alias("loss_mc_se"),
                    "n_finalists", "n_within_one_mc_se", F.col("_b.candidate").isin(*edges).alias("on_grid_boundary"))


def evaluate_frozen(selection: DataFrame, sim: DataFrame, real: DataFrame, scales: DataFrame, keys: Sequence[str], baseline: int,
                    medians: DataFrame | None = None) -> DataFrame:
    """Loss in an evaluation year of what its calibration window had fixed: candidate and scales.

    `selection` and `scales` are keyed by calibration window (`keys`), `sim` and `real` hold the
    statistics formed inside the evaluation year under the same keys. With `medians` of the
    year's resampled ensembles the Monte-Carlo error of each loss comes along.
    """
    pick = F.explode(F.array(F.struct(F.lit("recalibrated").alias("method"), F.col("selected").alias("candidate")),
                             F.struct(F.lit("fixed_baseline").alias("method"), F.lit(baseline).alias("candidate")))).alias("_p")
    frozen = selection.select(*keys, pick).select(*keys, "_p.*")
    cell = [*keys, "method", "candidate"]
    out = loss(loss_terms(sim.join(frozen, [*keys, "candidate"]), real, scales, keys), cell)
    if medians is None:
        return out
    return out.join(loss_error(medians.join(frozen, [*keys, "candidate"]), real, scales, cell, keys).drop("n_reps"), cell)


#: what the walk-forward table shows of each method
COMPARED = ("loss", "rv21_component", "acf_abs_component", "loss_mc_se")


def walk_forward_results(evals: DataFrame, keys: Sequence[str], calibrations: DataFrame) -> DataFrame:
    """Recalibrated against fixed baseline per cell, whether it helped, and the calibration that chose it."""
    p = evals.groupBy(*keys).agg(*[F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c}_{m}") for m in ("recalibrated", "fixed_baseline") for c in COMPARED])
    d = F.col("loss_recalibrated") - F.col("loss_fixed_baseline")
    return p.withColumn("loss_difference", d).withColumn("recalibration_helped", d < 0).join(calibrations, list(keys), "left")


def walk_forward_summary(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean loss difference and cells won."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("loss_difference").alias("mean_difference"), F.count_if("recalibration_helped").alias("n_helped"))


def coverage(contrast: DataFrame, keys: Sequence[str]) -> DataFrame:
    return contrast.groupBy(*keys, "statistic").agg(F.count("inside").alias("n"), F.avg(F.col("inside").cast("double")).alias("coverage"))


def centre_error_change(contrast: DataFrame, keys: Sequence[str], baseline: Column, selected: Column) -> DataFrame:
    """Distance of the median from the observed value in range widths, selected minus baseline."""
    width = F.col("sim_hi") - F.col("sim_lo")
    e = contrast.where(~F.col("statistic").isin(*TARGETS) & F.col("real").isNotNull() & (width > 0)).withColumn(
        "_e", F.abs(F.col("sim_median") - F.col("real")) / width)
    g = e.groupBy(*keys, "statistic").agg(F.max(F.when(baseline, F.col("_e"))).alias("baseline_error"), F.max(F.when(selected, F.col("_e"))).alias("selected_error"))
    g = g.where(F.col("baseline_error").isNotNull() & F.col("selected_error").isNotNull()).withColumn("change", F.col("selected_error") - F.col("baseline_error"))
    return g.withColumn("verdict", F.when(F.col("change") > UNCHANGED, "worse").when(F.col("change") < -UNCHANGED, "better").otherwise("unchanged"))


def flipped(contrast: DataFrame, keys: Sequence[str], setting: str, a: str, b: str) -> DataFrame:
    """Statistics whose verdict differs between two settings."""
    p = contrast.where(F.col("inside").isNotNull()).groupBy(*keys, "statistic").agg(
        F.max(F.when(F.col(setting) == a, F.col("inside"))).alias("inside_a"), F.max(F.when(F.col(setting) == b, F.col("inside"))).alias("inside_b"))
    return p.where(F.col("inside_a") != F.col("inside_b"))


def stat_vectors(long: DataFrame, scales: DataFrame, keys: Sequence[str], path: Sequence[str]) -> DataFrame:
    """Scaled vector of the eight fitted statistics, in target order."""
    t = long.where(F.col("statistic").isin(*TARGETS)).join(scales, [*keys, "statistic"])
    x = expressed(F.col("value"), F.col("statistic")) / F.col("scale")
    return t.groupBy(*path).agg(F.array(*[F.max(F.when(F.col("statistic") == s, x)) for s in TARGETS]).alias("v"))


def _norm(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def energy_score(vectors: DataFrame, observed: DataFrame, group: Sequence[str], on: Sequence[str], path: str = "entity") -> DataFrame:
    """mean|X - y| - mean|X - X'|/2 with X and X' from two halves; no pairwise matrix."""
    idx = dense_rank_rows(vectors, group, path, name="idx")
    half = F.floor(F.col("idx_n") / 2)
    a = idx.where(F.col("idx") <= half).select(*group, F.col("idx").alias("pair"), F.col("v").alias("a"))
    b = idx.where((F.col("idx") > half) & (F.col("idx") <= 2 * half)).select(*group, (F.col("idx") - half).alias("pair"), F.col("v").alias("b"))
    j = a.join(b, [*group, "pair"]).join(observed.withColumnRenamed("v", "y"), list(on))
    return j.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pairs"), (F.avg(_norm("a", "y")) - 0.5 * F.avg(_norm("a", "b"))).alias("energy_score"))


def recovery_errors(rec: DataFrame, keys: Sequence[str], error: Column, boundary: Column) -> DataFrame:
    """Selected minus truth over replicates."""
    d = rec.select(*keys, error.cast("double").alias("e"), boundary.alias("b"))
    g = d.groupBy(*keys).agg(F.count("e").alias("n"), F.avg("e").alias("mean_error"), (F.stddev_samp("e") / F.sqrt(F.count("e"))).alias("mean_error_mc_se"),
                             F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.col("b").cast("double")).alias("boundary_rate"))
    q = quantiles(d, keys, "e", {"median_error": .5, "error_lo": .025, "error_hi": .975})
    return g.join(q.drop("n_values"), list(keys))


def recovery_paired(rec: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Paired differences per replicate, and the difference of the two medians beside them."""
    cells = F.explode(F.array(*[F.struct(F.lit(f"{a} - {b}").alias("comparison"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))
    d = rec.select(*keys, cells.alias("_c")).select(*keys, "_c.*").withColumn("d", F.col("a") - F.col("b"))
    k = [*keys, "comparison"]
    g = d.groupBy(*k).agg(F.count("d").alias("n"), F.avg("d").alias("paired_mean"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("paired_mean_mc_se"),
                          F.count_if(F.col("d") < 0).alias("n_better"), F.count_if(F.col("d") == 0).alias("n_tied"), F.count_if(F.col("d") > 0).alias("n_worse"))
    m = d.select(*k, F.explode(F.array(*[F.struct(F.lit(c).alias("w"), F.col(c).alias("v")) for c in ("a", "b", "d")])).alias("_c")).select(*k, "_c.*")
    q = quantiles(m, [*k, "w"], "v", {"med": .5}).groupBy(*k).agg(*[F.max(F.when(F.col("w") == c, F.col("med"))).alias(f"_{c}") for c in ("a", "b", "d")])
    return g.join(q, k).withColumn("paired_median", F.col("_d")).withColumn("difference_of_the_two_medians", F.col("_a") - F.col("_b")).drop("_a", "_b", "_d")


def heldout(rec: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rec` has real, sim_median, sim_lo, sim_hi per replicate, statistic and version."""
    e = rec.withColumn("e", F.col("sim_median") - F.col("real"))
    g = e.groupBy(*keys).agg(F.count("e").alias("n"), F.count_if(F.col("real").between(F.col("sim_lo"), F.col("sim_hi"))).alias("n_inside"),
                             F.avg("e").alias("mean_raw_error"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse_raw"))
    q = quantiles(e, keys, "e", {"median_raw_error": .5}).drop("n_values")
    return g.join(q, list(keys))


def selection_stability(rec: DataFrame, keys: Sequence[str], delta: Column) -> DataFrame:
    return rec.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seed_sets"), F.countDistinct("selected").alias("n_distinct_selections"),
                                  F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"))


def compare_with_replications(analytic: DataFrame, rep: DataFrame) -> DataFrame:
    """z of the simulated against the analytic sd; unmatched keys are refused."""
    j = rep.join(small(analytic), "far_target", "left")
    sd = F.when(F.col("analytic_sd").isNull(), F.raise_error(F.lit("replications carry a budget the analytic table lacks")).cast("double")).otherwise(F.col("analytic_sd"))
    se = F.col("sd_far") / F.sqrt(2.0 * (F.col("n_replications") - 1))
    return j.select("method", "far_target", "n_replications", "sd_far", se.alias("sd_far_se"), sd.alias("analytic_sd"),
                    ((F.col("sd_far") - sd) / F.nullif(se, F.lit(0.0))).alias("z_vs_analytic"), "mean_far", "analytic_mean")
