"""Metrics for entities that are valid first and fail later.

`fp` carries tau and the last valid day T (`t_last_valid`, NULL = never fails).
tau <= T is a false alarm; tau = T + 1 is a detection with delay one; an entity
that never alarms survives and stays in the denominators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import MonitorConfig
from tidewatch.functions.expr import ratio, wilson
from tidewatch.functions.ranking import quantiles
from tidewatch.operators.passage import NEVER, alarmed, median_day



def early() -> Column:
    """Alarm on a day the entity was still valid; NULL T means always valid."""
    return alarmed() & (F.col("t_last_valid").isNull() | (F.col("tau") <= F.col("t_last_valid")))


def caught(window: int) -> Column:
    t = F.col("t_last_valid")
    return F.coalesce(alarmed() & (F.col("tau") > t) & (F.col("tau") <= t + window), F.lit(False))


def _delay(window: int) -> Column:
    """Delay of a survivor, scored at the cap when undetected."""
    return F.when(caught(window), F.col("tau") - F.col("t_last_valid")).otherwise(window).cast("double")


def _median_delay(fp: DataFrame, group: Sequence[str], window: int) -> DataFrame:
    surv = fp.where(~early()).withColumn(
        "tau", F.when(caught(window), F.col("tau") - F.col("t_last_valid")).otherwise(NEVER))
    return median_day(surv, group, window, name="median_delay")


def switching_metrics(fp: DataFrame, group: Sequence[str], windows: Sequence[int], post: int,
                      first_eligible: Column | None = None) -> DataFrame:
    """Pre-failure alarms, conditional and unconditional detection, truncated delay."""
    surv = ~early()
    d = F.when(surv, _delay(post))
    finite = F.col("t_last_valid").isNotNull()
    usable = None
    if first_eligible is not None:
        tmin = F.coalesce(F.min("t_last_valid"), F.lit(0))
        usable = F.greatest(F.lit(0), tmin + post - F.greatest(F.max(first_eligible), tmin + 1) + 1)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.when(finite, F.col("t_last_valid"))).alias("mean_T"),
            F.count_if(early()).alias("n_pre"), F.count_if(surv).alias("n_survived"),
            *[F.count_if(surv & caught(h)).alias(f"n_detect_h{h}") for h in windows],
            F.count_if(surv & caught(post)).alias("_post"), F.avg(d).alias("trunc_delay"),
            (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("trunc_delay_se")]
    if usable is not None:
        aggs.append(usable.cast("int").alias("usable_post_days"))
    g = fp.groupBy(*group).agg(*aggs).join(_median_delay(fp, group, post), list(group), "left")
    n, s = F.col("n"), F.col("n_survived")
    share = ratio(F.col("_post"), s)
    return g.select(*group, "n", "mean_T", "n_pre", "n_survived",
                    *(["usable_post_days"] if usable is not None else []),
                    ratio(F.col("n_pre"), n).alias("pre_fa"), ratio(s, n).alias("survival"),
                    *[c for h in windows for c in (
                        F.col(f"n_detect_h{h}"), ratio(F.col(f"n_detect_h{h}"), s).alias(f"cond_detect_h{h}"),
                        ratio(F.col(f"n_detect_h{h}"), n).alias(f"uncond_detect_h{h}"))],
                    "trunc_delay", "trunc_delay_se", (1.0 - share).alias("undetected"),
                    F.when(share >= 0.5, F.col("median_delay")).alias("median_delay"))


def survival_metrics(fp: DataFrame, group: Sequence[str], windows: Sequence[int], cfg: MonitorConfig) -> DataFrame:
    """As above with intervals, joint = survival x conditional carried as a check."""
    cap = max(windows)
    surv = ~early()
    d = F.when(surv, _delay(cap))
    g = fp.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(early()).alias("n_pre"), F.count_if(surv).alias("n_survivors"),
        *[F.count_if(caught(h)).alias(f"_k{h}") for h in windows], F.avg(d).alias("mean_delay"),
        (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("mean_delay_se"))
    g = g.join(_median_delay(fp, group, cap), list(group), "left")
    n, s = F.col("n"), F.col("n_survivors")
    lo, hi = wilson(F.col("n_pre"), n, cfg.wilson_z)
    cols = [F.col(c) for c in (*group, "n", "n_pre", "n_survivors")] + [
        ratio(F.col("n_pre"), n).alias("pre_far"), lo.alias("pre_far_lo"), hi.alias("pre_far_hi"),
        ratio(s, n).alias("survival_rate")]
    for h in windows:
        k = F.col(f"_k{h}")
        joint, cond = ratio(k, n), ratio(k, s)
        jl, jh = wilson(k, n, cfg.wilson_z)
        cl, ch = wilson(k, s, cfg.wilson_z)
        cols += [joint.alias(f"joint_h{h}"), jl.alias(f"joint_h{h}_lo"), jh.alias(f"joint_h{h}_hi"),
                 cond.alias(f"cond_h{h}"), cl.alias(f"cond_h{h}_lo"), ch.alias(f"cond_h{h}_hi"),
                 F.abs(joint - ratio(s, n) * cond).alias(f"identity_gap_h{h}")]
    cols += [F.col("mean_delay"), F.col("mean_delay_se"), F.lit(cap).alias("delay_cap"),
             (1.0 - ratio(F.col(f"_k{cap}"), s)).alias("undetected"), F.col("median_delay")]
    return g.select(*cols)


def belief_table(u: DataFrame, group: Sequence[str]) -> DataFrame:
    """Evidence at the last valid day for all entities and for survivors."""
    pop = F.explode(F.when(F.col("survived"), F.array(F.lit("all"), F.lit("survived"))).otherwise(F.array(F.lit("all"))))
    long = u.select(*group, "u", "q", pop.alias("population"))
    keys = [*group, "population"]
    mean = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("mean_u"), F.avg("q").alias("mean_q"))
    qs = quantiles(long, keys, "u", {"u_q10": .1, "u_median": .5, "u_q90": .9})
    qq = quantiles(long, keys, "q", {"q_median": .5}, count_as="_n")
    return mean.join(qs.drop("n_values"), keys).join(qq.drop("_n"), keys)


def bin_failure_time(t: Column, edges: Sequence[int]) -> Column:
    """Label of the pre-declared interval holding T; values outside go to the end bins."""
    labels = [f"{lo}-{hi - 1}" for lo, hi in zip(edges, edges[1:])]
    idx = F.lit(0)
    for e in edges[1:-1]:
        idx = idx + F.when(t >= e, 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(x) for x in labels]), idx + 1)
