"""Exact order statistics, quantiles and dense ranks for unbounded groups.

`percentile` keeps every distinct value of a group in one aggregation buffer
and `row_number` sorts a whole group in one task. Both are fine when the group
is bounded (days inside one entity) and both fail when the group is the entity
population. The functions here split each group into value buckets using a
mergeable quantile sketch. The sketch only decides where the buckets are cut;
ranks come from exact counts, so the results are exact whatever the sketch says.
Equal values are collapsed to one weighted row first, so a mass of ties is
pre-aggregated map-side instead of landing in one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import staged

BUCKETS = 32

RankOf = Callable[[Column], Column]


def _bucketed(vc: DataFrame, keys: Sequence[str], value: str, weight: str, buckets: int) -> DataFrame:
    cuts = [i / buckets for i in range(1, buckets)]
    # the total is taken here as well, so this branch reads the same columns as
    # the others and Spark runs the pre-aggregation once (exchange reuse)
    edges = vc.groupBy(*keys).agg(
        F.percentile_approx(value, cuts, 20 * buckets).alias("_edges"), F.sum(weight).alias("_n"))
    # the cuts are written once: a sketch depends on the order in which its parts meet, and buckets
    # that are counted under one set of cuts and ranked under another give wrong ranks
    edges = staged(edges, "edges")
    # one row per group; AQE picks the join strategy from its measured size
    return vc.join(edges, list(keys)).withColumn(
        "_b", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")


def _bucket_totals(b: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return (b.groupBy(*keys, "_b").agg(F.sum(weight).alias("_bw"), F.first("_n").alias("_n"))
            .withColumn("_hi", F.sum("_bw").over(run))
            .withColumn("_lo", F.col("_hi") - F.col("_bw")))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     ranks: Mapping[str, RankOf], *, weight: str | None = None,
                     count_as: str = "n", buckets: int = BUCKETS) -> DataFrame:
    """One row per group: its size and the value at each 1-based rank.

    `ranks` maps an output column to a function of the group size. A weight
    column counts a row that many times (bootstrap multiplicities). Only the
    buckets that hold a wanted rank are sorted.
    """
    keys = list(keys)
    df = df.where(F.col(value).isNotNull())
    if not keys:
        df, keys, drop = df.withColumn("_all", F.lit(1)), ["_all"], True
    else:
        drop = False
    vc = df.groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).cast("bigint").alias("_w"))
    vc = vc.where("_w > 0") if weight else vc
    b = _bucketed(vc, keys, value, "_w", buckets)
    tot = _bucket_totals(b, keys, "_w")
    # ranks are evaluated on the bucket totals only: a few rows per group
    for name, fn in ranks.items():
        tot = tot.withColumn(f"_r_{name}", fn(F.col("_n")).cast("bigint"))
    rcols = [f"_r_{name}" for name in ranks]
    hit = F.lit(False)
    for k in rcols:
        hit = hit | F.coalesce((F.col(k) > F.col("_lo")) & (F.col(k) <= F.col("_hi")), F.lit(False))
    # the last bucket always stays, so a group without a valid rank keeps its row
    need = tot.where(hit | (F.col("_hi") == F.col("_n"))).select(*keys, "_b", "_lo", "_n", *rcols)
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0)
    c = b.drop("_n").join(need, keys + ["_b"]).withColumn("_c", F.col("_lo") + F.sum("_w").over(inside))
    out = c.groupBy(*keys).agg(
        F.first("_n").alias(count_as),
        *[F.min(F.when(F.col("_c") >= F.col(k), F.col(value))).alias(name)
          for name, k in zip(ranks, rcols)])
    return out.drop("_all") if drop else out


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *,
              weight: str | None = None, count_as: str = "n_values") -> DataFrame:
    """Exact linear-interpolation quantiles per group, one row per group."""
    ranks: dict[str, RankOf] = {}
    for name, p in probs.items():
        ranks[f"_l_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1
        ranks[f"_h_{name}"] = lambda n, p=p: F.least(F.floor((n - 1) * F.lit(p)) + 2, n)
    os_ = order_statistics(df, keys, value, ranks, weight=weight, count_as=count_as)
    outs = []
    for name, p in probs.items():
        h = (F.col(count_as) - 1) * F.lit(p)
        lo, hi = F.col(f"_l_{name}"), F.col(f"_h_{name}")
        outs.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return os_.select(*keys, count_as, *outs)


def dense_rank_rows(df: DataFrame, keys: Sequence[str], order: str, *, name: str = "rank",
                    buckets: int = BUCKETS) -> DataFrame:
    """1-based row number by a unique numeric column, split over buckets."""
    keys = list(keys)
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    b = _bucketed(one, keys, order, "_one", buckets)
    lo = _bucket_totals(b, keys, "_one").select(*keys, "_b", "_lo", F.col("_n").alias(f"{name}_n"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    return (b.drop("_n").join(lo, keys + ["_b"])
            .withColumn(name, (F.col("_lo") + F.row_number().over(inside)).cast("bigint"))
            .drop("_b", "_lo", "_one"))
