"""Large strata are split down a tree of cells: same distribution as drawing entity by entity, and few rows moved."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import MonitorConfig
from tidewatch.operators import resample as rs

CFG = MonitorConfig(horizon=60, window=20, report_days=(10, 60))


def minima(spark, n, scenarios=("s",), seed=3):
    """Two correlated methods; many ties."""
    rng = random.Random(seed)
    rows = []
    for scenario in scenarios:
        for role in rs.SALTS:
            for e in range(n):
                x = rng.gauss(-1 - 0.3 * (role == "test_invalid") - 0.1 * (scenario == "t"), 1)
                rows += [(scenario, role, e, "x", round(x, 3)), (scenario, role, e, "y", round(0.7 * x + rng.gauss(0, 0.6), 2))]
    return spark.createDataFrame(rows, "scenario string, path_set string, entity bigint, method string, min_stat double")


def matrix(df, keys):
    """Replicates by named rates; the plain sample apart."""
    rows = df.collect()
    names = sorted({tuple(r[k] for k in keys) for r in rows})
    reps = sorted({r["rep"] for r in rows})
    out = np.full((len(reps), len(names)), np.nan)
    for r in rows:
        out[reps.index(r["rep"]), names.index(tuple(r[k] for k in keys))] = r["rate"]
    return out[reps.index(-1)], out[[k for k, r in enumerate(reps) if r >= 0]]


@pytest.mark.parametrize("unified", [False, True])
def test_split_draws_have_the_distribution_of_direct_draws(spark, monkeypatch, unified):
    scenarios, cell = (("s", "t"), ["scenario"]) if unified else (("s",), [])
    df, reps = minima(spark, 1500, scenarios).cache(), 1500
    df = df if unified else df.drop("scenario")
    keys = [*cell, "path_set", "method", "far_target"]
    monkeypatch.setattr(rs, "BAND", 5.0)
    plain, direct = matrix(rs.bootstrap_rates(df, CFG, reps, cell, unified), keys)
    monkeypatch.setattr(rs, "LEAF", 100)
    plain2, tree = matrix(rs.bootstrap_rates(df, CFG, reps, cell, unified), keys)
    assert np.array_equal(plain, plain2) and not np.isnan(tree).any() and tree.shape == direct.shape
    error = direct.std(axis=0) / math.sqrt(reps)
    assert (np.abs(tree.mean(axis=0) - direct.mean(axis=0)) < 5 * error + 1e-12).all()
    a, b = np.cov(direct.T), np.cov(tree.T)
    scale = np.sqrt(np.outer(np.diag(a), np.diag(a)))
    assert (np.abs(a - b) < 0.16 * scale).all()  # sampling error of a covariance over 1,500 replicates, five sd
    assert not np.array_equal(tree[0], tree[1])


def test_cells_of_a_large_stratum(spark, monkeypatch):
    """Outside the bands entities merge; counts are kept; every replicate draws as many entities as there are."""
    monkeypatch.setattr(rs, "LEAF", 100)
    df = minima(spark, 6000).drop("scenario")
    sizes = rs.sizes_of(df, ["path_set"])
    lim = rs.bands(df.where("path_set = 'calibration_valid'"), ["path_set"], "method", "min_stat", CFG.far_targets, ["method"])
    got = rs.cells(df, ["path_set"], "method", "min_stat", sizes, lim, ["method"])
    total = {r["path_set"]: (r["n"], r["c"]) for r in got.groupBy("path_set").agg(F.sum("k").alias("n"), F.count("k").alias("c")).collect()}
    assert all(n == 6000 and c < 4000 for n, c in total.values())
    assert got.where("entity IS NOT NULL").count() == 0
    rng = rs.generator(1, 2, "x")
    counts = np.array([1] * 50 + [40, 7, 3])
    drawn = np.stack([rs.split(rng, 100, counts) for _ in range(4000)])
    assert (drawn.sum(axis=1) == 100).all() and np.abs(drawn.mean(axis=0) - counts).max() < 0.5
    assert np.array_equal(rs.split(rs.generator(7), 100, counts), rs.split(rs.generator(7), 100, counts))


def test_hashed_draws_are_the_same_in_both_forms(spark):
    n = F.lit(37).cast("bigint")
    got = [r["i"] for r in spark.range(37).orderBy("id").select(rs.draw_index(F.lit(11).cast("bigint"), F.col("id"), F.lit(3).cast("bigint"), n).alias("i")).collect()]
    assert got == rs.draw_indices(11, 3, 37).tolist()


def test_medians_rates_and_sums_of_large_strata(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("s", c, e, st, rng.gauss(c, 1) if e % 7 or st == "a" else None) for c in (0, 1) for e in range(900) for st in ("a", "b")]
    long = spark.createDataFrame(rows, "scenario string, candidate int, entity bigint, statistic string, value double").withColumn("period", F.lit("w")).cache()
    out = spark.createDataFrame([("s", e, m, rng.random() < 0.6, rng.random() < 0.3) for e in range(900) for m in ("x", "y")], "scenario string, entity bigint, method string, base boolean, hit boolean").cache()
    sums = spark.createDataFrame([(role, e, rng.gauss(0, 1), rng.gauss(1, 2)) for role in rs.SALTS for e in range(900)], "path_set string, entity bigint, a double, b double").cache()
    reps = 800

    def stats():
        med = rs.resampled_medians(long, ["scenario", "candidate"], ["period", "statistic"], reps, 5).groupBy("candidate", "statistic", "period")
        rate = rs.conditional_rates(out, ["scenario"], ["method"], reps, 7).where("rep >= 0").groupBy("method")
        total = rs.resampled_sums(sums, ["path_set"], ["a", "b"], reps).where("rep >= 0").groupBy("path_set")
        return {**{r[:3]: r[3:] for r in map(tuple, med.agg(F.avg("med"), F.stddev("med"), F.count("med")).collect())},
                **{r[:1]: r[1:] for r in map(tuple, rate.agg(F.avg("rate"), F.stddev("rate"), F.count("rate")).collect())},
                **{r[:1]: r[1:] for r in map(tuple, total.agg(F.avg("b"), F.stddev("b"), F.count("b")).collect())}}
    direct = stats()
    monkeypatch.setattr(rs, "LEAF", 50)
    monkeypatch.setattr(rs, "BLOCKS", 16)
    tree = stats()
    assert direct.keys() == tree.keys() and len(tree) == 4 + 2 + 3
    for k, (mean, sd, n) in direct.items():
        assert tree[k][2] == n == reps and abs(tree[k][0] - mean) < 6 * sd / math.sqrt(reps) and tree[k][1] == pytest.approx(sd, rel=0.2)


def test_resampled_sums_make_their_rows_once(spark):
    """strata, blocks and draws read one written copy; what made the rows runs once for each of them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        made.add(1)
        return float(x)
    n = rs.LEAF + 10
    rows = spark.range(n).select(F.lit("test_valid").alias("path_set"), F.col("id").alias("entity"), costly("id").alias("a"))
    got = {r.rep: (r.n, r.a) for r in rs.resampled_sums(rows, ["path_set"], ["a"], 3).collect()}
    assert got[-1] == (n, n * (n - 1) / 2) and {k: v[0] for k, v in got.items()} == {k: n for k in range(-1, 3)}
    assert made.value <= n


def test_sums_of_large_strata_take_the_draws_of_the_sql(spark, monkeypatch):
    """beyond LEAF too an entity is drawn from the hash that the SQL repeats, also in several pieces; few rows do not make the work one task."""
    monkeypatch.setattr(rs, "MATRIX", 3000)
    monkeypatch.setattr(rs, "DRAWS", 1000, raising=False)
    n, reps = rs.LEAF + 300, 5
    values = np.random.default_rng(6).normal(size=(2, n))
    order = random.Random(2).sample(range(n), n)
    rows = [(role, 3 * e + 1, *map(float, values[:, e])) for role in ("test_valid", "test_invalid") for e in order]
    sums = rs.resampled_sums(spark.createDataFrame(rows, "path_set string, entity bigint, a double, b double"), ["path_set"], ["a", "b"], reps)
    got = {(r.path_set, r.rep): r for r in sums.collect()}
    assert len(got) == 2 * (reps + 1)
    for (role, rep), r in got.items():
        at = np.arange(n) if rep < 0 else rs.draw_indices(rep, rs.SALTS[role], n)
        assert r.n == n and (r.a, r.b) == pytest.approx(tuple(values[:, at].sum(axis=1)), abs=1e-9)
    assert f", {2 * 2 * 3}), REPARTITION_BY_NUM" in sums._jdf.queryExecution().executedPlan().toString()  # strata, blocks of replicates, pieces
