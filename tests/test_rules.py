"""Hand-row cases and protocol rules."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import MonitorConfig
from tidewatch.functions.expr import pair_corr, wilson
from tidewatch.functions.ranking import dense_rank_rows, order_statistics, quantiles
from tidewatch.operators import calendar as cl
from tidewatch.operators import calibrate as cal
from tidewatch.operators import evidence as ev
from tidewatch.operators import passage as pa
from tidewatch.operators import returns as rt
from tidewatch.operators import survival as sv

CFG = MonitorConfig(horizon=60, window=20, report_days=(10, 60))


def make_panel(spark, n=6, days=60, seed=3, roles=("calibration_valid", "test_valid", "test_invalid")):
    rng = random.Random(seed)
    rows = [("s", roles[e % len(roles)], e, d, rng.gauss(0, 0.006)) for e in range(n) for d in range(1, days + 1)]
    return spark.createDataFrame(rows, "scenario string, path_set string, entity bigint, day int, ret double")


def fp_rows(spark, taus, t):
    return spark.createDataFrame([("s", "test_invalid", i, "m", 0.1, -1.0, tau, t) for i, tau in enumerate(taus)],
                                 "scenario string, path_set string, entity bigint, method string, far_target double, threshold double, tau int, t_last_valid int")


def test_exact_ranks_with_ties_and_skew(spark):
    rng = random.Random(1)
    vals = [("a", rng.choice([0.0, 1.0, rng.random()])) for _ in range(3000)] + [("b", rng.gauss(0, 1e6)) for _ in range(50)] + [("c", 5.0)]
    df = spark.createDataFrame(vals, "k string, v double")
    got = {r["k"]: r for r in order_statistics(df, ["k"], "v", {"r1": lambda n: F.lit(1), "mid": lambda n: F.floor(n / 2) + 1}).collect()}
    q = {r["k"]: r for r in quantiles(df, ["k"], "v", {"p10": .1, "p50": .5, "p975": .975}).collect()}
    for k in "abc":
        x = sorted(v for kk, v in vals if kk == k)
        assert got[k]["n"] == len(x) and got[k]["r1"] == x[0] and got[k]["mid"] == x[len(x) // 2]
        for name, p in (("p10", 10), ("p50", 50), ("p975", 97.5)):
            assert q[k][name] == pytest.approx(np.percentile(x, p), rel=1e-12, abs=1e-15)


def test_weighted_order_statistic(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 0), (3.0, 2), (4.0, 1)], "v double, w bigint")
    r = order_statistics(df, [], "v", {f"r{i}": (lambda n, i=i: F.lit(i)) for i in range(1, 7)}, weight="w").collect()[0]
    assert [r[f"r{i}"] for i in range(1, 7)] == [1.0, 1.0, 1.0, 3.0, 3.0, 4.0] and r["n"] == 6


def test_dense_rank_is_a_permutation(spark):
    df = spark.createDataFrame([(i % 2, i * 7 % 1009) for i in range(1009)], "g int, e bigint")
    rows = dense_rank_rows(df, ["g"], "e").collect()
    for g in (0, 1):
        s = sorted((r["e"], r["rank"]) for r in rows if r["g"] == g)
        assert [x for _, x in s] == list(range(1, len(s) + 1))


def test_wilson_ends_and_constant_correlation(spark):
    lo, hi = wilson(F.col("k"), F.col("n"), CFG.wilson_z)
    rows = spark.createDataFrame([(0, 10), (10, 10), (0, 0)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0]["lo"] == 0.0 and rows[1]["hi"] == 1.0 and rows[2]["lo"] is None
    c = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double").agg(pair_corr(F.col("a"), F.col("b")).alias("c")).collect()
    assert c[0]["c"] is None


def test_causality(spark):
    p = make_panel(spark)
    bent = p.withColumn("ret", F.when(F.col("day") >= 40, F.col("ret") * 9 + 0.02).otherwise(F.col("ret")))
    cut = 40
    for methods in (ev.ALL_METHODS,):
        a = ev.wide_statistics(p, methods, CFG).where(F.col("day") < cut)
        b = ev.wide_statistics(bent, methods, CFG).where(F.col("day") < cut)
        assert a.exceptAll(b).count() == 0
    # the day's own return never enters its own variance
    va = ev.with_ewma_variance(p, CFG).where(F.col("day") <= cut).select("entity", "day", "v_ewma")
    vb = ev.with_ewma_variance(bent, CFG).where(F.col("day") <= cut).select("entity", "day", "v_ewma")
    assert va.exceptAll(vb).count() == 0


def test_variance_degenerate_cases(spark):
    p = make_panel(spark, n=2)
    flat = ev.with_ewma_variance(p, CFG.with_(ewma_lambda=1.0)).select("v_ewma").distinct().collect()
    assert len(flat) == 1 and flat[0][0] == pytest.approx(CFG.sigma_daily ** 2)
    wide = CFG.with_(truncation_c=1e9)
    j = ev.with_ewma_variance(ev.with_truncated_variance(p, wide), wide)
    assert j.where(F.abs(F.col("v_ewma") / F.col("v_trunc") - 1) > 1e-12).count() == 0
    # both forms equal the recursion carried from day to day
    rows = ev.with_truncated_variance(ev.with_ewma_variance(p, CFG, name="a"), CFG, name="b").orderBy("entity", "day").collect()
    lam, m, s2, cap = CFG.ewma_lambda, CFG.midpoint, CFG.sigma_daily ** 2, CFG.truncation_c ** 2
    for r in rows:
        if r["day"] == 1:
            a = b = s2
        assert r["a"] == pytest.approx(a, rel=1e-12) and r["b"] == pytest.approx(b, rel=1e-12)
        e2 = (r["ret"] - m) ** 2
        a, b = lam * a + (1 - lam) * e2, lam * b + (1 - lam) * min(e2, cap * b)


def test_rolling_matches_direct_window(spark):
    p = make_panel(spark, n=1)
    r = [x["ret"] for x in p.orderBy("day").collect()]
    rows = ev.wide_statistics(p, ["trailing_sharpe"], CFG).orderBy("day").collect()
    for i, row in enumerate(rows):
        if i < CFG.window - 1:
            assert row["trailing_sharpe"] is None
        else:
            w = np.array(r[i - CFG.window + 1:i + 1])
            assert row["trailing_sharpe"] == pytest.approx(math.sqrt(252) * w.mean() / w.std(ddof=1), rel=1e-9)


def test_unknown_method_and_undefined_statistic(spark):
    with pytest.raises(ValueError):
        ev.resolve(["nope"])
    bad = make_panel(spark, n=1).withColumn("ret", F.when(F.col("day") == 5, F.lit(float("nan"))).otherwise(F.col("ret")))
    with pytest.raises(Exception, match="undefined"):
        ev.record_lows(bad, ["binary_gaussian"], CFG).collect()


def test_ledger_equals_daily_scan(spark):
    p = make_panel(spark, n=9)
    lows = ev.record_lows(p, ["binary_gaussian", "known_vol_rolling"], CFG)
    thr = spark.createDataFrame([("binary_gaussian", 0.1, -0.05), ("known_vol_rolling", 0.1, -0.4)], "method string, far_target double, threshold double")
    got = {(r["entity"], r["method"]): r["tau"] for r in pa.first_passage(lows, thr, ["method"]).collect()}
    s = ev.long_statistics(p, ["binary_gaussian", "known_vol_rolling"], CFG).join(thr, "method")
    want = {(r["entity"], r["method"]): r["t"] for r in s.groupBy("entity", "method").agg(
        F.coalesce(F.min(F.when(F.col("stat") < F.col("threshold"), F.col("day"))), F.lit(-1)).alias("t")).collect()}
    assert got == want


def test_alarm_is_strict_and_budget_holds(spark):
    m = spark.createDataFrame([("s", "calibration_valid", i, "m", float(v)) for i, v in enumerate([1, 2, 2, 2, 3, 4, 5, 6, 7, 8])],
                              "scenario string, path_set string, entity bigint, method string, min_stat double")
    t = cal.with_achieved_rate(cal.thresholds(m, CFG.with_(far_targets=(0.3,))), m).collect()[0]
    assert t["threshold"] == 2.0 and t["rank"] == 4 and t["n_alarms"] == 1 and t["achieved_far"] <= 0.3


def test_buffered_rank_two_routes():
    for n, a, d in ((34, .15, .25), (1000, .05, .01), (10000, .15, .0003)):
        k = cal.buffered_rank(n, a, d)

        def cdf(j):
            return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log1p(-a)) for i in range(j + 1))
        assert cdf(k - 1) <= d < cdf(k)
    assert cal.buffered_rank(10, .05, .01) is None


def test_survivor_bookkeeping(spark):
    m = sv.survival_metrics(fp_rows(spark, [-1, -1, 5, 300], 100), ["method"], (63, 126, 252), CFG).collect()[0]
    assert m["n_pre"] == 1 and m["n_survivors"] == 3
    assert m["joint_h252"] == pytest.approx(1 / 4) and m["cond_h252"] == pytest.approx(1 / 3) and m["identity_gap_h252"] < 1e-12
    m = sv.survival_metrics(fp_rows(spark, [100, 101], 100), ["method"], (252,), CFG).collect()[0]
    assert m["n_pre"] == 1 and m["mean_delay"] == 1.0
    m = sv.survival_metrics(fp_rows(spark, [-1, 110], 100), ["method"], (252,), CFG).collect()[0]
    assert m["mean_delay"] == (252 + 10) / 2
    m = sv.survival_metrics(fp_rows(spark, list(range(101, 161)) + [-1] * 40, 100), ["method"], (252,), CFG).collect()[0]
    assert m["median_delay"] == 50
    none = sv.switching_metrics(fp_rows(spark, [5, -1], None), ["method"], (10,), 20).collect()[0]
    assert none["n_pre"] == 1 and none["n_survived"] == 1


def test_event_class_priority(spark):
    p = spark.createDataFrame([("s", "test_valid", 1, d, 0.0, e) for d, e in zip(range(1, 6), [0, 1, 0, 1, 0])],
                              "scenario string, path_set string, entity bigint, day int, ret double, event_count int")
    fp = spark.createDataFrame([("s", "test_valid", 1, m, 0.1, 0.0, t) for m, t in (("on", 4), ("after", 3), ("before", 1), ("none", -1))],
                               "scenario string, path_set string, entity bigint, method string, far_target double, threshold double, tau int")
    got = {r["method"]: r["event_class"] for r in pa.event_classes(fp, p, 20).collect()}
    assert got == {"on": 1, "after": 2, "before": 3, "none": 0}


def test_calendar_goldens(spark):
    c = {(r["calendar"], r["date"]): r for r in cl.trading_calendar(spark, "2017-01-01", "2024-12-31").collect()}

    def shut(k, y, m, d):
        return c[(k, dt.date(y, m, d))]["name"] is not None
    assert shut("nyse", 2019, 4, 19) and shut("nyse", 2024, 3, 29) and shut("nyse", 2022, 6, 20) and not shut("nyse", 2021, 6, 18)
    assert not shut("nyse", 2021, 12, 31) and shut("nyse", 2018, 12, 5) and shut("nyse", 2017, 1, 2)
    assert shut("jpx", 2020, 7, 23) and not shut("jpx", 2020, 7, 20) and shut("jpx", 2019, 5, 6) and shut("jpx", 2018, 9, 24)
    assert not c[("jpx", dt.date(2024, 1, 4))]["covered"]
    # 252 open days in 2018 after the extra closure is taken out
    assert c[("nyse", dt.date(2018, 12, 31))]["ordinal"] - c[("nyse", dt.date(2017, 12, 31))]["ordinal"] == 251


def _levels(spark, rows):
    return spark.createDataFrame([("a", "nyse", dt.date.fromisoformat(d), v) for d, v in rows], "asset string, calendar string, date date, value double")


def test_return_boundaries(spark):
    cal_ = cl.trading_calendar(spark, "2016-01-01", "2021-12-31")
    rows = [("2016-12-29", 100.0), ("2016-12-30", 101.0), ("2017-01-03", 102.0), ("2017-01-04", 103.0), ("2017-01-05", 104.0)]
    r = rt.returns_from_prices(_levels(spark, rows), cal_, "2017-01-01", "2017-12-31").orderBy("date").collect()
    assert r[0]["date"] == dt.date(2017, 1, 3) and r[0]["prev_date"] == dt.date(2016, 12, 30) and r[0]["ret"] == pytest.approx(102 / 101 - 1)
    gap = _levels(spark, [x for x in rows if x[0] != "2017-01-04"])
    flagged = rt.returns_from_prices(gap, cal_, "2017-01-01", "2017-12-31").orderBy("date").collect()
    assert flagged[-1]["gap_trading_days"] == 2 and flagged[-1]["spans_missing_day"]
    assert rt.returns_from_prices(gap, cal_, "2017-01-01", "2017-12-31", on_missing_day="drop").count() == 1
    with pytest.raises(Exception, match="unreported"):
        rt.returns_from_prices(gap, cal_, "2017-01-01", "2017-12-31", on_missing_day="raise").collect()
    closed = _levels(spark, rows + [("2017-01-02", 999.0)])
    assert rt.returns_from_prices(closed, cal_, "2017-01-01", "2017-12-31").orderBy("date").collect()[0]["ret"] == pytest.approx(102 / 101 - 1)
    hol = rt.simple_returns(rt.clean_prices(_levels(spark, [("2020-12-24", 1.0), ("2020-12-25", None), ("2020-12-28", 1.1)]), cal_, "2020-12-01", "2020-12-31"), cal_).collect()
    assert len(hol) == 1 and hol[0]["gap_trading_days"] == 1
    with pytest.raises(ValueError):
        rt.walk_forward_windows(spark, [2024], "2017-01-01", "2023-12-31")


def test_cleaning_defects(spark):
    cal_ = cl.trading_calendar(spark, "2021-01-01", "2021-12-31")
    rows = [("2021-03-01", 1.0), ("2021-03-01", 1.0), ("2021-03-02", -1.0), ("2021-03-04", None), ("2021-03-03", 2.0)]
    raw = spark.createDataFrame([("a", "nyse", dt.date.fromisoformat(d), v, i) for i, (d, v) in enumerate(rows)],
                                "asset string, calendar string, date date, value double, _pos bigint")
    r = rt.cleaning_report(raw, cal_, "2021-03-01", "2021-03-05").collect()[0]
    assert r["duplicate_dates"] == ["2021-03-01"] and r["nonpositive_prices"] == ["2021-03-02"] and r["out_of_order"]
    assert r["blank_on_open_day"] == ["2021-03-04"] and r["open_day_absent"] == ["2021-03-05"]
    # the chunked check sees breaks across chunk edges
    assert rt.out_of_order(raw, chunk=1).collect()[0]["out_of_order"]


def test_threshold_ulps(spark):
    a = spark.createDataFrame([("m", 1.0), ("k", -0.3)], "method string, threshold double")
    b = spark.createDataFrame([("m", math.nextafter(1.0, 2.0)), ("k", -0.3)], "method string, threshold double")
    got = {r["method"]: (r["exact"], r["ulps"]) for r in cal.compare_thresholds(a, b, ["method"]).collect()}
    assert got == {"m": (False, 1), "k": (True, 0)}


def test_side_without_days_has_no_first_days(spark):
    """nothing missing means no list (NULL), not an empty one."""
    from tidewatch.operators import returns as rt
    cal = spark.sql("SELECT 'c' AS calendar, date, name, is_open FROM VALUES (DATE '2020-01-01', 'x', true), (DATE '2020-01-02', 'x', true) t(date, name, is_open)")
    level = spark.sql("SELECT 'a' AS asset, 'c' AS calendar, date, 1.0D AS value FROM VALUES (DATE '2020-01-01'), (DATE '2020-01-02'), (DATE '2020-01-03') t(date)")
    r = rt.date_set_check(level, cal, "2020-01-01", "2020-01-31").collect()[0]
    assert (r.n_missing, r.n_unexpected, r.first_missing, r.first_unexpected) == (0, 1, None, "2020-01-03")
