"""Long series, distances, path statistics, resampling, walk-forward, leakage and the stream."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import MonitorConfig
from tidewatch.operators import contrast as ct
from tidewatch.operators import diagnostics as dg
from tidewatch.operators import evidence as ev
from tidewatch.operators import passage as pa
from tidewatch.operators import resample as rs
from tidewatch.operators import returns as rt
from tidewatch.plans import q_walkforward as wf
from tidewatch.sources import tables
from tidewatch.streaming import monitor as mon

CFG = MonitorConfig(horizon=60, window=20, report_days=(10, 60))
PANEL = "scenario string, path_set string, entity bigint, day int, ret double"


def test_variance_of_a_very_long_series(spark):
    rng = random.Random(4)
    n = 20_000
    ret = [rng.gauss(0, 0.006) if k % 5000 else 0.3 for k in range(n)]
    df = spark.createDataFrame([("s", "r", 1, d + 1, x) for d, x in enumerate(ret)], PANEL)
    got = [r["v_ewma"] for r in ev.with_ewma_variance(df, CFG).orderBy("day").select("v_ewma").collect()]
    v, want = CFG.sigma_daily ** 2, []
    for x in ret:
        want.append(max(v, CFG.variance_floor_factor * CFG.sigma_daily ** 2))
        v = CFG.ewma_lambda * v + (1 - CFG.ewma_lambda) * (x - CFG.midpoint) ** 2
    assert not any(math.isnan(x) for x in got)
    assert got == pytest.approx(want, rel=1e-9)


def test_wasserstein_of_unequal_samples(spark):
    rng = np.random.default_rng(3)
    samples = {"a": (rng.normal(size=40), rng.normal(size=40)), "b": (rng.normal(size=17), rng.normal(size=53)), "c": (np.zeros(5), np.array([0.0, 1.0]))}
    mk = lambda i: spark.createDataFrame([(k, float(x)) for k, v in samples.items() for x in v[i]], "k string, z double")
    got = {r["k"]: r for r in dg.wasserstein1(mk(0), mk(1), ["k"]).collect()}
    for k, (x, y) in samples.items():
        grid = np.sort(np.concatenate([x, y]))
        cdf = lambda s: np.searchsorted(np.sort(s), grid[:-1], side="right") / len(s)
        assert got[k]["w1"] == pytest.approx(np.sum(np.abs(cdf(x) - cdf(y)) * np.diff(grid))) and got[k]["n"] == len(x)
    assert got["a"]["w1"] == pytest.approx(np.mean(np.abs(np.sort(samples["a"][0]) - np.sort(samples["a"][1]))))


def test_path_statistics_use_every_day(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.01, 263)
    df = spark.createDataFrame([(1, d + 1, float(v)) for d, v in enumerate(x)], "entity bigint, day int, ret double")
    r = dg.path_statistics(df, ["entity"]).collect()[0]
    assert r["n_days"] == 263 and r["sd_daily"] == pytest.approx(np.std(x, ddof=1))
    for h in (1, 5, 21):
        whole = (1 + x[:len(x) // h * h]).reshape(-1, h).prod(1) - 1
        assert r[f"agg{h}d_n_blocks"] == len(whole) and r[f"agg{h}d_sd"] == pytest.approx(np.std(whole, ddof=1))
    plan = dg.path_statistics(df, ["entity"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_replicates_share_no_stream(spark):
    """Neither the same draws nor shifted copies of each other."""
    df = spark.range(400).select(F.col("id").alias("draw")).crossJoin(spark.range(40).select(F.col("id").alias("rep")))
    n = F.lit(10 ** 15).cast("bigint")
    rows = df.select("rep", "draw", rs.draw_index(F.col("rep"), F.col("draw"), F.lit(1).cast("bigint"), n).alias("i")).collect()
    assert len({r["i"] for r in rows}) == len(rows)
    small = [r["i"] for r in df.select(rs.draw_index(F.col("rep"), F.col("draw"), F.lit(2).cast("bigint"), F.lit(10).cast("bigint")).alias("i")).collect()]
    assert np.abs(np.bincount(small, minlength=10) / len(small) - 0.1).max() < 0.01


def test_bootstrap_equals_plain_python(spark):
    rng = random.Random(8)
    cfg = CFG
    rows = []
    for role in ("calibration_valid", "test_valid", "test_invalid"):
        for e in range(30):
            for m in ("x", "y"):
                rows.append((role, e if role[0] == "c" else e + 100, m, round(rng.gauss(-1, 1), 1)))  # many ties
    df = spark.createDataFrame(rows, "path_set string, entity bigint, method string, min_stat double")
    reps = 12
    got = {(r["path_set"], r["rep"], r["method"], r["far_target"]): r["rate"] for r in rs.bootstrap_rates(df, cfg, reps).collect()}
    ents = {role: sorted({r[1] for r in rows if r[0] == role}) for role in rs.SALTS}
    draws = {}
    for role, salt in rs.SALTS.items():
        d = spark.range(len(ents[role])).select(F.col("id").alias("d")).crossJoin(spark.range(reps).select(F.col("id").alias("r")))
        for r in d.select("r", rs.draw_index(F.col("r"), F.col("d"), F.lit(salt).cast("bigint"), F.lit(len(ents[role])).cast("bigint")).alias("i")).collect():
            draws.setdefault((role, r["r"]), []).append(ents[role][r["i"]])
        draws[(role, -1)] = ents[role]
    val = {(r[0], r[1], r[2]): r[3] for r in rows}
    for (role, rep, m, alpha), rate in got.items():
        calib = sorted(val[("calibration_valid", e, m)] for e in draws[("calibration_valid", rep)])
        thr = calib[min(math.floor(alpha * len(calib)), len(calib) - 1)]
        mine = draws[(role, rep)]
        assert rate == pytest.approx(sum(val[(role, e, m)] < thr for e in mine) / len(mine))
    assert len(got) == 2 * (reps + 1) * 2 * 2


def test_pairs_need_no_join(spark):
    fp = spark.createDataFrame([("s", role, e, m, 0.1, -1.0, (5 if (e + len(m)) % 3 else -1)) for role in ("test_valid", "test_invalid") for e in range(12) for m in ("a", "bb")],
                               "scenario string, path_set string, entity bigint, method string, far_target double, threshold double, tau int")
    df = pa.paired(fp, [("a", "bb"), ("a", "absent")], CFG, 60)
    r = df.collect()
    assert len(r) == 1 and r[0]["n_paired"] == 12
    d = [(1.0 if (e + 1) % 3 else 0.0) - (1.0 if (e + 2) % 3 else 0.0) for e in range(12)]
    assert r[0]["detect_diff"] == pytest.approx(np.mean(d)) and r[0]["discordant_a_only"] == sum(x > 0 for x in d)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def history(spark, seed=2):
    rng = random.Random(seed)
    rows = []
    for e in range(10):
        day = dt.date(1995, 1, 2)
        while day < dt.date(2002, 1, 1):
            rows.append(("even" if e % 2 else "odd", e % 5, e, day, rng.gauss(0, 0.004 + 0.001 * (e % 5))))
            day += dt.timedelta(days=4)
    return spark.createDataFrame(rows, "scenario string, candidate int, entity bigint, date date, ret double").cache()


def test_windows_end_before_their_year(spark):
    w = {r["period"]: r for r in wf.windows(spark).collect()}
    for y in wf.YEARS:
        for rule in ("rolling3y", "expanding"):
            assert w[f"{rule}_{y}"]["end"] < w[f"year_{y}"]["start"]
    with pytest.raises(ValueError, match="not read"):
        rt.walk_forward_windows(spark, [2002], wf.DEV_START, wf.DEV_END)


def test_leaks_are_found(spark):
    """The chain as it is moves nothing; one that also looks at later days is caught."""
    p = history(spark)
    hidden = F.col("date") > F.to_date(F.lit(wf.ORIGIN))
    clean = rt.leakage_check(p, lambda d: wf.decided_by(spark, d, wf.ORIGIN), hidden).collect()[0]
    assert clean["identical"] and clean["n_hidden"] > 0 and clean["n_rows"] > 0

    def leaking(d):
        whole = d.groupBy("entity").agg(F.stddev_samp("ret").alias("s"))  # a scale from all days
        scaled = d.join(whole, "entity").withColumn("ret", F.col("ret") / F.col("s") * 0.01).drop("s")
        return wf.decided_by(spark, scaled, wf.ORIGIN)
    leak = rt.leakage_check(p, leaking, hidden).collect()[0]
    assert not leak["identical"] and leak["n_moved"] > 0


def test_frozen_candidate_and_scales(spark):
    sel = spark.createDataFrame([("w", 2)], "period string, selected int")
    sim = spark.createDataFrame([("w", c, s, float(c)) for c in range(3) for s in ct.TARGETS], "period string, candidate int, statistic string, target double")
    real = spark.createDataFrame([("w", s, 1.0) for s in ct.TARGETS], "period string, statistic string, real double")
    sc = spark.createDataFrame([("w", s, 0.5) for s in ct.TARGETS], "period string, statistic string, scale double")
    got = {r["method"]: (r["candidate"], r["loss"]) for r in ct.evaluate_frozen(sel, sim, real, sc, ["period"], 0).collect()}
    assert got == {"recalibrated": (2, 4.0), "fixed_baseline": (0, 4.0)}


def test_stream_over_restarts_late_rows_and_replays(spark, tmp_path):
    """All eight methods equal the batch first passage; late and missing rows are counted whatever the entity's state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mon.ROCKSDB)
    cfg = MonitorConfig(horizon=40, window=20, report_days=(10, 40))
    rng = random.Random(6)
    rows = [(e, d * 86_400_000_000, 0, rng.gauss(-0.004 * (e % 2), 0.006)) for e in range(6) for d in range(1, 46)]
    schema = "entity bigint, ts_us bigint, event_id bigint, ret double"
    panel = spark.createDataFrame([("s", "r", e, t // 86_400_000_000, x) for e, t, _, x in rows], PANEL)
    lows = ev.record_lows(panel, mon.METHODS, cfg).cache()
    least = lows.groupBy("method", "entity").agg(F.min("stat").alias("m")).groupBy("method").agg(F.sort_array(F.collect_list("m")).alias("m"))
    # the fourth smallest minimum: it touches its own entity's statistic, which is no alarm
    thr = spark.createDataFrame([(r["method"], 0.1, r["m"][3]) for r in least.collect()], "method string, far_target double, threshold double")
    feed, out, ck = (str(tmp_path / x) for x in ("feed", "out", "ck"))
    cut = [15 * 86_400_000_000, 30 * 86_400_000_000]
    parts = [[r for r in rows if r[1] <= cut[0]], [r for r in rows if cut[0] < r[1] <= cut[1]], [r for r in rows if r[1] > cut[1]]]
    parts[1].append((0, 3 * 86_400_000_000 + 5, 1, 9.0))  # late: entity 0 is past day 3
    parts[2] += [(1, 31 * 86_400_000_000 + 7, 1, None), (2, 31 * 86_400_000_000 + 7, 1, float("nan"))]
    parts.append([(e, 5, 2, 0.0) for e in range(3)] + [(1, 99 * 86_400_000_000, 0, 0.1)])  # entities are past their horizon
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
        mon.run_available(spark.readStream.schema(schema).parquet(feed), cfg, thr, out, ck)
    read = lambda: spark.read.schema(mon.OUTPUT).option("recursiveFileLookup", True).parquet(out)
    alarms = {(r["entity"], r["method"]): r["tau"] for r in read().where(~F.col("method").isin(*mon.REPORTS)).collect()}
    told = sorted((r["method"], r["entity"], r["tau"]) for r in read().where(F.col("method").isin(*mon.REPORTS)).collect())
    assert told == [(mon.LATE, 0, 1), (mon.LATE, 0, 1), (mon.LATE, 1, 1), (mon.LATE, 2, 1), (mon.REFUSED, 1, 1), (mon.REFUSED, 2, 1)]
    batch = {(r["entity"], r["method"]): r["tau"] for r in pa.first_passage(lows, thr, ["method"]).collect() if r["tau"] != -1}
    assert alarms == batch and {m for _, m in alarms} == set(mon.METHODS) and len(alarms) == 3 * len(mon.METHODS)
    before = read().count()
    mon.alarm_sink(out)(spark.read.parquet(f"{out}/batch=0"), 99)  # another batch adds rows,
    assert read().count() > before
    again = spark.read.parquet(f"{out}/batch=99").cache()
    again.count()
    mon.alarm_sink(out)(again, 99)  # the same one replaces its own
    assert read().count() == before + again.count()


@pytest.mark.parametrize("retention,late", [(1, []), (600_000, [20])])
def test_finished_entities_expire(spark, tmp_path, retention, late):
    """A finished entity's place goes after the retention time: it then starts as a new one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mon.ROCKSDB)
    cfg = MonitorConfig(horizon=20, window=20, report_days=(20,))
    thr = spark.createDataFrame([("binary_gaussian", -1e9)], "method string, threshold double")
    schema = "entity bigint, ts_us bigint, event_id bigint, ret double"
    feed, out, ck = (str(tmp_path / x) for x in ("feed", "out", "ck"))
    for _ in range(2):
        spark.createDataFrame([(1, t, 0, 0.0) for t in range(20)], schema).coalesce(1).write.mode("append").parquet(feed)
        mon.run_available(spark.readStream.schema(schema).parquet(feed), cfg, thr, out, ck, ("binary_gaussian",), retention)
    assert [r["tau"] for r in spark.read.schema(mon.OUTPUT).option("recursiveFileLookup", True).parquet(out).where("entity = 1").collect()] == late


def test_recursions_do_not_depend_on_triggers():
    cfg = MonitorConfig(horizon=9000, window=30, report_days=(10,))
    ret = np.random.default_rng(2).normal(0, 0.006, 6000)
    whole = mon.Recursions(cfg).advance(ret)
    state, parts = None, []
    for at in range(0, len(ret), 517):
        one = mon.Recursions(cfg, state)
        parts.append(one.advance(ret[at:at + 517]))
        state = one.state()
    for m in mon.METHODS:
        assert np.array_equal(np.concatenate([p[m] for p in parts]), whole[m], equal_nan=True)


def test_capped_variance_in_blocks(spark):
    """A long series split over blocks equals the recursion, also through shocks, and short series are unchanged."""
    rng = random.Random(14)
    series = {1: [rng.gauss(0, 0.006) if k % 700 else 0.4 for k in range(20_000)], 2: [0.02], 3: [rng.gauss(0, 0.006) for _ in range(257)], 4: [CFG.midpoint] * 300}
    df = spark.createDataFrame([("s", "r", e, d + 1, x) for e, xs in series.items() for d, x in enumerate(xs)], PANEL)
    got = {(r["entity"], r["day"]): (r["v_trunc"], r["v_trunc_floored"]) for r in ev.with_truncated_variance(df, CFG).collect()}
    assert len(got) == sum(map(len, series.values()))
    lam, cap, s2 = CFG.ewma_lambda, CFG.truncation_c ** 2, CFG.sigma_daily ** 2
    for e, xs in series.items():
        v = s2
        for d, x in enumerate(xs):
            low = CFG.variance_floor_factor * s2
            assert got[e, d + 1] == (pytest.approx(max(v, low), rel=1e-11), v < low)
            v = lam * v + (1 - lam) * min((x - CFG.midpoint) ** 2, cap * v)


def test_shared_folder_is_required_off_the_local_machine(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError, match="share"):
        tables.shared_dir(Session)


def test_handoffs_follow_their_source(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    d = str(tmp_path)
    (tmp_path / "t.parquet").write_text("a")
    tables.handoff(spark, ("x", d, 1), build)
    tables.handoff(spark, ("x", d, 1), build)
    tables.handoff(spark, ("x", d, 2), build)
    (tmp_path / "t.parquet").write_text("ab")
    tables.handoff(spark, ("x", d, 1), build)
    assert len(calls) == 3


def test_distances_are_dealt_into_the_parts_asked_for(spark):
    """both samples of W1 in as many tasks as the panel's size asks for, with unchanged areas."""
    rng = np.random.default_rng(4)
    rows = [(g, e, float(x)) for g in ("a", "b") for e in range(1, 8) for x in rng.normal(size=5 + e)]
    z = spark.createDataFrame(rows + [("a", 3, None)], "g string, entity bigint, z double")
    k = ["g", "entity"]
    neg = z.select(*k, (-F.col("z")).alias("z"))
    plain = {(r["g"], r["entity"]): (r["w1"], r["n"]) for r in dg.wasserstein1(z, neg, k).collect()}
    for dealt in (dg.wasserstein1(z, neg, k, parts=7), dg.mirrored_wasserstein1(z, k, parts=7)):
        assert dealt.rdd.getNumPartitions() == 7
        assert {(r["g"], r["entity"]): (r["w1"], r["n"]) for r in dealt.collect()} == plain and len(plain) == 14
    half = dg.paired_half_reference(z, z.select(*k).distinct(), ["g"], 7)
    assert half.rdd.getNumPartitions() == 7
    got = {(r["g"], r["pair"]): r["w1"] for r in half.collect()}
    assert sorted(got) == [(g, p) for g in ("a", "b") for p in (1, 2, 3)]
    for (g, p), w in got.items():
        a, b = ([x for h, e, x in rows if h == g and e == i] for i in (p, p + 3))
        cut = sorted(a + b)
        assert w == pytest.approx(sum(abs(np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x)) * (y - x) for x, y in zip(cut, cut[1:])))


def test_distance_over_a_reference_of_zero(spark):
    """at 6 times sf0.1 every pair holds equal series; the SQL's ratio is then infinite, not missing."""
    rows = [(k, s, v, None) for k, o, r in ((1, 2.0, 0.5), (2, 2.0, 0.0), (3, 0.0, 0.0), (4, 2.0, None)) for s, v in ((ct.W1_OBS, o), (ct.W1_REF, r))]
    got = {r["k"]: r["w1_ratio"] for r in ct.gap_overview(spark.createDataFrame(rows, "k int, statistic string, sim_median double, inside boolean"), ["k"]).collect()}
    assert got[1] == 4.0 and got[2] == float("inf") and np.isnan(got[3]) and got[4] is None
