"""Path statistics: whole series on flat arrays, and panels that are dealt once."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.operators import diagnostics as dg


def test_path_statistics_repeat_no_row(spark):
    """no row per lag or window and no rescan per day; histories and windows are made where their series is."""
    from tidewatch.plans import q_diagnostics as qd
    from tidewatch.plans import q_walkforward as qw
    df = spark.createDataFrame([(1, 1, 0.1)], "entity bigint, day int, ret double")
    plan = dg.path_statistics(df, ["entity"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("windowspecdefinition") == 1
    p = qd.panel(spark, "/root/testdata/sf0.001")
    for d in (qw.resampled_statistics(p, 3), qw.window_statistics(p.drop("day"), qw.windows(spark))):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(entity") == 1 and "Exchange hashpartitioning(scenario" not in plan
        assert "Exchange hashpartitioning(period" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("rows", [1, 50, 1 << 16])
def test_series_cut_from_a_stream(rows):
    """Short, constant and gapped series beside each other, in batches that end anywhere."""
    from tidewatch.functions import series as se
    rng = np.random.default_rng(2)
    data = {0: [0.1] * 30, 1: [0.02], 2: list(rng.normal(0, 1, 70)), 3: [None if d % 4 == 1 else float(d % 7) for d in range(90)], 4: [None, None, 0.5], 5: [0.1] * 40 + [7.0]}
    arrow = [pa.RecordBatch.from_pydict({"_r": pa.array([d + 1], pa.int32()), "ret": pa.array([v], pa.float64())}) for x in data.values() for d, v in enumerate(x)]
    got = {}
    for t in se.whole_series(iter(arrow), rows=rows):
        x = t["ret"].combine_chunks()
        s = se.Series(t["_r"].to_numpy().astype(np.int64), x.fill_null(0.0).to_numpy(), x.is_valid().to_numpy(zero_copy_only=False))
        with np.errstate(all="ignore"):
            out = dg._path_values(s)
        for k in range(len(s.starts)):
            got[len(got)] = {n: float(v[k]) if ok[k] else None for n, (v, ok) in out.items()}
    assert len(got) == len(data)
    assert got[0]["sd_daily"] == 0 and got[0]["skewness"] is None and got[0]["acf_absret_lag1"] is None and got[0]["rv21_q50"] == 0
    assert got[1]["sd_daily"] is None and got[1]["agg1d_n_blocks"] == 1 and got[1]["rv21_q10"] is None
    x = np.array(data[2])
    assert got[2]["acf_ret_lag5"] == pytest.approx(np.corrcoef(x[:-5], x[5:])[0, 1])
    rv = [np.std(x[k:k + 21], ddof=1) * math.sqrt(252) for k in range(50)]
    assert got[2]["rv21_q90"] == pytest.approx(np.quantile(rv, .9)) and got[2]["concentration_max_exceed_63d"] == 0
    v = [u for u in data[3] if u is not None]
    assert got[3]["agg1d_n_blocks"] == len(v) and got[3]["sd_daily"] == pytest.approx(np.std(v, ddof=1)) and got[3]["rv21_q50"] is None
    two = [(a, b) for a, b in zip(data[3], data[3][10:]) if a is not None and b is not None]
    assert got[3]["acf_ret_lag10"] == pytest.approx(np.corrcoef(*zip(*two))[0, 1])
    assert got[4]["agg1d_n_blocks"] == 1 and got[5]["acf_ret_lag1"] is None and got[5]["tail_above_p5_count"] == 1


def test_medians_of_a_large_stratum_are_those_of_the_hashed_draws(spark, monkeypatch):
    """beyond LEAF entities too, in blocks of columns and replicates; an entity without a value keeps its place."""
    from tidewatch.operators import resample as rs
    rng = np.random.default_rng(8)
    n, reps = 301, 11
    monkeypatch.setattr(rs, "LEAF", 50)
    monkeypatch.setattr(rs, "MATRIX", 2 * n)
    data = {(p, s): [None if (e % 5 == 0 and p == "a") or (e > 290 and p != "b") else round(float(rng.normal()), 2) for e in range(n)] for p in ("a", "b") for s in ("x", "y", "z")}
    rows = [(p, s, 3, 7 * e, v) for (p, s), x in data.items() for e, v in enumerate(x)]
    long = spark.createDataFrame(rows, "period string, statistic string, candidate int, entity bigint, value double").repartition(5)
    got = {(r["period"], r["statistic"], r["rep"]): r["med"] for r in rs.resampled_medians(long, ["candidate"], ["period", "statistic"], reps, 5).collect()}
    assert len(got) == 6 * reps
    for (p, s), x in data.items():
        for rep in range(reps):
            drawn = sorted(x[i] for i in rs.draw_indices(rep, 5, n) if x[i] is not None)
            assert got[p, s, rep] == pytest.approx((drawn[(len(drawn) - 1) // 2] + drawn[len(drawn) // 2]) / 2)
