"""Joins over time against plain Python, and the shape of their plans."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewatch.functions.temporal import in_intervals, latest_before
from tidewatch.operators.returns import assign_periods


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_event_before_each_row(spark):
    rng = random.Random(3)
    # one key holds most of the rows; several bins lie between some rows and their latest event
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), rng.randrange(-5, 3000)) for i in range(600)]
    rows += [(600, None, 5), (601, "a", None), (602, "none", 7), (603, "hot", -1)]
    events = [("hot", rng.randrange(0, 3000)) for _ in range(12)] + [("a", 10), ("a", 10), ("b", 2990), (None, 1), ("c", None)]
    df = spark.createDataFrame(rows, "i int, k string, t int").repartition(5).withColumn("same", F.lit("x"))
    ev = spark.createDataFrame(events, "k string, t int")
    for width in (1, 64, 10_000):
        got = latest_before(df.drop("same"), ev, ["k"], "t", bin_width=width).collect()
        assert len(got) == len(rows)
        for r in got:
            mine = [] if r["k"] is None or r["t"] is None else [t for k, t in events if k == r["k"] and t is not None]
            assert r["previous"] == max((t for t in mine if t < r["t"]), default=None)
            assert r["same"] == (r["t"] in mine)
    clash = latest_before(df, ev, ["k"], "t", previous="before", same="hit")
    assert clash.columns == ["i", "k", "t", "same", "before", "hit"] and clash.count() == len(rows)
    assert latest_before(df.limit(0), ev, ["k"], "t", same="hit").count() == 0
    assert latest_before(df, ev.limit(0), ["k"], "t", same="hit").where("previous is not null or hit").count() == 0


def test_intervals_by_bins(spark):
    day = dt.date(2000, 1, 1)
    rows = [(i, day + dt.timedelta(days=i * 7 % 400)) for i in range(90)] + [(90, None)]
    spans = [(j, day + dt.timedelta(days=j * 3), day + dt.timedelta(days=j * 3 + j % 50 - 2)) for j in range(120)]
    spans += [(120, None, day), (121, day, None)]
    df = spark.createDataFrame(rows, "i int, date date")
    iv = spark.createDataFrame(spans, "j int, start date, end date")
    want = sorted((i, j) for i, d in rows for j, a, b in spans if d and a and b and a <= d <= b)
    for width in (1, 10, 1000):
        assert sorted((r["i"], r["j"]) for r in in_intervals(df, iv, "date", width).collect()) == want
    assert sorted((r["i"], r["j"]) for r in assign_periods(df, iv).collect()) == want
    assert sorted((r["i"], r["j"]) for r in assign_periods(df, iv, bin_days=30).collect()) == want


def test_a_hundred_thousand_intervals_need_no_nested_loop(spark):
    iv = spark.range(100_000).select(F.col("id").alias("j"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 36_000).cast("int")).alias("start"))
    iv = iv.withColumn("end", F.date_add("start", 20))
    df = spark.range(5_000).select(F.col("id").alias("i"), F.date_add(F.lit("1900-02-01").cast("date"), (F.col("id") * 7).cast("int")).alias("date"))
    out = assign_periods(df, iv, bin_days=20)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    starts = F.date_diff("date", F.lit("1900-01-01").cast("date"))
    # days d - 20 .. d start the spans that hold day d; ids run over 36,000 days two or three times
    each = df.select(starts.alias("d")).where("d < 36000").collect()
    held = sum(sum(3 if s < 28_000 else 2 for s in range(r["d"] - 20, r["d"] + 1)) for r in each)
    late = [r[0] for r in df.select(starts.alias("d")).where("d >= 36000").collect()]
    held += sum(sum(3 if s < 28_000 else 2 for s in range(d - 20, 36_000)) for d in late)
    assert out.count() == held
