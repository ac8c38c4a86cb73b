"""Joins over time: the latest event before a row, and the intervals that hold a row.

Both cut time into bins, so an entity with a long history is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(df: DataFrame, events: DataFrame, keys: Sequence[str], at: str, bin_width: int = 256,
                  previous: str = "previous", same: str = "same") -> DataFrame:
    """Every row of `df` with the time of its key's latest event strictly before `at`, and whether one is at `at` itself.

    `events` has the keys and a whole-number column also named `at`; repeated events count once.
    Rows and events meet in bins of `bin_width`; what lies in earlier bins is carried over, one row
    per key and bin, so no task holds a key's whole history. A row whose key or time is missing, or without
    an earlier event, has no previous one; such an event is ignored. No row is dropped or repeated.
    """
    keys = list(keys)
    e = events.select(*keys, F.col(at).cast("long").alias("_t")).dropna().distinct().withColumn("_event", F.col("_t"))
    rows = df.select(*keys, F.col(at).cast("long").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    both = rows.unionByName(e, allowMissingColumns=True).withColumn("_bin", F.floor(F.col("_t") / bin_width))
    near = Window.partitionBy(*keys, "_bin").orderBy("_t")
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "_bin").agg(F.max("_event").alias("_top")).withColumn("_carry", F.max("_top").over(before)).drop("_top")
    found = both.withColumns({"_near": F.max("_event").over(near.rangeBetween(Window.unboundedPreceding, -1)),
                              "_same": F.max("_event").over(near.rangeBetween(0, 0))}).where(F.col("_row").isNotNull())
    return found.join(carried, [*keys, "_bin"], "left").select(
        "_row.*", F.coalesce("_near", "_carry").alias(previous), F.col("_same").isNotNull().alias(same))


def in_intervals(df: DataFrame, intervals: DataFrame, at: str, bin_days: int) -> DataFrame:
    """Rows and the intervals [start, end] that hold their date: an equi-join by bin, the bounds checked behind it.

    For interval tables that grow with the data. An interval stands in each bin of `bin_days` days that it
    touches; a row stands in one, so every pair is found once. A row or interval without a date, or an interval that
    ends before it starts, has no partner.
    """
    number = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / bin_days)
    i = intervals.where(F.col("start") <= F.col("end")).withColumn("_bin", F.explode(F.sequence(number("start"), number("end"))))
    d = df.withColumn("_bin", number(at))
    return d.join(i, "_bin").where(F.col(at).between(F.col("start"), F.col("end"))).drop("_bin")
