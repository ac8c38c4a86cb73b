"""Means that do not depend on the order of the rows."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from tidewatch.functions.expr import exact_mean


def test_exact_mean_is_the_same_in_every_order(spark):
    """Copies of a series get equal means whatever order their rows meet in; a plain mean does not give that."""
    rng = random.Random(2)
    vals = [round(rng.choice((1e-2, 1.0, 1e5)) * rng.uniform(-1, 1), 2) for _ in range(40)]
    rows = []
    for k in range(30):
        rng.shuffle(vals)
        rows += [(k, x) for x in vals]
    got = spark.createDataFrame(rows, "k long, x double").coalesce(1).groupBy("k").agg(exact_mean("x").alias("m"), F.avg("x").alias("p")).collect()
    want = float(sum(map(Fraction, vals))) / len(vals)
    assert {r.m for r in got} == {want}
    assert len({r.p for r in got}) > 1


def test_exact_mean_of_odd_groups(spark):
    rows = [("one", 0.07), ("null", None), ("some", None), ("some", -3.25), ("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("big", 1e300), ("big", 3e300)]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(exact_mean("x").alias("m")).collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {"one": 0.07, "null": None, "some": -3.25, "inf": math.inf, "big": 2e300}
