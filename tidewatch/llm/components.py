"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node that can be reached.

    Alternating rounds: every node hands its larger neighbours to its smallest one, then
    its smaller neighbours to the smallest. Each round is two map-side combined minima and
    two joins on a node (the large side of a hub is split by the adaptive skew join), written
    to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    Loops are ignored; an empty table gives an empty one.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        up = written(up, "edges")
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(down.union(low.toDF("a", "b")).distinct(), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.toDF("node", "root").union(now.select("b", "b").distinct())
