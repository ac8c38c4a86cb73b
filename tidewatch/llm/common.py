"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import scratch_path

#: order key of a missing id: after all others
LAST_ID = 2**63 - 1
#: the characters of [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def narrowed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, its order key d (a missing id comes last) and text (missing: empty); no other column."""
    i = F.col(f"`{id_col}`").cast("long")
    return df.select(i.alias("id"), F.coalesce(i, F.lit(LAST_ID)).alias("d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(df: DataFrame) -> Column:
    """All columns as one struct named row, so that no name can clash with a join's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written once to the shared folder: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join whose rows go by key on both sides, never through the driver.

    Spark sizes a written table by its compressed files, and mapInArrow by its input, however many
    rows it makes of one; by such a size it would broadcast a table that the driver cannot hold.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Gapless global row numbers r from 0 in the order of `keys`, without one task seeing all rows.

    The table is range-partitioned, sorted and written; a row's number is its place in its
    file part plus the rows of all parts before it. The offsets are one row per part, so
    their broadcast is bounded by the number of shuffle partitions.
    """
    spark = df.sparkSession
    part = written(df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
                   .withColumn("at", F.monotonically_increasing_id()), name)
    low = F.lit(2**33 - 1)
    part = part.select(*df.columns, F.shiftrightunsigned("at", 33).alias("part"), F.col("at").bitwiseAND(low).alias("at"))
    counts = sorted((r["part"], r["n"]) for r in part.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets or [(0, 0)], "part long, before long")
    return part.join(F.broadcast(table), "part").select(*df.columns, (F.col("at") + F.col("before")).alias("r"))
