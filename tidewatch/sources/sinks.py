"""Result sinks: parquet, CSV (plain or gzip) and JSON, and frozen thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.sources.tables import scratch_path

FORMATS = {
    "parquet": lambda w, path: w.parquet(path),
    "csv": lambda w, path: w.option("header", True).csv(path),
    "csv.gz": lambda w, path: w.option("header", True).option("compression", "gzip").csv(path),
    "json": lambda w, path: w.json(path),
}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> str:
    """Write a result table; the write is distributed and never passes the driver."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown sink format {fmt!r}; known: {sorted(FORMATS)}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    FORMATS[fmt](w, path)
    return path


def read_table(like: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a result table back with the schema it was written with."""
    reader = like.sparkSession.read
    if fmt == "parquet":
        return reader.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in like.schema.fields])
    if fmt == "json":
        return reader.schema(schema).json(path)
    # partition columns move behind the data columns; CSV is positional
    return reader.schema(schema).option("header", True).csv(path)


def read_frozen_thresholds(spark, path: str, keys: str = "method string, far_target double") -> DataFrame:
    """Frozen thresholds from CSV; the JVM parser rounds doubles correctly."""
    return spark.read.schema(f"{keys}, threshold double").option("header", True).csv(path)


def roundtrip_thresholds(thr: DataFrame) -> DataFrame:
    """Freeze thresholds to CSV in the shared folder and read them back."""
    spark = thr.sparkSession
    path = write_table(thr, scratch_path(spark, "thresholds"), "csv")
    return read_frozen_thresholds(spark, path)
