"""Parquet table access and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # dates of the tables are UTC dates
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: bytes of a table's files that one task takes when rows are dealt by entity
DEAL_BYTES = 4 << 20


def deal_parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Number of parts for dealing a table's rows: it grows with the table's files, so a part does not."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // DEAL_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session, whose one machine is driver and executor, may lack the
    setting; it gets a temporary folder. Elsewhere the setting is required, as a
    folder of one machine would give readers a part of the rows.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="spark-")
    return _scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_handoffs: dict[tuple, tuple[str, StructType]] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table that a query reads more than once, written to the shared folder for it alone."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_status(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, length and change time of each table, as the tables' own file system reports them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))


def handoff(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A stage table written once per session to the shared folder and read by later stages.

    `key` is (name, source folder, what else the rows depend on: methods, configuration).
    A changed source is read anew. Stages hand over compact tables (ledgers, path
    statistics) instead of recomputing them; the copy is on shared storage, so losing an
    executor costs a re-read.
    """
    k = (spark.sparkContext.applicationId, *key, source_status(spark, key[1]))
    if k not in _handoffs or not _exists(spark, _handoffs[k][0]):
        path = scratch_path(spark, key[0])
        df = build()
        df.write.parquet(path)
        _handoffs[k] = (path, df.schema)
    path, schema = _handoffs[k]
    return spark.read.schema(schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def forget_handoffs() -> None:
    """Make the next call rebuild every stage table (benchmarks)."""
    _handoffs.clear()
