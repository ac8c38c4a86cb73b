"""Inputs derived from the given tables: panels, level series, registries.

The day-level aggregation has a map-side partial step, so a key holding a large
share of the raw rows is reduced before anything is shuffled; afterwards a
series has at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import SUPPLIER, USER, MonitorConfig
from tidewatch.functions.expr import exact_mean
from tidewatch.operators.evidence import KEYS, drift_overlay
from tidewatch.sources.tables import deal_parts, table

PRICE_TERM = 7.853981633974483e-10
ROLES = ("calibration_valid", "test_valid", "test_invalid")


def role_of(entity: Column) -> Column:
    """Every entity gets exactly one role; none is left out."""
    return (F.when(entity % 3 == 0, ROLES[0]).when(entity % 3 == 1, ROLES[1]).otherwise(ROLES[2]))


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = deal_parts(spark, sf_dir, "lineitem")
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_quantity", "l_extendedprice")
    # hardly two rows share supplier and day, so a map-side step would hold every row and save none;
    # dealt by both, a supplier with a large share of the rows is many tasks until it has one row a day
    daily = li.repartition(parts, "l_suppkey", "date").groupBy("l_suppkey", "date").agg(
        exact_mean("l_discount").alias("d"), exact_mean("l_quantity").alias("q"), exact_mean("l_extendedprice").alias("p"))
    # keys are derived before the days are numbered: filters on them reach the
    # scan, and the numbering shares its partitioning with every later window
    daily = daily.select(
        F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd").alias("scenario"),
        role_of(F.col("l_suppkey")).alias("path_set"), F.col("l_suppkey").alias("entity"), "date", "d", "q", "p")
    # dealt by entity alone: windows and groupings over any keys that hold the entity need no further shuffle
    daily = daily.repartition(parts, "entity")
    return daily.select(
        *KEYS, F.row_number().over(Window.partitionBy(*KEYS).orderBy("date")).alias("day"), "date",
        # the price term is tiny and not a decimal fraction; it keeps statistics off
        # the lattice of two-digit discounts, where values tie with thresholds
        ((F.col("d") - 0.05) * 0.2 + (F.col("p") - 38000.0) * PRICE_TERM).alias("ret"),
        # positive, day-varying variance that plays the part of the latent one
        (F.lit(SUPPLIER.sigma_daily ** 2) * (F.lit(0.5) + F.col("q") / 50.0)).alias("true_var"))


def panel_supplier(spark: SparkSession, sf_dir: str, cfg: MonitorConfig = SUPPLIER) -> DataFrame:
    """Long panel; entities in the valid roles carry the valid drift."""
    base = supplier_days(spark, sf_dir).withColumn(
        "t_last_valid", F.when(F.col("path_set") == "test_invalid", 0))
    return drift_overlay(base, cfg).drop("t_last_valid")


def failing_supplier(spark: SparkSession, sf_dir: str, cfg: MonitorConfig = SUPPLIER) -> DataFrame:
    """Every entity valid up to its own last valid day, which ranges over 0..252."""
    base = supplier_days(spark, sf_dir).withColumn(
        "t_last_valid", (F.col("entity") * 37 % 253).cast("int"))
    return drift_overlay(base, cfg)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and calendar day over all events: mean return, number of error events."""
    ev = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("date"), "event_type", "value")
    daily = ev.groupBy("user_id", "date").agg(exact_mean("value").alias("v"), F.count_if(F.col("event_type") == "error").alias("e"))
    return daily.select(F.lit("all").alias("scenario"), role_of(F.col("user_id")).alias("path_set"), F.col("user_id").alias("entity"), "date",
                        ((F.col("v") / 50.0 - 1.0) * F.lit(USER.sigma_daily)).alias("ret"), F.col("e").cast("int").alias("event_count"))


def panel_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short panel with event flags: all days of every user, numbered.

    The day-level aggregation is combined map-side, so a user holding a third of the
    events is reduced to at most one row per day and task before anything is shuffled.
    """
    w = Window.partitionBy(*KEYS).orderBy("date")
    return user_days(spark, sf_dir).select(*KEYS, F.row_number().over(w).alias("day"), "date", "ret", "event_count")


SHIFT_DAYS = 8036  # 1,148 weeks: keeps weekdays and lands inside both calendars


def level_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("asset"),
                     F.date_add(F.col("o_orderdate").cast("date"), SHIFT_DAYS).alias("date")).agg(
        F.avg("o_totalprice").alias("value"))


def level_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as landed, in file order: duplicates and disorder are still there."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    # prices below 1,000 play the part of unreadable prints, so blanks exist
    return o.select(F.col("o_orderpriority").alias("asset"),
                    F.date_add(F.col("o_orderdate").cast("date"), SHIFT_DAYS).alias("date"),
                    F.when(F.col("o_totalprice") >= 1000.0, F.col("o_totalprice")).alias("value"),
                    F.col("o_orderkey").alias("_pos"))


#: asset, category, reader, calendar, units
REGISTRY_ROWS = (
    ("1-URGENT", "price_change", "level_csv", "nyse", "index points"),
    ("2-HIGH", "price_change", "level_csv", "jpx", "index points"),
    ("3-MEDIUM", "price_change", "vendor_csv", "source_grid", "index points"),
    ("4-NOT SPECIFIED", "return", "factor_text", "nyse", "decimal return"),
    ("5-LOW", "market_state", "semicolon_text", "nyse", "percent"),
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY_ROWS),
                                 "asset string, category string, reader string, calendar string, units string")


# --- the same inputs as SQL, for the oracle -------------------------------------

_DRIFT = repr(SUPPLIER.drift_valid)
_S2 = repr(SUPPLIER.sigma_daily ** 2)

SQL_DAYS = f"""
sup_days AS (
  SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS scenario,
         CASE l_suppkey % 3 WHEN 0 THEN 'calibration_valid' WHEN 1 THEN 'test_valid' ELSE 'test_invalid' END AS path_set,
         l_suppkey AS entity,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS INTEGER) AS day,
         CAST(l_shipdate AS DATE) AS date,
         (avg(l_discount) - 0.05) * 0.2 + (avg(l_extendedprice) - 38000.0) * {PRICE_TERM!r} AS noise,
         {_S2} * (0.5 + avg(l_quantity) / 50.0) AS true_var
  FROM lineitem GROUP BY l_suppkey, l_shipdate)"""

SQL_PANEL = SQL_DAYS + f""",
panel AS MATERIALIZED (
  SELECT scenario, path_set, entity, day, date, true_var,
         noise + CASE WHEN path_set = 'test_invalid' THEN 0.0 ELSE {_DRIFT} END AS ret
  FROM sup_days)"""

SQL_FAILING = SQL_DAYS + f""",
panel AS MATERIALIZED (
  SELECT scenario, path_set, entity, day, date, true_var, CAST(entity * 37 % 253 AS INTEGER) AS t_last_valid,
         noise + CASE WHEN day <= entity * 37 % 253 THEN {_DRIFT} ELSE 0.0 END AS ret
  FROM sup_days)"""

SQL_USER = f"""
panel AS MATERIALIZED (
  SELECT 'all' AS scenario,
         CASE user_id % 3 WHEN 0 THEN 'calibration_valid' WHEN 1 THEN 'test_valid' ELSE 'test_invalid' END AS path_set,
         user_id AS entity,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS day, date,
         (v / 50.0 - 1.0) * {USER.sigma_daily!r} AS ret, e AS event_count
  FROM (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS v, CAST(count(*) FILTER (WHERE event_type = 'error') AS INTEGER) AS e
        FROM events GROUP BY 1, 2))"""

SQL_LEVEL = f"""
level AS MATERIALIZED (
  SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) + {SHIFT_DAYS} AS date, avg(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""

SQL_LEVEL_RAW = f"""
level_raw AS MATERIALIZED (
  SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) + {SHIFT_DAYS} AS date,
         CASE WHEN o_totalprice >= 1000.0 THEN o_totalprice END AS value, o_orderkey AS pos
  FROM orders)"""

SQL_REGISTRY = "registry(asset, category, reader, calendar, units) AS (VALUES " + ", ".join(
    "(" + ", ".join(f"'{x}'" for x in row) + ")" for row in REGISTRY_ROWS) + ")"
