"""Queries for landed files, sinks and the online monitor.

Inputs are written from the given tables into the shared folder first, so every
reader works on files whose size grows with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import SUPPLIER as CFG
from tidewatch.config import USER
from tidewatch.functions.expr import r
from tidewatch.operators import calibrate as cal
from tidewatch.operators import evidence as ev
from tidewatch.plans import fixtures as fx
from tidewatch.plans import q_calibrate as qc
from tidewatch.plans import q_passage as qp
from tidewatch.plans import sqlgen as sg
from tidewatch.plans.catalog import query
from tidewatch.sources import readers as rd
from tidewatch.sources import sinks
from tidewatch.sources.tables import handoff, scratch_path, staged
from tidewatch.streaming import monitor as mon

_ASSETS = tuple(row[0] for row in fx.REGISTRY_ROWS)


def _text(df, path):
    df.select("value").write.text(path)
    return path


def _fmt(c="value", d=4):
    """Plain decimal text, no exponent."""
    return F.col(c).cast(f"decimal(20,{d})").cast("string")


def landed(spark, sf, kind: str, asset: str) -> str:
    """Write one asset's daily levels in one of the landed file formats."""
    lv = fx.level_daily(spark, sf).where(F.col("asset") == asset)
    path = scratch_path(spark, kind)
    blank = F.col("value") < 120000.0
    day = F.date_format("date", "yyyy-MM-dd")
    if kind == "level_csv":
        # Friday blanks are '', the others '.'; each output file has its own header
        v = F.when(blank, F.when(F.weekday("date") == 4, "").otherwise(".")).otherwise(_fmt())
        lv.select(day.alias("observation_date"), v.alias(asset)).write.option("header", True).option("emptyValue", "").csv(path)
        return path
    if kind == "factor_text":
        body = lv.select(F.concat(F.date_format("date", "yyyyMMdd"), F.lit(", "), F.when(blank, "-99.99").otherwise(_fmt())).alias("value"))
        note = spark.createDataFrame([("This file holds daily values, in percent.",), ("Copyright notice, all rights reserved, 2024",), ("1926,header,row",)], "value string")
        return _text(note.unionByName(body), path)
    if kind == "vendor_csv":
        d = F.when(F.dayofmonth("date") % 2 == 0, F.date_format("date", "M/d/yyyy")).when(F.dayofmonth("date") == 13, "n/a").otherwise(day)
        lv.select(d.alias("Date"), F.when(blank, "null").otherwise(_fmt()).alias("Close")).write.option("header", True).csv(path)
        return path
    body = lv.select(F.concat(F.date_format("date", "dd.MM.yyyy"), F.lit(";"), F.when(blank, "-").otherwise(_fmt()), F.lit(";x")).alias("value"))
    note = spark.createDataFrame([("Datum;Wert;Kommentar",), ("Zeitreihe, täglich",)], "value string")
    note.unionByName(body).write.option("encoding", "ISO-8859-1").option("header", False).option("sep", "\u0001").option("quote", "").csv(path)
    return path


_VAL = "CAST(CAST(value AS DECIMAL(20,4)) AS DOUBLE)"


_OUT = {
    "level_csv": f"SELECT asset, date, {sg.rnd(f'CASE WHEN value >= 120000.0 THEN {_VAL} END', 4)} AS value FROM one",
    "factor_text": f"SELECT asset, date, {sg.rnd(f'CASE WHEN value >= 120000.0 THEN {_VAL} / 100.0 END', 6)} AS value FROM one",
    "vendor_csv": f"SELECT asset, date, {sg.rnd(f'CASE WHEN value >= 120000.0 THEN {_VAL} END', 4)} AS value FROM one WHERE day(date) <> 13",
    "semicolon_text": f"SELECT asset, date, {sg.rnd(_VAL, 4)} AS value FROM one WHERE value >= 120000.0",
}


def _read(kind):
    def run(spark, sf):
        """Every asset landed in this format and read back."""
        parts = [rd.READERS[kind](spark, landed(spark, sf, kind, a), a) for a in _ASSETS]
        return reduce(DataFrame.unionByName, parts).select("asset", "date", r("value", 6 if kind == "factor_text" else 4).alias("value"))
    return run


for _k in _OUT:
    query(f"read_{_k}", f"WITH {fx.SQL_LEVEL}, one AS (SELECT * FROM level) {_OUT[_k]}")(_read(_k))


@query("load_series", f"WITH {fx.SQL_LEVEL}, {fx.SQL_REGISTRY}, x AS (" + " UNION ALL ".join(
    f"SELECT * FROM ({_OUT[reader].replace('FROM one', f'FROM (SELECT * FROM level WHERE asset = {asset!r}) one')})" for asset, _, reader, _, _ in fx.REGISTRY_ROWS)
    + ") SELECT x.asset, x.date, x.value, r.reader, r.category, r.units FROM x JOIN registry r USING (asset)")
def load_series(spark, sf):
    files = {row[0]: landed(spark, sf, row[2], row[0]) for row in fx.REGISTRY_ROWS}
    s = rd.load_series(spark, files, list(fx.REGISTRY_ROWS))
    return s.select("asset", "date", r("value", 6).alias("value"), "reader", "category", "units")


def _name():
    return F.translate(F.regexp_replace("asset", "^[0-9]-", ""), " ", "_")


def _lines(spark, sf):
    """series, k, value: a header line and one line per day of each asset."""
    lv = fx.level_daily(spark, sf)
    body = lv.select(_name().alias("series"), F.date_format("date", "yyyy-MM-dd").alias("k"), F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), _fmt()).alias("value"))
    head = body.select("series").distinct().select("series", F.lit("").alias("k"), F.concat(F.lit("observation_date,"), "series").alias("value"))
    return head.unionByName(body)


def _landing(spark, sf):
    """One file per asset: four good ones and one page of HTML."""
    path = scratch_path(spark, "landing")
    page = F.when((F.col("series") == "LOW") & (F.col("k") == ""), F.concat(F.lit("<html><body>"), F.col("value"))).otherwise(F.col("value"))
    (_lines(spark, sf).withColumn("value", page).repartition("series").sortWithinPartitions("series", "k")
     .select("series", "value").write.partitionBy("series").text(path))
    return path


@query("validate_landed_file", f"""WITH {fx.SQL_LEVEL} SELECT upper(replace(substr(asset, 3), ' ', '_')) AS series, asset <> '5-LOW' AS ok, CASE WHEN any_value(asset) = '5-LOW' THEN 'looks like HTML' ELSE '' END AS reason FROM level GROUP BY asset""".replace(
    "asset <> '5-LOW' AS ok", "any_value(asset) <> '5-LOW' AS ok").replace("SELECT upper(replace(substr(asset, 3), ' ', '_'))", "SELECT upper(replace(substr(any_value(asset), 3), ' ', '_'))"))
def validate_landed_file(spark, sf):
    path = _landing(spark, sf)
    v = None
    for a in _ASSETS:
        s = a[2:].replace(" ", "_")
        one = rd.validate_landed(spark, f"{path}/series={s}", s, "*.txt").select(F.lit(s).alias("series"), "ok", "reason")
        v = one if v is None else v.unionByName(one)
    return v


#: name in the landing folder, and what its record says: the checksum, a wrong one, or nothing
_RECORDS = (("URGENT", "right"), ("HIGH", "right"), ("MEDIUM", "wrong"), ("NOT_SPECIFIED", "none"), ("LOW", "none"))


@query("pinned_snapshot", f"""WITH {fx.SQL_LEVEL}, n AS (SELECT upper(replace(substr(asset, 3), ' ', '_')) AS series, count(*) + 1 AS n_lines FROM level GROUP BY 1)
SELECT v.series, v.series || '_' || v.version || '.csv' AS file, v.pinned_by, v.sha_ok, CASE WHEN v.version = '20240102' THEN n.n_lines - 1 ELSE n.n_lines END AS n_lines
FROM (VALUES {', '.join(f"('{s}', '{'20240102' if k == 'none' else '20240101'}', '{'newest file' if k == 'none' else 'provenance'}', {k != 'wrong'})" for s, k in _RECORDS)}) v(series, version, pinned_by, sha_ok) JOIN n USING (series)""")
def pinned_snapshot(spark, sf):
    """Two versions of every asset's file, the later without its header; records pin some assets to the earlier."""
    path, side = scratch_path(spark, "snapshots"), scratch_path(spark, "provenance")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    for version, lines in (("20240101", _lines(spark, sf)), ("20240102", _lines(spark, sf).where(F.col("k") != ""))):
        tmp = scratch_path(spark, "version")
        lines.repartition("series").sortWithinPartitions("series", "k").select("series", "value").write.partitionBy("series").text(tmp)
        for s, _ in _RECORDS:
            part = [f.getPath() for f in fs.listStatus(at(f"{tmp}/series={s}")) if f.getPath().getName().startswith("part-")][0]
            fs.rename(part, at(f"{path}/{s}_{version}.csv"))
    sha = spark.read.format("binaryFile").option("pathGlobFilter", "*_20240101.csv").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("raw_file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _RECORDS for x in kv]), rd.stem(F.col("raw_file")))
    rec = sha.withColumn("kind", kind).where("kind <> 'none'").select(
        "raw_file", F.when(F.col("kind") == "wrong", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"), "bytes", F.lit("2024-01-03").alias("downloaded_at"))
    # a sidecar is a JSON record over several lines, a file for each
    side_text = F.replace(F.to_json(F.struct("raw_file", "sha256", "bytes", "downloaded_at")), F.lit(","), F.lit(",\n  "))
    rec.select(F.col("raw_file").alias("of"), side_text.alias("value")).repartition("of").write.partitionBy("of").text(side)
    series = spark.createDataFrame([(s,) for s, _ in _RECORDS], "series string")
    pins = rd.pinned_snapshots(spark, path, rd.read_provenance(spark, f"{side}/*"), series)
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_lines"))
    return pins.join(lines, "file").select("series", "file", "pinned_by", "sha_ok", "n_lines")


@query("read_frozen_thresholds", f"{qc.SQL_THR} SELECT method, far_target, {sg.rnd('threshold', 7)} AS threshold FROM thr")
def read_frozen_thresholds(spark, sf):
    t = cal.thresholds(qc.minima(spark, sf), CFG).select("method", "far_target", "threshold")
    return sinks.roundtrip_thresholds(t).select("method", "far_target", r("threshold", 7).alias("threshold"))


@query("write_result_tables", f"{qc.SQL_MIN} SELECT f.format, m.scenario, m.method, count(*) AS n, {sg.rnd('sum(min_stat)', 6)} AS total FROM minima m CROSS JOIN (VALUES ('parquet'), ('csv'), ('csv.gz'), ('json')) f(format) GROUP BY f.format, m.scenario, m.method")
def write_result_tables(spark, sf):
    m = qc.minima(spark, sf).select("entity", "method", "min_stat", "scenario")
    out = None
    for fmt in sinks.FORMATS:
        path = sinks.write_table(m, scratch_path(spark, "result"), fmt, partition_by=["scenario"])
        back = sinks.read_table(m, path, fmt).withColumn("format", F.lit(fmt))
        g = back.groupBy("format", "scenario", "method").agg(F.count(F.lit(1)).alias("n"), r(F.sum("min_stat"), 6).alias("total"))
        out = g if out is None else out.unionByName(g)
    return out


_A = 0.15


_LIVE = (f"WITH RECURSIVE {fx.SQL_USER}{sg.statistics(USER, mon.METHODS)}{sg.long_stats(mon.METHODS)}{sg.minima(USER)}{sg.thresholds(USER)}{sg.first_passage(USER)}")


@query("live_monitor_stream", f"{_LIVE} SELECT entity, method, tau, {sg.rnd('threshold', 7)} AS threshold FROM fp WHERE far_target = {_A} AND tau <> -1")
def live_monitor_stream(spark, sf):
    """All days of all users through the online monitor, landed in three parts; all eight methods equal the batch first passage.

    After each part the query is started from its checkpoint, so state is carried over a restart.
    """
    lw = handoff(spark, ("user_lows", sf, mon.METHODS, USER), lambda: ev.record_lows(fx.panel_user(spark, sf), mon.METHODS, USER))
    thr = cal.thresholds(cal.path_minima(lw), USER).where(F.col("far_target") == _A).select("method", "threshold")
    limits = staged(thr, "limits")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mon.ROCKSDB)
    days = fx.user_days(spark, sf).select("entity", F.unix_micros(F.col("date").cast("timestamp")).alias("ts_us"), F.lit(0).cast("bigint").alias("event_id"), "ret")
    feed, out, ck = (scratch_path(spark, x) for x in ("feed", "alarms", "alarms-state"))
    edges = days.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()
    span = (edges["b"] - edges["a"]) // 3 + 1 if edges["a"] is not None else 1
    for k in range(3):
        part = F.floor((F.col("ts_us") - F.lit(edges["a"] or 0)) / span) == k
        days.where(part).write.mode("append").parquet(feed)
        mon.run_available(spark.readStream.schema(days.schema).parquet(feed), USER, limits, out, ck)
    found = spark.read.schema(mon.OUTPUT).option("recursiveFileLookup", True).parquet(out)
    return found.where(~F.col("method").isin(*mon.REPORTS)).select("entity", "method", "tau", r("threshold", 7).alias("threshold"))
