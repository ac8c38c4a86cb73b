"""Readers for landed text files, their validation and snapshot pinning.

Files are parsed with DataFrame expressions line by line; no file content goes
through the driver. The blank row of a level file is kept, because its presence
marks a day without trading.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 64
#: longest file whose checksum is taken from one value; a longer one is read in chunks
WHOLE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
# fixed values: missing codes of the factor file
MISSING_CODES = (-99.99, -999.0)


def read_level_csv(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """`date,value` export; blanks and '.' become NULL and their rows stay.

    Every file must have a header of two columns that names the series; rows of a file
    without one fail the read. The headers are one row per file.
    """
    raw = spark.read.schema("date string, raw string").option("header", False).csv(path).select("date", "raw", F.col("_metadata.file_path").alias("file"))
    date = F.trim("date").try_cast("date")
    named = F.coalesce((F.trim("raw") == series_id) | (F.trim("date") == series_id), F.lit(False)) & date.isNull()
    heads = raw.groupBy("file").agg(F.max(named).alias("headed"))
    v = F.nullif(F.nullif(F.trim("raw"), F.lit("")), F.lit("."))
    # the check is part of the row filter: it cannot be pruned away
    keep = F.when(~F.col("headed"), F.raise_error(F.concat(
        F.lit(f"unexpected header, expected {series_id}: "), F.col("file"))).cast("boolean")).otherwise(date.isNotNull())
    return raw.join(heads, "file").where(keep).select(F.lit(series_id).alias("asset"), date.alias("date"), v.try_cast("double").alias("value"))


def read_factor_text(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """Lines of exactly two comma fields starting with eight digits; percent to decimal once."""
    p = F.split("value", ",")
    d, v = F.trim(p[0]), F.trim(p[1]).try_cast("double")
    t = spark.read.text(path).where((F.size(p) == 2) & d.rlike("^[0-9]{8}$") & v.isNotNull())
    return t.select(F.lit(asset).alias("asset"), F.to_date(d, "yyyyMMdd").alias("date"),
                    F.when(v.isin(*MISSING_CODES), None).otherwise(v / 100.0).alias("value"))


def read_vendor_csv(spark: SparkSession, path: str, asset: str, formats=("M/d/yyyy", "yyyy-MM-dd")) -> DataFrame:
    """Mixed date formats; unparsable dates are dropped, unparsable numbers become NULL."""
    raw = spark.read.schema("d string, v string").option("header", True).csv(path)
    date = F.coalesce(*[F.try_to_timestamp("d", F.lit(f)) for f in formats]).cast("date")
    return raw.select(F.lit(asset).alias("asset"), date.alias("date"), F.col("v").try_cast("double").alias("value")).where(F.col("date").isNotNull())


def read_semicolon_text(spark: SparkSession, path: str, asset: str, column: int = 1) -> DataFrame:
    """`;`-separated latin-1 text; rows whose first field is dd.mm.yyyy and whose value parses."""
    p = F.split("value", ";")
    d, v = F.trim(p[0]), F.trim(F.get(p, F.lit(column))).try_cast("double")
    # a line is one field: no separator, no quote and no escape may change it
    t = spark.read.option("encoding", "ISO-8859-1").schema("value string").option("sep", "\u0001").option("quote", "").option("escape", "").csv(path)
    return t.where(d.rlike(r"^\d{2}\.\d{2}\.\d{4}$") & v.isNotNull()).select(
        F.lit(asset).alias("asset"), F.to_date(d, "dd.MM.yyyy").alias("date"), v.alias("value"))


READERS = {"level_csv": read_level_csv, "factor_text": read_factor_text, "vendor_csv": read_vendor_csv, "semicolon_text": read_semicolon_text}


def load_series(spark: SparkSession, files: dict[str, str], registry: list[tuple]) -> DataFrame:
    """Every registered series through its reader, tidy, with its metadata."""
    unknown = {r[2] for r in registry} - set(READERS)
    if unknown:
        raise ValueError(f"no reader for {sorted(unknown)}")
    parts = [READERS[reader](spark, files[asset], asset).withColumns({
        "reader": F.lit(reader), "category": F.lit(category), "units": F.lit(units)})
        for asset, category, reader, _cal, units in registry if asset in files]
    return reduce(DataFrame.unionByName, parts)


def _empty_files(f: DataFrame) -> DataFrame:
    """uri of the files that a scan lists but skips because they have no byte; `f` has `_metadata`."""
    # the listing writes file:///a, a row's metadata file:/a
    names = f.sparkSession.createDataFrame([(n,) for n in f.inputFiles()], "uri string").select(F.regexp_replace("uri", "^file:/+", "file:/").alias("uri"))
    return names.join(f.select(F.col("_metadata.file_path").alias("uri")), "uri", "left_anti")


def validate_landed(spark: SparkSession, path: str, series_id: str, pattern: str = "*") -> DataFrame:
    """(path, length, ok, reason): too short, HTML, or a header that is not two columns with the id.

    Lengths come from the listing, and so do files without a byte, which a scan skips. First lines are found line by line, by place in the file, so
    no file is held as one value.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    sizes = files.select(F.col("_metadata.file_path").alias("path"), "length").unionByName(
        _empty_files(files).select(F.col("uri").alias("path"), F.lit(0).cast("long").alias("length")))
    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
             .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")))
    first = lines.groupBy("path").agg(F.min_by("value", F.struct("at", "i")).alias("head"))
    f = sizes.join(first, "path", "left")
    head = F.ltrim(F.coalesce("head", F.lit("")))
    cols = F.split(F.trim(head), ",")
    reason = (F.when(F.col("length") < MIN_BYTES, "too short to be a data file")
              .when(head.startswith("<") | F.lower(F.substring(head, 1, 200)).contains("<html"), "looks like HTML")
              .when((F.size(cols) != 2) | ~F.array_contains(F.transform(cols, lambda c: F.trim(c)), series_id), "unexpected header"))
    return f.select("path", "length", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def stem(name: Column) -> Column:
    """Series of a file: its name before the last underscore."""
    return F.regexp_extract(name, r"^(.*)_[^_]*$", 1)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """series, file, sha256, bytes, downloaded_at from sidecars, one multi-line JSON record per file."""
    raw = spark.read.schema("raw_file string, sha256 string, bytes long, downloaded_at string").option("multiLine", True).json(path)
    return raw.select(stem(F.col("raw_file")).alias("series"), F.col("raw_file").alias("file"), "sha256", "bytes", "downloaded_at")


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for path in batch["path"].to_pylist():
            if path.startswith("file:"):
                system, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            else:
                system, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(sums, pa.string())], ["path", "length", "sha256"])


def file_digests(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path, length, sha256 of every file under `path`, of any size.

    Files of up to `whole_bytes` are one value each, summed in the JVM. The content of longer ones is
    not read by the scan: the task that holds the file's row reads it in chunks through
    Arrow's file systems (local, HDFS, object stores), so its memory does not depend on the file.
    Both ways give the same sum; the split is by length alone and every file is in one of them. Files without a byte,
    which a scan skips, are added from its listing.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    short = f.where(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    long = f.where(F.col("length") > whole_bytes).select("path", "length")
    none = _empty_files(f).select(F.try_url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))).alias("path"),
                                  F.lit(0).cast("long").alias("length"), F.sha2(F.lit(b""), 256).alias("sha256"))
    return short.unionByName(long.mapInArrow(_in_chunks, "path string, length long, sha256 string")).unionByName(none)


def pinned_snapshots(spark: SparkSession, path: str, provenance: DataFrame, series: DataFrame, strict: bool = False) -> DataFrame:
    """series, file, pinned_by, sha_ok of each row of `series`: the file it is pinned to and whether its checksum agrees.

    `provenance` has series, file, sha256 and, if known, bytes. Without a record the series'
    last file by name is used and `pinned_by` says so. A series without any file, and a
    record whose file is not there, are errors. Checksums come from `file_digests`; if the
    recorded length already differs the checksum cannot agree.
    """
    f = file_digests(spark, path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    got = f.select(name.alias("file"), stem(name).alias("series"), F.col("sha256").alias("actual"), "length")
    newest = got.groupBy("series").agg(F.max("file").alias("newest"))
    if "bytes" not in provenance.columns:
        provenance = provenance.withColumn("bytes", F.lit(None).cast("long"))
    p = series.select("series").join(provenance.select("series", "file", "sha256", "bytes"), "series", "left").join(newest, "series", "left")
    p = p.withColumn("use", F.coalesce("file", "newest")).drop("file")
    j = p.join(got.select(F.col("file").alias("use"), "actual", "length"), "use", "left")
    there = F.when(F.col("actual").isNull(), F.raise_error(F.concat(F.lit("no file for series "), F.col("series")))).otherwise(F.col("use"))
    same = F.col("sha256").isNull() | ((F.col("sha256") == F.col("actual")) & F.coalesce(F.col("bytes") == F.col("length"), F.lit(True)))
    out = j.select("series", there.alias("file"), F.when(F.col("sha256").isNull(), "newest file").otherwise("provenance").alias("pinned_by"), same.alias("sha_ok"))
    if strict:
        out = out.withColumn("file", F.when(~F.col("sha_ok"), F.raise_error(F.concat(F.lit("checksum mismatch for "), F.col("series")))).otherwise(F.col("file")))
    return out
