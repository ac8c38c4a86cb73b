"""Line dedup: range-partitioned line hashes, streamed first occurrences, keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import BLANKS, LAST_ID, ascii_lower, let, narrowed, packed, partitions, written


def line_key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Run-length compressed keep bitmaps of the documents that lose lines: d, th, n_lines, n_dropped, keep.

    Every line whose key (stripped, A-Z lower-cased) has `min_chars` code points or more
    becomes one row of hash, document and position; no text is moved. The rows are
    range-partitioned by hash with document and position as secondary sort, and each run
    of equal hashes is streamed: lines of documents after the first holder are dropped.
    Keys that fill a quarter of a partition or more (at most four per partition, so their
    table may be broadcast) are compared with their smallest document where they lie,
    whatever share of the rows they have.

    `keep` is an array of runs (start, n) of kept lines. A document is identified by its id
    and its text's hash th: repeated rows get one bitmap, rows that share an id never drop
    each other's lines. A missing id counts as the largest id, an empty or missing text as
    one empty line (never dropped when min_chars > 0). An empty table gives an empty one.
    """
    lines = F.split(ascii_lower(F.col("text")), "\n", -1)
    rows = (narrowed(df, id_col, text_col)
            .select("d", F.xxhash64("text").alias("th"), lines.alias("lines"))
            .select("d", "th", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
            .select("d", "th", "n_lines", "pos", line_key(F.col("line")).alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "d", "th", "pos", "n_lines"))
    rows = written(rows, "lines")
    parts = partitions(df.sparkSession)
    heavy = rows.count() // (4 * parts) + 1
    hot = F.broadcast(rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("d").alias("first"))
                      .where(F.col("n") >= heavy).drop("n"))
    run = W.partitionBy("h1", "h2").orderBy("d", "th", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    streamed = (rows.join(hot, ["h1", "h2"], "left_anti").repartitionByRange(parts, "h1", "h2")
                .withColumn("first", F.first("d").over(run)))
    found = [x.where(F.col("d") > F.col("first")).select("d", "th", "pos", "n_lines")
             for x in (streamed, rows.join(hot, ["h1", "h2"]))]
    lost = (found[0].unionByName(found[1]).groupBy("d", "th")
            .agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("gone")))
    before = F.concat(F.array(F.lit(-1)), F.col("gone"))
    after = F.concat(F.col("gone"), F.array(F.col("n_lines")))
    runs = F.zip_with(before, after, lambda p, q: F.struct((p + 1).alias("start"), (q - p - 1).alias("n")))
    return lost.select("d", "th", "n_lines", F.size("gone").alias("n_dropped"), F.filter(runs, lambda r: r["n"] > 0).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of `text` in the runs of a keep bitmap; the whole text where there is none."""
    runs = lambda lines: F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["n"])))
    return F.when(keep.isNull(), text).otherwise(let(F.split(text, "\n", -1), lambda lines: F.array_join(runs(lines), "\n")))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """`df` with `text_col` reduced to the kept lines; all columns and rows stay. A missing text stays missing.

    The bitmaps meet the texts in one shuffle, with the bitmaps as the hashed side.
    """
    maps = keep_bitmaps(df, id_col, text_col, min_chars).select("d", "th", "keep")
    text = F.col(f"`{text_col}`")
    rows = df.select(packed(df), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("d"),
                     F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    value = lambda c: kept_text(F.col(f"row.`{c}`"), F.col("keep")) if c == text_col else F.col(f"row.`{c}`")
    return rows.join(maps.hint("shuffle_hash"), ["d", "th"], "left").select(*[value(c).alias(c) for c in df.columns])


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256, and the keep bitmap's number of runs."""
    maps = keep_bitmaps(df, id_col, text_col, min_chars)
    docs = narrowed(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    both = docs.join(maps.hint("shuffle_hash"), ["d", "th"], "left")
    n = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return both.select(F.col("id").alias("doc_id"), F.coalesce("n_lines", n).cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                       F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"),
                       F.coalesce(F.size("keep"), F.lit(1)).alias("keep_runs"))
