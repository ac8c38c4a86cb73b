"""A training corpus from raw documents: filter, dedup twice, mix, tokenize.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
rows as Parquet to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, line_dedup, mixing, near_copies, quality, simhash
from tidewatch.llm.common import documents, partitions, written
from tidewatch.llm.queries import TARGETS, tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go."""
    return quality.quality(docs, whole=True).where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text. A document may end up empty."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more): the one with the smallest id.

    Candidates come from op9's SimHash join and from MinHash bands; the shingle sets decide.
    """
    return simhash.representatives(docs, groups=near_copies.near_copies)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with slot and place: in that order the sources come at their target weights."""
    return mixing.mixed(docs, TARGETS, placed=True)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, slot, place, n_tokens, ids, ids_sha256, decoded_sha256 of each document, sorted by slot and place."""
    # a scan packs files by size, so the order is made anew, from the columns, before the map-only encoding
    docs = docs.repartitionByRange(partitions(spark), "slot", "place").sortWithinPartitions("slot", "place")
    out = bpe.round_trip(docs.select(F.struct("doc_id", "source", "slot", "place").alias("at"), "text"), tokenizer_file(), "at")
    return out.select("doc_id.*", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near-dedup", near_duplicate_stage),
          ("source mixing", mixing_stage), ("bpe encoding", token_stage)]

#: near-dedup and BPE have no SQL form; the tests compare run() with a plain Python version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
