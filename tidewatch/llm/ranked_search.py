"""Ranked lexical search over a length-stratified index.

Documents of one length normaliser m are a stratum. The index holds, for each segment (some MB of
consecutive texts), term and m, the documents by term frequency, so an impact is computed once for
each (m, tf). The best impact of every query term in a stratum bounds what its documents can score:
the best-bounded strata are scored first, their k-th score is what the others must reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import LAST_ID, UPPER, LOWER, partitions, written
from tidewatch.llm.terms import PATTERN, Terms, expanded
from tidewatch.llm.words import slices

#: bytes of text in a segment, documents scored in one group, and query terms searched at once
SEGMENT_BYTES, GROUP_DOCS, BLOCK_TERMS = 8 << 20, 1 << 15, 50_000
#: bits of a segment's number that count the segments of one task
_PER_TASK = 32
#: code of the rows that list a segment's documents instead of postings
DIRECTORY = -1

INDEX = "seg long, term string, m int, tf int, docs array<long>"


@dataclass(frozen=True)
class Index:
    """postings: seg, term, m, tf, docs (numbers in the segment), and one row a segment, term missing, with the ids of its documents."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def normaliser(terms: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L in whole numbers."""
    return 50 + 50 * terms * n_docs // max(n_terms, 1)


def impact(m: np.ndarray | Column, tf: np.ndarray | Column):
    """(1000000000 tf) div (1000 tf + 20 m), for arrays or columns of whole numbers."""
    if isinstance(m, Column):
        return F.floor((1_000_000_000 * tf.cast("long")) / (1000 * tf.cast("long") + 20 * m.cast("long")))
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of all rows of `df`, written to the shared folder. Two passes over the texts, no shuffle.

    A missing text has no term; documents without terms are in no stratum. Every row is a document
    of its own, also where ids repeat or are missing.
    """
    text = F.col(f"`{text_col}`").alias("text")
    total = df.select(text).mapInArrow(_sizes, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId() << _PER_TASK, 0
        for batch in slices(batches, "text", SEGMENT_BYTES):
            yield _segment(task + k, batch.column("id"), Terms(batch.column("text")), n_docs, n_terms)
            k += 1

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text).mapInArrow(segments, INDEX)
    return Index(written(rows, "postings"), n_docs, n_terms)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SEGMENT_BYTES):
        per = Terms(batch.column("text")).per_text
        yield pa.RecordBatch.from_pydict({"n_docs": pa.array([int((per > 0).sum())], pa.int64()), "n_terms": pa.array([int(per.sum())], pa.int64())})


def _segment(seg: int, ids: pa.Array, terms: Terms, n_docs: int, n_terms: int) -> pa.RecordBatch:
    coded = terms.strings().dictionary_encode()
    size, n = max(len(coded.dictionary), 1), len(ids)
    pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + terms.doc, return_counts=True)
    code, doc = pair // n, pair % n
    m = normaliser(terms.per_text, n_docs, n_terms)[doc]
    order = np.lexsort((doc, tf, m, code))
    code, doc, m, tf = code[order], doc[order], m[order], tf[order]
    heads = np.r_[True, (code[1:] != code[:-1]) | (m[1:] != m[:-1]) | (tf[1:] != tf[:-1])] if len(code) else np.zeros(0, bool)
    head = np.flatnonzero(heads)
    bounds = np.r_[0, n, n + head[1:], n + len(code)] if len(code) else np.array([0, n])
    known = ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    names = pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.cast(pa.string()).take(pa.array(code[head]))])
    numbers = lambda x: pa.array(np.r_[0, x[head]].astype(np.int32), mask=np.r_[True, np.zeros(len(head), bool)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(head) + 1, seg, np.int64)), names, numbers(m), numbers(tf),
                                       pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.r_[known, doc]))],
                                      ["seg", "term", "m", "tf", "docs"])


@dataclass(frozen=True)
class Block:
    """Query rows searched together: their ids and the codes of their distinct terms."""

    ids: list
    terms: dict[str, int]
    codes: list[np.ndarray]


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Queries in blocks of about BLOCK_TERMS terms, one query at least, read one partition at a time."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    rows = queries.select(F.col(f"`{id_col}`"), F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    ids, terms, codes, held = [], {}, [], 0
    for i, words in rows.toLocalIterator():
        if ids and held + len(words) > BLOCK_TERMS:
            yield Block(ids, terms, codes)
            ids, terms, codes, held = [], {}, [], 0
        ids.append(i)
        codes.append(np.array(sorted(terms.setdefault(w, len(terms)) for w in words), np.int64))
        held += max(len(words), 1)
    if ids:
        yield Block(ids, terms, codes)


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank, doc, score: for every query the k documents of highest score above 0, ties by smaller id.

    The score is the sum over a query's distinct terms of weight times impact, in whole numbers;
    the weight is floor(1000 ln((2 N + 2) / (2 df + 1))). Queries come in blocks; each block reads
    its terms' postings once, bounds every (query, stratum), scores the best-bounded strata that
    surely hold k documents, then all other strata whose bound reaches the k-th score so found. A
    stratum is scored in groups of documents, so a length or a text that a third of all documents
    share is spread over tasks. Each query row counts for itself; a query without terms has no rows.
    A missing document id comes after all others. An empty index gives an empty table.
    """
    spark, out = index.postings.sparkSession, None
    for block in query_blocks(queries, id_col, text_col):
        part = _search_block(spark, index, block, k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"q int, item {queries.schema[id_col].dataType.simpleString()}")
        part = part.join(F.broadcast(names), "q").select("item", "rank", F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc"), "score")  # a row per query of a block
        out = part if out is None else out.union(part)
    if out is None:
        kind = queries.schema[id_col].dataType.simpleString()
        out = spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    return out


def _search_block(spark: SparkSession, index: Index, block: Block, k: int) -> DataFrame:
    # BLOCK_TERMS bounds this table, but for a single query of more terms: its size decides how it is joined
    terms = written(spark.createDataFrame(list(block.terms.items()), "term string, code int").coalesce(1), "terms")
    hits = index.postings.join(terms, "term").select("seg", "code", "m", "tf", "docs")
    directory = index.postings.where("term IS NULL").select("seg", F.lit(DIRECTORY).alias("code"), "m", "tf", "docs")
    hits = written(hits.union(directory), "hits")
    strata = written(hits.where(f"code <> {DIRECTORY}").groupBy("code", "m").agg(F.max("tf").alias("tf"), F.sum(F.size("docs").cast("long")).alias("n")), "strata")
    found = dict(strata.groupBy("code").agg(F.sum("n")).collect())
    weight = np.zeros(len(block.terms), np.int64)
    for code, df in found.items():
        weight[code] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1)))
    groups = max(partitions(spark), -(-index.n_docs // GROUP_DOCS))
    hits = hits.withColumn("part", F.pmod(F.xxhash64("seg"), F.lit(groups)))

    first = _first_strata(spark, strata, block, weight, k)
    lengths = sorted({m for ms in first for m in ms})
    start = written(_top(_scored(hits.where((F.col("code") == DIRECTORY) | F.col("m").isin(lengths)), block, weight, k, first, None), k), "start")
    least = np.ones(len(block.ids), np.int64)  # a score above 0
    for q, score in start.where(F.col("rank") == k).select("q", "score").collect():
        least[q] = score
    rest = _scored(hits, block, weight, k, first, least)
    return _top(start.drop("rank").union(rest), k)


def _first_strata(spark: SparkSession, strata: DataFrame, block: Block, weight: np.ndarray, k: int) -> list[list[int]]:
    """For each query its best-bounded strata, until they surely hold k documents with a term (at most k strata)."""
    pairs = [(q, int(c), int(weight[c])) for q, codes in enumerate(block.codes) for c in codes if weight[c] > 0]
    table = written(spark.createDataFrame(pairs, "q int, code int, w long").coalesce(1), "weights")
    bounds = strata.join(table, "code").groupBy("q", "m").agg(F.sum(F.col("w") * impact(F.col("m"), F.col("tf"))).alias("bound"), F.max("n").alias("sure"))
    w = Window.partitionBy("q").orderBy(F.desc("bound"), "m")
    best = bounds.withColumn("before", F.sum("sure").over(w) - F.col("sure")).where(F.col("before") < k)
    out = [[] for _ in block.ids]
    for q, m in best.select("q", "m").collect():
        out[q].append(m)
    return out


def _top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "doc", "seg", "at")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scored(hits: DataFrame, block: Block, weight: np.ndarray, k: int, first: list[list[int]], least: np.ndarray | None) -> DataFrame:
    """q, doc, seg, at, score: of every group of documents the k best of each query.

    Without `least` only a query's `first` strata are scored; with it the others whose bound, from
    the best tf of each term in the group, reaches the query's least score.
    """
    codes, chosen = block.codes, [np.array(sorted(ms), np.int64) for ms in first]

    def score(table: pa.Table) -> pa.Table:
        code = table["code"].to_numpy()
        own = table.filter(pa.array(code == DIRECTORY))
        docs = own["docs"].combine_chunks()
        per = docs.value_lengths().to_numpy(zero_copy_only=False)
        segs = own["seg"].to_numpy()
        order = np.argsort(segs)
        base = (np.cumsum(per) - per)[order]
        ids = docs.flatten().to_numpy(zero_copy_only=False)
        table = table.filter(pa.array(code != DIRECTORY)).sort_by([("code", "ascending"), ("m", "ascending"), ("tf", "ascending")])
        code, m, tf, seg = (table[c].to_numpy().astype(np.int64) for c in ("code", "m", "tf", "seg"))
        lists = table["docs"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        member = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(base[np.searchsorted(segs[order], seg)], size)
        gain = impact(m, tf)  # once for each (term, m, tf), whatever the number of documents
        tops = np.r_[(code[1:] != code[:-1]) | (m[1:] != m[:-1]), True] if len(code) else np.zeros(0, bool)
        levels, level = np.unique(m, return_inverse=True)
        low, high = np.searchsorted(code, np.arange(len(weight))), np.searchsorted(code, np.arange(len(weight)), "right")
        out = []
        for q, terms in enumerate(codes):
            terms = terms[(weight[terms] > 0) & (high[terms] > low[terms])]
            rows = expanded(low[terms], high[terms] - low[terms])
            value = weight[code[rows]] * gain[rows]
            picked = np.isin(levels, chosen[q])
            if least is not None:
                top = tops[rows]
                bound = np.zeros(len(levels), np.int64)
                np.add.at(bound, level[rows[top]], value[top])
                picked = ~picked & (bound >= least[q])
            stay = picked[level[rows]]
            rows, value = rows[stay], value[stay]
            if not len(rows):
                continue
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, member[expanded(begin[rows], size[rows])], np.repeat(value, size[rows]))
            best = np.flatnonzero(total >= (1 if least is None else least[q]))
            if len(best) > k:
                best = best[total[best] >= np.partition(total[best], len(best) - k)[len(best) - k]]
                best = best[np.lexsort((best, ids[best], -total[best]))][:k]
            out.append((q, best, total[best]))
        where = np.concatenate([b for _, b, _ in out]) if out else np.zeros(0, np.int64)
        part = np.searchsorted(np.cumsum(per), where, "right")
        return pa.table({"q": pa.array(np.repeat([q for q, _, _ in out], [len(b) for _, b, _ in out]).astype(np.int32)), "doc": pa.array(ids[where]),
                         "seg": pa.array(segs[part] if len(segs) else where), "at": pa.array(where - (np.cumsum(per) - per)[part] if len(segs) else where),
                         "score": pa.array(np.concatenate([s for _, _, s in out]) if out else np.zeros(0, np.int64))})

    return hits.groupBy("part").applyInArrow(score, "q int, doc long, seg long, at long, score long")
