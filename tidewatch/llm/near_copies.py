"""Near copies by exact Jaccard similarity of word shingles: SimHash links and MinHash bands propose, shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import simhash
from tidewatch.llm.common import LAST_ID, narrowed, written
from tidewatch.llm.components import components
from tidewatch.llm.words import Words, binaries, mixed, slices, values_of, windows

SHINGLE = 5
#: least similarity of a link, as a fraction, so that the comparison is one of whole numbers
LEAST = (4, 5)
#: a pair meets if one band of ROWS smallest hashes agrees; at similarity 0.8 that fails for 6 pairs in 100,000
BANDS, ROWS = 32, 6
#: bytes of shingle sets that are compared in one piece; larger groups are compared piece by piece
PIECE_BYTES = 4 << 20
_rng = np.random.default_rng(20240307)
_FACTORS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the bounds of each text's.

    A text of fewer words has one shingle of all its words, a text without words none. A-Z count as a-z.
    """
    w = Words(text, lower=True)
    h = w.hashes()
    every = mixed(windows(h, SHINGLE))
    out, bounds = [np.zeros(0, np.uint64)], np.zeros(len(w.per_text) + 1, np.int64)
    for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            out.append(np.unique(every[a:b - SHINGLE + 1]) if b - a >= SHINGLE else mixed(windows(h[a:b], b - a)))
            bounds[k + 1] = len(out[-1])
    return np.concatenate(out), np.cumsum(bounds)


def _bands(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One key per band of every set with a member."""
    head = bounds[:-1][bounds[1:] > bounds[:-1]]
    out = np.empty((len(head), BANDS), np.uint64)
    for band in range(BANDS if len(head) else 0):
        key = np.full(len(head), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(sets * _FACTORS[k] + _SHIFTS[k], head))
        out[:, band] = key
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """id, d, th (hash of the text), p (digest of the shingle set), fp (op9's fingerprint) and the keys of the set's bands, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            sets, bounds = shingle_sets(part.column(3))
            raw = sets.tobytes()
            p = np.array([xxhash.xxh64_intdigest(raw[8 * a:8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.uint64)
            fp = np.array([simhash.fingerprint(t) for t in part.column(3).cast(pa.binary()).to_pylist()], np.uint64)
            at = np.r_[0, np.cumsum(bounds[1:] > bounds[:-1])] * BANDS
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(p.view(np.int64)), pa.array(fp.view(np.int64)),
                                              binaries(_bands(sets, bounds).reshape(-1), at)], names=["id", "d", "th", "p", "fp", "bands"])

    return docs.select("id", "d", "th", "text").mapInArrow(run, "id long, d long, th long, p long, fp long, bands binary")


def _cells(points: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = values_of(batch.column(1), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], names=["cell", "p"])

    return points.select("p", "bands").mapInArrow(run, "cell long, p long")


def _fingerprint_ties(prints: DataFrame) -> DataFrame:
    """a, b: points (`prints`: p, fp) whose SimHash fingerprints are equal, or linked by op9's grid join within its 4 bits.

    A fingerprint stands for its smallest point, and the join gives enough links to connect
    all that its links connect, so the points of one SimHash group are one group here too.
    """
    heads = prints.groupBy("fp").agg(F.min("p").alias("a"))
    same = prints.join(heads, "fp").where("a <> p").select("a", F.col("p").alias("b"))
    links = simhash.links(heads.select("fp")).toDF("fa", "fb")
    left, right = heads.select(F.col("fp").alias("fa"), "a"), heads.select(F.col("fp").alias("fb"), F.col("a").alias("b"))
    return same.union(links.join(left, "fa").join(right, "fb").where("a <> b").select("a", "b"))


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between similar sets that connect whatever all such links connect, breadth first: one less than the sets at most."""
    size = np.array([len(s) for s in sets], np.int64)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    first = np.r_[0, np.cumsum(size)]
    wanted, new = np.zeros(len(shingle) + 1, bool), np.ones(len(sets), bool)
    rest_shingle, rest_owner, out = shingle, owner, []
    for start in range(len(sets)):
        if not new[start]:
            continue
        new[start] = False
        front = [start]
        while front and new.any():
            keep = new[rest_owner]
            rest_shingle, rest_owner = rest_shingle[keep], rest_owner[keep]
            found = []
            for x in front:
                mine = shingle[first[x]:first[x + 1]]
                wanted[mine] = True
                common = np.bincount(rest_owner[wanted[rest_shingle]], minlength=len(sets))
                wanted[mine] = False
                hit = np.flatnonzero(new & (LEAST[1] * common >= LEAST[0] * (size[x] + size - common)))
                new[hit] = False
                found += hit.tolist()
                out += [(x, y) for y in hit.tolist()]
            front = found
    return out


def _links(docs: DataFrame, points: DataFrame, prints: DataFrame) -> DataFrame:
    """a, b: linked points, enough of them to connect all that links connect.

    Points that share a band are tied to the smallest one there, and points of one SimHash group are
    tied as well; whatever these ties connect is one group, so that a point's shingle set moves to one place. A group of more than
    PIECE_BYTES is dealt out as pairs of pieces, each compared in full.
    """
    cells = _cells(points)
    heads = cells.groupBy("cell").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a < b").select("cell", "a")
    ties = cells.join(heads, "cell").where("a <> p").select("a", F.col("p").alias("b"))
    ties = ties.union(_fingerprint_ties(prints)).distinct()
    groups = written(components(ties).withColumnRenamed("node", "p"), "groups")
    some = points.join(groups, "p").select("p", "root", F.col("at.d").alias("d"), F.col("at.th").alias("th"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            sets, bounds = shingle_sets(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binaries(sets, bounds)], names=["root", "p", "set"])

    held = docs.select("d", "th", "text").join(some, ["d", "th"]).select("root", "p", "text").mapInArrow(members, "root long, p long, set binary")
    held = written(held, "shingle_sets")
    pieces = held.groupBy("root").agg(F.ceil(F.sum(F.length("set")) / PIECE_BYTES).cast("int").alias("pieces"))
    held = held.join(pieces, "root").withColumn("mine", F.pmod(F.xxhash64("p"), "pieces").cast("int"))
    held = held.select("root", "p", "set", "mine", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    held = held.select("root", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "p", "set")

    def compare(group: pa.Table) -> pa.Table:
        values, sizes = values_of(group["set"], np.uint64)
        points, at = np.unique(group["p"].to_numpy(), return_index=True)  # rows with one id and text are one point
        end = np.cumsum(sizes)
        pairs = linked([values[end[k] - sizes[k]:end[k]] for k in at.tolist()])
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": points[a], "b": points[b]})

    return held.groupBy("root", "x", "y").applyInArrow(compare, "a long, b long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id of every row: documents joined by a chain of pairs of Jaccard similarity 0.8 or more share a component.

    Similarity is that of the sets of distinct 5-word shingles, held as 64-bit hashes. Every link
    is decided on the whole sets; pairs are proposed by op9's SimHash join and by MinHash bands, and a pair
    that neither proposes is not looked at. Texts with equal
    sets (those without words too) are one point from the start. component_id is the smallest id
    of the component: a missing id counts as the largest, and a component of missing ids has none.
    """
    docs = narrowed(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    signed = written(_signed(docs), "signatures")
    points = written(signed.groupBy("p").agg(F.first("bands").alias("bands"), F.min(F.struct("d", "th")).alias("at")), "points")
    roots = components(_links(docs, points, written(signed.select("p", "fp").distinct(), "prints")))
    named = points.join(roots.withColumnRenamed("node", "p"), "p", "left").select("p", F.coalesce("root", "p").alias("root"), F.col("at.d").alias("low"))
    lows = named.groupBy("root").agg(F.min("low").alias("low"))
    of = named.select("p", "root").join(lows, "root").select("p", F.when(F.col("low") != LAST_ID, F.col("low")).alias("component_id"))
    return signed.select("id", "p").join(of, "p").select("id", "component_id")
