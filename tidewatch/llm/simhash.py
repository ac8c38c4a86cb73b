"""SimHash near-dedup: segment bit counts as coordinates, a grid range-join, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import LAST_ID, narrowed, packed, shuffled, written
from tidewatch.llm.components import components
from tidewatch.llm.words import slices

SHINGLE, SEED, RADIUS = 4, 42, 4
#: bits per segment, and how many groups of segments span a grid of their own
SEGMENT_BITS, GROUPS = 2, 3
#: most points of a cell that are compared in one piece; larger cells are compared piece by piece
PIECE = 8192
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """64 bits; bit k is set if it is set in more than half of the hashes of all 4-word shingles."""
    words = text.translate(_LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(SHINGLE, len(words))
    hashed = xxhash.xxh64_intdigest
    ends = end[k - 1:].tolist()
    h = np.array([hashed(line[a:b], SEED) for a, b in zip(start.tolist(), ends, strict=False)], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, d (order key), fp (the 64 bits as a signed long) of every whole text, in one pass without a shuffle."""
    rows = narrowed(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t) for t in part.column(2).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], names=["id", "d", "fp"])

    return rows.mapInArrow(run, "id long, d long, fp long")


def bit_counts(fp: np.ndarray) -> np.ndarray:
    """Bits set in each segment: one coordinate per segment. Their Manhattan distance is at most the Hamming distance."""
    at = np.arange(0, 64, SEGMENT_BITS, dtype=np.uint64)
    return np.bitwise_count((fp[:, None] >> at) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)


def _cells(fps: DataFrame) -> DataFrame:
    """cell, fp, home: a point's own grid cell in each group of segments and the cells one step above it.

    Points within Hamming distance 4 are within Manhattan distance 4, so within 1 in at least
    one of the three groups: they share a cell there, or one lies a step above the other.
    """
    groups = np.array_split(np.arange(64 // SEGMENT_BITS), GROUPS)
    assert RADIUS // GROUPS == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0).slice(lo, 1 << 14).to_numpy().view(np.uint64)
                point = bit_counts(fp)
                cell, who, home = [], [], []
                for g, dims in enumerate(groups):
                    step = (SEGMENT_BITS + 1) ** np.arange(len(dims), dtype=np.int64) * GROUPS
                    own = point[:, dims] @ step + g
                    row, dim = np.nonzero(point[:, dims] < SEGMENT_BITS)
                    cell += [own, own[row] + step[dim]]
                    who += [np.arange(len(fp)), row]
                    home += [np.ones(len(fp), bool), np.zeros(len(row), bool)]
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(fp[who].view(np.int64)), pa.array(np.concatenate(home))],
                                                 names=["cell", "fp", "home"])

    return fps.mapInArrow(run, "cell long, fp long, home boolean")


def _forest(home: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between points within the radius that connect whatever the home points' pairs connect.

    Points are visited breadth first, each once, and compared with those not yet reached; the
    edges are at most as many as the points, also among thousands of near copies.
    """
    left, right = [], []
    rest, homes = np.concatenate([home, guest]), len(home)
    is_home = np.arange(len(rest)) < homes
    near = np.zeros(len(rest), bool)
    for lo in range(0, homes, 256):  # most points of a cell have no neighbour: they are left out first
        close = np.bitwise_count(home[lo:lo + 256, None] ^ rest) <= RADIUS
        close[np.arange(close.shape[0]), lo + np.arange(close.shape[0])] = False
        hit = close.any(axis=1)
        near[lo:lo + len(hit)] |= hit
        near |= close.any(axis=0)
    rest, is_home = rest[near], is_home[near]
    while len(rest) and is_home[0]:
        front, rest, is_home = rest[:1], rest[1:], is_home[1:]
        while len(front) and len(rest):
            now, front = front[:256], front[256:]
            close = np.bitwise_count(now[:, None] ^ rest) <= RADIUS
            hit = close.any(axis=0)
            if hit.any():
                left.append(now[close[:, hit].argmax(axis=0)])
                right.append(rest[hit])
                front = np.concatenate([front, rest[hit]])
                rest, is_home = rest[~hit], is_home[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(cells: DataFrame) -> DataFrame:
    """a, b: linked fingerprints, enough of them to connect all that links connect.

    Cells with one point are dropped. The rest are compared cell by cell in sorted streams. A cell
    of over PIECE points is dealt out in pieces: a group holds one pair of pieces and compares it in full.
    """
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 AND any_home")
    some = cells.join(shuffled(sizes.select("cell", "n")), "cell")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    mine = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    some = some.withColumn("pieces", pieces).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    some = some.select("cell", "fp", "home", "mine", other)
    some = some.select("cell", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> list[pa.RecordBatch]:
            """Compares the finished cells of the held rows and keeps the unfinished one."""
            if not held:
                return []
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t[c].to_numpy() for c in ("cell", "p", "q")], axis=1)
            heads = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
            stop = len(heads) - 1 if last else len(heads) - 2
            fp, home = t["fp"].to_numpy().view(np.uint64), t["home"].to_numpy()
            found = []
            for k in range(stop):
                f, h = fp[heads[k]:heads[k + 1]], home[heads[k]:heads[k + 1]]
                if len(f) > 1 and h.any():
                    found.append(_forest(f[h], f[~h]))
            held[:] = [t.slice(heads[stop]).combine_chunks().to_batches()[0]] if not last and heads[stop] < len(key) else []
            if not found:
                return []
            return [pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]).view(np.int64)) for k in (0, 1)], names=["a", "b"])]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from flush(False)
        yield from flush(True)

    key = ["cell", "p", "q"]
    return some.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) within the radius, enough of them to connect all that such links connect."""
    return _links(_cells(fps))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id of every row: documents whose fingerprints are linked in a chain share a component.

    Fingerprints link at Hamming distance 4 or less, with no link lost. Equal fingerprints are
    one point from the start, so copies are never paired with each other. component_id is the
    smallest id of the component (a missing id counts as the largest, and a component of
    missing ids has none). A missing text counts as empty; texts without words have
    fingerprint zero, linked like any other. Repeated rows and ids need no special case.
    """
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    points = written(docs.groupBy("fp").agg(F.min("d").alias("low")), "points")
    roots = components(links(points.select("fp")))
    named = points.join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = named.groupBy("root").agg(F.min("low").alias("low"))
    of = named.select("fp", "root").join(lows, "root").select("fp", F.when(F.col("low") != LAST_ID, F.col("low")).alias("component_id"))
    return docs.join(shuffled(of), "fp").select("id", "fp", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """`df`'s rows of one document per component of `groups`, all columns: those with the component's smallest id.

    Rows that share that id are all of that document. Rows without an id stay only where
    their component has no other.
    """
    kept = groups(df, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.coalesce("id", F.lit(LAST_ID)).alias("d")).distinct()
    rows = df.select(packed(df), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("d"))
    return rows.join(kept.hint("shuffle_hash"), "d", "left_semi").select("row.*")
