"""Substring dedup: anchors at difference-cover positions find candidates, whole windows decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import LAST_ID, narrowed
from tidewatch.llm.words import Words, _candidates, binaries, mixed, values_of, windows

#: perfect difference sets: every residue modulo the period is a difference of two members (fixed values)
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: shortest anchor, so that chance matches of anchors are rare
ANCHOR = 8
#: bytes of text in a block, and bytes of all texts for each hash range
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 8 << 20


def cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length: two equal windows hold an equal anchor at the same offset, within the period.

    For window positions p and q some members x, y of the cover have x - y = p - q modulo the
    period, so offset x - p puts both on the cover; period - 1 + anchor length is the window.
    """
    period = max([v for v in COVERS if v + ANCHOR - 1 <= window], default=1)
    return period, COVERS[period], window - period + 1


class Block:
    """The documents of a block in order, with their anchors and windows."""

    def __init__(self, table: pa.Table, window: int):
        table = table.sort_by([("d", "ascending"), ("text", "ascending")]).combine_chunks()
        self.d = table["d"].to_numpy()
        self.window = window
        period, members, width = cover(window)
        self.words = w = Words(table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0))
        self.h = w.hashes()
        self.last = w.first[1:][w.doc] if len(self.d) else w.doc
        grams = windows(self.h, width)
        place = np.arange(len(grams))
        on = np.isin((place - w.first[w.doc[:len(grams)]]) % period, members) & (place + width <= self.last[:len(grams)])
        self.at = np.flatnonzero(on)
        self.key = mixed(grams[self.at])
        self.reach = period - 1
        self.anchors, count = np.unique(self.key, return_counts=True)
        self.twice = count > 1

    def candidates(self, shared: np.ndarray) -> None:
        """Windows that hold an anchor which occurs elsewhere (`shared`, per distinct anchor) or twice here."""
        hot = self.anchors[shared.astype(bool) | self.twice]
        if len(hot):
            slot = np.minimum(np.searchsorted(hot, self.key), len(hot) - 1)
            at = self.at[hot[slot] == self.key]
        else:
            at = self.at[:0]
        n = len(self.h)
        edge = np.bincount(np.maximum(at - self.reach, self.words.first[self.words.doc[at]]), minlength=n + 1).astype(np.int64)
        edge -= np.bincount(at + 1, minlength=n + 1)
        inside = np.cumsum(edge)[:n] > 0
        inside &= np.arange(self.window, n + self.window) <= self.last
        self.start = np.flatnonzero(inside)
        key = mixed(windows(self.h, self.window)[self.start]) if len(self.start) else np.zeros(0, np.uint64)
        self.seen, self.first, self.which = np.unique(key, return_index=True, return_inverse=True)

    def second(self) -> np.ndarray:
        """32 more bits for each distinct window."""
        if not len(self.first):
            return np.zeros(0, np.uint32)
        return (mixed(windows(self.words.hashes(1), self.window, 1)[self.start[self.first]]) >> np.uint64(32)).astype(np.uint32)

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Words covered by a window that starts earlier too, in another block (`earlier`, per distinct window) or in this one."""
        gone = earlier.astype(bool)[self.which]
        gone |= self.first[self.which] != np.arange(len(self.start))
        at, n = self.start[gone], len(self.h)
        edge = np.bincount(at, minlength=n + 1).astype(np.int64) - np.bincount(at + self.window, minlength=n + 1)
        return np.cumsum(edge)[:n] > 0

    def kept(self, gone: np.ndarray) -> list[str]:
        """Kept words of each document, joined by one space."""
        w, stay = self.words, np.flatnonzero(~gone)
        size = w.end[stay] - w.start[stay] + 1
        before = np.cumsum(size) - size
        total = int(size.sum())
        data = np.concatenate([w.data, np.zeros(1, np.uint8)])[np.repeat(w.start[stay] - before, size) + np.arange(total)]
        data[before + size - 1] = 32
        at = np.r_[before, total][np.searchsorted(stay, w.first)].tolist()
        data = data.tobytes()
        return [data[a:max(a, b - 1)].decode() for a, b in zip(at[:-1], at[1:], strict=True)]


def _by_range(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the hash ranges that sorted keys have, and those ranges."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    heads = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1] if len(part) else np.zeros(0, np.int64)
    return np.r_[heads, len(keys)], part[heads]


def _flags(table: pa.Table, kind: int, expected: int) -> np.ndarray:
    """One flag per key in key order, from the answers of all ranges."""
    rows = table.filter(pa.compute.equal(table["kind"], kind)).sort_by("part")
    out, _ = values_of(rows["flags"], np.uint8)
    if len(out) != expected:
        raise ValueError("a block's keys and their answers differ in number")
    return out


def substring_dedup(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept: every row's words without those in windows that occur earlier.

    A word goes when a window of `window` words over it occurs at an earlier start (smaller id,
    or earlier in the same text); windows are those of the input. Documents are dealt by id into
    blocks of a few MB in one shuffle that all three passes share. The first sends each block's distinct
    anchor hashes to hash ranges, which answer whether another block has them. The second
    extends: windows around shared anchors send 96 bits and their document to hash ranges, which
    answer whether an earlier block has them. The third removes. A passage costs each
    block one entry, so one that a third of all documents share makes no range large; no pairs are formed.

    A missing or empty text has no word. A missing id counts as the largest. Rows that share an
    id are ordered by text, so of repeated rows the first keeps its words. An empty table gives an empty one.
    """
    docs = narrowed(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = min(40, max(0, (size // RANGE_BYTES).bit_length()))
    base = docs.select(F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(blocks)).alias("block"), "d", "text")

    def anchors(table: pa.Table) -> pa.Table:
        b = Block(table, window)
        bounds, part = _by_range(b.anchors, bits)
        return pa.table({"part": part, "block": np.full(len(part), table["block"][0].as_py()), "keys": binaries(b.anchors, bounds)})

    def shared(table: pa.Table) -> pa.Table:
        keys, sizes = values_of(table["keys"], np.uint64)
        ordered = np.sort(keys)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        flag = again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys if len(again) else np.zeros(len(keys), bool)
        return pa.table({"block": table["block"], "part": table["part"], "kind": np.zeros(len(sizes), np.int32),
                         "flags": binaries(flag.astype(np.uint8), np.r_[0, np.cumsum(sizes)])})

    def extended(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()),
                             "more": pa.array([], pa.binary()), "docs": pa.array([], pa.binary())})
        b = Block(left, window)
        b.candidates(_flags(right, 0, len(b.anchors)))
        bounds, part = _by_range(b.seen, bits)
        return pa.table({"part": part, "block": np.full(len(part), left["block"][0].as_py()), "keys": binaries(b.seen, bounds),
                         "more": binaries(b.second(), bounds), "docs": binaries(b.d[b.words.doc[b.start[b.first]]], bounds)})

    def earlier(table: pa.Table) -> pa.Table:
        keys, sizes = values_of(table["keys"], np.uint64)
        more, _ = values_of(table["more"], np.uint32)
        doc, _ = values_of(table["docs"], np.int64)
        block = np.repeat(table["block"].to_numpy(), sizes)
        some = _candidates(keys)
        order = some[np.lexsort((block[some], doc[some], more[some], keys[some]))]
        flag = np.zeros(len(keys), np.uint8)
        flag[order[1:][(keys[order[1:]] == keys[order[:-1]]) & (more[order[1:]] == more[order[:-1]])]] = 1
        return pa.table({"block": table["block"], "part": table["part"], "kind": np.ones(len(sizes), np.int32), "flags": binaries(flag, np.r_[0, np.cumsum(sizes)])})

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"d": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        b = Block(left, window)
        b.candidates(_flags(right, 0, len(b.anchors)))
        gone = b.removed(_flags(right, 1, len(b.seen)))
        sums = np.r_[0, np.cumsum(gone)]
        return pa.table({"d": b.d, "n_words": b.words.per_text.astype(np.int64), "n_removed": sums[b.words.first[1:]] - sums[b.words.first[:-1]],
                         "kept": pa.array(b.kept(gone), pa.string())})

    answer = "block long, part long, kind int, flags binary"
    first = base.groupBy("block").applyInArrow(anchors, "part long, block long, keys binary").groupBy("part").applyInArrow(shared, answer)
    second = (base.groupBy("block").cogroup(first.groupBy("block"))
              .applyInArrow(extended, "part long, block long, keys binary, more binary, docs binary").groupBy("part").applyInArrow(earlier, answer))
    out = base.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(removed, "d long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("d") != LAST_ID, F.col("d")).alias("id"), "n_words", "n_removed", "kept")
