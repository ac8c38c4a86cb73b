"""Sharding: a Feistel permutation of global row numbers gives shuffle, shard and slot."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewatch.llm.common import narrowed, numbered, written

ROUNDS = 6


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser (fixed values: the public splitmix64 multipliers)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permuted(r: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Image of row numbers 0..n-1 under the seeded permutation of 0..n-1.

    A balanced Feistel network permutes the smallest even-bit power of two that holds n;
    images of n or more walk on along their cycle. The domain is below 4n, so a walk takes
    fewer than four steps on average.
    """
    b = np.uint64(_half_bits(n))
    mask = (np.uint64(1) << b) - np.uint64(1)
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    out = np.array(r, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> b, out[todo] & mask
        for k in order:
            if inverse:
                left, right = right ^ (_mixed(left, seed * ROUNDS + k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, seed * ROUNDS + k) & mask)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permutation(r: Column, n: int, seed: int, inverse: bool = False) -> Column:
    @F.pandas_udf(LongType())
    def walk(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, seed, inverse))
    return walk(r)


def row_of(shard: Column, slot: Column, shards: int, n: int, seed: int) -> Column:
    """The global row number at a shard and slot: the table can be read in shuffled order without a lookup."""
    return permutation(slot * shards + shard, n, seed, inverse=True)


def assign_shards(df: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, r (global row number), shard and slot of every row.

    Rows are numbered in the order of id, text checksum and size (a missing id last), so the
    numbering, and with it the shuffle, is a function of the table's content. Row r goes to
    shard p(r) mod `shards`, slot p(r) div `shards`: shard sizes differ by one at most, slots
    have no gaps, and repeated rows, which are interchangeable, get places of their own. Only
    id, checksum and size are moved. A missing or empty text has size 1 and checksum 0. An
    empty table gives an empty one.
    """
    docs = narrowed(df, id_col, text_col).select("id", "d", (F.octet_length("text") + 1).cast("long").alias("size"),
                                                 F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    rows = numbered(written(docs, "sizes"), ["d", "text_crc32", "size"], "numbered")
    n = rows.count()
    p = rows.withColumn("p", permutation(F.col("r"), n, seed))
    return p.select("id", "size", "text_crc32", "r", (F.col("p") % shards).cast("int").alias("shard"),
                    F.floor(F.col("p") / shards).alias("slot"))
