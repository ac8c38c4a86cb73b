"""Mixing sources to target weights: Pfair windows and earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import LAST_ID, packed, partitions, written

#: most slots of one schedule period
PERIOD = 1000


def shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots per period and source, at least one.

    Weights in a ratio of whole numbers that add up to `period` or less are kept exactly;
    others are rounded to multiples of 1/`period` by largest remainders.
    """
    if len(weights) > period:
        raise ValueError("more sources than slots in a period")
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    ratio = {s: Fraction(w).limit_denominator(period) for s, w in weights.items()}
    unit = math.lcm(*(f.denominator for f in ratio.values()))
    whole = {s: int(f * unit) for s, f in ratio.items()}
    common = math.gcd(*whole.values())
    if all(float(ratio[s]) == float(w) for s, w in weights.items()) and sum(whole.values()) <= period * common:
        return {s: n // common for s, n in whole.items()}
    total = float(sum(weights.values()))
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(out, key=lambda s: (out[s] - exact[s], s))
    while sum(out.values()) < period:
        s = min(order, key=lambda s: (out[s] - exact[s], s))
        out[s] += 1
    while sum(out.values()) > period:
        s = max((s for s in order if out[s] > 1), key=lambda s: (out[s] - exact[s], s))
        out[s] -= 1
    return out


def period_schedule(share: Mapping[str, int]) -> dict[str, list[int]]:
    """Slot of each source's blocks within one period.

    Block j (from 0) of a source with p of P slots is released at floor(j P / p) and due by
    ceil((j + 1) P / p). In every slot the released block with the earliest deadline runs.
    With the shares adding up to P every deadline is met, so that after any number of slots
    a source is less than one block ahead of or behind its weight.
    """
    period = sum(share.values())
    waiting = sorted(((j * period) // p, -(-(j + 1) * period // p), s) for s, p in share.items() for j in range(p))
    out: dict[str, list[int]] = {s: [] for s in share}
    ready: list[tuple[int, str]] = []
    k = 0
    for slot in range(period):
        while k < len(waiting) and waiting[k][0] <= slot:
            heapq.heappush(ready, waiting[k][1:])
            k += 1
        due, s = heapq.heappop(ready)
        assert due > slot
        out[s].append(slot)
    return out


def phases(weights: Mapping[str, float], blocks: Mapping[str, int], period: int = PERIOD) -> list[tuple]:
    """(source, first block, end block, first slot, share, period, slots of its blocks in a period), one row per source and phase.

    A phase ends when a source has no block left; the others go on with their weights in
    proportion. No block is repeated or left out. The work depends on the number of
    sources and the period alone.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        share = shares({s: weights[s] for s in left}, period)
        plan, p = period_schedule(share), sum(share.values())
        length = min((left[s] - 1) // share[s] * p + plan[s][(left[s] - 1) % share[s]] + 1 for s in left)
        for s in list(left):
            n = length // p * share[s] + sum(x < length % p for x in plan[s])
            if n:
                out.append((s, done[s], done[s] + n, start, share[s], p, plan[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += length
    return out


def source_blocks(df: DataFrame, key: str, source: str, block_rows: int, seed: int) -> DataFrame:
    """Adds _block and _at: the source's rows in seeded hash order, cut into blocks.

    A source is split into hash ranges of some ten thousand rows, so its rows are ordered by
    many tasks whatever its share of the table; a range's rows follow those of the ranges
    before it, whose number comes from one row per source and range.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    wide = df.withColumn("_h", h)
    sub = max(1, df.count() // 10_000) * 2
    wide = wide.withColumn("_sub", F.floor((F.shiftrightunsigned("_h", 33).cast("double")) / 2.0**31 * sub).cast("int"))
    ranks = wide.withColumn("_rn", F.row_number().over(W.partitionBy(source, "_sub").orderBy(F.shiftrightunsigned("_h", 1), "_h", key)) - 1)
    sizes = df.select(source, h.alias("_h")).withColumn("_sub", F.floor((F.shiftrightunsigned("_h", 33).cast("double")) / 2.0**31 * sub).cast("int"))
    sizes = sizes.groupBy(source, "_sub").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(source).orderBy("_sub").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"))
    rank = F.col("_before") + F.col("_rn")
    return (ranks.join(before.drop("_n"), [source, "_sub"])
            .withColumn("_block", F.floor(rank / block_rows)).withColumn("_at", (rank % block_rows).cast("int")).drop("_h", "_sub", "_rn", "_before"))


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 16, seed: int = 11, rest: float = 1.0,
        id_col: str = "doc_id", source_col: str = "source", period: int = PERIOD) -> DataFrame:
    """id, source, block, slot, place of every row: the order in which a reader meets the mixed sources.

    `weights` are relative target weights by source; a source without one gets `rest`, and so
    do rows without a source, which are one source (the empty name is another). Reading by (slot,
    place), the number of finished blocks of each source that still has rows differs from its
    weight's share by less than one block (see `shares` for how weights are rounded); when a source
    ends the others share its weight. Nothing is dropped or repeated; a source's last block
    may be short. Rows of a source come in a seeded shuffle of their ids; rows that share the id
    are interchangeable, a missing id is the largest. Only id and source are moved. Sources
    must be at most `period` in number: one row per source and phase is broadcast.
    """
    weights = weights or {}
    spark = df.sparkSession
    i = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))
    s = F.col(f"`{source_col}`").cast("string")
    rows = written(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), i.alias("d"), F.coalesce(F.concat(F.lit("="), s), F.lit("")).alias("src")), "sources")
    counts = {r["src"]: r["n"] for r in rows.groupBy("src").agg(F.count("*").alias("n")).limit(period + 1).collect()}
    if len(counts) > period:
        raise ValueError("more sources than slots in a period")
    blocks = {k: -(-n // block_rows) for k, n in counts.items()}
    plan = phases({k: float(weights.get(k[1:], rest) if k else rest) for k in blocks}, blocks, period)
    table = spark.createDataFrame(plan or [("", 0, 0, 0, 1, 1, [0])], "src string, first long, end long, base long, share long, period long, plan array<int>")
    j = F.col("_block") - F.col("first")
    slot = F.col("base") + F.floor(j / F.col("share")) * F.col("period") + F.get("plan", (j % F.col("share")).cast("int"))
    placed = source_blocks(rows, "d", "src", block_rows, seed).join(
        F.broadcast(table.withColumnRenamed("src", "_s")), (F.col("src") == F.col("_s")) & (F.col("_block") >= F.col("first")) & (F.col("_block") < F.col("end")))
    return placed.select("id", F.when(F.col("src") == "", None).otherwise(F.substring("src", 2, 2**31 - 1)).alias("source"),
                         F.col("_block").alias("block"), slot.alias("slot"), F.col("_at").alias("place"))


def mixed(df: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 16, seed: int = 11, rest: float = 1.0,
          id_col: str = "doc_id", source_col: str = "source", placed: bool = False) -> DataFrame:
    """`df` itself, all rows and columns, range-partitioned and sorted in mixed order.

    A scan of files written from it may take them in another order; with `placed` the rows
    carry their slot and place as further columns, which are the order. Rows that share id and source are in one place each; a missing id or source is as in `mix`.
    """
    m = mix(df, weights, block_rows, seed, rest, id_col, source_col)
    first = m.groupBy("id", "source").agg(F.min(F.struct("slot", "place")).alias("at"))
    first = first.select(F.coalesce("id", F.lit(LAST_ID)).alias("d"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), "at.slot", "at.place")
    rows = df.select(packed(df), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("d"),
                     F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("src"))
    return (rows.join(first.hint("shuffle_hash"), ["d", "src"], "left").repartitionByRange(partitions(df.sparkSession), "slot", "place")
            .sortWithinPartitions("slot", "place").select("row.*", *(["slot", "place"] if placed else [])))
