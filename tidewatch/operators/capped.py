"""The variance recursion with a capped update, composed block by block.

One day maps the forecast v to min(lam v + (1 - lam) x, g v) with g = lam + (1 - lam) c^2: the
lower of two increasing lines. Days compose: k days map v to the least of k + 1 lines, and line j
(j of the days capped) has slope lam^(k-j) g^j, so a block of days is its k + 1 intercepts. Blocks
are composed independently of each other, the value at a block's start is carried over an
entity's few blocks, and each block is then run from its own start. Composing takes one numpy step
per day over all blocks of a batch, running stays in the JVM; a long series is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import MonitorConfig

#: days in a block
DAYS = 256


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, filled up with zeros, and their lengths."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, size


def _lists(matrix: np.ndarray, size: np.ndarray) -> pa.ListArray:
    keep = np.arange(matrix.shape[1]) < size[:, None]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(matrix[keep]))


def composed(x: np.ndarray, size: np.ndarray, lam: float, grow: float) -> np.ndarray:
    """Intercepts (rows x days + 1) of each row's composed map; x holds (1 - lam) times the squared residuals."""
    out = np.full((len(x), x.shape[1] + 1), np.inf)
    out[:, 0] = 0.0
    for day in range(x.shape[1]):
        on = size > day
        old = out[on, :day + 1]
        new = np.full((len(old), day + 2), np.inf)
        new[:, :-1] = lam * old + x[on, day, None]
        new[:, 1:] = np.minimum(new[:, 1:], grow * old)
        out[on, :day + 2] = new
    return out


def _at(v: Column, intercepts: Column, lam: float, grow: float) -> Column:
    """A block's map at v: the least of its lines."""
    days = F.size(intercepts) - 1
    line = lambda i, j: F.pow(F.lit(lam), (days - j).cast("double")) * F.pow(F.lit(grow), j.cast("double")) * v + i
    return F.array_min(F.transform(intercepts, line))


def with_capped_variance(panel: DataFrame, cfg: MonitorConfig, keys: Sequence[str], name: str) -> DataFrame:
    """`panel` with the capped forecast `name` and whether the floor held it; a block is at most DAYS rows of one series."""
    lam, cap, mid, first = cfg.ewma_lambda, cfg.truncation_c ** 2, cfg.midpoint, cfg.sigma_daily ** 2
    grow, floor = lam + (1.0 - lam) * cap, cfg.variance_floor_factor * first
    ids = [*keys, "_b"]
    others = [c for c in panel.columns if c not in keys and c != "day"]
    rows = F.sort_array(F.collect_list(F.struct("day", *others))).alias("_rows")
    blocks = panel.withColumn("_b", F.floor((F.col("day") - 1) / DAYS)).groupBy(*ids).agg(rows)
    pull = F.transform("_rows", lambda r: F.lit(1.0 - lam) * F.pow(r["ret"] - F.lit(mid), F.lit(2.0)))
    blocks = blocks.withColumn("_x", pull)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = _matrix(batch.column("_x"))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ids], _lists(composed(x, size, lam, grow), size + 1)], [*ids, "_lines"])

    fields = {f.name: f for f in blocks.schema}
    lines = blocks.select(*ids, "_x").mapInArrow(compose, T.StructType([*[fields[k] for k in ids], T.StructField("_lines", T.ArrayType(T.DoubleType()))]))
    ordered = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_lines"))).alias("_all"))
    carried = F.aggregate("_all", F.array(F.lit(first)), lambda acc, b: F.array_append(acc, _at(F.element_at(acc, -1), b["_lines"], lam, grow)))
    starts = ordered.select(*keys, F.explode(F.arrays_zip(F.col("_all._b").alias("b"), F.slice(carried, 1, F.size("_all")).alias("v"))).alias("_s"))
    starts = starts.select(*keys, F.col("_s.b").alias("_b"), F.col("_s.v").alias("_start"))
    one = lambda v, x: F.least(F.lit(lam) * v + x, F.lit(grow) * v)
    inside = F.aggregate("_x", F.array("_start"), lambda acc, x: F.array_append(acc, one(F.element_at(acc, -1), x)))
    out = blocks.join(starts, ids).select(*keys, F.explode(F.arrays_zip("_rows", F.slice(inside, 1, F.size("_x")).alias("_v"))).alias("_z"))
    out = out.select(*keys, "_z._rows.*", F.col("_z._v").alias("_raw"))
    return out.select(*panel.columns, F.greatest("_raw", F.lit(floor)).alias(name), (F.col("_raw") < F.lit(floor)).alias(f"{name}_floored"))
