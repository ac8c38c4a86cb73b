"""Resampling whole entities with draws shared by every method and budget.

A replicate draws as many entities as a stratum has, with replacement. Nothing is
repeated per entity and replicate:

* Entities with the same joint outcome are one weighted cell. An outcome is the value
  itself only in the bands around the wanted ranks; elsewhere a value says which bands it
  lies between, and that is all a threshold can ask of it.
* A replicate's draws are split down: first between bands and the rest, then inside both.
  A stratum of at most LEAF entities is drawn entity by entity from an integer hash, and
  so is every stratum of which sums, or medians over many columns, are wanted.
* Cells are dealt to groups of replicates. What moves is cells times groups of replicates;
  cells grow with the square root of a large stratum, not with its size.

A draw depends on (replicate, stratum) alone: not on partitioning, retries or task order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewatch.config import MonitorConfig
from tidewatch.functions.ranking import order_statistics
from tidewatch.functions.small import small
from tidewatch.sources.tables import staged

# fixed values: constants of the portable draw hash, two words of 31 bits each
MOD = (2147483647, 2147483629)
STEPS = ((7919, 104729, 15485863), (1299709, 6700417, 32452843))
MIX = ((48271, 65537, 40014, 69621, 32749, 12345), (39373, 46337, 20011, 40692, 28657, 54773))
# fixed values: replicates of the protocol, of its mixture and of its loss error
REPS, MIXTURE_REPS, LOSS_REPS = 2000, 1000, 400

SALTS = {"calibration_valid": 1, "test_valid": 2, "test_invalid": 3}
#: entities of a stratum drawn one by one, half-width of a band in standard deviations of its rank, blocks of replicates of sums
LEAF, BAND, BLOCKS = 4096, 8.0, 32
#: numbers of a matrix of replicates and cells, draws of a replicate of sums made at a time
MATRIX, DRAWS = 4 << 20, 1 << 16

Salt = Callable[[tuple], int]


def draw_index(rep: Column, draw: Column, salt: Column, n: Column) -> Column:
    """0-based index below n; all arguments BIGINT.

    Each word starts from its own linear form modulo its own prime. Two streams could only be
    shifted copies if both congruences held, so replicates stay apart for up to some 10^18 draws.
    """
    words = []
    for mod, (r, d, s), (a, b, c, e, f, g) in zip(MOD, STEPS, MIX, strict=True):
        m = F.lit(mod).cast("bigint")
        h = ((rep * r + draw * d + salt * s) % m * a) % m
        h = (h * (h % b) + c) % m
        h = (h * e) % m
        words.append((h * (h % f) + g) % m)
    return (words[0] * F.lit(MOD[1]).cast("bigint") + words[1]) % n


def draw_indices(rep: int, salt: int, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """`draw_index` of the draws 0 to n - 1, or from `first` to before `last`."""
    words = []
    draws = np.arange(first, n if last is None else last, dtype=np.int64)
    for m, (r, d, s), (a, b, c, e, f, g) in zip(MOD, STEPS, MIX, strict=True):
        h = ((rep * r + draws * d + salt * s) % m * a) % m
        h = (h * (h % b) + c) % m
        h = (h * e) % m
        words.append((h * (h % f) + g) % m)
    return (words[0] * MOD[1] + words[1]) % n


def generator(*coordinates) -> np.random.Generator:
    """Random numbers that depend on the coordinates alone."""
    text = "/".join(map(str, coordinates)).encode()
    return np.random.Generator(np.random.Philox(key=np.array([zlib.crc32(text), zlib.adler32(text)], np.uint64)))


def split(rng: np.random.Generator, total: int, counts: np.ndarray) -> np.ndarray:
    """Multinomial multiplicities of cells that hold `counts` entities: first the single ones against the others."""
    out = np.zeros(len(counts), np.int64)
    one = counts == 1
    n_one, n = int(one.sum()), int(counts.sum())
    part = int(rng.binomial(total, n_one / n)) if 0 < n_one < n else (total if n_one else 0)
    if n_one:
        out[one] = np.bincount(rng.integers(0, n_one, part), minlength=n_one)
    if n_one < n:
        out[~one] = rng.multinomial(total - part, counts[~one] / (n - n_one))
    return out


def sizes_of(rows: DataFrame, stratum: Sequence[str]) -> dict[tuple, int]:
    """Entities of every stratum; parameters (roles, scenarios, candidates) bound their number."""
    got = rows.select(*stratum, "entity").distinct().groupBy(*stratum).agg(F.count(F.lit(1)).alias("n")).collect()
    return {tuple(r[s] for s in stratum): r["n"] for r in got}


def bands(rows: DataFrame, stratum: Sequence[str], column: str, value: str, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, _bands): the values between which the wanted ranks of a resampled stratum lie, exact order statistics."""
    ranks = {}
    for k, a in enumerate(shares):
        half = lambda n, a=a: BAND * F.sqrt(a * (1 - a) * n) + 2
        ranks[f"lo{k}"] = lambda n, a=a, half=half: F.greatest(F.floor(a * n - half(n)), F.lit(1))
        ranks[f"hi{k}"] = lambda n, a=a, half=half: F.least(F.ceil(a * n + half(n)), n)
    got = order_statistics(rows, [*stratum, column], value, ranks)
    pairs = F.array(*[F.struct(F.col(f"lo{k}").alias("lo"), F.col(f"hi{k}").alias("hi")) for k in range(len(shares))])
    return got.groupBy(*by).agg(F.flatten(F.collect_list(pairs)).alias("_bands"))


def outside_merged(value: Column, bands_: Column) -> Column:
    """The value itself inside a band; elsewhere one value for all that lie between the same bands."""
    lower = F.array_max(F.filter(F.transform(bands_, lambda b: b["hi"]), lambda x: x < value))
    upper = F.array_min(F.filter(F.transform(bands_, lambda b: b["lo"]), lambda x: x > value))
    inside = F.exists(bands_, lambda b: (b["lo"] <= value) & (value <= b["hi"]))
    return (F.when(value.isNull() | inside, value).when(lower.isNull(), float("-inf")).when(upper.isNull(), float("inf"))
            .otherwise((lower + upper) / 2))


def cells(rows: DataFrame, stratum: Sequence[str], column: str, value: str, sizes: Mapping[tuple, int], limits: DataFrame | None = None,
          on: Sequence[str] = ()) -> DataFrame:
    """(stratum, entity, k, m): k entities with the joint outcome m = (column, value) list.

    Small strata keep one cell per entity and its id; in large ones values outside the bands
    `limits` (joined by `on`) are merged and the id is missing.
    """
    spark = rows.sparkSession
    rows = rows.select(*stratum, "entity", F.col(column).cast("string").alias("c"), F.col(value).cast("double").alias("v"),
                       *[x for x in on if x not in stratum and x != column])
    kinds = spark.createDataFrame([(*k, n <= LEAF) for k, n in sizes.items()] or [(*[None] * len(stratum), True)],
                                  StructType([*[rows.schema[s] for s in stratum], StructField("_leaf", rows.selectExpr("true").schema[0].dataType)]))
    large = any(n > LEAF for n in sizes.values())
    if large:
        rows = rows.join(small(kinds), list(stratum))
        if limits is not None:
            rows = rows.join(small(limits.withColumnRenamed(column, "c")), [c if c != column else "c" for c in on], "left")
            rows = rows.withColumn("v", F.when(F.col("_leaf") | F.col("_bands").isNull(), F.col("v")).otherwise(outside_merged(F.col("v"), F.col("_bands"))))
    one = rows.groupBy(*stratum, "entity", *(["_leaf"] if large else [])).agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("m"))
    if not large:
        return one.select(*stratum, "entity", F.lit(1).cast("bigint").alias("k"), "m")
    one = one.withColumn("entity", F.when(F.col("_leaf"), F.col("entity")))
    return one.groupBy(*stratum, "entity", "m").agg(F.count(F.lit(1)).alias("k")).select(*stratum, "entity", "k", "m")


class Stratum:
    """The cells of one stratum in a task, with multiplicities of any replicate."""

    def __init__(self, key: tuple, table: pa.Table, n: int, salt: int, columns: Sequence[str]):
        self.key, self.n, self.salt = key, n, salt
        self.k = table["k"].to_numpy()
        self.leaf = table["entity"].null_count == 0
        m = table["m"].combine_chunks()
        flat = m.flatten()
        at = np.repeat(np.arange(len(m)), m.value_lengths().to_numpy(zero_copy_only=False))
        self.values = np.full((len(m), len(columns)), np.nan)
        place = pa.compute.index_in(flat.field("c"), value_set=pa.array(columns, pa.string())).to_numpy(zero_copy_only=False)
        self.values[at, place] = flat.field("v").to_numpy(zero_copy_only=False)
        if self.leaf:
            self.order = np.argsort(table["entity"].to_numpy(zero_copy_only=False), kind="stable")
        else:  # one order whatever the order of arrival
            self.order = np.lexsort((*self.values.T[::-1], self.k))

    def weights(self, rep: int) -> np.ndarray:
        """How often each cell is drawn; replicate -1 is the plain sample."""
        if rep < 0:
            return self.k
        out = np.zeros(len(self.k), np.int64)
        if self.leaf:
            out[self.order] = np.bincount(draw_indices(rep, self.salt, self.n), minlength=self.n)
        else:
            out[self.order] = split(generator(rep, self.salt, *self.key), self.n, self.k[self.order])
        return out

    def running(self, reps: Sequence[int], column: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values of a column and the running multiplicities of each replicate."""
        have = np.flatnonzero(~np.isnan(self.values[:, column]))
        order = have[np.argsort(self.values[have, column], kind="stable")]
        return self.values[order, column], np.cumsum(self.drawn(reps)[:, order], axis=1)

    def drawn(self, reps: Sequence[int]) -> np.ndarray:
        if getattr(self, "_reps", None) != tuple(reps):
            self._reps, self._drawn = tuple(reps), np.stack([self.weights(r) for r in reps])
        return self._drawn


def replicate_groups(cell_rows: DataFrame, sizes: Mapping[tuple, int], reps: int, columns: int, plain: bool = True) -> tuple[DataFrame, Callable[[int], list[list[int]]]]:
    """Cells dealt to groups of replicates (column _group), and a group's replicates in parts whose matrices stay small."""
    most = sum(min(n, LEAF + int(columns * 4 * BAND * math.sqrt(n))) for n in sizes.values())
    per = max(1, min(MATRIX // max(most, 1), -(-reps // 32)))
    groups = -(-reps // per)

    def of(group: int) -> list[list[int]]:
        mine = list(range(group * per, min(reps, (group + 1) * per)))
        return [*([[-1]] if plain and group == 0 else []), *([mine] if mine else [])]
    dealt = cell_rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1))))
    return dealt, of


def _strata(table: pa.Table, stratum: Sequence[str], sizes: Mapping[tuple, int], salt: Salt, columns: Sequence[str]) -> Iterator[Stratum]:
    keys = list(zip(*[table[s].to_pylist() for s in stratum], strict=True))
    rows: dict[tuple, list[int]] = {}
    for k, key in enumerate(keys):
        rows.setdefault(key, []).append(k)
    for key in sorted(rows, key=str):
        yield Stratum(key, table.take(pa.array(rows[key], pa.int64())), sizes[key], salt(key), columns)


def _fields(df: DataFrame, names: Sequence[str]) -> list[StructField]:
    return [df.schema[n] for n in names]


def bootstrap_rates(minima: DataFrame, cfg: MonitorConfig, reps: int = REPS, cell: Sequence[str] = (), unified: bool = False) -> DataFrame:
    """(cell, path_set, rep, method, far_target, rate, binding): rates of every method and budget per replicate, -1 is the plain sample.

    A replicate resamples every (path_set, cell) stratum, takes each budget's order statistic of
    the resampled calibration minima as threshold, and counts the resampled test entities below
    it. `unified` applies the lowest threshold of all cells everywhere; `binding` names its cell.
    """
    stratum = ["path_set", *cell]
    columns = sorted(r["method"] for r in minima.select("method").distinct().collect())
    sizes = sizes_of(minima, stratum)
    is_cal = F.col("path_set") == "calibration_valid"
    own = ["method"] if unified else [*cell, "method"]
    limits = bands(minima.where(is_cal), stratum, "method", "min_stat", cfg.far_targets, own) if max(sizes.values(), default=0) > LEAF else None
    rows = cells(minima, stratum, "method", "min_stat", sizes, limits, own)
    dealt, of = replicate_groups(rows, sizes, reps, len(columns) * len(cfg.far_targets))
    targets = [float(a) for a in cfg.far_targets]

    def rates(table: pa.Table) -> pa.Table:
        all_ = list(_strata(table, stratum, sizes, lambda k: SALTS[k[0]], columns))
        cal = [s for s in all_ if s.key[0] == "calibration_valid"]
        tests = [s for s in all_ if s.key[0] != "calibration_valid"]
        out: list[list] = [[] for _ in range(len(stratum) + 5)]
        for part in of(table["_group"][0].as_py()) if cal else []:
            for j, method in enumerate(columns):
                have = [s for s in cal if (~np.isnan(s.values[:, j])).any()]
                limit = {(s.key[1:], a): t for s in have for a, t in _thresholds(s, part, j, targets)}
                for s in tests:
                    values, run = s.running(part, j)
                    if not len(values):
                        continue
                    for a in targets:
                        names = [c.key[1:] for c in have]
                        if unified:
                            every = np.stack([limit[c, a] for c in names])
                            best = every.argmin(axis=0)
                            t, bound = every[best, np.arange(len(part))], [str(names[b][0]) for b in best]
                        elif (s.key[1:], a) in limit:
                            t, bound = limit[s.key[1:], a], [None] * len(part)
                        else:
                            continue
                        below = np.searchsorted(values, t, "left")
                        hits = np.where(below > 0, run[np.arange(len(part)), np.maximum(below - 1, 0)], 0)
                        for c, x in zip(out, [*[[x] * len(part) for x in s.key], part, [method] * len(part), [a] * len(part), (hits / run[:, -1]).tolist(), bound], strict=True):
                            c.extend(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    schema = StructType([*_fields(minima, stratum), StructField("rep", LongType()), StructField("method", StringType()), StructField("far_target", DoubleType()),
                         StructField("rate", DoubleType()), StructField("binding", StringType())])
    arrow = _arrow(schema)
    got = dealt.groupBy("_group").applyInArrow(rates, schema)
    return got if unified else got.drop("binding")


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _thresholds(s: Stratum, reps: Sequence[int], column: int, targets: Sequence[float]) -> Iterator[tuple[float, np.ndarray]]:
    """The floor(a n) + 1-th smallest drawn value of each replicate."""
    values, run = s.running(reps, column)
    for a in targets:
        rank = min(math.floor(a * s.n), s.n - 1) + 1
        t = values[np.minimum((run < rank).sum(axis=1), len(values) - 1)]
        if not np.isfinite(t).all():
            raise ValueError("a resampled rank left its band")  # 8 standard deviations: does not happen by chance
        yield a, t


def resampled_medians(long: DataFrame, stratum: Sequence[str], columns: Sequence[str], reps: int, salt: int) -> DataFrame:
    """(stratum, columns, rep, med): median of the drawn entities' values for every combination of `columns`.

    An entity without a value is drawn like the others and left out of the median. Every stratum,
    however large, is drawn entity by entity from the integer hash. An entity sends its values as a
    plain array to each group of replicates; over many columns hardly two entities agree, so merging
    them would save nothing. Groups and blocks of columns keep a task's matrices below MATRIX numbers
    (for a stratum beyond that, to one replicate and one column).
    """
    long = long.where(F.col("value").isNotNull())
    rows = long.select(*stratum, *columns, "entity", F.col("value").cast("double").alias("value"))
    kinds = sorted(map(tuple, rows.select(*columns).distinct().collect()), key=str)  # parameters bound their number
    sizes = sizes_of(rows, stratum)
    most = max(sizes.values(), default=1)
    wide = max(1, min(len(kinds), MATRIX // most))
    per = max(1, min(MATRIX // most, -(-reps // 8)))
    places = rows.sparkSession.createDataFrame([(*k, j // wide, j % wide) for j, k in enumerate(kinds)] or [(*[None] * len(columns), 0, 0)],
                                               StructType([*_fields(rows, columns), StructField("_block", LongType()), StructField("_at", LongType())]))
    one = rows.join(small(places), list(columns)).groupBy(*stratum, "entity", "_block").agg(F.collect_list("_at").alias("a"), F.collect_list("value").alias("v"))
    # an entity without a value in a block keeps its place in the order of draws
    every = one.groupBy(*stratum, "entity").agg(F.collect_list(F.struct("_block", "a", "v")).alias("_m"))
    none = F.struct(F.lit(None).cast("bigint").alias("_block"), F.array().cast("array<bigint>").alias("a"), F.array().cast("array<double>").alias("v"))
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(-(-len(kinds) // wide), 1) - 1).cast("bigint"))).alias("_block")
    mine = F.coalesce(F.get(F.filter("_m", lambda m: m["_block"] == F.col("_block")), F.lit(0)), none)
    dealt = every.select(*stratum, "entity", "_m", at).select(*stratum, "entity", "_block", mine.alias("_m")).select(
        *stratum, "entity", "_block", F.col("_m.a").alias("a"), F.col("_m.v").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(-(-reps // per) - 1))).alias("_group"))

    def medians(table: pa.Table) -> pa.Table:
        key, group, block = tuple(table[x][0].as_py() for x in stratum), table["_group"][0].as_py(), table["_block"][0].as_py()
        n, mine = table.num_rows, kinds[block * wide:(block + 1) * wide]
        rank = np.empty(n, np.int64)
        rank[np.argsort(table["entity"].to_numpy(), kind="stable")] = np.arange(n)
        lists, values = table["a"].combine_chunks(), np.full((len(mine), n), np.nan)
        values[lists.flatten().to_numpy(), np.repeat(rank, lists.value_lengths().to_numpy())] = table["v"].combine_chunks().flatten().to_numpy()
        part = list(range(group * per, min(reps, (group + 1) * per)))
        drawn = np.stack([np.bincount(draw_indices(r, salt, n), minlength=n) for r in part]).astype(np.int32)
        out: list[list] = [[] for _ in range(len(stratum) + 2 + len(columns))]
        for kind, v in zip(mine, values, strict=True):
            order = np.argsort(v, kind="stable")[:int((~np.isnan(v)).sum())]
            if not len(order):
                continue
            v, run = v[order], np.cumsum(drawn[:, order], axis=1)
            some = [k for k in range(len(part)) if run[k, -1] > 0]
            med = [(v[np.searchsorted(run[k], (run[k, -1] - 1) // 2 + 1)] + v[np.searchsorted(run[k], run[k, -1] // 2 + 1)]) / 2 for k in some]
            for c, x in zip(out, [*[[x] * len(some) for x in key], [part[k] for k in some], *[[x] * len(some) for x in kind], med], strict=True):
                c.extend(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    schema = StructType([*_fields(long, stratum), StructField("rep", LongType()), *_fields(long, columns), StructField("med", DoubleType())])
    arrow = _arrow(schema)
    return dealt.groupBy(*stratum, "_block", "_group").applyInArrow(medians, schema)


def conditional_rates(outcomes: DataFrame, stratum: Sequence[str], columns: Sequence[str], reps: int, salt: int) -> DataFrame:
    """(stratum, columns, rep, rate): share of the drawn entities with `base` that have `hit` as well; missing where none has `base`.

    Entities with the same joint pattern over all combinations of `columns` are one cell, whatever their number.
    """
    sizes = sizes_of(outcomes, stratum)
    rows = outcomes.select(*stratum, "entity", F.to_json(F.struct(*columns)).alias("column"), (F.col("base").cast("int") * (1 + F.col("hit").cast("int"))).cast("double").alias("value"))
    dealt, of = replicate_groups(cells(rows, stratum, "column", "value", sizes), sizes, reps, 1)

    def rates(table: pa.Table) -> pa.Table:
        names = sorted(pa.compute.unique(table["m"].combine_chunks().flatten().field("c")).to_pylist())
        out: list[list] = [[] for _ in range(len(stratum) + 3)]
        for s in _strata(table, stratum, sizes, lambda k: salt, names):
            for part in of(table["_group"][0].as_py()):
                base, hit = s.drawn(part) @ (s.values >= 1), s.drawn(part) @ (s.values == 2)
                for j, name in enumerate(names):
                    rate = [h / b if b else None for b, h in zip(base[:, j].tolist(), hit[:, j].tolist(), strict=True)]
                    for c, x in zip(out, [*[[x] * len(part) for x in s.key], part, [name] * len(part), rate], strict=True):
                        c.extend(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    schema = StructType([*_fields(outcomes, stratum), StructField("rep", LongType()), StructField("column", StringType()), StructField("rate", DoubleType())])
    arrow = _arrow(schema)
    got = dealt.groupBy(*stratum, "_group").applyInArrow(rates, schema)
    return got.withColumn("_c", F.from_json("column", StructType(_fields(outcomes, columns)))).select(*stratum, "rep", *[F.col(f"_c.{c}").alias(c) for c in columns], "rate")


def ranked(rows: DataFrame, stratum: Sequence[str]) -> tuple[DataFrame, dict[tuple, int]]:
    """Rows, one per entity, with their places from 0 in their stratum's order of entities (_rank), and the strata's sizes.

    The rows are dealt by ranges, sorted and written; a row's rank follows from its place in its part and the
    parts before, so no task sees a whole stratum. Parts and strata bound what is collected and broadcast.
    """
    spark, keys = rows.sparkSession, [*stratum, "entity"]
    rows = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = rows.groupBy(*stratum, "_part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    sizes: dict[tuple, int] = {}
    starts = []
    for r in sorted(counts, key=lambda r: r["_part"]):
        key = tuple(r[s] for s in stratum)
        starts.append((*key, r["_part"], sizes.get(key, 0) - r["first"]))
        sizes[key] = sizes.get(key, 0) + r["n"]
    schema = StructType([*_fields(rows, stratum), StructField("_part", LongType()), StructField("_shift", LongType())])
    table = pa.table([pa.array([x[j] for x in starts], f.type) for j, f in enumerate(_arrow(schema))], schema=_arrow(schema))
    table = spark.createDataFrame(table, schema)  # a local table: no Python worker makes it
    return rows.join(small(table), [*stratum, "_part"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), sizes


def resampled_sums(rows: DataFrame, stratum: Sequence[str], values: Sequence[str], reps: int) -> DataFrame:
    """(stratum, rep, n, values): sums over the drawn entities; replicate -1 is the plain sample.

    Sums of real numbers need every entity. Every stratum, however large, is drawn entity by entity
    from the integer hash. The rows, one per entity, are written once; a stratum, in pieces of MATRIX
    numbers in the order of its entities, goes to each block of replicates: BLOCKS of them, or fewer with
    16 DRAWS draws each. A task adds the values that its replicates' draws find in its piece, DRAWS at a time;
    a stratum of several pieces makes its draws once for each. The tasks are dealt by number, as their
    rows are few for the work they bring.
    """
    rows, sizes = ranked(staged(rows.select(*stratum, "entity", *[F.col(v).cast("double").alias(v) for v in values]), "sums"), stratum)
    wide = max(1, MATRIX // len(values))
    per = max(1, -(-reps // BLOCKS), min(reps, 16 * DRAWS // max(sizes.values(), default=1)))
    blocks = max(1, -(-reps // per))
    key = [*stratum, "_piece", "_block"]
    dealt = rows.select(*stratum, *values, "_rank", F.floor(F.col("_rank") / wide).alias("_piece"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    dealt = dealt.repartition(max(1, blocks * sum(-(-n // wide) for n in sizes.values())), *key)

    def sums(table: pa.Table) -> pa.Table:
        key, piece, block = tuple(table[s][0].as_py() for s in stratum), table["_piece"][0].as_py(), table["_block"][0].as_py()
        n, salt, low, size = sizes[key], SALTS[key[0]], piece * wide, table.num_rows
        x = np.empty((len(values), size))
        x[:, table["_rank"].to_numpy() - low] = [table[v].to_numpy() for v in values]
        out = [(-1, size, *x.sum(axis=1).tolist())] if block == 0 else []
        for rep in range(block * per, min(reps, (block + 1) * per)):
            count, total = 0, np.zeros(len(values))
            for first in range(0, n, DRAWS):
                at = draw_indices(rep, salt, n, first, min(n, first + DRAWS)) - low
                if size < n:
                    at = at[(at >= 0) & (at < size)]
                count += len(at)
                total += [v[at].sum() for v in x]
            out.append((rep, count, *total.tolist()))
        return pa.table([*[pa.array([k] * len(out), f.type) for k, f in zip(key, arrow, strict=False)],
                         *[pa.array([r[j] for r in out], f.type) for j, f in enumerate(list(arrow)[len(key):])]], schema=arrow)

    schema = StructType([*_fields(rows, stratum), StructField("rep", LongType()), StructField("n", LongType()), *[StructField(v, DoubleType()) for v in values]])
    arrow = _arrow(schema)
    got = dealt.groupBy(*key).applyInArrow(sums, schema)
    return got.groupBy(*stratum, "rep").agg(*[F.sum(c).alias(c) for c in ("n", *values)])


def interval(draws: DataFrame, keys: Sequence[str], value: str, more: Sequence[Column] = ()) -> DataFrame:
    """Point value (replicate -1) and percentile interval over the replicates, whose number is a parameter; `more` aggregates beside."""
    drawn = F.when(F.col("rep") >= 0, F.col(value))
    out = draws.groupBy(*keys).agg(F.max(F.when(F.col("rep") == -1, F.col(value))).alias("point"), F.count(drawn).alias("n_reps"),
                                   F.percentile(drawn, F.array(F.lit(.025), F.lit(.975))).alias("_q"), *more)
    out = out.withColumn("lo", F.get("_q", F.lit(0))).withColumn("hi", F.get("_q", F.lit(1))).drop("_q")
    return out.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def contrasts(rates: DataFrame, exprs: dict[str, Sequence[tuple[float, str]]], keys: Sequence[str]) -> DataFrame:
    """Named linear contrasts of method rates inside each replicate."""
    terms = sorted({m for e in exprs.values() for _, m in e})
    wide = rates.groupBy(*keys, "rep").agg(*[F.max(F.when(F.col("method") == m, F.col("rate"))).alias(m) for m in terms])

    def value(e):
        out = F.lit(0.0)
        for c, m in e:
            out = out + F.lit(c) * F.col(m)
        return out
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), value(e).alias("value")) for n, e in exprs.items()]))
    return wide.select(*keys, "rep", named.alias("_c")).select(*keys, "rep", "_c.*")
