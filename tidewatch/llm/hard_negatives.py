"""Hard-negative mining by threshold joins on an inverted index that omits what norms cover.

Anchors come in blocks; a block meets all rows, one batch after the other. For a threshold t the
leading dimensions of a row are left out of the index as long as their norm times the anchors' norm
over the same dimensions stays below t: alone they reach it for no anchor. Partial scores are
accumulated over the indexed dimensions, from the last to the first, pairs are dropped when the
remaining norms cannot lift them to t, and only survivors get their exact whole-number score.
Thresholds start at what a bounded sample of rows suggests and fall until every window is full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import LAST_ID, numbered, partitions, written

#: distinct anchors in a block, rows of the sample that first thresholds come from, rows and anchors scored at once, dimensions summed at once
BLOCK, SAMPLE, ROWS, ANCHORS, STEP = 2048, 4096, 4096, 512, 8
#: relative room for rounding in the bounds; scores themselves are whole numbers
SLACK = 1e-9


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale x) of every component, x as double; null where the vector, a component, or a component's number is missing."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x * scale)))


@dataclass(frozen=True)
class Wanted:
    """What a pass looks for: for anchor a and window w (label: tag) scores from least to most, the `count` best."""

    vectors: np.ndarray
    labels: np.ndarray
    tag: np.ndarray
    least: np.ndarray
    most: np.ndarray
    open: np.ndarray
    same_label: bool
    count: int


def _matrix(column: pa.Array, width: int, exact) -> np.ndarray:
    """Rows of an array column, filled with zeros to one width."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), exact)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms of the first 0, STEP, 2 STEP, ... components of each row."""
    square = x.astype(np.float64) ** 2
    sums = np.add.reduceat(square, np.arange(0, x.shape[1], STEP), axis=1).cumsum(axis=1)
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), sums], axis=1))


def threshold_join(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y, score) whose inner product is least[row of x] or more."""
    nx, ny = _norms(x), _norms(y)
    groups = nx.shape[1] - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(least[:, None] > 0, np.where(nx > 0, least[:, None] / nx, np.inf), 0).min(axis=0)
    skipped = (ny * (1 + SLACK) < room).cumprod(axis=1).sum(axis=1) - 1  # leading groups without index; -1: some threshold is 0 or less
    skipped = np.maximum(skipped, 0)
    order = np.argsort(skipped, kind="stable")
    order = order[skipped[order] < groups]  # no anchor can be reached otherwise
    y, ny, skipped = y[order], ny[order], skipped[order]
    score = np.zeros((len(x), len(y)), x.dtype)
    for g in range(groups - 1, -1, -1):
        n = int(np.searchsorted(skipped, g, "right"))  # rows that index this group of dimensions
        score[:, :n] += x[:, g * STEP:(g + 1) * STEP] @ y[:n, g * STEP:(g + 1) * STEP].T
        if g in (groups // 4, groups // 2) and n:  # what no anchor can reach any more is not carried on
            open_ = np.maximum(skipped, g)  # leading groups that are not summed yet
            live = ((score + nx[:, open_] * ny[np.arange(len(y)), open_] * (1 + SLACK)) >= least[:, None]).any(axis=0)
            y, ny, skipped, score, order = y[live], ny[live], skipped[live], score[:, live], order[live]
    rest = nx[:, skipped] * ny[np.arange(len(y)), skipped] * (1 + SLACK)
    a, b = np.nonzero(score + rest >= least[:, None])
    exact = score[a, b]
    for s in np.unique(skipped[b]):
        if s:
            k = np.flatnonzero(skipped[b] == s)
            exact[k] += np.einsum("ij,ij->i", x[a[k], :s * STEP], y[b[k], :s * STEP])
    good = exact >= least[a]
    return a[good], order[b[good]], exact[good].astype(np.int64)


def _best(found: list[np.ndarray], count: int) -> list[np.ndarray]:
    """The `count` best (score, then smallest id) of every (anchor, window)."""
    a, w, score, row, first = found
    order = np.lexsort((first, -score, w, a))
    a, w = a[order], w[order]
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(head, np.diff(np.r_[head, len(a)]))
    stay = order[place < count]
    return [c[stay] for c in found]


def _pass(wanted: Wanted):
    """mapInArrow task: every window's best rows among those of the partition."""
    width, exact = wanted.vectors.shape[1], wanted.vectors.dtype

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.where(wanted.open, wanted.least, np.inf)  # a window's least score rises with what the partition holds
        held = [np.zeros(0, np.int64) for _ in range(5)]
        kept: list = []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = _meet(wanted, least, part, width, exact, len(kept))
                kept += part.column("ids").to_pylist() if len(found[0]) else []
                held = _best([np.r_[h, f] for h, f in zip(held, found, strict=True)], wanted.count)
                pair = held[0] * least.shape[1] + held[1]
                n = np.bincount(pair, minlength=least.size)
                full = np.flatnonzero(n >= wanted.count)
                low = np.full(least.size, np.inf)
                np.minimum.at(low, pair, held[2])
                least.ravel()[full] = np.maximum(least.ravel()[full], low[full])
        a, w, score, row, _ = held
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(wanted.tag[a, w]), pa.array(score), pa.array([kept[k] for k in row.tolist()], pa.list_(pa.int64()))],
                                         ["a", "tag", "score", "ids"])
    return task


def _meet(wanted: Wanted, least: np.ndarray, part: pa.RecordBatch, width: int, exact, offset: int) -> list[np.ndarray]:
    y, label = _matrix(part.column("q"), width, exact), part.column("label").to_numpy()
    first = part.column("ids").flatten().to_numpy(zero_copy_only=False)
    size = part.column("ids").value_lengths().to_numpy(zero_copy_only=False)
    first = first[np.cumsum(size) - size] if len(size) else first
    per_anchor = least.min(axis=1)
    found = [[np.zeros(0, np.int64)] for _ in range(5)]

    def add(rows: np.ndarray, anchors: np.ndarray) -> None:
        for at in range(0, len(anchors), ANCHORS):
            some = anchors[at:at + ANCHORS]
            a, b, score = threshold_join(wanted.vectors[some], y[rows], per_anchor[some])
            a, b = some[a], rows[b]
            if not wanted.same_label:
                other = wanted.labels[a] != label[b]
                a, b, score = a[other], b[other], score[other]
            for w in range(least.shape[1]):
                inside = (score >= least[a, w]) & (score <= wanted.most[a, w])
                mine = _best([a[inside], np.full(int(inside.sum()), w), score[inside], b[inside], first[b[inside]]], wanted.count)
                for k, c in enumerate(mine):
                    found[k].append(c)

    live = np.flatnonzero(per_anchor < np.inf)
    if wanted.same_label:
        for one in np.unique(label):
            add(np.flatnonzero(label == one), live[wanted.labels[live] == one])
    else:
        add(np.arange(len(y)), live)
    out = [np.concatenate(c) for c in found]
    out[3] = out[3] + offset
    return out


def hard_negatives(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id",
                   vector_col: str = "vector", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for whole-number vectors.

    `anchors` is a condition on the columns of `df`. A score is the inner product with the anchor;
    higher first, ties by smaller id. Positives of an anchor are its best other rows of the same
    label; for each, the best rows of other labels with low * positive <= 100 * negative <= high *
    positive are returned. Rows that share vector and label are one class: of a class the smallest
    ids are enough, so a vector that a third of all rows share is one row in every pass.

    Rows without label or vector (or with a missing component) take no part; shorter vectors count
    as filled with zeros. A missing id comes after all others. Repeated rows are rows of their own.
    An empty table gives an empty one. Vectors whose scores could leave 62 bits raise ValueError.
    """
    spark = df.sparkSession
    q, label = F.col(f"`{vector_col}`").cast("array<long>"), F.col(f"`{label_col}`").cast("long")
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), label.alias("label"), q.alias("q"),
                     F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("q").isNotNull() & F.forall("q", lambda x: x.isNotNull())).withColumn("h", F.xxhash64("q"))
    rows = written(rows, "vectors")
    key = ["label", "h", "q"]
    smallest = Window.partitionBy(*key).orderBy("id")
    some = rows.withColumn("k", F.row_number().over(smallest)).where(F.col("k") <= positives + 1)
    classes = written(some.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids")).drop("h"), "classes")
    reach = classes.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    width, most = max(reach[0] or 1, 1), reach[1] or 0
    if width * most * most >= 2**62:
        raise ValueError("inner products of these vectors do not fit into 62 bits")
    exact = np.float64 if width * most * most < 2**53 else np.int64
    own = rows.where("anchor").select("id", *key)
    distinct = numbered(own.select(*key).dropDuplicates(), ["h", "label", "q"], "anchors")
    numbers = written(own.join(distinct, key).select("id", "r"), "anchor_rows")
    total = distinct.count()
    sample = classes.orderBy(F.xxhash64("q", "label")).limit(SAMPLE).select("label", "q").toArrow().combine_chunks()
    sy, sl = _matrix(sample["q"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int64())), width, exact), sample["label"].to_numpy()
    classes = classes.repartition(partitions(spark))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for at in range(0, total, BLOCK):
        block = distinct.where((F.col("r") >= at) & (F.col("r") < at + BLOCK)).orderBy("r").select("label", "q").toArrow().combine_chunks()
        x, xl = _matrix(block["q"].combine_chunks(), width, exact), block["label"].to_numpy()
        variety = np.argsort(np.einsum("ij,ij->j", x.astype(np.float64), x), kind="stable")  # heavy dimensions last: they are the indexed ones
        n = len(x)
        bottom = np.full((n, 1), -np.inf)
        pos = _filled(classes, variety, Wanted(x, xl, np.zeros((n, 1), np.int64), bottom, -bottom, np.ones((n, 1), bool), True, positives + 1), sy, sl, "positives")
        scores = {r["a"]: sorted({p["score"] for p in r["best"]}, reverse=True) for r in pos.select("a", "best").collect()}
        tag, bottom, top, open_ = np.zeros((n, positives + 1), np.int64), np.zeros((n, positives + 1)), np.zeros((n, positives + 1)), np.zeros((n, positives + 1), bool)
        for a, ps in scores.items():
            for w, p in enumerate(ps):
                tag[a, w], bottom[a, w], top[a, w] = p, -(-low * p // 100), high * p // 100
                open_[a, w] = bottom[a, w] <= top[a, w]
        neg = _filled(classes, variety, Wanted(x, xl, tag, bottom, top, open_, False, negatives), sy, sl, "negatives")
        out = out.union(_named(numbers.where((F.col("r") >= at) & (F.col("r") < at + BLOCK)), at, pos, neg, positives))
    return out


def _named(anchors: DataFrame, at: int, pos: DataFrame, neg: DataFrame, positives: int) -> DataFrame:
    """Rows of every anchor of a block: its class's lists without the anchor itself. BLOCK bounds what is broadcast."""
    best = anchors.withColumn("a", F.col("r") - at).join(F.broadcast(pos.select("a", "best")), "a")
    self_at = F.array_position(F.transform("best", lambda b: b["id"]), F.col("id"))
    others = F.slice(F.filter("best", lambda b, k: k + 1 != self_at), 1, positives)
    one = best.select("id", "a", F.explode(others).alias("p")).select("id", "a", F.col("p.id").alias("positive"), F.col("p.score").alias("tag"))
    all_ = one.join(F.broadcast(neg.select("a", "tag", F.col("best").alias("negatives"))), ["a", "tag"])
    given = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return (all_.select("id", "positive", "tag", F.posexplode("negatives").alias("k", "n")).withColumn("negative", F.col("n.id"))
            .select(given("id").alias("anchor_id"), given("positive").alias("positive_id"), (F.col("k") + 1).cast("int").alias("rank"),
                    given("negative").alias("negative_id"), F.col("tag").alias("positive_score"), F.col("n.score").alias("negative_score")))


def _suggested(wanted: Wanted, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best and the count-th best score that the sample has in each window; its least score where there is none."""
    out = np.repeat(wanted.least[None].astype(np.float64), 2, axis=0)
    for at in range(0, len(wanted.vectors) if len(rows) >= wanted.count else 0, ANCHORS):
        some = slice(at, at + ANCHORS)
        near = (wanted.vectors[some] @ rows.T).astype(np.float64)
        near[(wanted.labels[some, None] == labels[None, :]) != wanted.same_label] = -np.inf
        for w in range(wanted.tag.shape[1]):
            inside = np.where(near <= wanted.most[some, w, None], near, -np.inf)
            last = np.partition(inside, inside.shape[1] - wanted.count, axis=1)[:, inside.shape[1] - wanted.count:]
            out[0, some, w] = np.maximum(out[0, some, w], last.max(axis=1))
            out[1, some, w] = np.maximum(out[1, some, w], last.min(axis=1))
    return out[0], out[1]


def _filled(classes: DataFrame, variety: np.ndarray, wanted: Wanted, sample: np.ndarray, sample_labels: np.ndarray, name: str) -> DataFrame:
    """a, tag, best (score, id) of every window: thresholds fall until it is full, down to its own least score.

    First the best score that the sample has in a window, then its count-th best, which all rows
    together must reach, then the window's lower end.
    """
    rungs = [*_suggested(wanted, sample, sample_labels), wanted.least]
    waiting, done = wanted.open, None
    for k, rung in enumerate(rungs):
        if k < 2 and not (waiting & (rung > wanted.least)).any():
            continue  # nothing would be left out
        task = _pass(Wanted(wanted.vectors[:, variety], wanted.labels, wanted.tag, rung, wanted.most, waiting, wanted.same_label, wanted.count))
        found = _permuted(classes, variety).mapInArrow(task, "a long, tag long, score long, ids array<long>")
        w = Window.partitionBy("a", "tag").orderBy(F.desc("score"), "id")
        best = (found.select("a", "tag", "score", F.explode("ids").alias("id")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= wanted.count)
                .groupBy("a", "tag").agg(F.array_sort(F.collect_list(F.struct("k", "score", "id"))).alias("best")))
        best = written(best, name)
        if k < 2:
            best = best.where(F.size("best") >= wanted.count)
            full = {(r["a"], r["tag"]) for r in best.select("a", "tag").collect()}
            waiting = waiting & np.array([[(a, t) not in full for t in row] for a, row in enumerate(wanted.tag.tolist())], bool).reshape(waiting.shape)
        done = best if done is None else done.union(best)
        if not waiting.any():
            break
    return done


def _permuted(classes: DataFrame, variety: np.ndarray) -> DataFrame:
    """The rows with their dimensions in the block's order."""
    order = F.array(*[F.lit(int(k)) for k in variety])
    return classes.select("label", "ids", F.transform(order, lambda k: F.coalesce(F.get("q", k), F.lit(0))).alias("q"))
