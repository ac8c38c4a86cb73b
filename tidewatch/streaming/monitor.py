"""Online monitor: one absorbing first alarm per entity and method from a stream of returns.

All eight methods run on one composite state per entity: six sums of increments, two variance
recursions, and the last prefix sums of the rolling window as a ring. Returns and parameters are
all it sees. Thresholds are a table next to the stream, read anew by every trigger.

Rows of one trigger arrive unordered; only the earliest rows still inside the horizon can matter,
so no more than that many are kept while an entity's batch is read. A row older than the last one
used is late, a row without a finite return is refused; both are counted and reported, neither is
used. An entity that has raised all alarms or reached the horizon gives up its state; what stays
is its last place, which is needed to tell late rows, and expires after a retention time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import MonitorConfig
from tidewatch.functions.small import small
from tidewatch.operators.evidence import ALL_METHODS, DETECTORS

OUTPUT = "entity bigint, method string, tau int, stat double, threshold double"
STATE = ("day int, last_ts bigint, last_id bigint, sums array<double>, block int, offset int, run double, last double, v_trunc double, "
         "ring_1 array<double>, ring_2 array<double>, alarms array<int>")
FINISHED = "last_ts bigint, last_id bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
METHODS = ALL_METHODS
#: methods of rows that report late and refused rows; tau is their number
LATE, REFUSED = "late_rows", "refused_rows"
REPORTS = (LATE, REFUSED)
#: how long a finished entity's place is remembered
RETENTION_MS = 90 * 86_400_000
#: a statistic within rounding of its threshold has not fallen below it
TOLERANCE = 1e-12
ROW = ("entity", "ts_us", "event_id", "ret")
_LIMIT = "_limit_"


def _log_gap(x: np.ndarray, loc1: float, loc0: float, scale2, nu: float) -> np.ndarray:
    """log t(x; loc1) - log t(x; loc0), in the order of the batch expression."""
    d1, d0 = x - loc1, x - loc0
    return -(nu + 1.0) / 2.0 * (np.log1p(d1 * d1 / (scale2 * nu)) - np.log1p(d0 * d0 / (scale2 * nu)))


class Recursions:
    """The state of one entity; `advance` takes days in order and gives every method's statistic of each day."""

    def __init__(self, cfg: MonitorConfig, state: tuple | None = None):
        self.cfg = cfg
        if state is None:
            state = (0, -(1 << 62), -(1 << 62), [0.0] * 6, 0, 0, 0.0, 0.0, cfg.sigma_daily ** 2, [], [], [0] * len(METHODS))
        (self.day, self.ts, self.id, sums, self.block, self.offset, self.run, self.last, self.v_trunc, r1, r2, alarms) = state
        self.sums, self.ring_1, self.ring_2, self.alarms = list(sums), list(r1), list(r2), list(alarms)

    def state(self) -> tuple:
        return (self.day, self.ts, self.id, self.sums, self.block, self.offset, self.run, self.last, self.v_trunc, self.ring_1, self.ring_2, self.alarms)

    def _plain_variance(self, e2: np.ndarray) -> np.ndarray:
        """Unrolled inside blocks of days, as in batch: a block starts from the sum over the block before it."""
        c = self.cfg
        lam, s2 = c.ewma_lambda, c.sigma_daily ** 2
        decay = -math.log(lam)
        size = 1 << 30 if decay == 0.0 else max(1, int(min(300.0 / decay, 1 << 30)))
        out = np.empty(len(e2))
        at = 0
        while at < len(e2):
            n = min(len(e2) - at, size - self.offset)
            o = np.arange(self.offset, self.offset + n, dtype=float)
            sums = np.cumsum(np.r_[self.run, e2[at:at + n] * lam ** (-o - 1.0)])
            first = s2 if self.block == 0 else s2 * lam ** size if self.block == 1 else 0.0
            out[at:at + n] = lam ** o * (first + (1.0 - lam) * (self.last + sums[:-1]))
            self.run, self.offset, at = float(sums[-1]), self.offset + n, at + n
            if self.offset == size:  # the next block sees this one decayed to its end
                self.last, self.run, self.offset, self.block = self.run * lam ** size, 0.0, 0, self.block + 1
        return out

    def _capped_variance(self, e2: np.ndarray) -> np.ndarray:
        lam, cap, out, v = self.cfg.ewma_lambda, self.cfg.truncation_c ** 2, [], self.v_trunc
        for x in e2.tolist():  # a few days a trigger, each from the one before
            out.append(v)
            v = lam * v + (1.0 - lam) * min(x, cap * v)
        self.v_trunc = v
        return np.array(out)

    def _rolling(self, ret: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the last `window` returns and squares; NaN before the window is full."""
        w, out = self.cfg.window, []
        for name, x in (("ring_1", ret), ("ring_2", ret * ret)):
            ring = getattr(self, name)
            prefix = np.r_[ring, np.cumsum(np.r_[ring[-1] if ring else 0.0, x])[1:]]
            now = np.arange(len(ring), len(prefix))
            before = np.where(now >= w, prefix[np.maximum(now - w, 0)], 0.0)
            out.append(np.where(self.day + 1 + np.arange(len(x)) >= w, prefix[now] - before, np.nan))
            setattr(self, name, prefix[-w:].tolist())
        return out[0], out[1]

    def advance(self, ret: np.ndarray) -> dict[str, np.ndarray]:
        c = self.cfg
        gap, nu, floor = c.drift_valid - c.drift_invalid, c.ewma_df, c.variance_floor_factor * c.sigma_daily ** 2
        z, e2 = ret / c.sigma_daily, (ret - c.midpoint) ** 2
        plain, capped = np.maximum(self._plain_variance(e2), floor), np.maximum(self._capped_variance(e2), floor)
        s = (c.student_t_df - 2.0) / c.student_t_df
        steps = {"binary_gaussian": z * (c.sharpe_valid / c.sqrt_days) - c.sharpe_valid * c.sharpe_valid / (2.0 * c.days_per_year),
                 "binary_student_t": _log_gap(z, c.sharpe_valid / c.sqrt_days, 0.0, s, c.student_t_df)}
        for kind, v in (("ewma", plain), ("ewma_trunc", capped)):
            steps[f"{kind}_gaussian"] = gap * (ret - c.midpoint) / v
            steps[f"{kind}_student_t"] = _log_gap(ret, c.drift_valid, c.drift_invalid, v * ((nu - 2.0) / nu), nu)
        out = {}
        for k, (name, step) in enumerate(steps.items()):
            total = np.cumsum(np.r_[self.sums[k], step])[1:]
            self.sums[k] = float(total[-1]) if len(total) else self.sums[k]
            out[name] = c.prior_log_odds + total
        s1, s2 = self._rolling(ret)
        mean = s1 / c.window
        sd = np.sqrt(np.maximum(s2 - c.window * mean * mean, 0.0) / (c.window - 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            out["trailing_sharpe"] = np.where(sd > 0, c.sqrt_days * mean / sd, np.nan)
        out["known_vol_rolling"] = c.sqrt_days / c.window / c.sigma_daily * s1
        self.day += len(ret)
        return out


class FirstAlarm(StatefulProcessor):
    """Emits one row per method on its first alarm, and counts of late and refused rows."""

    def __init__(self, cfg: MonitorConfig, methods: Sequence[str], retention_ms: int):
        self.cfg, self.methods, self.retention_ms = cfg, tuple(methods), retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("monitor", STATE)
        self.finished = handle.getValueState("finished", FINISHED, self.retention_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over = self.finished.get() if self.finished.exists() else None
        mine = Recursions(self.cfg, self.state.get() if self.state.exists() else None)
        last, room = (tuple(over), 0) if over else ((mine.ts, mine.id), self.cfg.horizon - mine.day)
        late = refused = 0
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        limits: dict[str, float] = {}
        newest = last
        for pdf in rows:
            if not len(pdf):
                continue
            # by position: columns from the static side of the join can lose their names on the way here
            limits = {m: float(pdf.iloc[0, len(ROW) + k]) for k, m in enumerate(self.methods)}
            ts, at, ret = pdf["ts_us"].to_numpy(np.int64), pdf["event_id"].to_numpy(np.int64), pdf["ret"].to_numpy(float)
            good = np.isfinite(ret)
            refused += int((~good).sum())
            old = (ts < last[0]) | ((ts == last[0]) & (at <= last[1]))
            late += int((good & old).sum())
            use = good & ~old
            ts, at, ret = (np.r_[a, b[use]] for a, b in zip(kept, (ts, at, ret), strict=True))
            order = np.lexsort((at, ts))
            if len(order):
                newest = max(newest, (int(ts[order[-1]]), int(at[order[-1]])))
            kept = tuple(x[order[:room]] for x in (ts, at, ret))
        out = [(key[0], name, n, None, None) for name, n in ((LATE, late), (REFUSED, refused)) if n]
        ts, at, ret = kept
        if not over and len(ret):
            day = mine.day
            stats = mine.advance(ret)
            for k, m in enumerate(self.methods):
                slot = METHODS.index(m)
                if mine.alarms[slot]:
                    continue
                from_day = DETECTORS[m].first_eligible_day(self.cfg) - day - 1
                low = stats[m] < limits[m] - TOLERANCE * max(1.0, abs(limits[m]))
                low[:max(from_day, 0)] = False
                if low.any():
                    first = int(low.argmax())
                    mine.alarms[slot] = day + first + 1
                    out.append((key[0], m, mine.alarms[slot], float(stats[m][first]), limits[m]))
            mine.ts, mine.id = int(ts[-1]), int(at[-1])
            if mine.day >= self.cfg.horizon or all(mine.alarms[METHODS.index(m)] for m in self.methods):
                self.state.clear()
                self.finished.update((mine.ts, mine.id))
            else:
                self.state.update(mine.state())
        elif over:
            self.finished.update(newest)  # still heard of: the retention time starts anew
        yield pd.DataFrame(out, columns=["entity", "method", "tau", "stat", "threshold"])

    def close(self) -> None:
        pass


def monitor(stream: DataFrame, cfg: MonitorConfig, thresholds: DataFrame, methods: Sequence[str] = METHODS, retention_ms: int = RETENTION_MS) -> DataFrame:
    """First alarms of `stream` (entity, ts_us, event_id, ret); needs the RocksDB state store.

    `thresholds` (method, threshold) is a batch table: where it is read from files, each trigger
    sees their present rows. It becomes one row of as many columns as there are methods, so its
    broadcast is bounded. A method without a threshold never alarms.
    """
    one = thresholds.groupBy().agg(*[F.coalesce(F.max(F.when(F.col("method") == m, F.col("threshold"))), F.lit(float("-inf"))).alias(_LIMIT + m) for m in methods])
    rows = stream.select(*ROW).join(small(one), F.lit(True))
    return rows.groupBy("entity").transformWithStateInPandas(
        statefulProcessor=FirstAlarm(cfg, methods, retention_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")


def alarm_sink(path: str):
    """Writes a trigger's rows to a folder named by its batch id: a batch that is run again replaces its own rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def run_available(stream: DataFrame, cfg: MonitorConfig, thresholds: DataFrame, path: str, checkpoint: str, methods: Sequence[str] = METHODS,
                  retention_ms: int = RETENTION_MS) -> None:
    """Reads what has landed since the checkpoint's last run and stops; state carries over.

    Expiry needs the processing-time mode, which asks for another trigger as long as the query
    lives; without empty triggers the query ends with the landed rows, and expired places go with
    the next run that has rows.
    """
    spark, name = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        q = (monitor(stream, cfg, thresholds, methods, retention_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(alarm_sink(path)).start())
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
