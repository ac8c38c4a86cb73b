"""Statistics of whole series in Arrow batches, all series of a batch at once.

Spark partitions and sorts the rows; `whole_series` cuts the stream between two series, so
a task holds some 65,536 rows, or one series if that is longer. A statistic is a pair
(values, present): what is missing is NULL, a NaN stays a NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS = 1 << 16

Stat = tuple[np.ndarray, np.ndarray]


def whole_series(batches: Iterator[pa.RecordBatch], number: str = "_r", rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of whole series; `number` is 1 on the first row of each."""
    held, n, limit = [], 0, rows
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < limit:
            continue
        t = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(t[number].to_numpy() == 1)[-1])
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
        limit = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


class Series:
    """Rows of several series one after the other; `ok` tells which values are there."""

    def __init__(self, number: np.ndarray, x: np.ndarray, ok: np.ndarray):
        self.x, self.ok, self.place = np.where(ok, x, 0.0), ok, number - 1
        self.starts = np.flatnonzero(self.place == 0)
        self.lengths = np.diff(np.append(self.starts, len(x)))
        self.owner = np.repeat(np.arange(len(self.starts)), self.lengths)

    def sum(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v.astype(np.int64) if v.dtype == bool else v, self.starts)

    def rows(self, v: np.ndarray) -> np.ndarray:
        return np.repeat(v, self.lengths)

    def trailing(self, flag: np.ndarray, window: int) -> np.ndarray:
        """How many of the last `window` rows of the series have the flag; -1 while there are fewer rows."""
        run = np.concatenate([[0], np.cumsum(flag)])
        out = run[1:] - run[np.maximum(np.arange(len(flag)) + 1 - window, 0)]
        return np.where(self.place >= window - 1, out, -1)

    def centred(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values around their series' mean (0 where missing) and the mean; exactly 0 in a constant series."""
        at = np.arange(len(v)) if ok.all() else np.where(ok, np.arange(len(v)), len(v) - 1)
        ref = v[np.minimum.reduceat(at, self.starts)]
        c = np.where(ok, v - self.rows(ref), 0.0)
        mean = self.sum(c) / np.maximum(n, 1)
        return np.where(ok, c - self.rows(mean), 0.0), ref + mean

    def moments(self, v: np.ndarray, ok: np.ndarray) -> dict[str, Stat]:
        n = self.sum(ok)
        c, mean = self.centred(v, ok, n)
        c2 = c * c
        m2, m3, m4 = self.sum(c2), self.sum(c2 * c), self.sum(c2 * c2)
        shaped = (n > 0) & (m2 != 0)
        return {"n": (n.astype(float), np.ones(len(n), bool)), "mean": (mean, n > 0), "sd": (np.sqrt(m2 / np.maximum(n - 1, 1)), n > 1),
                "skewness": (np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2), shaped), "excess_kurtosis": (n * m4 / (m2 * m2) - 3.0, shaped)}

    def later(self, v: np.ndarray, h: int) -> np.ndarray:
        """The value h rows on; what lies beyond the series is masked by `pairs`."""
        out = np.zeros_like(v)
        out[:-h or None] = v[h:]
        return out

    def pairs(self, h: int) -> np.ndarray:
        """Rows whose value and the one h rows on in the same series are there."""
        return self.ok & self.later(self.ok, h) & (self.place + h < self.rows(self.lengths))

    def correlation(self, a: np.ndarray, b: np.ndarray, ok: np.ndarray, n: np.ndarray) -> Stat:
        """Around the means of the pairs; missing below three pairs and for a constant side."""
        a, b, k = self.centred(a, ok, n)[0], self.centred(b, ok, n)[0], np.maximum(n, 1)
        den = np.sqrt(self.sum(a * a) / k * (self.sum(b * b) / k))
        return self.sum(a * b) / k / den, (n >= 3) & (den != 0)

    def rolling_sd(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a complete window and the sd of that window, from its own two passes."""
        at = np.flatnonzero(self.trailing(self.ok, window) == window)
        m = len(self.x) - window + 1
        if m <= 0:
            return at, np.zeros(0)
        base, s = self.x[:m], np.zeros(m)
        for j in range(1, window):
            s += self.x[j:j + m] - base
        mean = s / window
        q = mean * mean
        for j in range(1, window):
            d = self.x[j:j + m] - base - mean
            q += d * d
        return at, np.sqrt(q[at - window + 1] / (window - 1))

    def quantiles(self, at: np.ndarray, v: np.ndarray, probs: tuple[float, ...]) -> list[Stat]:
        """Linear quantiles of the values v, which stand on the rows `at`, in each series."""
        own = self.owner[at]
        v = v[np.lexsort((v, own))]
        n = np.bincount(own, minlength=len(self.starts))
        first, some, out = np.cumsum(n) - n, n > 0, []
        for p in probs:
            place = np.maximum(n - 1, 0) * p
            low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
            q = np.zeros(len(n))
            a, b = v[(first + low)[some]], v[(first + high)[some]]
            w = (place - low)[some]
            q[some] = np.where(low[some] == high[some], a, (1 - w) * a + w * b)
            out.append((q, some))
        return out

    def blocks(self, h: int) -> Stat:
        """Compounded return of each whole block of h rows, on the block's last row."""
        if h == 1:
            return self.x, self.ok
        ends = np.flatnonzero((self.place + 1) % h == 0)
        value, some = np.ones(len(ends)), np.zeros(len(ends), bool)
        for j in range(h - 1, -1, -1):
            value *= np.where(self.ok[ends - j], 1.0 + self.x[ends - j], 1.0)
            some |= self.ok[ends - j]
        v, ok = np.zeros(len(self.x)), np.zeros(len(self.x), bool)
        v[ends], ok[ends] = value - 1.0, some
        return np.where(ok, v, 0.0), ok
