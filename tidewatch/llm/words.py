"""Words of a batch of texts as flat numpy arrays: boundaries, hashes, rolling windows, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
#: one random odd-or-even 64-bit value per byte and stream, and an odd multiplier per stream
_BYTES = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Polynomials modulo a power of two have collisions that can be written down (Thue-Morse words), from
#: some 1,000 places on. Spans of more bytes than this are hashed one by one with xxHash, windows of
#: more values are folded with a mixing step between doublings.
LONG = 255
_SEGMENT = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about `most` bytes of text, at least one row each."""
    for batch in batches:
        off = np.frombuffer(_plain(batch.column(batch.schema.get_field_index(column))).buffers()[1], np.int32)[:batch.num_rows + 1] if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _plain(text: pa.Array) -> pa.Array:
    """Without nulls and with offsets that start at 0."""
    text = text.cast(pa.string()).fill_null("")
    return pa.concat_arrays([text]) if text.offset == 0 else pa.concat_arrays([text, pa.array([], pa.string())])


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each."""
    text = _plain(text)
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, off - off[0]


class Words:
    """Byte spans of the words of each text; `first[d]:first[d + 1]` are the words of text d."""

    def __init__(self, text: pa.Array, lower: bool = False):
        self.data, self.off = raw(text)
        if lower:
            up = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (up * np.uint8(32))
        n = len(self.data)
        ink = ~SPACE[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = ink[:-1], ink[1:]
        before[self.off[:-1][self.off[:-1] < n]] = False
        after[self.off[1:][self.off[1:] > self.off[:-1]] - 1] = False
        self.start = np.flatnonzero(ink & ~before)
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.per_text = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.per_text)), self.per_text)

    def hashes(self, stream: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, stream)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (fixed values: the public murmur3 multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tables(stream: int) -> tuple[np.ndarray, np.ndarray]:
    if stream not in _powers:
        n = _SEGMENT + LONG + 1
        out = []
        for base in (_BASE[stream], pow(_BASE[stream], -1, 2**64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[stream] = tuple(out)
    return _powers[stream]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, stream: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; a function of its bytes alone. Spans must be in order and not overlap.

    A span's hash is a polynomial in the stream's base, read off prefix sums; only spans of more
    than LONG bytes are looped over. The two streams are independent: together they have 128 bits.
    """
    up, down = _tables(stream)
    out = np.zeros(len(start), np.uint64)
    long = np.flatnonzero(end - start > LONG)
    short = np.flatnonzero(end - start <= LONG) if len(long) else np.arange(len(start))
    s, e = start[short], end[short]
    at = 0
    while at < len(s):
        to = int(np.searchsorted(s, s[at] + _SEGMENT, "left"))
        base, stop = int(s[at]), int(e[to - 1])
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_BYTES[stream][data[base:stop]] * up[:stop - base], out=sums[1:])
        a, b = s[at:to] - base, e[at:to] - base
        out[short[at:to]] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    for k in long:
        out[k] = xxhash.xxh64_intdigest(data[start[k]:end[k]].tobytes(), seed=stream)
    return out


def windows(h: np.ndarray, width: int, stream: int = 0) -> np.ndarray:
    """Hash of each `width` consecutive values, by doubling: a polynomial up to LONG values; mix before use."""
    total = len(h) - width + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    if width > LONG:
        return _folded(h, width, stream)
    base, size, power, have, out = _BASE[stream], 1, h, 0, np.zeros(total, np.uint64)
    while True:
        if width & size:
            out += np.uint64(pow(base, have, 2**64)) * power[have:have + total]
            have += size
        if 2 * size > width:
            return out
        power = power[:len(power) - size] + np.uint64(pow(base, size, 2**64)) * power[size:]
        size *= 2


def _folded(h: np.ndarray, width: int, stream: int) -> np.ndarray:
    """As `windows`, but every doubling is mixed, so no algebra holds between windows."""
    base, size, have, total = np.uint64(_BASE[stream]), 1, 0, len(h) - width + 1
    power, out = mixed(h + base), np.zeros(total, np.uint64)
    while True:
        if width & size:
            out = mixed(out * base + power[have:have + total])
            have += size
        if 2 * size > width:
            return out
        power = mixed(power[:len(power) - size] * base + power[size:])
        size *= 2


def _candidates(keys: np.ndarray) -> np.ndarray:
    """Positions whose key may occur again: all that share a slot of a counting table."""
    bits = max(8, int(4 * max(len(keys), 1)).bit_length())
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the keys that occur twice or more, and of those that occurred before."""
    every, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    some = _candidates(keys)
    if len(some):
        order = some[np.argsort(keys[some], kind="stable")]
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:][same]] = True
        every[order[1:][same]] = True
        every[order[:-1][same]] = True
    return every, later


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[k]:bounds[k + 1]] as the bytes of row k, without a copy per row."""
    values = np.ascontiguousarray(values)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def values_of(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of `binaries`: all values in row order and the number of values in each row."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts, sizes = [], []
    for c in chunks:
        if not len(c):
            continue
        off = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1]
        data = c.buffers()[2]
        parts.append(np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8))
        sizes.append(np.diff(off))
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.frombuffer(np.concatenate(parts).tobytes(), dtype), (np.concatenate(sizes) // np.dtype(dtype).itemsize).astype(np.int64)
