"""Terms of a batch of texts under a set of inner bytes, as flat arrays and one Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidewatch.llm.words import raw


def inner(*ranges: tuple[int, int]) -> np.ndarray:
    """Mask of the bytes that terms consist of; all bytes of letters beyond ASCII are inner."""
    mask = np.zeros(256, bool)
    mask[128:] = True
    for low, high in ranges:
        mask[low:high + 1] = True
    return mask


#: digits and both cases; A-Z become lower case first
ALPHANUMERIC = inner((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: the same terms as a pattern over text whose A-Z are lower case
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Terms:
    """Maximal runs of inner bytes, A-Z lower-cased; `first[d]:first[d + 1]` are the terms of text d."""

    def __init__(self, text: pa.Array, mask: np.ndarray = ALPHANUMERIC):
        data, off = raw(text)
        ink = mask[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = ink[:-1], ink[1:]
        before[off[:-1][off[:-1] < len(data)]] = False
        after[off[1:][off[1:] > off[:-1]] - 1] = False
        self.start = np.flatnonzero(ink & ~before)
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.per_text = np.diff(self.first)
        self.off = off
        self._data, self._ink = data, ink

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_text)), self.per_text)

    def strings(self) -> pa.Array:
        """The terms themselves, compared as strings wherever equality matters."""
        data = self._data[self._ink]
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
        bounds = np.r_[0, np.cumsum(self.end - self.start)]
        return pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))


def expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... (size[k] values) for every k, one after the other."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
