"""Byte-level BPE: batched numpy merge rounds over the distinct words of a batch."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import raw, slices

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: encoded words a task remembers; past it the memory is emptied, which changes nothing but time
MEMORY = 1 << 16
_NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    if not _classes:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                out[c] = LETTER
            elif k == "N":
                out[c] = NUMBER
        # fixed values: code points with the white space property
        out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        _classes.append(out)
    return _classes[0]


class Bpe:
    """A byte-level vocabulary with its merges, read from a tokenizer file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        ids = spec["model"]["vocab"]
        size = max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        token: list[bytes] = [b""] * size
        for s, i in ids.items():
            token[i] = bytes(letters[c] for c in s)
        #: strings in a text that are one token, whatever surrounds them
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        for s, i in self.special.items():
            token[i] = s
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        new = np.array([ids[p[0] + p[1]] for p in pairs], np.int64)
        self.size = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order.astype(np.int64), new[order]
        self.byte_id = np.array([ids[{b: c for c, b in letters.items()}[b]] for b in range(256)], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum([len(t) for t in token])]).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.seen: dict[bytes, bytes] = {}

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair, by binary search over the sorted pair keys."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NEVER), self.new[at]

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in one flat array and the offsets of each word.

        A round finds every word's lowest-ranked pair and joins all its places in that word,
        from the left without overlap. Words with no pair left are put aside, so a round costs what
        is still in work; only pairs next to a join are looked up again.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbol, done_word = [], []
        rank, new = np.full(len(symbol), _NEVER), np.zeros(len(symbol), np.int64)
        look = np.flatnonzero(word[1:] == word[:-1])
        while len(symbol):
            rank[look], new[look] = self._ranked(symbol[look], symbol[look + 1])
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, len(word)]))
            busy = low < _NEVER
            if not busy.all():
                done_symbol.append(symbol[~busy])
                done_word.append(word[~busy])
                symbol, word, rank, new, low = symbol[busy], word[busy], rank[busy], new[busy], low[busy]
                if not len(symbol):
                    break
            hit = rank == low
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            take = hit & ((place - run) % 2 == 0)
            stay = ~np.r_[False, take[:-1]]
            symbol = np.where(take, new, symbol)[stay]
            word, rank, new, take = word[stay], rank[stay], new[stay], take[stay]
            look = np.flatnonzero(take | np.r_[take[1:], False])
            rank[look] = _NEVER
            look = look[look < len(word) - 1]
            look = look[word[look] == word[look + 1]]
        if not done_symbol:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each distinct word as bytes of 32-bit integers."""
        if len(self.seen) > MEMORY:
            self.seen.clear()
        fresh = [w for w in words if w not in self.seen]
        flat, off = self.merge_words([w for w in fresh if w not in self.special])
        flat = flat.astype(np.int32).tobytes()
        k = 0
        for w in fresh:
            if w in self.special:
                self.seen[w] = np.int32(self.special[w]).tobytes()
            else:
                self.seen[w] = flat[4 * off[k]:4 * off[k + 1]]
                k += 1
        return [self.seen[w] for w in words]

    def split(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte positions at which the pieces begin, as the pattern of byte-level vocabularies cuts.

        Pieces are runs of letters, of numbers or of other characters, each with the space
        before it, an apostrophe with a short ending (s t re ve m ll d), and white space up to
        the last character before a piece.
        """
        text = data.tobytes()
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(code)
        if not n:
            return np.zeros(0, np.int64)
        kind = char_classes()[code]
        cut = np.zeros(n + 1, bool)
        at = np.searchsorted(lead, off)
        cut[at] = True
        cut[n] = True
        inner = []
        for s in self.special:
            k = text.find(s)
            while k >= 0:
                a, b = np.searchsorted(lead, [k, k + len(s)])
                if not cut[a + 1:b].any():
                    cut[a] = cut[b] = True
                    inner.append((a, b))
                    k = text.find(s, k + len(s))
                else:
                    k = text.find(s, k + 1)
        edge = cut[:n] | np.r_[True, kind[1:] != kind[:-1]]
        space = (code == 32)
        spaced = np.r_[False, space[:-1]] & ~cut[:n]
        begin = edge & ((kind == BLANK) | ~spaced)
        follows = np.r_[(kind[1:] != BLANK) & ~cut[1:n], False]
        begin |= (kind == BLANK) & follows
        # apostrophes that are a run of their own, start a piece and have a letter behind them
        single = np.flatnonzero((code == 39) & edge & ~spaced & np.r_[(kind[1:] == LETTER) & ~cut[1:n], False])
        if len(single):
            get = lambda i: np.where(i < n, code[np.minimum(i, n - 1)], 0)
            one, two = get(single + 1), get(single + 2)
            two = np.where(cut[np.minimum(single + 2, n)], 0, two)
            is1 = np.isin(one, [ord(c) for c in "stmd"])
            is2 = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for mask, size in ((is1, 1), (is2 & ~is1, 2)):
                q = single[mask]
                begin[q + 1] = False
                to = q + 1 + size
                begin[to[to < n]] = True
        for a, b in inner:
            begin[a + 1:b] = False
            begin[a] = True
            if b < n:
                begin[b] = True
        return lead[np.flatnonzero(begin)]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array and the offsets of each text."""
        data, off = raw(text)
        start = self.split(data, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        bounds = np.r_[start, len(data)].astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        known = self._encoded(pieces.dictionary.to_pylist())
        sizes = np.array([len(k) for k in known], np.int64) // 4
        flat = np.frombuffer(b"".join(known), np.int32)
        codes = pieces.indices.to_numpy()
        ids = spread(flat, np.concatenate([[0], np.cumsum(sizes)])[:-1][codes], sizes[codes])
        before = np.concatenate([[0], np.cumsum(sizes[codes])])
        return ids, before[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of id lists given flat; bytes that are no UTF-8 become replacement characters."""
        ids = np.asarray(ids, np.int64)
        sizes = self.token_start[ids + 1] - self.token_start[ids]
        data = spread(self.token_bytes, self.token_start[ids], sizes).tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[off]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of every row, one after the other."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(total)]


_loaded: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """One copy per process and file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _rows(df: DataFrame, id_col: str, value: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{value}`").alias("value"))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of each whole text.

    `path` is a tokenizer file that every executor can open. A missing text counts as empty
    and gives an empty list. Special strings in a text are their own token. Rows are encoded
    alone in batches of about 1 MB (one text at least) without a shuffle, so repeated rows and ids
    and empty tables need no special case; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "value", 1 << 20):
            ids, off = vocabulary(path).encode(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    rows = _rows(df, id_col, text_col).withColumn("value", F.coalesce("value", F.lit("")))
    return rows.mapInArrow(run, rows.select("id", F.array().cast("array<int>").alias("ids")).schema)


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, text: the text of each list of ids (a missing list: empty). Ids outside the vocabulary are an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            texts = vocabulary(path).decode(lists.values.to_numpy()[off[0]:off[-1]], off - off[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = _rows(df, id_col, ids_col).withColumn("value", F.coalesce(F.col("value").cast("array<int>"), F.array().cast("array<int>")))
    return rows.mapInArrow(run, rows.select("id", F.lit("").alias("text")).schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256: `encode`'s ids, and digests of them and of the text they decode to, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for part in slices(batches, "value", 1 << 20):
            ids, off = bpe.encode(part.column(1))
            spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
            listed = ids.tolist()
            hashed = [hashlib.sha256(",".join([bpe.decimal[i] for i in listed[a:b]]).encode()).hexdigest() for a, b in spans]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(ids, off)]
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), lists, pa.array(hashed, pa.string()), pa.array(back, pa.string())],
                                             names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = _rows(df, id_col, text_col).withColumn("value", F.coalesce("value", F.lit("")))
    schema = rows.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("ids"),
                         F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return rows.mapInArrow(run, schema)
