"""Benchmark decontamination: an FM-index of each shard is searched backwards for the test phrases.

A shard is some MB of consecutive texts. Its words are numbered by the phrases' vocabulary; every
other word separates, and stretches shorter than the shortest phrase cannot hold one. The suffixes
of what is left are sorted, their preceding words form the transform, a wavelet matrix ranks them.
All phrases are searched at once, last word first; each range of rows is walked back to the nearest
sampled suffix, which gives the occurrence's place. Map-only: no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidewatch.llm.common import packed
from tidewatch.llm.terms import Terms, expanded
from tidewatch.llm.words import slices

#: bytes of text in a shard, distance of sampled suffixes, and phrase words sent to the tasks at once
SHARD_BYTES, SAMPLE, BLOCK_WORDS = 4 << 20, 16, 1 << 20


class WaveletMatrix:
    """Ranks of a sequence of small numbers, for arrays of positions at once."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels, now = [], values
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (now >> bit) & 1
            count = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, count, len(now) - int(count[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often value[k] occurs before position at[k]."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for bit, count, zeros in self.levels:
            one = (value >> bit) & 1 == 1
            a, b = count[low], count[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


def suffix_order(symbols: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes by prefix doubling; zeros are separators, each smaller than every later one and than any word."""
    n = len(symbols)
    stops = symbols == 0
    width = max(1, int(size + 1).bit_length())
    depth = max(1, 62 // width)
    key, step = np.zeros(n, np.int64), symbols.astype(np.int64) + 1
    alive = np.ones(n, bool)
    for k in range(depth):  # several words in one key; what follows a separator does not count
        key <<= width
        live = np.flatnonzero(alive)  # the text ends with a separator, so live + k is inside it
        key[live] += step[live + k]
        alive[live] = ~stops[live + k]
    order = np.argsort(key, kind="stable")  # stops tie by position: a stable sort orders them
    rank = np.zeros(n, np.int64)
    fresh = np.r_[True, key[order[1:]] != key[order[:-1]]]
    ended = ~alive[order]  # the key reached its separator, so position decides
    fresh[1:] |= ended[1:]
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = group
    reach = depth
    while True:
        tied = np.zeros(n, bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        place = np.flatnonzero(tied)
        if not len(place):
            return order
        at = order[place]
        # at + reach exists: a tie means that no separator came within reach
        sub = np.lexsort((at, rank[at + reach], group[place]))
        order[place] = at[sub]
        head, tail = group[place], rank[at + reach][sub]
        new = np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]
        group[place] = np.maximum.accumulate(np.where(new, place, 0))
        rank[order[place]] = group[place]
        reach *= 2


class FMIndex:
    """Backward search over symbols (zero separates), with sampled suffix positions."""

    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_order(symbols, size)
        self.last = symbols[order - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=size))]
        self.wavelet = WaveletMatrix(self.last, size)
        # every run's start is a sample, so that no walk crosses a separator
        self.sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.number = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases words[first[k]:first[k + 1]]; an empty range where one does not occur."""
        size = np.diff(first)
        low, high = np.zeros(len(size), np.int64), np.full(len(size), len(self.last), np.int64)
        low[size == 0] = high[size == 0] = 0
        live = np.flatnonzero(size > 0)
        for k in range(int(size.max(initial=0))):
            live = live[(size[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            c = words[first[live + 1] - 1 - k]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows: steps back to the nearest sample."""
        out, steps = np.zeros(len(rows), np.int64), 0
        waiting, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(waiting):
            done = self.sampled[at]
            out[waiting[done]] = self.samples[self.number[at[done]]] + steps
            waiting, at = waiting[~done], at[~done]
            c = self.last[at]
            at = self.before[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


class Phrases:
    """A block of the benchmark: distinct windows of words as numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        text = Terms(pa.array([t for _, t in items], pa.string()))
        coded = text.strings().dictionary_encode()
        self.vocabulary = coded.dictionary
        words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.names = [i for i, _ in items]
        self.size = len(self.vocabulary) + 1
        place: dict[bytes, int] = {}
        phrases, holders = [], []
        for d in range(len(items)):
            a, b = text.first[d], text.first[d + 1]
            for s in range(a, max(a + 1, b - window + 1)) if b > a else ():
                w = words[s:min(s + window, b)]
                k = place.setdefault(w.tobytes(), len(phrases))
                if k == len(phrases):
                    phrases.append(w)
                    holders.append(set())
                holders[k].add(d)
        self.first = np.r_[0, np.cumsum([len(p) for p in phrases], dtype=np.int64)].astype(np.int64)
        self.words = np.concatenate(phrases) if phrases else np.zeros(0, np.int64)
        self.shortest = min((len(p) for p in phrases), default=0)
        self.held = np.r_[0, np.cumsum([len(h) for h in holders], dtype=np.int64)].astype(np.int64)
        self.holders = np.array([d for h in holders for d in sorted(h)], np.int64)

    def hits(self, text: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mask of the words in any occurrence of a phrase, and the distinct (text, item) pairs."""
        n, doc = len(text.start), text.doc
        none = np.zeros(0, np.int64)
        if not n or not len(self.words):
            return np.zeros(n, bool), none, none
        code = pc.fill_null(pc.index_in(text.strings(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        known = code > 0
        opens, closes = known.copy(), known.copy()
        same = doc[1:] == doc[:-1]
        opens[1:] &= ~(known[:-1] & same)
        closes[:-1] &= ~(known[1:] & same)
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = stop - start >= self.shortest
        start, size = start[long], (stop - start)[long]
        if not len(start):
            return np.zeros(n, bool), none, none
        begin = np.cumsum(size + 1) - size  # every run follows its separator; one more ends the text
        symbols = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
        symbols[expanded(begin, size)] = code[expanded(start, size)]
        index = FMIndex(symbols, self.size)
        low, high = index.find(self.words, self.first)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        place = index.locate(expanded(low, count))
        run = np.searchsorted(begin, place, "right") - 1
        at = start[run] + place - begin[run]
        edge = np.bincount(at, minlength=n + 1) - np.bincount(at + np.diff(self.first)[which], minlength=n + 1)
        pair = np.unique(doc[at] * len(count) + which)
        d, p = pair // len(count), pair % len(count)
        per = np.diff(self.held)[p]
        owner = np.unique(np.repeat(d, per) * len(self.names) + self.holders[expanded(self.held[p], per)])
        return np.cumsum(edge)[:n] > 0, owner // len(self.names), owner % len(self.names)


def phrase_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Phrases]:
    """The benchmark in blocks of at most BLOCK_WORDS bytes of items (one item at least), read one partition at a time."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    items, held = [], 0
    for i, t in rows.toLocalIterator():
        if items and held + len(t) > BLOCK_WORDS:
            yield Phrases(items, window)
            items, held = [], 0
        items.append((i, t))
        held += len(t)
    yield Phrases(items, window)


FOUND = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()),
                    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))),
                    StructField("cuts", ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))),
                    StructField("items", ArrayType(StringType()))])


def _lists(values: np.ndarray, per: np.ndarray, make) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), make(values))


def _searched(phrases: Phrases, text: pa.Array, earlier: pa.Array | None) -> pa.Array:
    t = Terms(text)
    hit, owner, item = phrases.hits(t)
    n_docs = len(t.per_text)
    names = np.array(phrases.names, object)[item] if len(item) else np.zeros(0, object)
    if earlier is not None:  # what the blocks before this one have found
        spans, docs = earlier.field("spans"), np.arange(n_docs)
        flat = spans.flatten()
        d = np.repeat(docs, spans.value_lengths().to_numpy(zero_copy_only=False))
        a, b = (t.first[d] + flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "stop"))
        edge = np.bincount(a, minlength=len(hit) + 1) - np.bincount(b, minlength=len(hit) + 1)
        hit = hit | (np.cumsum(edge)[:len(hit)] > 0)
        items = earlier.field("items")
        owner = np.r_[owner, np.repeat(docs, items.value_lengths().to_numpy(zero_copy_only=False))]
        names = np.r_[names, np.array(items.flatten().to_pylist(), object)]
    named = sorted(set(zip(owner.tolist(), names.tolist(), strict=True)))
    doc = t.doc
    opens, closes = hit.copy(), hit.copy()
    same = doc[1:] == doc[:-1]
    opens[1:] &= ~(hit[:-1] & same)
    closes[:-1] &= ~(hit[1:] & same)
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    per = np.bincount(doc[a], minlength=n_docs)
    word, byte = t.first[doc[a]], t.off[doc[a]]
    pairs = lambda x: pa.StructArray.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64())], ["start", "stop"])
    sums = np.r_[0, np.cumsum(hit)]
    return pa.StructArray.from_arrays([
        pa.array(t.per_text.astype(np.int64)), pa.array((sums[t.first[1:]] - sums[t.first[:-1]]).astype(np.int64)),
        _lists((a - word, b + 1 - word), per, pairs), _lists((t.start[a] - byte, t.end[b] - byte), per, pairs),
        _lists([n for _, n in named], np.bincount(np.array([d for d, _ in named], np.int64), minlength=n_docs), lambda x: pa.array(x, pa.string()))], FOUND.names)


def contamination(df: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """row (all columns of `df` as one struct), text, and found: n_words, n_hit, spans, cuts, items of every row.

    A word is hit if it lies in an occurrence of a phrase: `window` consecutive words of an item, or
    all words of an item that has fewer (none: no phrase). Words are runs of letters and digits, A-Z
    as a-z. `spans` are the maximal stretches of hit words as word numbers, `cuts` the same in UTF-8
    bytes, `items` the sorted names of the items found. Occurrences never cross two texts.

    A benchmark larger than BLOCK_WORDS is searched block after block in the same tasks, and spans
    are merged; what a task is sent at once stays bounded. A missing text has no words. Repeated rows are
    judged each for itself. An item without id has the name ''; items of one id are one name. An
    empty benchmark hits nothing, an empty table gives an empty one.
    """
    out = df.select(packed(df), F.col(f"`{text_col}`").alias("text"))
    for phrases in phrase_blocks(benchmark, window, item_col, item_text_col):
        schema = StructType([*[f for f in out.schema if f.name != "found"], StructField("found", FOUND)])
        out = out.mapInArrow(_task(phrases), schema)
    return out


def _task(phrases: Phrases):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            text = batch.column("text")
            earlier = batch.column("found") if "found" in batch.schema.names else None
            yield pa.RecordBatch.from_arrays([batch.column("row"), text, _searched(phrases, text, earlier)], ["row", "text", "found"])
    return search


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated of each row of `contamination`."""
    f = F.col("found")
    names: Column = f["items"]
    return found.select(F.col("row")[id_col].alias(id_col), f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated"))


def cleaned(found: DataFrame) -> DataFrame:
    """The rows as they came, with `text` cut: the stretches of hit words and what lies between their words go."""
    cuts, raw_text = F.col("found")["cuts"], F.col("text").cast("binary")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(cuts, lambda c: F.array(c["start"], c["stop"]))), F.array(F.octet_length("text").cast("long")))
    kept = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: F.decode(F.substring(raw_text, (F.get(edges, 2 * k) + 1).cast("int"),
                       (F.get(edges, 2 * k + 1) - F.get(edges, 2 * k)).cast("int")), "UTF-8"))
    columns = found.schema["row"].dataType.names
    out = F.when(F.col("text").isNotNull(), F.array_join(kept, "")).alias("text")
    return found.select(*[out if c == "text" else F.col("row")[c].alias(c) for c in columns])
