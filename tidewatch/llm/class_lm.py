"""Class-based n-gram language model: distributed exchange clustering, class transitions, word emissions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import partitions, written
from tidewatch.llm.words import Words, binaries, mixed, slices, values_of

#: words that are clustered jointly, round by round; every other word of LEAST or more occurrences then
#: joins the class that suits it best. At most 65,533, as their ids are 16-bit
CORE = 1 << 15
#: words seen less often than this share the rare class
LEAST = 4
#: the exchange ends when fewer than SETTLED of the core's tokens moved in two rounds, at the latest after ROUNDS
CLASSES, ROUNDS, SETTLED = 64, 16, 0.01
#: weight of the shorter context in a smoothed transition, in tokens
ALPHA = 20.0
#: frequency bands per doubling of the count
BANDS = 8
#: words whose counts one group sums up
CHUNK = 1024
#: key of the token that ends every text
END_KEY = int(mixed(np.array([0x454E44], np.uint64)).view(np.int64)[0])


@dataclass
class Vocabulary:
    """The core words in key order with counts; ids: word, then other (all words outside the core), then end."""

    keys: np.ndarray
    counts: np.ndarray
    least: int       # occurrences from which on a word has a class of its own choice
    tokens: int      # all training tokens, ends included
    types: int       # distinct ones
    ends: int
    rare_tokens: int  # of the words seen less than `least` times
    edge_tokens: int  # of the words seen `least` times
    once: int         # words seen once
    twice: int        # words seen twice

    @property
    def rare(self) -> int:
        return len(self.keys)

    @property
    def end(self) -> int:
        return len(self.keys) + 1

    def ids(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.rare, np.uint16)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, self.rare).astype(np.uint16)

    @property
    def unseen(self) -> float:
        """Share of the rare class that unseen words have (Good and Turing).

        Words seen r times are expected to have what those seen r + 1 times had: unseen words
        have n_1, and the class, which ends below count t, has r n_r over all r from 1 to t.
        """
        return (self.once + 0.5) / (self.rare_tokens + self.edge_tokens + 1.0) if self.rare_tokens else 1.0

    @property
    def unseen_types(self) -> float:
        """Estimate of how many words were never seen, from those seen once and twice (Chao); one at least."""
        return max(1.0, self.once * (self.once - 1) / (2.0 * (self.twice + 1)))

    @property
    def unseen_word(self) -> float:
        """Share of the rare class that a single unseen word has, so that all of them together have `unseen`."""
        return self.unseen / self.unseen_types


def token_counts(docs: DataFrame) -> DataFrame:
    """key, n: training count of each word's 64-bit hash and of the end token, combined map-side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=16 << 20):
            w = Words(part.column(0), lower=True)
            keys, n = np.unique(w.hashes(), return_counts=True)
            keys, n = np.r_[keys.view(np.int64), END_KEY], np.r_[n, part.num_rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, core: int, least: int = LEAST) -> Vocabulary:
    """The words of the highest frequency bands that together have at most `core` words of `least` or more
    occurrences; their number bounds what the driver gets."""
    n, tokens = F.col("n"), F.sum("n")
    band = F.floor(F.log2(n.cast("double")) * BANDS)
    words = counts.where(F.col("key") != END_KEY)
    table = {r["band"]: r for r in words.where(n >= least).groupBy(band.alias("band")).agg(F.count("*").alias("types")).collect()}
    total = words.agg(tokens.alias("tokens"), F.count("*").alias("types"), F.sum(F.when(n < least, n)).alias("rare"), F.sum(F.when(n == least, n)).alias("edge"),
                      F.count_if(n == 1).alias("once"), F.count_if(n == 2).alias("twice")).first()
    end = counts.where(F.col("key") == END_KEY).agg(tokens.alias("n")).first()["n"] or 0
    chosen, room = None, core
    for b in sorted(table, reverse=True):
        room -= table[b]["types"]
        if room < 0:
            break
        chosen = b
    top = (words.where((band >= chosen) & (n >= least)).select("key", "n").toArrow() if chosen is not None
           else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}))
    keys, n = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    return Vocabulary(keys[order], n[order], least, (total["tokens"] or 0) + end, total["types"] + (end > 0), end, total["rare"] or 0, total["edge"] or 0,
                      total["once"], total["twice"])


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """id, held_out, ids (16-bit, with the end), rare (keys of the words outside the core), block (rows of some
    8 MB of text), asked (a block's distinct such keys, on its first row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(slices(batches, most=8 << 20)):
            w = Words(part.column(2), lower=True)
            keys = w.hashes()
            word = v.ids(keys)
            at = w.first + np.arange(len(w.first))  # one end per text
            ids = np.full(len(keys) + len(w.per_text), v.end, np.uint16)
            ids[np.arange(len(keys)) + w.doc] = word
            rare = np.flatnonzero(word == v.rare)
            other = keys[rare].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, w.first), pa.int32()), pa.array(other))
            distinct = np.unique(other)
            asked = pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(part.num_rows, len(distinct))], pa.int32()), pa.array(distinct))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binaries(ids, at), lists, pa.array(np.full(part.num_rows, number)), asked],
                                             names=["id", "held_out", "ids", "rare", "slice", "asked"])

    rows = docs.select("id", "held_out", "text").mapInArrow(run, "id long, held_out boolean, ids binary, rare array<long>, slice long, asked array<long>")
    block = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("slice")
    return written(rows.withColumn("block", block).drop("slice"), "tokens")


def _columns(table: DataFrame) -> DataFrame:
    """Training texts' ids, read by as many tasks as the cluster has cores: a task adds up all its texts before it hands anything on."""
    return table.where(~F.col("held_out")).select("ids").coalesce(max(1, table.sparkSession.sparkContext.defaultParallelism))


def _neighbours(table: DataFrame, classes: np.ndarray, groups: int) -> DataFrame:
    """chunk, counts: how often each class follows and precedes each word, for CHUNK words a row."""
    n = len(classes)
    chunks = -(-n // CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * chunks * CHUNK * groups, np.int64).reshape(2, -1)
        for batch in batches:
            ids, sizes = values_of(batch.column(0), np.uint16)
            if not len(ids):
                continue
            heads = np.cumsum(sizes) - sizes
            before = np.r_[ids[:1], ids[:-1]].astype(np.int64)
            before[heads] = n - 1  # the end token also stands before a text
            ids = ids.astype(np.int64)
            total[0] += np.bincount(before * groups + classes[ids], minlength=total.shape[1])
            total[1] += np.bincount(ids * groups + classes[before], minlength=total.shape[1])
        by_chunk = np.ascontiguousarray(total.reshape(2, chunks, -1).transpose(1, 0, 2)).reshape(chunks, -1)
        cell = np.flatnonzero(by_chunk)  # few of a chunk's cells are filled
        value = by_chunk.reshape(-1)[cell]
        bounds = np.searchsorted(cell, np.arange(chunks + 1) * by_chunk.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunks, dtype=np.int32)), binaries((cell % by_chunk.shape[1]).astype(np.int32), bounds), binaries(value, bounds)],
                                         names=["chunk", "cells", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        cells, _ = values_of(rows["cells"], np.int32)
        counts, _ = values_of(rows["counts"], np.int64)
        out = np.zeros(2 * CHUNK * groups, np.int64)
        np.add.at(out, cells, counts)
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "counts": pa.array([out.tobytes()], pa.binary())})

    return written(_columns(table).mapInArrow(run, "chunk int, cells binary, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary"), "neighbours")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def moved(follow: np.ndarray, precede: np.ndarray, own: np.ndarray, matrix: np.ndarray, movable: int) -> np.ndarray:
    """Best class of each word with all other words where they are: the one that raises the class bigrams' likelihood most."""
    rows, cols = matrix.sum(1), matrix.sum(0)
    out = own.copy()
    for lo in range(0, len(own), 64):
        s, p, a = follow[lo:lo + 64].astype(float), precede[lo:lo + 64].astype(float), own[lo:lo + 64]
        here = np.arange(len(a))
        m_rows = np.repeat(matrix[None, :movable], len(a), 0)
        m_cols = np.repeat(matrix.T[None, :movable], len(a), 0)
        r, c = np.repeat(rows[None, :movable], len(a), 0), np.repeat(cols[None, :movable], len(a), 0)
        m_rows[here, a] -= s
        m_cols[here, a] -= p
        r[here, a] -= s.sum(1)
        c[here, a] -= p.sum(1)
        gain = (_xlogx(m_rows + s[:, None]) - _xlogx(m_rows)).sum(2) + (_xlogx(m_cols + p[:, None]) - _xlogx(m_cols)).sum(2)
        gain -= _xlogx(r + s.sum(1)[:, None]) - _xlogx(r) + _xlogx(c + p.sum(1)[:, None]) - _xlogx(c)
        best = gain.argmax(1)
        out[lo:lo + 64] = np.where(gain[here, best] > gain[here, a] + 1e-9, best, a)
    return out


def exchange(table: DataFrame, v: Vocabulary, classes: int, rounds: int) -> np.ndarray:
    """Class of each core id when the exchange has settled, at the latest after `rounds` rounds.

    A round counts each word's neighbouring classes over the whole training text, sums the
    class bigrams, and lets half of the words (by hash, in turn) move to their best class with the
    others held. Counts of CHUNK words are one group; the class matrix and the assignment, whose
    sizes are set by the parameters, are what the driver sees. Words outside the core and the end
    token are classes of their own here.
    """
    n, groups = len(v.keys) + 2, classes + 2
    of = np.empty(n, np.int64)
    of[np.argsort(-v.counts, kind="stable")] = np.arange(len(v.keys)) % classes
    of[v.rare], of[v.end] = classes, classes + 1
    turn = (mixed(v.keys) & np.uint64(1)).astype(np.int64)
    restless = []
    for k in range(rounds if len(v.keys) else 0):
        now = of.copy()
        counts = _neighbours(table, now, groups)

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    follow = np.frombuffer(raw, np.int64).reshape(2, CHUNK, groups)[0]
                    out = np.zeros((groups, groups), np.int64)
                    at = now[chunk * CHUNK:(chunk + 1) * CHUNK]
                    np.add.at(out, at, follow[:len(at)])
                    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["matrix"])

        matrix = sum((np.frombuffer(r["matrix"], np.int64).reshape(groups, groups) for r in counts.mapInArrow(sums, "matrix binary").collect()),
                     np.zeros((groups, groups), np.int64)).astype(float)

        def move(batches: Iterator[pa.RecordBatch], now=now, matrix=matrix, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    follow, precede = np.frombuffer(raw, np.int64).reshape(2, CHUNK, groups)
                    at = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, len(turn)))
                    at = at[turn[at] == k % 2]
                    to = moved(follow[at % CHUNK], precede[at % CHUNK], now[at], matrix, classes)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(to)], names=["id", "to"])

        moves = counts.mapInArrow(move, "id long, to long").toArrow()
        of[moves["id"].to_numpy()] = moves["to"].to_numpy()
        restless.append(int(v.counts[of[:v.rare] != now[:v.rare]].sum()))
        if k and sum(restless[-2:]) < SETTLED * v.counts.sum():
            break
    return of


def _class_trigrams(rows: DataFrame, dtype, of: np.ndarray | None, groups: int) -> np.ndarray:
    """Counts of class triples in the rows' ids (or classes, without `of`); a text begins after two ends. At most groups^3 rows reach the driver."""
    end = groups - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups ** 3, np.int64)
        for batch in batches:
            ids, sizes = values_of(batch.column(0), dtype)
            c = ids.astype(np.int64) if of is None else of[ids]
            total += np.bincount(context(c, sizes, groups, end)[0], minlength=groups ** 3)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    found = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(groups ** 3, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(groups, groups, groups)


def context(c: np.ndarray, sizes: np.ndarray, groups: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class triple of every token as one number, and each text's first position."""
    heads = np.cumsum(sizes) - sizes
    one, two = np.r_[c[:1], c[:-1]], np.r_[c[:1], c[:1], c[:-2]][:len(c)]
    one[heads] = end
    two[heads] = end
    second = heads[sizes > 1] + 1
    two[second] = end
    return (two * groups + one) * groups + c, heads


def smoothed(triples: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """P(class | two classes before), each context length smoothed by the next shorter one; every row adds up to 1."""
    groups = len(triples)
    pairs = triples.sum(0).astype(float)
    one = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * groups)
    two = (pairs + alpha * one) / (pairs.sum(1, keepdims=True) + alpha)
    return (triples + alpha * two[None]) / (triples.sum(2, keepdims=True) + alpha)


def suited(follow: np.ndarray, precede: np.ndarray, matrix: np.ndarray, movable: int) -> np.ndarray:
    """Class that each word, which is in none, joins: the one that raises the class bigrams' likelihood most.

    The criterion of `moved` for words with few neighbours: only the cells that a word fills are looked at.
    """
    rows, cols, out = matrix.sum(1)[:movable], matrix.sum(0)[:movable], np.zeros(len(follow), np.int64)
    own = _xlogx(rows), _xlogx(cols)
    for lo in range(0, len(follow), 256):
        gain = np.zeros((len(follow[lo:lo + 256]), movable))
        for counts, m in ((follow, matrix[:movable].T), (precede, matrix[:, :movable])):
            word, cell = np.nonzero(counts[lo:lo + 256])
            if len(word):
                more = _xlogx(m[cell] + counts[lo + word, cell][:, None]) - _xlogx(m[cell])
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                gain[word[first]] += np.add.reduceat(more, first, 0)
        n = follow[lo:lo + 256].sum(1)[:, None]
        gain -= _xlogx(rows + n) - own[0] + _xlogx(cols + n) - own[1]
        out[lo:lo + 256] = gain.argmax(1)
    return out


def joined(table: DataFrame, v: Vocabulary, of: np.ndarray, matrix: np.ndarray, classes: int) -> DataFrame:
    """key, n, class of every training word outside the core; the rare class for words of less than `v.least` occurrences.

    Occurrences with the classes beside them are shuffled by word and sorted, so a task holds the
    counts of one batch's words, however many words there are. A word outside the core is no hot
    key: each of the core's words is more frequent.
    """
    groups, rare = classes + 2, v.rare

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = values_of(batch.column(0), np.uint16)
            at = np.flatnonzero(ids == rare)
            before = np.where(at > 0, of[ids[at - 1]], groups - 1)  # what ends the text before is the end token
            yield pa.RecordBatch.from_arrays([batch.column(1).flatten(), pa.array((before * groups + of[ids[at + 1]]).astype(np.int32))], names=["key", "cell"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            n = counts[:, 0].sum(1)
            own = np.full(len(keys), classes, np.int64)
            often = np.flatnonzero(n >= v.least)
            own[often] = suited(counts[often, 0], counts[often, 1], matrix, classes)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(own.astype(np.int16))], names=["key", "n", "class"])

        last, held = np.zeros(0, np.int64), np.zeros((0, 2, groups), np.int64)
        for batch in batches:
            keys, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            if not len(keys):
                continue
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
            counts = np.stack([np.bincount(run * groups + side, minlength=len(first) * groups).reshape(-1, groups) for side in (cell % groups, cell // groups)], 1)
            if len(last) and last[0] == keys[0]:
                counts[0] += held[0]
            elif len(last):
                yield result(last, held)
            last, held = keys[first[-1:]], counts[-1:]
            yield result(keys[first[:-1]], counts[:-1])
        if len(last):
            yield result(last, held)

    found = table.where(~F.col("held_out")).select("ids", "rare").mapInArrow(beside, "key long, cell int")
    found = found.repartition(partitions(table.sparkSession), "key").sortWithinPartitions("key")
    return written(found.mapInArrow(place, "key long, n long, class short"), "joined")


def _classed(table: DataFrame, others: DataFrame, v: Vocabulary, of: np.ndarray, mass: np.ndarray) -> DataFrame:
    """id, held_out, classes (one byte or two a token), n_tokens, known, base, emission (sum of the words' log10 P(word | class)) of every row.

    A block asks once about each of its words; its rows and the answers meet in one group, which the block's text bounds.
    """
    groups = len(mass)
    dtype = _class_type(groups)
    cost = math.log10(v.tokens + 0.5 * (v.types + 1))
    known = np.r_[np.ones(v.rare, bool), False, v.ends > 0].astype(np.int64)
    base = np.r_[np.log10(v.counts + 0.5) - cost, 0.0, math.log10(v.ends + 0.5) - cost]
    emission = np.r_[np.log10(v.counts / mass[of[:v.rare]]), 0.0, 0.0]
    weight = mass.copy()
    weight[groups - 2] = v.rare_tokens / (1 - v.unseen) if v.unseen < 1 else 1.0  # the rare class keeps a share for unseen words
    new = math.log10(v.unseen_word)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        ids, sizes = values_of(rows["ids"], np.uint16)
        c, heads = of[ids].astype(dtype), np.cumsum(sizes) - sizes
        k, b, e = known[ids], base[ids], emission[ids]
        at = np.flatnonzero(ids == v.rare)
        if len(at):
            keys = found["key"].to_numpy()
            order = np.argsort(keys)
            place = order[np.searchsorted(keys, rows["rare"].combine_chunks().flatten().to_numpy(), sorter=order)]
            n, own = found["n"].to_numpy()[place], found["class"].to_numpy()[place]
            c[at], k[at], b[at] = own, n > 0, np.log10(n + 0.5) - cost
            e[at] = np.where(n > 0, np.log10(np.maximum(n, 1) / weight[own]), new)
        total = lambda x: np.add.reduceat(x, heads)
        return pa.table({"id": rows["id"], "held_out": rows["held_out"], "classes": binaries(c, np.r_[heads, len(c)]), "n_tokens": sizes, "known": total(k),
                         "base": total(b), "emission": total(e)})

    found = table.select("block", F.explode("asked").alias("key")).join(others, "key", "left").select(
        F.col("block").alias("of"), "key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(groups - 2)).cast("short").alias("class"))
    rows = table.select("block", "id", "held_out", "ids", "rare").groupBy("block").cogroup(found.groupBy("of"))
    return written(rows.applyInArrow(run, "id long, held_out boolean, classes binary, n_tokens long, known long, base double, emission double"), "classed")


def _class_type(groups: int):
    return np.uint8 if groups <= 256 else np.uint16


def _scores(rows: DataFrame, transition: np.ndarray) -> DataFrame:
    """score of every classed row: its transitions and the emissions that it carries."""
    groups, flat = len(transition), transition.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, sizes = values_of(batch.column(6), _class_type(groups))
            cell, heads = context(c.astype(np.int64), sizes, groups, groups - 1)
            moves = np.add.reduceat(flat[cell], heads) if len(heads) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(moves + batch.column(5).to_numpy())], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return rows.select("id", "held_out", "n_tokens", "known", "base", "emission", "classes").mapInArrow(
        run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def class_mass(v: Vocabulary, of: np.ndarray, others: DataFrame, classes: int) -> np.ndarray:
    """Training tokens of each class; one row a class reaches the driver."""
    mass = np.bincount(of[:v.rare], weights=v.counts, minlength=classes + 2)
    for r in others.groupBy("class").agg(F.sum("n").alias("n")).collect():
        mass[r["class"]] += r["n"]
    mass[classes + 1] = v.ends
    return mass


def score_documents(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", core: int = CORE,
                    classes: int = CLASSES, rounds: int = ROUNDS, least: int = LEAST) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text.

    The model learns from the rows for which `held_out` is not true. Tokens are lower-cased
    (A-Z) words and one end per text. Each word's training count is kept, by 64-bit hash. The
    `core` most frequent words (to the edge of a frequency band) are clustered into `classes`
    classes by exchange; then every other word of `least` or more occurrences, however many there
    are, joins the class that its neighbours' classes suit best. Words seen less often share the
    rare class, where each has its count's share and all unseen words together the share of Good
    and Turing, spread evenly over the estimated number of words never seen, so that probabilities
    add up to one over that many. `score` is the log10 probability under P(class | two classes
    before) P(word | class), `base_score` that of add-half unigrams.

    Texts are read twice: to count words, and to be encoded and written as 16-bit ids with
    the keys of words outside the core; each block of rows asks once for the class of each such word.
    Repeated rows and ids are scored alike, each for itself; a missing or empty text is one end token. Without training texts every base probability is 1 and transitions are uniform.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    v = vocabulary(written(token_counts(docs), "counts"), core, least)
    table = encoded(docs, v)
    groups = classes + 2
    of = exchange(table, v, classes, rounds)
    matrix = _class_trigrams(_columns(table), np.uint16, of, groups).sum(0).astype(float)
    others = joined(table, v, of, matrix, classes)
    rows = _classed(table, others, v, of, class_mass(v, of, others, classes))
    triples = _class_trigrams(rows.where(~F.col("held_out")).select("classes"), _class_type(groups), None, groups)
    return (_scores(rows, np.log10(smoothed(triples))).withColumn("train_tokens", F.lit(int(v.tokens)).cast("long"))
            .select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
