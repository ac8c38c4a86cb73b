"""Quality rules: how many characters lie in repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import packed
from tidewatch.llm.words import _BASE, Words, mixed, repeats, slices, span_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: the most frequent n-gram may hold this share of a text's word characters (fixed values: the published rules)
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: all n-grams that repeat an earlier one together may hold this share (fixed values: the published rules)
DUP_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: lines that repeat an earlier one: share of lines (one such line is never too many), share of characters (fixed values: the published rules)
DUP_LINES, DUP_LINE_CHARS = 0.30, 0.20
#: symbols per word (fixed value: the published rule)
SYMBOLS_PER_WORD = 0.10
BASE_WORDS, BASE_WINDOW, BASE_REPEAT = 20, 8, 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars",
          *(f"top_{n}_chars" for n in TOP_SHARE), *(f"dup_{n}_chars" for n in DUP_SHARE))


def measures(text: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for every text of a batch, without a loop over texts or words."""
    w = Words(text)
    texts = len(w.per_text)
    sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    lead = sums((w.data & 0xC0) != 0x80)
    signs = sums(SYMBOLS[w.data])
    chars = lead[w.end] - lead[w.start]
    char_sums = sums(chars)
    by_text = lambda s: s[w.first[1:]] - s[w.first[:-1]]
    out = {"n_words": w.per_text.astype(np.int64), "word_chars": by_text(char_sums), "n_symbols": signs[w.off[1:]] - signs[w.off[:-1]]}
    salt = mixed(np.arange(1, texts + 1, dtype=np.uint64))

    breaks = np.flatnonzero(w.data == 10)
    start, end = np.sort(np.concatenate([w.off[:-1], breaks + 1])), np.sort(np.concatenate([breaks, w.off[1:]]))
    of = np.repeat(np.arange(texts), np.diff(np.searchsorted(breaks, w.off)) + 1)
    full = np.flatnonzero(np.searchsorted(w.start, end) > np.searchsorted(w.start, start))
    start, end, of = start[full], end[full], of[full]
    _, again = repeats(mixed(span_hashes(w.data, start, end) ^ salt[of]))
    out["n_lines"] = np.bincount(of, minlength=texts)
    out["n_dup_lines"] = np.bincount(of[again], minlength=texts)
    inked = char_sums[np.searchsorted(w.start, end)] - char_sums[np.searchsorted(w.start, start)]
    out["dup_line_chars"] = np.bincount(of[again], weights=inked[again], minlength=texts).astype(np.int64)

    h = w.hashes()
    last = w.first[1:][w.doc] if texts else w.doc
    gram = h.copy()
    for n in range(2, max(DUP_SHARE) + 1):
        total = max(0, len(h) - n + 1)
        gram = gram[:total] + np.uint64(pow(_BASE[0], n - 1, 2**64)) * h[n - 1:n - 1 + total]
        at = np.flatnonzero(np.arange(n, n + total) <= last[:total])
        keys = mixed(gram[at] ^ salt[w.doc[at]])
        every, later = repeats(keys)
        copies = at[later]
        found, keys = at[every], keys[every]
        if n in TOP_SHARE:
            order = np.argsort(keys, kind="stable")
            heads = np.flatnonzero(np.r_[True, keys[order[1:]] != keys[order[:-1]]]) if len(order) else order
            size = np.diff(np.r_[heads, len(order)])
            head = found[order[heads]]
            best = np.zeros(texts, np.int64)
            np.maximum.at(best, w.doc[head], size * (char_sums[head + n] - char_sums[head]))
            out[f"top_{n}_chars"] = np.minimum(best, out["word_chars"])
        if n in DUP_SHARE:
            out[f"dup_{n}_chars"] = by_text(sums(chars * _covered(copies, n, len(h))))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = by_text(sums(_covered(found, n, len(h))))
    return {k: np.asarray(out[k], np.int64) for k in COUNTS}


def _covered(start: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int32)
    edge[start] += 1
    edge[start + n] -= 1
    return np.cumsum(edge)[:words] > 0


def quality(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), whole: bool = False) -> DataFrame:
    """The columns of `keep` (all columns as `row` if `whole`), the counts of COUNTS, base_failed, failed (names of broken rules) and kept.

    Words, lines and characters are those of the whole text; a missing or empty text has no
    word and fails. A text fails the base with fewer than 20 words or over 30 % of its words in
    repeated 8-word windows. Of the others those are kept that break none of the rules: share of
    characters in repeated lines and in repeated n-grams of each length, share of the most
    frequent short n-gram, symbols per word. n-grams and lines are compared by 64-bit hashes within a text.
    One pass without a shuffle: each task holds a few MB of text at a time (one text at
    least). Rows are judged alone, so repeated rows and ids need no special case.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    rows = df.select(packed(df) if whole else F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = measures(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[c]) for c in COUNTS]], names=["row", *COUNTS])

    schema = rows.select("row", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    return judged(rows.mapInArrow(measure, schema)).select(*(["row"] if whole else [F.col(f"row.`{c}`") for c in keep]), *COUNTS, "base_failed", "failed", "kept")


def judged(df: DataFrame) -> DataFrame:
    """base_failed, failed and kept from the counts."""
    c = F.col
    over = lambda part, whole, share: c(part).cast("double") > share * c(whole).cast("double")
    rules = {"dup_lines": (c("n_dup_lines") - 1).cast("double") > DUP_LINES * c("n_lines").cast("double"), "dup_line_chars": over("dup_line_chars", "word_chars", DUP_LINE_CHARS),
             "symbols": over("n_symbols", "n_words", SYMBOLS_PER_WORD),
             **{f"top_{n}": over(f"top_{n}_chars", "word_chars", s) for n, s in TOP_SHARE.items()},
             **{f"dup_{n}": over(f"dup_{n}_chars", "word_chars", s) for n, s in DUP_SHARE.items()}}
    base = (c("n_words") < BASE_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * BASE_REPEAT)
    failed = F.array_compact(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()]))
    return df.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~c("base_failed") & (F.size("failed") == 0))
