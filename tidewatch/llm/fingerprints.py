"""Document fingerprints: threshold-scaled sketches of shingle hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import LAST_ID, let, narrowed, numbered

SHINGLE = 5
#: one hash in SCALE is retained; a short text doubles its share until it has LEAST hashes or all
SCALE = 8
LEAST = 64


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all `width`-word shingles; a shorter text gives one of all its words, a text without words none."""
    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
        return F.when(F.size(words) >= width, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return let(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), of)


def _ceiling(scale: int) -> int:
    """Hashes below this lie in the lowest 1/scale of the signed 64-bit range."""
    return -(2**63) + 2**64 // scale


def _scales(scale: int) -> list[int]:
    """scale, scale / 2, ... 1: the thresholds a text may have."""
    return [scale >> k for k in range(scale.bit_length())]


def retained(hashes: Column, scale: int = SCALE, least: int = 1) -> Column:
    """Sorted distinct hashes below the text's threshold: the lowest of the scale's thresholds that leaves `least` hashes, else all.

    The rule gives the same sketch whether it is applied to a whole or to a union of sketches
    of parts: a union never has a higher threshold than its parts, so sketches merge; only a
    text without words has an empty one.
    """
    def below(all_: Column, scales: list[int]) -> Column:
        if scales == [1]:
            return all_
        low = F.filter(all_, lambda h: h < _ceiling(scales[0]))
        return let(low, lambda x: F.when(F.size(x) >= least, x).otherwise(below(all_, scales[1:])))
    return let(F.array_distinct(hashes), lambda all_: F.array_sort(below(all_, _scales(scale))))


def sketch(text: Column, width: int = SHINGLE, scale: int = SCALE, least: int = 1) -> Column:
    return retained(shingle_hashes(text, width), scale, least)


def merged(a: Column, b: Column, scale: int = SCALE, least: int = 1) -> Column:
    """The sketch of the union of two shingle sets."""
    return retained(F.array_union(a, b), scale, least)


def covered(s: Column, scale: int = SCALE, least: int = 1) -> Column:
    """The sketch's threshold: the largest value up to which it holds every hash of its text; follows from the sketch alone."""
    def among(scales: list[int]) -> Column:
        if scales == [1]:
            return F.lit(2**63 - 1)
        limit = _ceiling(scales[0])
        return F.when(F.size(F.filter(s, lambda h: h < limit)) >= least, F.lit(limit - 1)).otherwise(among(scales[1:]))
    return among(_scales(scale))


def _shared(a: Column, b: Column, scale: int, least: int, body) -> Column:
    """body(a, b) of both sketches cut to what both cover."""
    cut = lambda s, t: F.filter(s, lambda h: h <= t)
    return let(F.least(covered(a, scale, least), covered(b, scale, least)), lambda t: let(cut(a, t), lambda x: let(cut(b, t), lambda y: body(x, y))))


def likeness(a: Column, b: Column, scale: int = SCALE, least: int = 1) -> Column:
    """Estimated Jaccard similarity; two texts without words are alike. Missing where neither has a hash that both sketches cover."""
    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_union(x, y))
        return F.when(both > 0, F.size(F.array_intersect(x, y)) / F.greatest(both, F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_shared(a, b, scale, least, of))


def containment(a: Column, b: Column, scale: int = SCALE, least: int = 1) -> Column:
    """Estimated share of a's shingles that b holds, however unequal their lengths; 1 where a has none.

    Missing, not zero, where a has no hash that both sketches cover: they tell nothing about it then.
    """
    def of(x: Column, y: Column) -> Column:
        return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1)))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(b) == 0, F.lit(0.0)).otherwise(_shared(a, b, scale, least, of))


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, scale: int = SCALE, least: int = 1) -> DataFrame:
    """id, sketch (sorted array of hashes) of every whole text; a row-wise pass without a shuffle.

    Compare sketches that were made with the same `least`; the larger, the surer are short texts.
    A missing text counts as empty. Repeated rows get equal sketches.
    """
    return narrowed(df, id_col, text_col).select("id", sketch(F.col("text"), width, scale, least).alias("sketch"))


def printed(s: Column) -> Column:
    """The sketch as a string of 16 hexadecimal digits per hash."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against its edited copy and the next document, in descending id order.

    The edited copy has the last third of its characters replaced by as many of the next
    document's first ones. Ids, lengths and hashes are numbered in a narrow table. Texts are
    shuffled once by id and text hash; that exchange serves both as a document's own side and
    as the donor's side, whose needed prefix alone is shuffled on to the receiver. Rows that
    share id and text are one document in this order; rows that share the id alone follow
    their text hashes. A missing id is the largest. A single document is its own next one.
    A text's threshold is the lowest that leaves LEAST hashes, so texts with fewer shingles are
    compared in full; two sketches are compared below the lower of their thresholds. Only the
    containment columns can be missing: where that part holds nothing of the contained text.
    """
    docs = narrowed(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    keys = docs.select("d", "th", F.char_length("text").alias("n")).groupBy("d", "th").agg(F.max("n").alias("n"))
    rows = numbered(keys, ["d", "th"], "order")
    total = rows.count()
    own = rows.select(F.when(F.col("r") == 0, F.lit(total - 1)).otherwise(F.col("r") - 1).alias("r"),
                      F.col("d").alias("to_d"), F.col("th").alias("to_th"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    donors = own.join(rows.select("r", "d", "th"), "r").select("d", "th", "to_d", "to_th", "need")
    # a running count: Spark pushes the limit of a rank filter below the exchange, which would then
    # differ from the own side's exchange, and all texts would be shuffled twice
    nth = F.count("*").over(W.partitionBy("d", "th").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow))
    base = docs.select("d", "th", "text")
    lent = (base.withColumn("nth", nth).where("nth = 1").join(donors.hint("shuffle_hash"), ["d", "th"])
            .select(F.col("to_d").alias("d"), F.col("to_th").alias("th"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("loan"),
                    sketch(F.col("text"), least=LEAST).alias("next_s")))
    both = base.join(lent, ["d", "th"]).withColumn("n_chars", F.char_length("text"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.floor(F.col("n_chars") / 3).cast("int")), F.col("loan")))
    both = both.select(F.when(F.col("d") != LAST_ID, F.col("d")).alias("id"), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       sketch(F.col("text"), least=LEAST).alias("s"), sketch(F.col("edited"), least=LEAST).alias("e"), "next_s")
    s, e, n = F.col("s"), F.col("e"), F.col("next_s")
    return both.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", printed(s).alias("fingerprint"), printed(e).alias("edited_fingerprint"),
                       likeness(s, e, least=LEAST).alias("near_edited"), likeness(s, n, least=LEAST).alias("near_next"),
                       containment(s, e, least=LEAST).alias("held_by_edited"), containment(s, n, least=LEAST).alias("held_by_next"))
