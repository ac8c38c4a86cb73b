"""Line dedup, substring dedup, quality rules, BPE and sketches against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import ROUGH, random_texts, rough_frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, fingerprints, line_dedup, quality, substring_dedup
from tidewatch.llm.words import LONG, Words, repeats, span_hashes, windows

LAST = 2**63 - 1
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lines_by_hand(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(LAST if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (LAST if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


@pytest.mark.parametrize("rows", [ROUGH, random_texts(300), [(k, "hot line of all documents\nown line number %d" % k) for k in range(400)]])
def test_line_dedup(spark, rows):
    got = line_dedup.line_report(frame(spark, rows)).drop("keep_runs").collect()
    assert Counter(map(tuple, got)) == lines_by_hand(rows)


def test_line_dedup_keeps_columns_and_bitmaps_are_small(spark, rough, nothing):
    out = line_dedup.dedup_lines(rough)
    assert out.columns == rough.columns and out.count() == rough.count()
    assert Counter(sha(r.text or "") for r in out.collect()) == Counter(k for _, _, _, k in lines_by_hand(ROUGH).elements())
    assert line_dedup.dedup_lines(nothing).count() == 0 and line_dedup.line_report(nothing).count() == 0
    assert set(line_dedup.keep_bitmaps(rough).columns) == {"d", "th", "n_lines", "n_dropped", "keep"}


def substrings_by_hand(rows, width):
    rows = sorted(rows, key=lambda r: (LAST if r[0] is None else r[0], (r[1] or "").encode()))
    seen, out = set(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            if g in seen:
                gone[k:k + width] = [True] * width
            seen.add(g)
        out.append((i, len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y)))
    return Counter(out)


@pytest.mark.parametrize("rows,width", [(ROUGH, 20), (random_texts(300), 20), (random_texts(200, seed=8), 9), (random_texts(60, seed=9), 3), (random_texts(200, seed=3), 45)])
def test_substring_dedup(spark, rows, width, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 20_000)  # many blocks and ranges also on small tables
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 10_000)
    got = substring_dedup.substring_dedup(frame(spark, rows), width).collect()
    assert Counter(map(tuple, got)) == substrings_by_hand(rows, width)


def test_substring_dedup_empty_and_extra_columns(rough, nothing):
    assert substring_dedup.substring_dedup(nothing).count() == 0
    assert substring_dedup.substring_dedup(rough).count() == rough.count()


def test_every_difference_is_covered():
    for period, members in substring_dedup.COVERS.items():
        assert {(x - y) % period for x in members for y in members} == set(range(period))


def quality_by_hand(t):
    w = WORD.findall(t or "")
    chars = sum(map(len, w))
    seen, dup, lines, dup_chars = set(), 0, 0, 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            lines += 1
            if x in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(x)))
            seen.add(x)
    out = {"n_words": len(w), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", t or "")), "n_dup_lines": dup, "n_lines": lines, "dup_line_chars": dup_chars}
    for n in range(2, 11):
        grams = [tuple(w[k:k + n]) for k in range(len(w) - n + 1)]
        count, first = Counter(grams), {}
        for k, g in enumerate(grams):
            first.setdefault(g, k)
        if n in quality.TOP_SHARE:
            out[f"top_{n}_chars"] = min(chars, max([c * sum(map(len, g)) for g, c in count.items() if c > 1], default=0))
        if n in quality.DUP_SHARE:
            out[f"dup_{n}_chars"] = sum(len(w[j]) for j in {j for k, g in enumerate(grams) if first[g] != k for j in range(k, k + n)})
        if n == 8:
            out["n_repeat_words"] = len({j for k, g in enumerate(grams) if count[g] > 1 for j in range(k, k + n)})
    return tuple(out[c] for c in quality.COUNTS)


def test_quality(spark, nothing):
    rows = [r for r in ROUGH if len(r[1] or "") < 10_000] + random_texts(150) + [(900, "spam " * 100), (901, "# * $ % & | < >\n" * 3 + "word " * 5)]
    rows += [(902, "One clean line of words that nobody repeats, long enough to pass the base rule of twenty words in a document, as it should be.")]
    got = quality.quality(rough_frame(spark, rows)).collect()
    hand = Counter((i, *quality_by_hand(t)) for i, t in rows)
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got) == hand
    verdict = {r.doc_id: r for r in got}
    assert verdict[902].kept and not verdict[900].kept and verdict[900].base_failed and not verdict[901].kept
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.quality(nothing, whole=True).count() == 0


def test_quality_on_long_texts(spark, rough):
    got = {r.doc_id: r for r in quality.quality(rough).where("doc_id in (9, 11)").collect()}
    assert got[9].n_words == 1 and got[9].word_chars == 300_000 and got[11].n_repeat_words == 40_000 and not got[11].kept


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab\x0bcÉ日🙂\x1f.", max_size=40), max_size=8))
def test_words(texts):
    w = Words(pa.array(texts, pa.string()))
    flat = w.data.tobytes()
    got = [flat[a:b].decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(t)]
    assert w.per_text.tolist() == [len(WORD.findall(t)) for t in texts]
    h = w.hashes()
    assert all((h[i] == h[j]) == (got[i] == got[j]) for i in range(len(got)) for j in range(i))


def test_span_hashes_do_not_depend_on_place():
    words = ["ab", "b", "x" * (LONG + 5), "ab", "y" * 1_200_000, "x" * (LONG + 5), "b"]
    w = Words(pa.array([" ".join(words)]))
    h = w.hashes()
    assert [h.tolist().index(x) for x in h] == [words.index(x) for x in words]
    assert h[0] == Words(pa.array(["zzz", "  ab"])).hashes()[1] and h[0] != w.hashes(1)[0]
    assert len(span_hashes(w.data, w.start[:0], w.end[:0])) == 0


def test_windows_and_repeats():
    x = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    g = windows(x, 3)
    assert len(g) == 5 and g[0] == g[3] and len(set(g.tolist())) == 4 and len(windows(x, 9)) == 0
    every, later = repeats(g * np.uint64(0x9E3779B97F4A7C15))
    assert every.tolist() == [True, False, False, True, False] and later.tolist() == [False, False, False, True, False]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" '\nsretvlmdaXé１3!<|endoftxt>日", max_size=40)), min_size=1, max_size=6))
def test_bpe_equals_the_library(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    b = bpe.vocabulary(PATH)
    ids, off = b.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:c].tolist() for a, c in zip(off[:-1], off[1:], strict=True)] == want
    assert b.decode(ids, off) == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_round_trip_on_tables(spark, rough, nothing, library):
    got = bpe.round_trip(rough, PATH).collect()
    want = Counter()
    for i, t in ROUGH:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(t or ""))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode(bpe.encode(rough, PATH), PATH)
    assert Counter(r.text for r in back.collect()) == Counter(t or "" for _, t in ROUGH)
    assert bpe.round_trip(nothing, PATH).count() == 0 and bpe.decode(bpe.encode(nothing, PATH), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, [255, 0]), (2, None)], "id long, ids array<int>"), PATH).collect()[1].text == ""


def test_decode_replaces_broken_bytes(library):
    ids = [bpe.vocabulary(PATH).byte_id[x] for x in (0xE6, 0x97, 0x41)]
    assert bpe.vocabulary(PATH).decode(np.array(ids), np.array([0, 3])) == [library.decode([int(i) for i in ids], skip_special_tokens=False)]


def threshold(hashes, least, scale=fingerprints.SCALE):
    """The lowest of the thresholds at 1/8, 1/4, 1/2 of the range that leaves `least` hashes, else none."""
    while scale > 1:
        limit = -(2**63) + 2**64 // scale - 1
        if sum(h <= limit for h in set(hashes)) >= least:
            return limit
        scale //= 2
    return 2**63 - 1


def test_sketches(spark, rough, nothing):
    rows = random_texts(40) + [(100, None), (101, ""), (102, "two words"), (103, "two words")]
    got = {r.id: r.sketch for r in fingerprints.sketches(frame(spark, rows)).collect()}
    assert got[100] == [] == got[101] and len(got[102]) == 1 and got[102] == got[103]
    every = {r.k: set(r.h) for r in frame(spark, rows).select(F.col("doc_id").alias("k"), fingerprints.shingle_hashes(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for i, s in got.items():
        assert s == sorted(h for h in every[i] if h <= threshold(every[i], 1))
    # a sketch merges: the union's sketch follows from the parts'
    pair = spark.createDataFrame([("a b c d e f g h i j k l m n o p q r s t u v", "b b c d e x y z h i j k l m n o p q r s t u v w")], "x string, y string")
    both = F.array_union(fingerprints.shingle_hashes(F.col("x")), fingerprints.shingle_hashes(F.col("y")))
    a, b = fingerprints.sketch(F.col("x")), fingerprints.sketch(F.col("y"))
    r = pair.select(fingerprints.retained(both).alias("whole"), fingerprints.merged(a, b).alias("parts"), fingerprints.containment(a, a).alias("c")).first()
    assert r.whole == r.parts and r.c == 1.0
    assert fingerprints.edit_report(nothing).count() == 0


def test_edit_report(spark):
    for rows in (ROUGH, random_texts(50), [(4, "only one")]):
        got = fingerprints.edit_report(frame(spark, rows)).collect()
        keys = {r["k"]: r["h"] for r in frame(spark, rows).select(F.coalesce("text", F.lit("")).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        order = sorted({(LAST if i is None else i, keys[t or ""], t or "") for i, t in rows}, reverse=True)
        nxt = {a[:2]: b[2] for a, b in zip(order, order[1:] + order[:1], strict=True)}
        want = Counter()
        for i, t in rows:
            t = t or ""
            k = len(t) // 3
            want[(i, len(t), sha(t[:len(t) - k] + nxt[(LAST if i is None else i, keys[t])][:k]))] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


@pytest.mark.parametrize("least", [1, 8, fingerprints.LEAST])
def test_short_texts_against_long_ones(spark, least):
    """Likeness and containment equal those of the whole shingle sets below what both sketches cover; full for short pairs."""
    words = [f"w{k}" for k in range(1500)]
    long = " ".join(words)
    pairs = [(" ".join(words[k:k + n + 4]), long) for n in range(1, 30) for k in (0, 40, 900)]  # n shingles, all in the long text
    pairs += [(" ".join(words[:n]), " ".join([*words[:n - 2], "x", "y"])) for n in range(5, 60)]
    pairs += [(long, long + " end"), ("", long), (long, ""), ("", ""), ("a b", "a b"), ("a b", "c d"), ("a b", "")]
    df = spark.createDataFrame(pairs, "x string, y string")
    hashes = df.select(fingerprints.shingle_hashes(F.col("x")).alias("x"), fingerprints.shingle_hashes(F.col("y")).alias("y")).collect()
    a, b = (fingerprints.sketch(F.col(c), least=least) for c in "xy")
    got = df.select(F.lit(0).alias("o"), fingerprints.likeness(a, b, least=least).alias("j"), fingerprints.containment(a, b, least=least).alias("c")).collect()
    for (x, y), h, r in zip(pairs, hashes, got, strict=True):
        p, q = set(h.x), set(h.y)
        t = min(threshold(p, least), threshold(q, least))
        u, v = {k for k in p if k <= t}, {k for k in q if k <= t}
        j = 1.0 if not p and not q else len(u & v) / len(u | v) if u | v else None
        c = 1.0 if not p else 0.0 if not q else len(u & v) / len(u) if u else None
        assert (r.j, r.c) == (j, c), (x[:40], y[:40])
        if p and p <= q:
            assert r.c in (1.0, None)  # a wholly contained text never has containment below 1
        if max(len(p), len(q)) < least and p | q:
            assert r.j == len(p & q) / len(p | q)


def test_report_compares_short_texts_in_full(spark):
    rows = [(k, " ".join(f"v{k}x{j}" for j in range(9 + k))) for k in range(30)]
    got = {r.doc_id: r for r in fingerprints.edit_report(frame(spark, rows)).collect()}
    for k, t in rows:
        n = len(t) // 3
        edited = t[:len(t) - n] + dict(rows)[(k - 1) % 30][:n]
        a, b = ({tuple(x.split()[j:j + 5]) for j in range(len(x.split()) - 4)} for x in (t, edited))
        assert got[k].near_edited == len(a & b) / len(a | b) > 0 and got[k].held_by_edited == len(a & b) / len(a)


def thue_morse(letters, length):
    return [letters[bin(k).count("1") % 2] for k in range(length)]


@pytest.mark.parametrize("length", [256, 1024, 2048, 4096])
def test_crafted_words_and_windows_do_not_collide(length):
    """Complementary Thue-Morse words have equal values under every polynomial modulo a power of two."""
    one, two = "".join(thue_morse("ab", length)), "".join(thue_morse("ba", length))
    for stream in (0, 1):
        h = Words(pa.array([one, two])).hashes(stream)
        assert h[0] != h[1]
        w = Words(pa.array([" ".join(one), " ".join(two)])).hashes(stream)
        x = windows(w, length, stream)
        assert len(x) == length + 1 and x[0] != x[-1] and len(set(x.tolist())) == len(x)
        again = windows(w[3:3 + length + 5], length, stream)
        assert np.array_equal(again, x[3:9])


def test_crafted_words_lose_nothing(spark):
    one, two = "".join(thue_morse("ab", 2048)), "".join(thue_morse("ba", 2048))
    rest = [f"w{k}" for k in range(22)]
    rows = [(1, " ".join([*rest[:11], one, *rest[11:]])), (2, " ".join([*rest[:11], two, *rest[11:]]))]
    got = {r.id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0}
    lines = quality.quality(frame(spark, [(1, f"{one}\n{two}\nshort")])).first()
    assert lines.n_dup_lines == 0
