"""Ranked search, hard negatives and decontamination against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ROUGH, random_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, hard_negatives, ranked_search
from tidewatch.llm.decontamination import FMIndex, Phrases, suffix_order

LAST = 2**63 - 1
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# ---- ranked search

def ranked_by_hand(docs, queries, k):
    docs = [(i, words(t)) for i, t in docs]
    docs = [(i, w) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w in docs)
    counts = [(i, len(w), Counter(w)) for i, w in docs]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, size, c in counts:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, LAST if i is None else i))
        out += [(item, r + 1, None if i == LAST else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def found(df):
    return Counter((r["item"], r["rank"], r["doc"], r["score"]) for r in df.collect())


QUERIES = [(1, "quick brown FOX line"), (2, None), (3, "..., !"), (None, "w1 w2 w3 line"), (1, "document"), (5, "été 日本 nowhere"), (6, "the " * 300 + "dog")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranked_search_rough(spark, rough, k):
    index = ranked_search.build_index(rough)
    assert found(ranked_search.search(index, items(spark, QUERIES), k)) == ranked_by_hand(ROUGH, QUERIES, k)


def test_ranked_search_many_strata(spark, monkeypatch):
    """Many segments, groups and query blocks; few results of many candidates; a text that a third of all documents share."""
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", 2_000)
    monkeypatch.setattr(ranked_search, "GROUP_DOCS", 7)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)
    docs = random_texts(300, seed=4)
    docs += [(1000 + k, docs[0][1]) for k in range(150)]
    queries = [(k, " ".join(t.split()[:12])) for k, t in docs[3:20]]
    index = ranked_search.build_index(frame(spark, docs))
    assert index.postings.where("term IS NULL").count() > 20
    assert found(ranked_search.search(index, items(spark, queries), 5)) == ranked_by_hand(docs, queries, 5)


def test_ranked_search_empty(spark, nothing, rough):
    assert ranked_search.search(ranked_search.build_index(nothing), items(spark, QUERIES)).count() == 0
    none = ranked_search.search(ranked_search.build_index(rough), items(spark, []))
    assert none.columns == ["item", "rank", "doc", "score"] and none.count() == 0
    assert ranked_search.search(ranked_search.build_index(frame(spark, [(1, None), (2, "?!")])), items(spark, QUERIES)).count() == 0


def test_best_strata_are_scored_first(spark):
    """A query's first strata are few; the others are left out where their bound is below the k-th score."""
    docs = [(k, " ".join(["rare"] * (6 if k % 5 == 0 else 1) + [f"w{k}"] * (k % 40))) for k in range(400)]
    index = ranked_search.build_index(frame(spark, docs))
    assert index.postings.where("term IS NOT NULL").select("m").distinct().count() > 20
    assert found(ranked_search.search(index, items(spark, [(1, "rare")]), 4)) == ranked_by_hand(docs, [(1, "rare")], 4)


# ---- hard negatives

def negatives_by_hand(rows, positives=5, negatives=3):
    rows = [(LAST if i is None else i, v, y) for i, v, y in rows if v is not None and y is not None and all(x is not None for x in v)]
    out = []
    for a, (i, v, y) in enumerate(rows):
        if i == LAST or i % 50:
            continue
        score = lambda w: sum(p * q for p, q in zip(v, w, strict=False))  # noqa: B023, E731
        others = sorted((-score(w), j, z == y) for b, (j, w, z) in enumerate(rows) if b != a)
        for p, j, _ in [o for o in others if o[2]][:positives]:
            inside = [(-s, n) for s, n, same in others if not same and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, j, r + 1, n, -p, s) for r, (s, n) in enumerate(inside)]
    return Counter(tuple(None if c == LAST else c for c in o) for o in out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, vector array<long>, label int, id string, h int")
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, out.collect()))


def vectors(n, seed, dims=12, spread=40, labels=4):
    rng = random.Random(seed)
    centre = [[rng.randint(-spread, spread) for _ in range(dims)] for _ in range(labels)]
    out = []
    for k in range(n):
        y = rng.randrange(labels)
        out.append((10 * k, [c + rng.randint(-spread, spread) for c in centre[y]], y if rng.random() < 0.8 else rng.randrange(labels)))
    return out


@pytest.mark.parametrize("block,rows,sample", [(2048, 4096, 4096), (7, 16, 20), (24, 9, 2)])
def test_hard_negatives(spark, monkeypatch, block, rows, sample):
    """Blocks, batches and samples of several sizes: thresholds start high and fall."""
    for name, value in (("BLOCK", block), ("ROWS", rows), ("SAMPLE", sample)):
        monkeypatch.setattr(hard_negatives, name, value)
    data = vectors(160, 3)
    assert mined(spark, data) == negatives_by_hand(data)


def test_hard_negatives_hot_vector_and_rough_rows(spark):
    """A vector that a third of the rows share, with several labels; missing parts, repeats, zeros, no positives, other lengths."""
    data = vectors(90, 5, dims=5)
    data += [(20_000 + k, data[0][1], k % 3) for k in range(60)]
    data += [(None, data[1][1], 0), (None, data[2][1], 1), (50, None, 1), (100, [1, 2, 3, 4, 5], None), (150, [1, None, 3, 4, 5], 1), (0, data[0][1], 0), (0, data[0][1], 0),
             (31_000, [0] * 5, 2), (32_000, [9, -9], 1), (33_000, [], 1), (34_000, [7, 7, 7, 7, 7, 7, 7], 3), (35_000, [3] * 5, 77)]
    assert mined(spark, data) == negatives_by_hand(data)
    assert mined(spark, data, positives=2, negatives=1) == negatives_by_hand(data, 2, 1)
    assert mined(spark, []) == Counter()


def test_large_components(spark):
    big = [(50 * k, [(k * 7919 % 13 - 6) * 2**26, (k * 104729 % 11 - 5) * 2**26], k % 2) for k in range(30)]
    assert mined(spark, big) == negatives_by_hand(big)
    with pytest.raises(ValueError):
        mined(spark, [(0, [2**40], 1)])


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 50), st.booleans())
def test_threshold_join(seed, width, low):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(-9, 9, (13, width)).astype(np.float64), rng.integers(-9, 9, (40, width)).astype(np.float64)
    y *= rng.integers(0, 4, (40, 1))
    least = rng.integers(-50 if low else 20, 60 + 25 * width, 13).astype(np.float64)
    a, b, s = hard_negatives.threshold_join(x, y, least)
    full = x @ y.T
    want = {(int(i), int(j), int(full[i, j])) for i, j in zip(*np.nonzero(full >= least[:, None]), strict=True)}
    assert set(zip(a.tolist(), b.tolist(), s.tolist(), strict=True)) == want and len(a) == len(want)


def test_quantised(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [1.0, float("nan")]), (3, [float("inf")]), (4, None), (5, [None]), (6, [])], "k int, v array<float>")
    got = {r.k: r.q for r in df.select("k", hard_negatives.quantised(F.col("v")).alias("q")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


# ---- decontamination

def hits_by_hand(docs, tests, window):
    holders = defaultdict(set)
    for i, t in tests:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            holders[tuple(w[k:k + window])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(g) for g in holders}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in holders:
                    hit |= set(range(k, k + n))
                    named |= holders[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


BENCH = [(7, "a line that several documents SHARE here"), (10, "fox"), (10, "jumps over"), (None, "no id on this one"), (3, None), (4, "!?"),
         (5, "w0 w1 w2 w3 w4 w5 w6 w0 w1 w2 w3 w4 w5 w6 w0"), (6, "日本"), (8, "not in any of the documents at all"), (9, "FOX.")]


@pytest.mark.parametrize("window", [1, 3, 10])
def test_decontamination_rough(spark, rough, window, monkeypatch):
    got = decontamination.report(decontamination.contamination(rough, items(spark, BENCH), window))
    assert Counter(map(tuple, got.collect())) == hits_by_hand(ROUGH, BENCH, window)
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)  # several blocks of the benchmark in turn
    got = decontamination.report(decontamination.contamination(rough, items(spark, BENCH), window))
    assert Counter(map(tuple, got.collect())) == hits_by_hand(ROUGH, BENCH, window)


def test_decontamination_random(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 5_000)
    docs = random_texts(250, seed=6)
    tests = [(k, " ".join(t.split()[3:30])) for k, t in docs[::9]] + [(999, " ".join(docs[4][1].split()[:4]))]
    got = decontamination.report(decontamination.contamination(frame(spark, docs), items(spark, tests)))
    assert Counter(map(tuple, got.collect())) == hits_by_hand(docs, tests, 10)


def test_decontamination_cuts_the_text(spark, rough, nothing):
    bench = items(spark, [(1, "several documents share here"), (2, "日本")])
    found_ = decontamination.contamination(rough, bench)
    out = decontamination.cleaned(found_)
    assert out.columns == rough.columns and out.count() == rough.count()
    texts = Counter(r.text for r in out.collect())
    cut = lambda t: None if t is None else re.sub("日本", "", re.sub("several documents share here", "", t))
    assert texts == Counter(cut(t) for _, t in ROUGH)
    spans = {r.row.doc_id: [tuple(s) for s in r.found.spans] for r in found_.collect() if r.row.doc_id in (1, 8)}
    assert spans == {1: [(3, 7)], 8: []}
    assert decontamination.report(decontamination.contamination(nothing, bench)).count() == 0
    clean = decontamination.report(decontamination.contamination(rough, items(spark, [])))
    assert clean.where("contaminated OR n_items > 0").count() == 0 and clean.count() == len(ROUGH)
    again = decontamination.report(decontamination.contamination(out, bench))
    assert again.where("contaminated").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(2, 5))
def test_fm_index(seed, n, size):
    rng = np.random.default_rng(seed)
    s = np.r_[0, rng.integers(0, size, n), 0].astype(np.int64)
    if seed % 3 == 0:  # a long repeat
        s = np.r_[s[:-1], s]
    ends = np.flatnonzero(s == 0)
    key = lambda i: [int(c) for c in s[i:ends[np.searchsorted(ends, i)]]] + [-1, int(ends[np.searchsorted(ends, i)])]
    assert suffix_order(s, size).tolist() == sorted(range(len(s)), key=key)
    index = FMIndex(s, size)
    phrases = [rng.integers(1, size, rng.integers(1, 5)) for _ in range(6)] + [np.array([size - 1])]
    low, high = index.find(np.concatenate(phrases), np.r_[0, np.cumsum([len(p) for p in phrases])])
    for k, p in enumerate(phrases):
        want = [i for i in range(len(s) - len(p) + 1) if (s[i:i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_phrases_of_short_items():
    p = Phrases([("a", "One two three"), ("b", "one two"), ("c", ""), ("d", "TWO three")], 2)
    assert np.diff(p.first).tolist() == [2, 2] and p.shortest == 2
    assert [sorted(p.names[d] for d in p.holders[p.held[k]:p.held[k + 1]]) for k in range(2)] == [["a", "b"], ["a", "d"]]
