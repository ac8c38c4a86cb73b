"""Sharding, mixing, URL rules, SimHash groups, the class model and the pipeline against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import ROUGH, random_texts, rough_frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import class_lm, components, mixing, queries, sharding, simhash, url_filter
from tidewatch.llm.words import mixed

SF = "/root/testdata/sf0.001"
LAST = 2**63 - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10))
def test_permutation(n, seed):
    p = sharding.permuted(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permuted(p, n, seed, inverse=True).tolist() == list(range(n))


def test_sharding(spark, rough, nothing):
    got = sharding.assign_shards(rough, 4).collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROUGH)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    back = spark.createDataFrame(got).withColumn("back", sharding.row_of(F.col("shard"), F.col("slot"), 4, len(got), 17)).collect()
    assert all(r.back == r.r for r in back) and sorted(r.r for r in back) == list(range(len(got)))
    again = Counter((r.id, r.shard, r.slot) for r in sharding.assign_shards(rough.repartition(5), 4).where("id is not null and id <> 3").collect())
    assert again == Counter((r.id, r.shard, r.slot) for r in got if r.id not in (None, 3))  # the order of the rows does not matter
    assert sharding.assign_shards(nothing).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 40), min_size=1, max_size=9))
def test_schedule_stays_within_one_block(weights):
    share = mixing.shares(weights)
    plan = mixing.period_schedule(share)
    period = sum(share.values())
    assert sorted(x for s in plan.values() for x in s) == list(range(period))
    for s, p in share.items():
        assert abs(p / period - weights[s] / sum(weights.values())) < 1e-9
        done = np.searchsorted(plan[s], np.arange(period + 1))
        assert (np.abs(done - np.arange(period + 1) * p / period) < 1).all()


def test_mix_deviates_by_less_than_one_block(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), "abc"[int(x)]) for k, x in enumerate(rng.choice(3, 3000, p=[0.7, 0.2, 0.1]))]
    target = {"a": 2.0, "b": 1.0, "c": 0.5}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), target, block_rows=4).collect()
    assert sorted(r.id for r in got) == [k for k, _ in rows] and len({(r.slot, r.place) for r in got}) == len(rows)
    owner = {r.slot: r.source for r in got}
    assert sorted(owner) == list(range(len(owner))) and len({(r.source, r.block) for r in got}) == len(owner)
    assert all(len({r.slot for r in got if (r.source, r.block) == x}) == 1 for x in {(r.source, r.block) for r in got if r.source == "c"})
    blocks = Counter(owner.values())
    done, start, alive = Counter(), 0, set(blocks)
    base = Counter()
    for t in range(len(owner)):
        done[owner[t]] += 1
        whole = sum(target[s] for s in alive)
        for s in alive:
            assert abs(done[s] - base[s] - (t + 1 - start) * target[s] / whole) < 1
        if any(done[s] == blocks[s] for s in alive):
            alive = {s for s in alive if done[s] < blocks[s]}
            base, start = Counter(done), t + 1


def test_mix_rough_rows(rough, nothing):
    got = mixing.mix(rough, {"s1": 3.0}, block_rows=2).collect()
    assert Counter(r.id for r in got) == Counter(i for i, _ in ROUGH)
    assert Counter(r.source for r in got) == Counter(r.source for r in rough.collect())
    out = mixing.mixed(rough, {"s1": 3.0}, block_rows=2)
    assert out.columns == rough.columns and out.count() == len(ROUGH)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.shares({"a": 0.0})


def test_mixed_rows_come_in_order(spark):
    df = spark.createDataFrame([(k, f"s{k % 3}") for k in range(200)], "doc_id long, source string")
    place = {r.id: (r.slot, r.place) for r in mixing.mix(df, {"s0": 2.0}).collect()}
    order = [place[r.doc_id] for r in mixing.mixed(df, {"s0": 2.0}).collect()]
    assert order == sorted(order)


def test_urls(spark):
    urls = ["http://A.Example.com/en/7x?q#z", "https://example.net/de/81", "ftp://x.net/de/1", "https://www.cheap-pills.example.com/fr/1", "no url", None, "",
            "://", "http://org/es/", "http://notexample.com/en/1", "http://x.org/es", "http://spamfarm.org/", "http://spam-farm.org/fr#://", "http://com/en/"]
    df = spark.createDataFrame([(k, u, "h", "p", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, address string")
    got = {r.id: r for r in url_filter.filter_urls(df, queries.OWN_RULES).collect()}
    judged = lambda k: (got[k].host, got[k].path, got[k].rule, got[k].verdict)
    assert judged(0) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert judged(1)[2:] == ("example.net/de/8", "block") and judged(2)[2:] == ("net/de/", "allow")
    assert judged(3)[2:] == (None, "block") and got[3].method_rule == "cheap-pills"
    assert all(judged(k) == ("", "", None, "allow") for k in (4, 5, 6, 7))
    assert judged(8)[2:] == ("org/es/", "block") and judged(9)[2:] == ("com/en/", "block") and judged(10)[2:] == (None, "allow")
    assert judged(11)[3] == "allow" and judged(12)[3] == "block" and judged(13)[2] == "com/en/"
    assert all(r.rules_tried < 17 for r in got.values())
    assert url_filter.filter_urls(df.limit(0), queries.OWN_RULES).count() == 0
    every = url_filter.Rule("any", "block", ".", (), 1)  # a rule without a token is tried on every address
    assert [r.verdict for r in url_filter.filter_urls(df, (every,), ()).orderBy("id").collect()].count("block") == len(urls) - 4


def simhash_by_hand(text):
    w = (text or "").translate(LOWER)
    w = WORD.findall(w)
    if not w:
        return 0
    grams = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_by_hand(fps):
    """Smallest id reachable over links of 4 bits or fewer; fps: (id, fingerprint)."""
    low = {}
    left = list(dict.fromkeys(fps))
    while left:
        group, left = [left[0]], left[1:]
        for x in group:
            near = [y for y in left if (x[1] ^ y[1]).bit_count() <= 4]
            group += near
            left = [y for y in left if y not in set(near)]
        for x in group:
            low[x] = min(i for i, _ in group)
    return low


@pytest.mark.parametrize("piece", [8192, 7])
def test_simhash(spark, rough, nothing, piece, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rows = [r for r in ROUGH if len(r[1] or "") < 10_000] + [(i + 100, t) for i, t in random_texts(150)]
    got = simhash.near_duplicates(rough_frame(spark, rows)).collect()
    hand = {t: simhash_by_hand(t) for _, t in rows}
    low = groups_by_hand([(LAST if i is None else i, hand[t]) for i, t in rows])
    want = Counter((i, hand[t], None if low[(LAST if i is None else i, hand[t])] == LAST else low[(LAST if i is None else i, hand[t])]) for i, t in rows)
    assert Counter((r.id, r.fp % 2**64, r.component_id) for r in got) == want
    kept = simhash.representatives(rough_frame(spark, rows))
    assert kept.columns == rough.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in want}
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.representatives(nothing).count() == 0


def test_simhash_links_of_crafted_fingerprints(spark):
    """Every distance from 1 to 6 at random places, a dense cluster and a chain: no link is lost."""
    rng = np.random.default_rng(9)
    fps = set()
    for base in rng.integers(0, 2**63, 40):
        fps.add(int(base))
        for d in range(1, 7):
            x = int(base)
            for b in rng.choice(64, d, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {1 << a | 1 << b for a in range(20) for b in range(a)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in components.components(simhash._links(simhash._cells(df))).collect()}
    want = groups_by_hand([(int(x.view(np.int64)), int(x)) for x in fps])
    got = defaultdict(set)
    for x in map(int, fps):
        got[roots.get(x, x)].add(x)
    hand = defaultdict(set)
    for (_, x), low in want.items():
        hand[low].add(x)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in hand.values()}


def shingles_by_hand(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = shingles_by_hand(a), shingles_by_hand(b)
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("piece", [4 << 20, 3000])
def test_near_copies_from_similarity_0_8_on(spark, nothing, piece, monkeypatch):
    """Planted near copies of 0.8 to 0.95 go, whatever their fingerprints' distance; pairs below 0.8 stay."""
    import corpus_pipeline

    from tidewatch.llm import near_copies
    monkeypatch.setattr(near_copies, "PIECE_BYTES", piece)
    rng = np.random.default_rng(8)
    rows = [r for r in ROUGH if len(r[1] or "") < 10_000]
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        edits = 1 + k % 8  # each replaced word changes five of the shingles: similarity 0.97 to 0.76
        near = list(words)
        for at in range(edits):
            near[20 + 30 * at] = f"new{at}"
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join(near).upper())]
    hot = [f"h{x}" for x in range(200)]
    rows += [(2000 + k, " ".join([*hot[:5 * k], f"own{k}", *hot[5 * k + 1:]])) for k in range(30)]
    rows += [(3000 + k, " ".join(hot[8 * k:] + [f"z{x}" for x in range(8 * k)])) for k in range(12)]  # a chain
    sets = [(LAST if i is None else i, t) for i, t in rows]
    near, left, low = {}, list(range(len(sets))), {}
    while left:
        group, left = [left[0]], left[1:]
        for x in group:
            near = {y for y in left if alike(sets[x][1], sets[y][1])}
            group += near
            left = [y for y in left if y not in near]
        for x in group:
            low[x] = min(sets[y][0] for y in group)
    want = Counter((rows[k][0], None if c == LAST else c) for k, c in low.items())
    df = rough_frame(spark, rows)
    assert Counter(map(tuple, near_copies.near_copies(df).collect())) == want
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()}
    assert kept == {c for _, c in want}
    planted = [(k, alike(rows_a, rows_b)) for k, (rows_a, rows_b) in enumerate((dict(rows)[1000 + 2 * k], dict(rows)[1001 + 2 * k]) for k in range(40))]
    assert all((1001 + 2 * k in kept) != gone for k, gone in planted) and 0 < sum(gone for _, gone in planted) < 40
    assert near_copies.near_copies(nothing).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(60)] + [(1000, int(k)) for k in range(1001, 1100)] + [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_class_model(spark, rough, nothing):
    rows = random_texts(200) + [(i + 500, t) for i, t in enumerate([None, "", "unseen words only here", "x" * 200_000])]
    held = F.col("doc_id") % 5 == 1
    df = rough_frame(spark, rows)
    got = {r.id: r for r in class_lm.score_documents(df, held, core=120, classes=6, rounds=4).collect()}
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t in rows}
    count = Counter(w for i in tokens if i % 5 != 1 for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 1, len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert class_lm.score_documents(nothing, held).count() == 0
    assert class_lm.score_documents(rough, F.lit(True), rounds=1).count() == len(ROUGH)  # nothing to learn from
    assert class_lm.score_documents(rough, F.lit(None).cast("boolean"), rounds=1).count() == len(ROUGH)


def test_class_model_is_a_distribution(spark):
    """Transitions of every context and emissions of every class add up to one, words outside the core included."""
    docs = rough_frame(spark, random_texts(80)).select(F.col("doc_id").alias("id"), F.lit(False).alias("held_out"), "text")
    counts = class_lm.token_counts(docs).cache()
    v = class_lm.vocabulary(counts, 20)
    table = class_lm.encoded(docs, v)
    of = class_lm.exchange(table, v, 5, 3)
    triples = class_lm._class_trigrams(table.select("ids"), np.uint16, of, 7)
    assert np.allclose(class_lm.smoothed(triples).sum(2), 1)
    others = class_lm.joined(table, v, of, triples.sum(0).astype(float), 5)
    mass = class_lm.class_mass(v, of, others, 5)
    got = {r.key: r for r in others.collect()}
    core = set(v.keys.view(np.int64).tolist())
    words = {r.key: r.n for r in counts.collect() if r.key != class_lm.END_KEY}
    assert {k: r.n for k, r in got.items()} == {k: n for k, n in words.items() if k not in core}  # every word of any count, once
    assert all((r["class"] < 5) == (r.n >= v.least) for r in got.values()) and any(r["class"] < 5 for r in got.values())
    member = {**{k: of[j] for j, k in enumerate(v.keys.view(np.int64).tolist())}, **{k: r["class"] for k, r in got.items()}}
    for g in range(5):
        inside = [n for k, n in words.items() if member[k] == g]
        assert not inside or math.isclose(sum(n / mass[g] for n in inside), 1)
    rare = [r.n for r in got.values() if r["class"] == 5]
    assert sum(rare) == v.rare_tokens == mass[5] and 0 < v.unseen < 1
    every = sum((1 - v.unseen) * n / v.rare_tokens for n in rare)
    assert math.isclose(every + v.unseen_word * v.unseen_types, 1) and v.unseen_types >= 1  # as many unseen words as are estimated


def test_class_model_score_by_brute_force(spark):
    """Every text's score is the sum over its tokens of transition and emission, from the word classes that the model found."""
    rows = random_texts(120, seed=4)
    held = F.col("doc_id") % 5 == 1
    docs = rough_frame(spark, rows).select(F.col("doc_id").alias("id"), held.alias("held_out"), "text")
    v = class_lm.vocabulary(class_lm.token_counts(docs), 25)
    table = class_lm.encoded(docs, v)
    of = class_lm.exchange(table, v, 4, 3)
    groups, end, other = 6, 5, 4
    matrix = class_lm._class_trigrams(class_lm._columns(table), np.uint16, of, groups).sum(0).astype(float)
    others = {r.key: r for r in class_lm.joined(table, v, of, matrix, 4).collect()}
    import pyarrow as pa
    tokens = {i: WORD.findall((t or "").translate(LOWER)) for i, t in rows}
    vocabulary = sorted({w for t in tokens.values() for w in t})
    key = dict(zip(vocabulary, class_lm.Words(pa.array([" ".join(vocabulary)])).hashes().view(np.int64).tolist(), strict=True))
    core = {k: j for j, k in enumerate(v.keys.view(np.int64).tolist())}
    own = {w: of[core[k]] if k in core else others[k]["class"] if k in others else other for w, k in key.items()}
    count = Counter(w for i, t in tokens.items() if i % 5 != 1 for w in t)
    triples, mass = np.zeros((groups,) * 3), Counter()
    for w, n in count.items():
        mass[own[w]] += n
    for i, t in tokens.items():
        c = [end, end, *(own[w] for w in t), end]
        for x in zip(c, c[1:], c[2:], strict=False):
            triples[x] += i % 5 != 1
    p = class_lm.smoothed(triples)
    got = {r.id: r.score for r in class_lm.score_documents(rough_frame(spark, rows), held, core=25, classes=4, rounds=3).collect()}
    for i, t in tokens.items():
        c, want = [end, end, *(own[w] for w in t), end], 0.0
        for x in zip(c, c[1:], c[2:], strict=False):
            want += math.log10(p[x])
        for w in t:
            want += math.log10(v.unseen_word if not count[w] else count[w] / mass[own[w]] * ((1 - v.unseen) if own[w] == other else 1))
        assert got[i] == pytest.approx(want)


def test_words_join_the_class_that_suits_them(spark):
    """A word outside the core ends where trying every class in turn gives the highest likelihood."""
    rng = np.random.default_rng(8)
    matrix = rng.integers(0, 500, (8, 8)).astype(float)
    follow, precede = rng.integers(0, 4, (300, 8)) * (rng.random((300, 8)) < 0.4), np.zeros((300, 8), int)
    for k in range(300):
        precede[k] = rng.permutation(follow[k])
    x = lambda m: (m * np.log(np.maximum(m, 1))).sum()
    for k, c in enumerate(class_lm.suited(follow, precede, matrix, 6)):
        gain = []
        for g in range(6):
            rows, cols = matrix[g] + follow[k], matrix[:, g] + precede[k]
            gain.append(x(rows) - x(matrix[g]) + x(cols) - x(matrix[:, g]) - x(rows.sum()) + x(matrix[g].sum()) - x(cols.sum()) + x(matrix[:, g].sum()))
        assert gain[c] == pytest.approx(max(gain))


def test_random_letters_score_below_clean_text(spark):
    """Unseen words share what is left; a text of them scores worse per token than any held-out text of the corpus."""
    rng = np.random.default_rng(12)
    junk = [(10_001 + 5 * k, " ".join("".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(300))) for k in range(3)]
    rows = random_texts(300, seed=9, words=200, passage=0.1) + junk
    got = class_lm.score_documents(rough_frame(spark, rows), F.col("doc_id") % 5 == 1, core=120, classes=6, rounds=4).collect()
    per = {r.id: r.score / r.n_tokens for r in got if r.held_out and r.n_tokens > 1}
    bad = {i for i, _ in junk}
    assert bad <= set(per) and max(per[i] for i in bad) < min(x for i, x in per.items() if i not in bad)


def test_exchange_finds_planted_classes(spark):
    """Words of two kinds that alternate strictly are told apart."""
    rng = np.random.default_rng(1)
    texts = [(k, " ".join(f"{'ab'[j % 2]}{rng.integers(12)}" for j in range(200))) for k in range(40)]
    docs = rough_frame(spark, texts).select(F.col("doc_id").alias("id"), F.lit(False).alias("held_out"), "text")
    v = class_lm.vocabulary(class_lm.token_counts(docs), 100)
    of = class_lm.exchange(class_lm.encoded(docs, v), v, 2, 8)
    words = [f"{k}{j}" for k in "ab" for j in range(12)]
    import pyarrow as pa
    ids = v.ids(class_lm.Words(pa.array(words)).hashes())
    assert len(set(of[ids[:12]])) == 1 and len(set(of[ids[12:]])) == 1 and of[ids[0]] != of[ids[-1]]
    assert len(mixed(v.keys)) == 24


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_match_sql(spark, name):
    import check
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    assert check.rows(df.columns, df.collect()) == check.rows([d[0] for d in cur.description], cur.fetchall())


def test_pipeline(spark):
    import hashlib

    import corpus_pipeline
    from test_text_operators import lines_by_hand, quality_by_hand

    from tidewatch.llm import quality
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = {}
    for i, r in docs.items():
        m = dict(zip(quality.COUNTS, quality_by_hand(r.text), strict=True))
        bad = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] or m["n_symbols"] > 0.1 * m["n_words"]
        bad |= m["n_dup_lines"] - 1 > 0.3 * m["n_lines"] or m["dup_line_chars"] > 0.2 * m["word_chars"]
        bad |= any(m[f"top_{n}_chars"] > s * m["word_chars"] for n, s in quality.TOP_SHARE.items())
        bad |= any(m[f"dup_{n}_chars"] > s * m["word_chars"] for n, s in quality.DUP_SHARE.items())
        if not bad:
            kept[i] = r.text
    want = {i: k for i, _, _, k in lines_by_hand(list(kept.items())).elements()}
    from tidewatch.llm import line_dedup
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(kept.items()), "doc_id long, text string")).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()} == want
    low = groups_by_hand([(i, simhash_by_hand(t)) for i, t in texts.items()])
    stay = {i for (i, _), c in low.items() if i == c}
    assert set(got) == stay and all(got[i].decoded_sha256 == want[i] for i in stay)
    assert all(hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 and len(r.ids) == r.n_tokens for r in got.values())


def test_pipeline_meets_the_target_weights(spark):
    """run()'s rows are in mixed order, and every source stays within one block of its weight while it has blocks."""
    import corpus_pipeline
    assert spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count() > 1
    got = corpus_pipeline.run(spark, SF).collect()
    order = [(r.slot, r.place) for r in got]
    assert order == sorted(order) and len(set(order)) == len(order)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(source[r.doc_id] == r.source for r in got)
    owner = {r.slot: r.source for r in got}
    assert sorted(owner) == list(range(len(owner))) and all(owner[r.slot] == r.source for r in got)
    blocks = Counter(owner.values())
    done, base, start, alive = Counter(), Counter(), 0, set(blocks)
    for t in range(len(owner)):
        done[owner[t]] += 1
        whole = sum(queries.TARGETS[s] for s in alive)
        assert all(abs(done[s] - base[s] - (t + 1 - start) * queries.TARGETS[s] / whole) < 1 for s in alive)
        if any(done[s] == blocks[s] for s in alive):
            alive = {s for s in alive if done[s] < blocks[s]}
            base, start = Counter(done), t + 1


def test_near_copies_are_proposed_by_simhash_too(spark, monkeypatch):
    """op9's fingerprints and grid join propose candidates; without MinHash bands its links alone find a near copy."""
    from tidewatch.llm import near_copies, simhash
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 5000, 2000)]
    near = [*words[:1000], "new", *words[1001:]]
    a, b = (simhash.fingerprint(" ".join(w).encode()) for w in (words, near))
    assert 0 < (a ^ b).bit_count() <= simhash.RADIUS
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "another text of other words altogether")], "doc_id long, text string")
    monkeypatch.setattr(near_copies, "_cells", lambda points: points.select(F.col("p").alias("cell"), "p"))  # no band is shared
    assert {r.id: r.component_id for r in near_copies.near_copies(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_simhash_broadcasts_no_table_of_points(spark):
    """a point's grid cells, some 25 rows, are sized like one row; however small Spark takes points and documents for, their joins go by key."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([(k, t) for k, t in random_texts(60)], "doc_id long, text string")
    cells = plan(simhash.links(simhash.fingerprints(df).select("fp")))
    assert "SortMergeJoin [cell" in cells and "Broadcast" not in cells
    whole = plan(simhash.near_duplicates(df))
    assert whole.count("SortMergeJoin [fp") >= 2 and "BroadcastHashJoin [fp" not in whole
