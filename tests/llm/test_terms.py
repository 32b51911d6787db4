"""Problems 1, 4, 6 and 7: terms, counts, overlaps and stripes."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest_llm import at, clashing, rows, twice
from wordtide.llm import burst, dfr, overlap, stripes

BT = "book_id string, platform_data string, term string, count_ bigint, published_at timestamp"
CT = "term string, book_ids array<string>, book_count int"
TL = "s3_token_lemmas_key string, sent_ix bigint, lemmas array<string>, loaded_at timestamp"


def terms(spark, data):
    return spark.createDataFrame([(b, b, t, n, None if day is None else at(day)) for b, t, n, day in data], BT)


EDGES = [
    ("b1", "rent", 100, 0), ("b1", "rent", 100, 0), ("b1", "rent", 3, -5), ("b1", "rent", None, 9), ("b1", "the", 50, 0), ("b1", "", 1, None),
    ("b2", "the", 70, 0), ("b2", "corn", 5, 0), ("b3", "the", 0, 0), ("b3", "wage", -4, 0), ("b4", "alone", 9, 0), (None, "x", 1, 0), ("b4", None, 1, 0),
]


def current(data):
    best = {}
    for b, t, n, day in data:
        if b is not None and t is not None and n is not None:
            key = (-1e9 if day is None else day, n)
            best[b, t] = max(best.get((b, t), key), key)
    return {k: v[1] for k, v in best.items()}


def weights(data):
    now = {k: max(n, 0) for k, n in current(data).items()}
    books = {b for b, _ in now}
    length, df, cf = Counter(), Counter(), Counter()
    for (b, t), n in now.items():
        length[b] += n
        df[t] += 1
        cf[t] += n
    mean, out = sum(length.values()) / len(books), {}
    for (b, t), n in now.items():
        if n == 0:
            out[b, t] = 0.0
            continue
        rate, tfn = cf[t] / len(books), n * math.log2(1 + mean / max(length[b], 1))
        out[b, t] = (math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (tfn + 1)
    return out


@pytest.mark.parametrize("change", [lambda x: x, clashing, twice])
def test_weights_are_the_formula(spark, change):
    got = {(r.book_id, r.term): r.dfr for r in dfr.term_weights(change(terms(spark, EDGES))).collect()}
    assert got == pytest.approx(weights(EDGES))


def test_standout_terms(spark):
    got = rows(dfr.standout_terms(dfr.term_weights(terms(spark, EDGES))))
    # "the" is in three books of four; b3 has no occurrence at all, b4 a single term
    assert got == [("b1", "rent"), ("b2", "the")] or got == [("b1", "rent")]
    assert rows(dfr.standout_terms(dfr.term_weights(terms(spark, [("b", "x", 5, 0), ("b", "y", 5, 0), ("c", "z", 1, 0)])))) == []
    empty = terms(spark, EDGES).limit(0)
    assert dfr.term_weights(empty).count() == dfr.standout_terms(dfr.term_weights(empty)).count() == 0


def test_rare_terms_weigh_more(spark):
    data = [(f"b{i}", "the", 30, 0) for i in range(20)] + [("b0", "rare", 30, 0)]
    got = {(r.book_id, r.term): r.dfr for r in dfr.term_weights(terms(spark, data)).collect()}
    assert got["b0", "rare"] > 2 * got["b0", "the"]


def test_hot_keys_are_spread(spark, monkeypatch):
    from wordtide.plans import skew

    monkeypatch.setattr(skew, "HOT_SHARE", 0.1)
    df = spark.range(30).selectExpr("'hot' as k", "id as v").unionByName(spark.range(5).selectExpr("concat('k', id) as k", "id as v"))
    stats = df.groupBy("k").count()
    joined = skew.spread_join(df, stats, "k", "count", ["v"])
    assert joined.count() == 35 and joined.select("v", "k", "count").distinct().count() == 35


@given(st.lists(st.tuples(st.text(alphabet="abλ\U0001d5bd\n", max_size=6), st.integers(0, 5)), max_size=200))
@settings(max_examples=60, deadline=None)
def test_burst_trie_counts_and_packs(items):
    trie, want = burst.BurstTrie(container=4), Counter()
    for t, n in items:
        trie.add(t, n, 1, 0)
        want[t] += n
    got = list(trie.items())
    assert [t for t, _ in got] == sorted(want) and {t: c[0] for t, c in got} == dict(want)
    assert sum(c[1] for _, c in got) == len(items)
    assert [(t, c) for t, c in burst.unpack(burst.pack(got))] == [(t, list(c)) for t, c in got]


def frequencies(bt, ct):
    now, books, occ = current(bt), defaultdict(set), Counter()
    for (_, t), n in now.items():
        occ[t] += n
    every = {b for b, _ in now}
    for t, ids, _ in ct:
        if t is not None:
            books[t] |= {b for b in ids or [] if b is not None}
    mark = {t: "common" if len(s) > len(every) / 2 else "rare" if len(s) < 3 or occ[t] < 60 else None for t, s in books.items()}
    return {(t, occ[t], len(s), mark[t]) for t, s in books.items()}


CORPUS = [
    ("rent", ["b1", "b1", None], 9), ("rent", ["b2"], None), ("the", ["b1", "b2", "b3"], 3), ("wage", None, 1), ("corn", [], 0), ("", ["b1"], 1),
    (None, ["b1"], 1), ("nowhere", ["b8"], 1), ("wide", [f"z{i}" for i in range(40)], 1), *[("x" * i, ["b1"], 1) for i in (1, 50, 5000)],
]


@pytest.mark.parametrize("change", [lambda x: x, clashing, twice])
def test_frequencies(spark, change):
    got = burst.term_frequencies(change(terms(spark, EDGES)), change(spark.createDataFrame(CORPUS, CT)))
    assert set(rows(got)) == frequencies(EDGES, CORPUS) and got.count() == len(frequencies(EDGES, CORPUS))


def test_frequencies_over_whole_tables(spark, tables, monkeypatch):
    bt = [(r.book_id, r.term, r.count_, r.published_at.timestamp()) for r in tables("book_terms").collect()]
    ct = [(r.term, r.book_ids, 0) for r in tables("corpus_terms").collect()]
    monkeypatch.setattr(burst, "CONTAINER", 8)
    assert set(rows(burst.term_frequencies(tables("book_terms"), tables("corpus_terms")))) == frequencies(bt, ct)


def test_frequencies_of_nothing(spark):
    bt, ct = terms(spark, EDGES), spark.createDataFrame(CORPUS, CT)
    assert burst.term_frequencies(bt, ct.limit(0)).count() == 0
    assert {r.occurrences for r in burst.term_frequencies(bt.limit(0), ct).collect()} == {0}


def test_routes_follow_the_vocabulary(spark):
    df = spark.createDataFrame([("aaaa" + chr(97 + i % 26) + str(i),) for i in range(500)] + [("b",)], "term string")
    heavy = burst.heavy_prefixes(df, routes=20)
    assert {"", "a", "aaaa"} <= heavy and "b" not in heavy
    assert burst.route("aaaab1", heavy) == "aaaab" or "aaaab" in heavy
    assert burst.route("", heavy) == "" and burst.route("b", heavy) == "b"


def overlapping(ct, least=6, share=0.75):
    sets = defaultdict(set)
    for t, ids, _ in ct:
        if t is not None:
            sets[t] |= {b for b in ids or [] if b is not None}
    big = sorted(t for t, s in sets.items() if len(s) >= least)
    return [(x, y) for i, x in enumerate(big) for y in big[i + 1 :] if len(sets[x] & sets[y]) >= share * len(sets[x] | sets[y])]


def planted(seed=0):
    rng, out = random.Random(seed), []
    for i in range(60):
        size = rng.choice([6, 7, 8, 12, 30, 90, 300])
        own = rng.sample(range(400), size)
        out.append((f"t{i}", [f"b{x}" for x in own], 0))
        for k in range(rng.randrange(3)):
            keep = [x for x in own if rng.random() > 0.12 * k]
            out.append((f"t{i}~{k}", [f"b{x}" for x in keep] + [f"n{i}{k}"], 0))
    return out + [(f"all{i}", [f"b{x}" for x in range(400)], 0) for i in range(5)] + [("none", None, 0), ("small", ["b1"], 0), (None, ["b1"], 0), ("t1", ["b1", None], 0)]


@pytest.mark.parametrize(("change", "k"), [(lambda x: x, 256), (clashing, 64), (twice, 32)])
def test_overlaps_lose_no_pair(spark, change, k):
    data = planted()
    got = rows(overlap.overlapping_terms(change(spark.createDataFrame(data, CT)), k=k))
    assert got == sorted(overlapping(data), key=repr) and len(got) > 20


def test_overlap_with_hot_members(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 1e-9)
    data = [(f"t{i}", [f"h{j}" for j in range(7)] + [f"u{i // 2}"], 0) for i in range(1200)]
    got = rows(overlap.overlapping_terms(spark.createDataFrame(data[:40], CT)))
    assert got == sorted(overlapping(data[:40]), key=repr)


def test_overlap_estimates(spark):
    data = planted(1)
    sets = defaultdict(set)
    for t, ids, _ in data:
        sets[t] |= {b for b in ids or [] if b}
    off = []
    for r in overlap.overlap_estimates(spark.createDataFrame(data, CT), k=64).collect():
        off.append(abs(r.shared / len(sets[r.term_a] & sets[r.term_b]) - 1))
    assert off and sum(off) / len(off) < 0.15 and max(off) < 0.6


def test_shared_books_of_every_term(spark):
    data = planted(2) + [(f"equal{i}", [f"q{x}" for x in range(9)], 0) for i in range(4)]
    sets = defaultdict(set)
    for t, ids, _ in data:
        sets[t] |= {b for b in ids or [] if b}
    got = rows(overlap.shared_books(spark.createDataFrame(data, CT), k=1024))
    want = [(a, b, len(sets[a]), len(sets[b]), float(len(sets[a] & sets[b]))) for a, b in overlapping(data)]
    assert [r[:5] for r in got] == sorted(want, key=repr) and ("equal1", "equal2", 9, 9, 9.0) in want


def test_overlaps_of_nothing(spark):
    empty = spark.createDataFrame([], CT)
    assert overlap.overlapping_terms(empty).count() == overlap.overlap_estimates(empty).count() == 0


def together(data, least, lift=6.0):
    best = {}
    for k, i, words, day in data:
        if k is not None and i is not None and words is not None:
            key = -1e9 if day is None else day
            if (k, i) not in best or key > best[k, i][0]:
                best[k, i] = key, words
    sents = [{w for w in words if w} for _, words in best.values()]
    one, two = Counter(w for s in sents for w in s), Counter((a, b) for s in sents for a in s for b in s if a < b)
    return sorted((a, b) for (a, b), n in two.items() if n >= least and n * len(sents) / (one[a] * one[b]) >= lift)


def sentences(seed=0):
    rng, out = random.Random(seed), []
    for i in range(600):
        words = [rng.choice(["the", "rent", "wage", "corn", "of", "mill", "toll", "", None]) for _ in range(rng.randrange(8))]
        out.append((f"k{i % 3}", i // 3, words + (["hop", "malt"] if i % 20 == 0 else []), 0))
    return out + out[:50] + [("k0", 0, ["late", "load"], 5), ("k1", 1, None, 9), (None, 1, ["x"], 0), ("k9", None, ["x"], 0), ("k2", 7, ["old"], None), ("k8", 1, ["a\0b", "c"] * 30, 0)]


@pytest.mark.parametrize("change", [lambda x: x, clashing, twice])
def test_stripes(spark, change, monkeypatch):
    data = sentences()
    df = spark.createDataFrame([(k, i, w, None if day is None else at(day)) for k, i, w, day in data], TL)
    got = rows(stripes.bound_items(change(df)))
    assert got == together(data, 10) and ("hop", "malt") in got


def test_stripes_that_are_sent_on_early(spark, tables, monkeypatch):
    data = [(r.s3_token_lemmas_key, r.sent_ix, r.lemmas, r.loaded_at.timestamp()) for r in tables("token_lemmas").collect()]
    assert rows(stripes.bound_items(tables("token_lemmas"))) == together(data, 10)


def test_pairs_come_in_blocks():
    import numpy as np

    row = np.array([0, 0, 0, 2, 5, 5, 5, 5])
    want = [(i, j) for i in range(8) for j in range(i, 8) if row[i] == row[j]]
    for size in (1, 2, 3, 7, 100):
        got = [tuple(map(int, x)) for left, right in stripes._pairs(row, size) for x in zip(left, right)]
        assert got == want
    assert list(stripes._pairs(row[:0])) == []


def test_a_very_long_record(spark):
    data = [("k", 0, [f"w{i}" for i in range(3000)], 0)] + [("k", i, ["w1", "w2"], 0) for i in range(1, 15)] + [("k", i, ["x"], 0) for i in range(20, 300)]
    df = spark.createDataFrame([(k, i, w, at(day)) for k, i, w, day in data], TL)
    assert rows(stripes.bound_items(df)) == [("w1", "w2")]


def test_stripes_of_nothing(spark):
    empty = spark.createDataFrame([], TL)
    assert stripes.cooccurrences(empty).count() == stripes.bound_items(empty).count() == 0


def test_significance(spark):
    data = [("k", i, ["a", "b"] if i < 10 else ["c"], 0) for i in range(100)]
    df = spark.createDataFrame([(k, i, w, at(day)) for k, i, w, day in data], TL)
    r = stripes.cooccurrences(df).first()
    want = 2 * (100 * math.log(100) - 90 * math.log(90) - 10 * math.log(10))
    assert (r.item_a, r.item_b, r.n_ab, r.lift) == ("a", "b", 10, 10.0) and r.llr == pytest.approx(want)


def test_a_hot_item_goes_to_many_segments_and_streams(spark, monkeypatch):
    data = [("k", i, ["hot", f"w{i % 40}", f"v{i % 30}"]) for i in range(1200)]
    df = spark.createDataFrame(data, "s3_token_lemmas_key string, sent_ix bigint, lemmas array<string>").withColumn("loaded_at", F.lit(None).cast("timestamp")).repartition(6)
    want = rows(stripes.cooccurrences(df, 5, 0.0))
    assert max(stripes.segments(df).values()) >= 7
    for name, value in (("BLOCK", 3), ("GATHERED", 7), ("SENT", 50), ("HELD", 60), ("SHARE", 1 / 64)):
        monkeypatch.setattr(stripes, name, value)
    assert rows(stripes.cooccurrences(df, 5, 0.0)) == want and len(want) > 100


def test_terms_with_a_long_common_beginning_are_routed_apart(spark):
    site = "https://books.invalid/shelf/"
    data = [(f"{site}{i:04d}",) for i in range(3000)] + [(f"{site}{i}/page",) for i in range(20)] + [("word",), (site,)]
    heavy = burst.heavy_prefixes(spark.createDataFrame(data * 2, "term string"), routes=16, entries=100)
    sizes = Counter(burst.route(t, heavy) for t, in data)
    assert max(sizes.values()) <= 100 and all(site[:k] in heavy for k in range(len(site) + 1))
    ct = spark.createDataFrame([(t, ["b"], 1) for t, in data], CT)
    got = burst.term_frequencies(terms(spark, EDGES), ct)
    assert got.count() == len(data)


def test_candidates_lose_no_leader(spark):
    rng = random.Random(3)
    data = [(f"b{b}", f"t{int(rng.paretovariate(0.7)) % 400}", int(rng.paretovariate(0.6)) - rng.randrange(2)) for b in range(40) for _ in range(120)]
    weights = dfr.term_weights(terms(spark, [(b, t, n, 0) for b, t, n in {(b, t): (b, t, n) for b, t, n in data}.values()]))
    score = F.when(F.col("tf") > 0, F.col("tf") * F.log(F.col("all_books") / F.col("n_books"))).otherwise(0.0)
    best = {}
    for r in weights.withColumn("s", score).collect():
        best.setdefault(r.book_id, []).append((r.s, r.term))
    kept = {(r.book_id, r.term) for r in dfr.candidates(weights, 1.57).collect()}
    want = set()
    for book, own in best.items():
        own.sort(reverse=True)
        assert all((book, t) in kept for s, t in own if s * 1.57 >= own[0][0] and s > 0)
        if len(own) > 1 and own[0][0] > own[1][0] and own[0][0] >= 1.57 * own[1][0]:
            want.add((book, own[0][1]))
    assert set(rows(dfr.standout_terms(weights))) == want and want and len(kept) < weights.count()
