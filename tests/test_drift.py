import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.functions import expressions as ex
from wordtide.functions import vectors
from wordtide.operators import books, scores, similarity
from wordtide.plans import catalog
from wordtide.plans.engine import Engine, drift
from wordtide.plans.errors import ExpressionAbsent, InvalidRequest, QueryInTooFewBooks
from wordtide.plans.settings import DEFAULT, Settings

NAMED = ["labour", "value", "wage", "rent", "stock", "price", "profit", "capital"]
FILLERS = [f"filler{i:03d}" for i in range(100)]
WORD = ex.Term("labour")
CORPUS = "/root/testdata/sf0.01"


def corpus(spark, profiles, seeds=5, counts=100):
    """profiles: book -> term -> similarity to labour, one number or one a seed."""
    rows, held = [], []
    for book, terms in profiles.items():
        own = {"labour": 1.0} | terms
        for term, s in own.items():
            values = s if isinstance(s, list) else [s] * (seeds[book] if isinstance(seeds, dict) else seeds)
            rows.append((f"gutenberg-{book}", term, [[float(x), math.sqrt(max(0.0, 1 - x * x))] for x in values]))
            held.append((f"gutenberg-{book}", term, counts, ["N"]))
    matrix = spark.createDataFrame(rows, "book_id string, term string, vs array<array<double>>")
    return matrix, spark.createDataFrame(held, "book_id string, term string, count_ bigint, tags array<string>")


def fillers(shift=0.0):
    return {t: 0.05 + i / 400 + shift for i, t in enumerate(FILLERS)}


def noisy(rng, terms):
    return {t: [float(x) for x in np.clip(rng.normal(0.3, 0.2, 5), -0.99, 0.99)] for t in terms}


def test_vectors_in_the_plan(spark):
    row = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"))
    got = row.select(vectors.unit(F.col("a")), vectors.unit(F.col("z")), vectors.dot(F.col("a"), F.col("a"))).first()
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0] and got[2] == 25


def test_deep_expressions_of_long_vectors_are_quick(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(rng.normal(size=200).tolist() for _ in range(5)) for _ in range(80)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} array<double>" for c in "abcde"))
    began = time.time()
    got = df.select(ex.compile_tree(ex.parse("a + (b - (c + (d - e)))"), F.col).alias("q")).collect()
    assert time.time() - began < 30  # it took minutes when lengths were computed anew for every number
    one = lambda v: v / np.linalg.norm(v)
    for r, (a, b, c, d, e) in zip(got, ([np.array(x) for x in row] for row in rows)):
        assert r.q == pytest.approx(one(a + one(b - one(c + one(d - e)))), abs=1e-12)


def test_half_precision(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=500), 10.0 ** rng.uniform(-6, 0, 500), [0.0, 1.0, -2.5, 6e-8]])
    rows = spark.createDataFrame([(float(x), bytearray(np.array([x, -x], dtype="<f2").tobytes())) for x in values], "x double, b binary")
    got = rows.select(vectors.to_half(F.col("x")), vectors.from_half_bytes(F.col("b"))).collect()
    for x, (half, both) in zip(values, got):
        want = float(np.float16(x))
        assert half == want and both == [want, -want]
    odd = spark.createDataFrame([(bytearray(np.array([np.inf, 1], dtype="<f2").tobytes()),), (None,), (bytearray(),), (bytearray(b"\0\x3c\1"),)], "b binary")
    assert [r[0] for r in odd.select(vectors.from_half_bytes(F.col("b"))).collect()] == [[math.inf, 1.0], None, [], [1.0]]


def test_pairs_of_books_are_bounded_by_a_request(spark):
    counts = spark.createDataFrame([(f"gutenberg-{b}", "x") for b in range(18)], "book_id string, term string")
    assert scores.shared_terms(counts.where("book_id <> 'gutenberg-0'")).count() == 17 * 16
    with pytest.raises(Exception, match="at most 17 books"):
        scores.shared_terms(counts).collect()


def test_every_published_book_is_scored(spark):
    rng = np.random.default_rng(5)
    own = {b: {"labour": [1.0] * 5} | noisy(rng, fillers()) for b in range(1, 21)}
    matrix, counts = corpus(spark, own)
    got = {r.book_id: r for r in catalog._published_scores(matrix, counts, WORD, list(range(1, 21)), DEFAULT).where("expr = 'labour'").collect()}
    assert len(got) == 20
    for group in (range(1, 11), range(11, 21)):
        for a in group:
            nearest = sorted(FILLERS, key=lambda t: (-np.mean(own[a][t]), t))[: DEFAULT.anchors]
            each = [np.corrcoef([own[a][t][i] for t in nearest], [own[b][t][i] for t in nearest])[0, 1] for b in group if b != a for i in range(5)]
            assert got[f"gutenberg-{a}"].mean_local_similarity == pytest.approx(np.mean(each), abs=2e-6) and got[f"gutenberg-{a}"].n_books == 9


def test_requests_hold_every_book():
    for n in (1, 16, 17, 100, 1248):
        asked = catalog.requests(list(range(n)), 16)
        assert sum(asked, []) == list(range(n)) and max(map(len, asked)) <= 16 and max(map(len, asked)) - min(map(len, asked)) <= 1


def test_statistics_equal_hand_computed(spark):
    rising = {b: {**fillers(), "rising": 0.1 + 0.2 * b} for b in range(1, 5)}
    matrix, _ = corpus(spark, rising)
    means = similarity.similarities(matrix, similarity.query_vectors(matrix, {"labour": WORD}))
    got = {r.term: r for r in scores.term_statistics(similarity.centred(means, DEFAULT)).collect()}
    places = []
    for b in range(1, 5):
        every = sorted([*fillers().values(), 0.1 + 0.2 * b], reverse=True)
        places.append(0.1 + 0.2 * b - np.mean(every[:100]))
    assert got["rising"].n_books_in == 4
    assert got["rising"].stability == pytest.approx(np.mean(places))
    assert got["rising"].instability == pytest.approx(np.var(places, ddof=1))


def test_instability_ignores_a_shift_of_the_whole_book(spark):
    matrix, _ = corpus(spark, {b: {**fillers(0.1 * b), "x": 0.3 + 0.1 * b} for b in range(1, 5)})
    means = similarity.similarities(matrix, similarity.query_vectors(matrix, {"labour": WORD}))
    got = {r.term: r for r in scores.term_statistics(similarity.centred(means, DEFAULT)).collect()}
    assert got["x"].instability == pytest.approx(0, abs=1e-12)


def test_membership_counts_ties(spark):
    rows = spark.createDataFrame([("e", "b", f"t{i:02d}", 1.0 if i < 60 else 0.1) for i in range(120)], "expr string, book_id string, term string, m double")
    got = similarity.centred(rows, DEFAULT)
    assert got.where("in_stable").count() == 60 and got.where("in_unstable").count() == 120


def test_strategies_agree(spark):
    matrix, _ = books.embedding_books(spark.read.parquet(f"{CORPUS}/embeddings.parquet"))
    q = similarity.query_vectors(matrix, {"x": ex.parse("t0007 + (t0011 - t0013)")})
    a = similarity.similarities(matrix, q).select("book_id", F.posexplode("s").alias("seed_ix", "s"), "term")
    b = similarity.similarities(matrix, q, "arrow").select("book_id", F.posexplode("s").alias("seed_ix", "r"), "term")
    both = a.join(b, ["book_id", "seed_ix", "term"]).select(F.max(F.abs(F.col("s") - F.col("r"))), F.count("*")).first()
    assert both[0] < 1e-9 and both[1] == a.count()


def test_golden_scores(spark):
    got = {r.book_id: r for r in catalog.drift_corpus(spark, CORPUS).collect()}
    want = {1: (-0.022914, -0.062727, 0.016899), 2: (-0.041202, -0.140791, 0.058386), 3: (0.031721, -0.058005, 0.121447), 4: (-0.016482, -0.108521, 0.075558), 5: (-0.025438, -0.063193, 0.012317)}
    for b, (mean, lo, hi) in want.items():
        r = got[f"gutenberg-{b}"]
        assert (r.mean_local_similarity, r.ci_lo, r.ci_hi) == pytest.approx((mean, lo, hi), abs=2e-6)
    nested = {r.book_id: r for r in catalog.drift_pinned_nested(spark, CORPUS).collect()}
    r = nested["gutenberg-3"]
    assert (r.mean_local_similarity, r.ci_lo, r.ci_hi) == pytest.approx((-0.004994, -0.101496, 0.091507), abs=2e-6)
    comparative = {r.term: r for r in catalog.comparative_terms_corpus(spark, CORPUS).collect()}
    assert sorted(comparative) == ["t0000", "t0002", "t0022", "t0023", "t0028", "t0035", "t0036", "t0045", "t0079", "t0081"]
    assert comparative["t0081"].instability == pytest.approx(0.044359, abs=2e-6)


def test_peers_or_seeds_give_the_interval(spark):
    local = spark.createDataFrame([("e", "a", p, s, c, 5) for p, c in (("p", 0.2), ("q", 0.8)) for s in range(5)], "expr string, a string, b string, seed_ix int, c double, n_seeds int")
    free, pinned = (scores.scores(local, p).first() for p in (False, True))
    assert free.mean_local_similarity == pinned.mean_local_similarity == pytest.approx(0.5)
    assert pinned.ci_hi - pinned.ci_lo == pytest.approx(0) and free.ci_hi - free.ci_lo > 1
    assert free.n_books == 2
    one = spark.createDataFrame([("e", "a", "p", s, 0.1 * (s + 1), 5) for s in range(5)], "expr string, a string, b string, seed_ix int, c double, n_seeds int")
    free, pinned = (scores.scores(one, p).first() for p in (False, True))
    assert (free.ci_lo, free.ci_hi) == pytest.approx((pinned.ci_lo, pinned.ci_hi)) and free.n_books == 1
    assert free.ci_hi - free.mean_local_similarity == pytest.approx(2.776 * np.std([0.1, 0.2, 0.3, 0.4, 0.5], ddof=1) / math.sqrt(5))


def test_unequal_seeds_are_cut_to_the_fewest(spark):
    rng = np.random.default_rng(1)
    profiles = {b: noisy(rng, FILLERS) for b in range(1, 6)}
    profiles[5] = {t: v[:3] for t, v in profiles[5].items()}
    matrix, counts = corpus(spark, profiles, seeds={b: 3 if b == 5 else 5 for b in profiles})
    got = drift(matrix, counts, WORD, [1, 2, 3, 4, 5]).response()
    assert {r["n_seeds"] for r in got["expr"]["books"]} == {3}
    thin = {**profiles, 5: {t: v for t, v in list(profiles[5].items())[:70]}}
    matrix, counts = corpus(spark, thin, seeds={b: 3 if b == 5 else 5 for b in thin})
    got = drift(matrix, counts, WORD, [1, 2, 3, 4, 5]).response()
    # a book that can't be compared costs nobody seeds and has no score
    assert {(r["book_id"], r["n_seeds"]) for r in got["expr"]["books"]} == {(b, 5) for b in (1, 2, 3, 4)}
    assert [b["missing_terms"] for b in got["books"]][4] is not None


def test_response_order_and_counts(spark):
    rng = np.random.default_rng(2)
    matrix, counts = corpus(spark, {b: noisy(rng, [*FILLERS, "wage"]) for b in range(1, 6)}, counts=7)
    got = drift(matrix, counts, ex.parse("labour + wage"), [4, 2, 3, 5], 1).response()
    assert [r["book_id"] for r in got["expr"]["books"]] == [4, 2, 3, 5]
    assert {r["occurrences"] for r in got["expr"]["books"]} == {14}
    assert got["expr"]["terms"] == ["labour", "wage"] and got["expr"]["expr"] == "labour + wage"
    terms = [c["term"] for c in got["comparative_terms"]]
    assert terms == sorted(terms) and 5 <= len(terms) <= 10 and not {"labour", "wage"} & set(terms)
    assert [b["id"] for b in got["books"]] == [4, 2, 3, 5] and {b["n_shared_terms"] for b in got["books"]} == {102}
    assert all("n_books" not in r for r in got["expr"]["books"])
    again = drift(matrix, counts, ex.parse("labour + wage"), [5, 3, 2, 4], 1).response()
    assert sorted(map(str, again["expr"]["books"])) == sorted(map(str, got["expr"]["books"]))


def test_zero_vector_scores_zero(spark):
    rng = np.random.default_rng(3)
    matrix, counts = corpus(spark, {b: noisy(rng, FILLERS) for b in range(1, 5)})
    got = drift(matrix, counts, ex.parse("labour - labour"), [1, 2, 3, 4]).response()
    assert {r["mean_local_similarity"] for r in got["expr"]["books"]} == {0.0}


def test_refusals_in_order(spark):
    matrix, counts = corpus(spark, {b: fillers() for b in (1, 2, 3, 4)})
    for ids, selected in (([], None), (list(range(1, 18)), None), ([2, 2, 2], None), ([1, 2], 1)):
        with pytest.raises(InvalidRequest):
            drift(matrix, counts, WORD, ids, selected)
    deep = WORD
    for _ in range(5):
        deep = ex.Op("+", deep, WORD)
    with pytest.raises(InvalidRequest):
        drift(matrix, counts, deep, [1, 2, 3, 4])
    with pytest.raises(ExpressionAbsent) as absent:
        drift(matrix, counts, ex.parse("wage + labour"), [2, 3], 1)
    assert absent.value.fields() == {"book_id": 1, "terms": ["wage"]}
    with pytest.raises(QueryInTooFewBooks) as few:
        drift(matrix, counts, WORD, [2, 3, 4], 1)
    assert few.value.fields() == {"book_id": 1} and few.value.status == 404


def term_rows(spark, rows):
    schema = "book_id string, platform_data string, term string, count_ bigint, tags array<string>, seeds array<int>, vectors array<binary>, published_at timestamp"
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    full = [(b, b, t, n, tags, list(range(len(v or []))), v, at + dt.timedelta(days=day)) for b, t, n, tags, v, day in rows]
    return spark.createDataFrame(full, schema)


def half(*x):
    return bytearray(np.array(x, dtype="<f2").tobytes())


def test_loading_books(spark):
    two = [half(1, 0), half(0, 1)]
    rows = term_rows(spark, [
        ("gutenberg-1", "quickly", 5, ["R"], two, 0), ("gutenberg-1", "value", 5, ["N", "R"], two, 0), ("gutenberg-1", "bare", 5, ["N"], None, 0),
        ("gutenberg-1", "rent", 9, None, [*two, half(1, 1)], 0), ("gutenberg-1", "rent", 4, ["N"], two, 3), ("gutenberg-1", "rent", None, ["N"], two, 9),
    ])
    matrix, counts = books.term_books(rows)
    assert sorted((r.term, r.count_) for r in counts.collect()) == [("rent", 4), ("value", 5)]
    assert sorted((r.term, r.seed_ix, r.v) for r in books.seed_rows(matrix).collect()) == [("rent", 0, [1.0, 0.0]), ("rent", 1, [0.0, 1.0]), ("value", 0, [1.0, 0.0]), ("value", 1, [0.0, 1.0])]


def pipeline(spark, rows):
    import datetime as dt

    schema = "book_id string, author string, title string, published_year int, s3_prefix_models string, updated_at timestamp"
    return spark.createDataFrame([(*r, dt.datetime(2025, 1, 1)) for r in rows], schema)


def test_lists(spark):
    rows = pipeline(spark, [
        ("gutenberg-1", "Smith, Adam", "Wealth of Nations", 1776, "models/1"), ("gutenberg-2", "Montesquieu", "Spirit of the Laws", 1748, "models/2"),
        ("gutenberg-9", "Say, J-B", "Treatise", 1803, None), ("gutenberg-8", "Anonymous", "Undated Tract", None, "models/8"),
    ])
    terms = term_rows(spark, [(f"gutenberg-{b}", t, 3, tags, None, 0) for b, t, tags in ((1, "labour", ["N"]), (1, "only", ["N"]), (8, "labour", ["N"]), (9, "labour", ["N"]), (1, "slowly", ["R"]), (2, "slowly", ["R"]))])
    engine = Engine(terms, rows)
    assert {r.label for r in engine.books().collect()} == {"Smith (1776)", "Montesquieu (1748)"}
    assert [(r.term, r.books) for r in engine.terms().collect()] == [("labour", [1, 8])]
    assert {r.term for r in engine.vocabulary().collect()} == {"labour", "only"}


def test_requests_are_scored_at_once(spark, monkeypatch):
    """All requests in one plan, with the scores that the drift query gives one by one; for several requests, and without a seed here and there."""
    from dataclasses import replace

    table = spark.read.parquet("/root/testdata/sf0.001/book_terms.parquet").where("book_id is not null")
    table = table.withColumn("vectors", F.when(F.col("book_id") == "gutenberg-9063837", F.slice("vectors", 1, 2)).otherwise(F.col("vectors")))
    settings = Settings(min_books=3, anchors=10, centre=10, stable_rank=10, unstable_rank=20, max_books=4)
    matrix, counts = books.term_books(table)
    rich = counts.where("term = 'rent'").select("book_id").join(counts.groupBy("book_id").agg(F.count("*").alias("n")), "book_id").orderBy(F.desc("n"), "book_id").collect()
    want = catalog._published_scores(matrix, counts, ex.parse("rent"), [int(r.book_id.rpartition("-")[2]) for r in rich], settings).orderBy("expr", "book_id").collect()
    monkeypatch.setattr(catalog, "drift", None)
    got = catalog._batched(table, ex.parse("rent"), settings).orderBy("expr", "book_id").collect()
    assert len(got) == len(want) > 10 and len(rich) > 8 and {r.n_seeds for r in got} >= {2}
    for a, b in zip(got, want):
        assert (a.expr, a.book_id, a.n_seeds, a.n_books, a.occurrences) == (b.expr, b.book_id, b.n_seeds, b.n_books, b.occurrences)
        assert [a.mean_local_similarity, a.ci_lo, a.ci_hi] == pytest.approx([b.mean_local_similarity, b.ci_lo, b.ci_hi], abs=2e-6)
    with pytest.raises(QueryInTooFewBooks):
        catalog._batched(table, ex.parse("rent"), replace(settings, min_books=5))
    assert catalog.queries()["published_drift"](spark, "/root/testdata/sf0.001").count() > 0
