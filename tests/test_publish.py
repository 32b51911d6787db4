import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordtide.operators import alignment, lemmas as lemmas_of, publish, training


def corpus(spark, rows):
    return spark.createDataFrame(rows, "term string, book_ids array<string>")


def sets(df):
    return {r.term: sorted(r.book_ids) for r in df.collect()}


def terms(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "term string")


def test_corpus_sets(spark):
    c = corpus(spark, [("rent", ["a", "b"]), ("wage", ["a"])])
    added = publish.add_book(publish.add_book(c, "c", terms(spark, "rent", "new")), "c", terms(spark, "rent"))
    assert sets(added) == {"rent": ["a", "b", "c"], "wage": ["a"], "new": ["c"]}
    assert sets(publish.remove_book(c, "a")) == {"rent": ["b"], "wage": []}
    assert sets(publish.remove_book_terms(c, "a", terms(spark, "rent", "wage"))) == {"rent": ["b"]}
    assert sets(publish.remove_book_terms(c, "a", terms(spark, "wage"))) == {"rent": ["a", "b"]}
    merged = publish.merged_corpus(corpus(spark, [("rent", ["a", "a", None]), ("rent", ["b"]), ("x", None), ("y", []), (None, ["a"])]))
    assert sets(merged) == {"rent": ["a", "b"], "x": [], "y": []}


def test_republishing(spark):
    old = spark.createDataFrame([("b1", "rent", 1), ("b1", "gone", 1), ("b2", "rent", 1)], "book_id string, term string, count_ int")
    new = spark.createDataFrame([("b1", "rent", 2)], "book_id string, term string, count_ int")
    assert [tuple(r) for r in publish.deprecated(old, new).collect()] == [("b1", "gone")]
    assert {tuple(r) for r in publish.republished(old, new).collect()} == {("b1", "rent", 2), ("b2", "rent", 1)}
    assert publish.deprecated(old.limit(0), new).count() == 0


def lemmas(spark, rows):
    import datetime as dt

    schema = "s3_token_lemmas_key string, book_id string, sent_ix bigint, lemmas array<string>, tags array<string>, loaded_at timestamp"
    return spark.createDataFrame([(f"k/{b}", b, i, w, t, dt.datetime(2025, 1, 1 + day)) for b, i, w, t, day in rows], schema)


def test_tokens_tags_and_places(spark):
    rows = lemmas(spark, [
        ("b", 0, ["labour", "", "rent"], ["NN", ",", "VB"], 0), ("b", 1, ["labour", "often", "why"], ["VB", "RB", "WRB"], 0),
        ("b", 1, ["old"], ["NN"], -0), ("b", 5, ["labour", "cut"], ["DT"], 0), ("b", 7, None, None, 0),
    ])
    tags = {r.term: r.tags for r in publish.term_tags(rows.where("lemmas is null or lemmas[0] <> 'old'")).collect()}
    assert tags == {"labour": ["N", "V"], "rent": ["V"], "often": ["R"], "why": ["W"]}
    places = sorted((r.lemma, r.iloc) for r in publish.positions(rows.where("lemmas is null or lemmas[0] <> 'old'")).collect())
    assert places == [("cut", 7), ("labour", 0), ("labour", 3), ("labour", 6), ("often", 4), ("rent", 2), ("why", 5)]


def test_counts_follow_the_training_filter(spark):
    rows = lemmas(spark, [("b", i, ["labour", "ox", "x1y2", "wagé"], None, 0) for i in range(10)] + [("b", 99, ["rent"], None, 0)])
    assert sorted((r.term, r.count_) for r in publish.term_counts(rows).collect()) == [("labour", 10), ("wagé", 10)]
    assert {tuple(r.words) for r in training.training_sentences(rows).collect()} == {("labour", "wagé"), ("rent",)}


def test_published_rows(spark):
    centroid = spark.createDataFrame([("b", "labour", 42, 0.1, 0.05, 0.95), ("b", "the", 500, 0.1, 0.1, 0.1)], "book_id string, term string, count_ bigint, variance double, disparity double, r_squared double")
    tags = spark.createDataFrame([("b", "labour", ["N", "V"])], "book_id string, term string, tags array<string>")
    models = spark.createDataFrame([("b", t, s, [0.1 * s, 1 / 3]) for t in ("labour", "the") for s in (10, 2)], "book_id string, term string, seed int, v array<double>")
    r = publish.term_rows(centroid, tags, models).collect()
    assert len(r) == 1 and r[0].seeds == [2, 10] and r[0].alignment_stats.r_squared == 0.95
    assert r[0].vectors[0] == [float(np.float16(0.2)), float(np.float16(1 / 3))]


def test_vector_entries_check_their_size(spark):
    row = spark.createDataFrame([("b", "a::b", [1.0, 2.0], 3, ["N"])], "book_id string, term string, vector array<double>, count_ bigint, tags array<string>")
    assert publish.vector_entries(row, 2).first().id == "b::a::b"
    with pytest.raises(Exception, match="must have 3 numbers"):
        publish.vector_entries(row, 3).collect()


def planted(noise=0.01):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 4))
    models = []
    for _ in range(3):
        q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
        models.append(base @ q + noise * rng.normal(size=base.shape))
    return np.stack(models)


def test_rotation_recovers_a_planted_one():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(20, 5))
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    r = alignment.rotation(a, a @ q)
    assert np.allclose(r, q) and np.allclose(r.T @ r, np.eye(5))
    with pytest.raises(ValueError):
        alignment.rotation(a, a[:5])


def test_alignment_invariants():
    models = planted()
    out, centroid, mean, n = alignment.align(models)
    assert 0 <= mean < 0.04 and n <= 40
    for before, after in zip(models, out):
        assert np.allclose(before @ before.T, after @ after.T)  # cosines within a seed stay
    with pytest.raises(alignment.NotAligned):
        alignment.align(models, max_iterations=0)
    assert alignment.disparity(np.ones((2, 2)), np.ones((2, 2))) == float("inf")


def test_alignment_in_spark(spark):
    models = planted()
    rows = [("b", s, f"t{i:02d}", models[s, i].tolist()) for s in range(3) for i in range(30) if not (s == 2 and i == 7)]
    df = spark.createDataFrame(rows, "book_id string, seed int, term string, v array<double>")
    stats = alignment.term_statistics(df).toPandas()
    assert len(stats) == 30 and (stats.r_squared <= 1).all() and (stats.variance >= 0).all() and stats.r_squared.median() > 0.9
    aligned = alignment.aligned_models(df)
    assert aligned.count() == len(rows) and isinstance(aligned.toPandas(), pd.DataFrame)


def test_books_that_do_not_align_keep_their_terms(spark):
    rng = np.random.default_rng(0)
    rows = [("b", s, "only", rng.normal(size=50).tolist()) for s in range(3)]
    df = spark.createDataFrame(rows, "book_id string, seed int, term string, v array<double>")
    assert [r.term for r in alignment.term_statistics(df, strict=False, max_iterations=1, min_gradient=-1.0).collect()] == ["only"]


def test_training_is_repeatable(spark):
    words = [f"word{chr(97 + i)}" for i in range(8)]
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([("b", i, [str(w) for w in rng.choice(words, 6)]) for i in range(80)], "book_id string, sent_ix bigint, words array<string>")
    a, b = (training.train_book(rows, "b", [7], size=5, min_count=2, epochs=1, sample=None).orderBy("term").collect() for _ in range(2))
    assert [r.v for r in a] == [r.v for r in b] and len(a) == 8
    c, d = (training.train_books(rows, [7, 8], size=5, min_count=2, epochs=2, sample=None).orderBy("seed", "term").collect() for _ in range(2))
    assert [r.v for r in c] == [r.v for r in d] and len(c) == 16 and c[0].v != c[8].v
    assert training.train_books(rows, [1], size=5, min_count=1000, epochs=1).count() == 0
    thin = training.subsampled(rows, 1, 1e-3)
    assert thin.select(F.sum(F.size("words"))).first()[0] < 480


def test_long_books_are_not_gathered(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(b, i, [f"word{x}" for x in rng.choice(8, 6)]) for b, n in (("long", 80), ("short", 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "book_id string, sent_ix bigint, words array<string>")
    own, gathered = training.train_book, training.train_books
    asked = []
    monkeypatch.setattr(training, "train_book", lambda s, b, *a, **k: asked.append(b) or own(s, b, *a, **k))
    monkeypatch.setattr(training, "train_books", lambda s, *a, **k: asked.append({r.book_id for r in s.select("book_id").collect()}) or gathered(s, *a, **k))
    got = training.train_all(df, [1, 2], long=300, size=5, min_count=2, epochs=1, sample=None).groupBy("book_id", "seed").count().collect()
    assert sorted(map(tuple, got)) == [(b, s, 8) for b in ("long", "short") for s in (1, 2)]
    assert asked == [{"short"}, "long"]


def test_queries_train_with_the_production_parameters(spark, monkeypatch):
    from wordtide.plans import catalog

    seen = []
    monkeypatch.setattr(training, "skip_gram", None)
    monkeypatch.setattr(training, "train_books", lambda s, seeds, size=200, min_count=10, epochs=30, window=10, sample=5e-4: seen.append((size, min_count, epochs, window, sample)) or s.selectExpr("book_id", "0 AS seed", "'t' AS term", "array(1D) AS v"))
    catalog.queries()["train_vectors"](spark, "/root/testdata/sf0.001")
    assert seen == [(200, 10, 30, 10, 5e-4)] == [(training.SIZE, training.MIN_COUNT, training.EPOCHS, training.WINDOW, training.SAMPLE)]


def test_skip_gram_brings_neighbours_together():
    rng = np.random.default_rng(0)
    sentences = [list(rng.permutation(["a", "b", "c"] if i % 2 else ["x", "y", "z"])) for i in range(400)]
    terms, v = training.skip_gram([list(map(str, s)) for s in sentences], 3, 8, 5, 10, 3, None)
    assert terms == ["a", "b", "c", "x", "y", "z"]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    like = unit @ unit.T
    assert like[0, 1] > like[0, 3] + 0.5 and like[3, 5] > like[5, 2] + 0.5
    assert training.skip_gram([["a"]], 1, 4, 2, 1, 2, None)[0] == [] and training.skip_gram([["a", "a"]], 1, 4, 2, 1, 2, 1e-3)[0] == ["a"]


def test_huffman_codes():
    paths, codes = training._codes(np.array([50, 20, 5, 5, 1]))
    assert len(paths[0]) == 1 and len(paths[4]) == max(map(len, paths))
    assert len({tuple(c) for c in codes}) == 5 and {int(p[0]) for p in paths} == {3}
    assert sum(2.0 ** -len(c) for c in codes) == 1


def test_lemmas(spark):
    words = spark.createDataFrame([(1, "Wages,", "NOUN"), (2, "LABORS", "VERB"), (3, "--", "PUNCT"), (4, "Building", "NOUN"), (5, "producer", "NOUN"), (6, "producer", "VERB"), (7, None, "NOUN"), (8, "the", "DET"), (9, "x9y", None)], "i int, token string, coarse string")
    known = spark.createDataFrame([("wages", "n", "wage"), ("labours", "v", "labour"), ("wages", "v", "wage")], "token string, pos string, lemma string")
    verbs = spark.createDataFrame([("producer", "produce"), ("producer", "process"), ("producer", "make"), ("building", "build"), ("wage", "wage"), ("producer", "procure")], "lemma string, verb string")
    got = {r.i: (r.clean, r.lemma) for r in lemmas_of.lemmatised(words, known, verbs).collect()}
    assert got == {1: ("wages", "wage"), 2: ("labours", "labour"), 3: ("", ""), 4: ("building", "building"), 5: ("producer", "process"), 6: ("producer", "producer"), 7: (None, None), 8: ("the", "the"), 9: ("xy", "xy")}
    assert len(lemmas_of.KEPT_NOUNS) == 21


def test_entries_leave_the_index(spark):
    entries = spark.createDataFrame([("a::x", "a"), ("a::y", "a"), ("b::x", "b")], "id string, book_id string")
    assert [r.id for r in publish.without_vectors(entries, "a").collect()] == ["b::x"]
    gone = spark.createDataFrame([("a::x",), ("none",)], "id string")
    assert sorted(r.id for r in publish.without_vectors(entries, ids=gone).collect()) == ["a::y", "b::x"]


def test_training_loop_is_skip_gram(spark):
    """The loop in the JVM gives what `skip_gram` gives, for books that share a task and for one that has a task a model."""
    rng = np.random.default_rng(1)
    books = {b: [[f"word{chr(97 + x)}" for x in rng.zipf(1.5, 7) % 20] for _ in range(n)] for b, n in (("a", 40), ("b", 300), ("c", 2))}
    rows = [(b, i, s) for b, own in books.items() for i, s in enumerate(own)]
    df = spark.createDataFrame(rows, "book_id string, sent_ix bigint, words array<string>").orderBy(F.desc("sent_ix"))
    got = {}
    for r in training.train_all(df, [3, 4], size=13, min_count=3, epochs=4, sample=1e-2).collect():
        got.setdefault((r.book_id, r.seed), {})[r.term] = r.v
    for b, own in books.items():
        for seed in (3, 4):
            terms, v = training.skip_gram(own, seed, 13, 3, 4, training.WINDOW, 1e-2)
            assert sorted(got[b, seed]) == terms and np.allclose([got[b, seed][t] for t in terms], v, atol=1e-5)


def test_a_book_of_many_words_trains_in_seconds(spark):
    import time

    rng = np.random.default_rng(2)
    rows = [("b", i, [f"w{chr(97 + x % 26)}{chr(97 + x // 26)}xx" for x in rng.integers(0, 600, 7)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "book_id string, sent_ix bigint, words array<string>")
    began = time.time()
    assert training.train_all(df, [1], epochs=10, sample=None).count() == 600
    assert time.time() - began < 25


def test_few_terms_align_in_their_own_space():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 200))
    models = np.stack([(base + rng.normal(size=base.shape) * 0.05) @ np.linalg.qr(rng.normal(size=(200, 200)))[0] for _ in range(3)])
    a, b = models[0], models[1]
    assert np.allclose(alignment.turned(a, b), a @ alignment.rotation(a, b))
    out, centroid, mean, n = alignment.align(models)
    assert out.shape == models.shape and all(np.allclose(x @ x.T, y @ y.T) for x, y in zip(models, out)) and mean < 0.04
    with pytest.raises(alignment.NotAligned):
        alignment.align(models[:, :1], max_iterations=10**12)  # one term never aligns, and is not tried
