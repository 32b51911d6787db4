"""The core's queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import text, vectors
from ..operators import alignment, batches, books, describe, lemmas, publish, scores, similarity, training
from ..sources import readers, sinks
from . import sql
from .engine import Engine, drift
from .errors import QueryInTooFewBooks, TermResolutionError
from .settings import DEFAULT, SMALL, Settings
from .ship import shared_folder, ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WORD = ex.parse("t0007")
SUM = ex.parse("t0007 + t0011")
DIFFERENCE = ex.parse("t0007 - t0011")
NESTED = ex.parse("t0007 + (t0011 - t0013)")
PINNED = "gutenberg-1"


def query(statement: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        name = f.__name__

        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        _QUERIES[name] = run
        if statement is not None:
            _SQL[name] = statement
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return semantic_drift(spark, d)


def six(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return books.embedding_books(readers.table(spark, d, "embeddings"))


def _similar(spark: SparkSession, d: str, tree: ex.Tree = WORD, strategy: str = "native") -> tuple[DataFrame, DataFrame, DataFrame]:
    matrix, counts = _books(spark, d)
    return matrix, counts, similarity.similarities(matrix, similarity.query_vectors(matrix, {ex.serialise(tree): tree}), strategy)


def _parts(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _trees(*trees: ex.Tree) -> str:
    return sql.query({ex.serialise(t): t for t in trees})


# profiles


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar()) + " SELECT expr, book_id, term, round(m, 6) + 0.0 AS m FROM msim")
def query_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity of every term to a word, per book."""
    means = _similar(spark, d)[2]
    return means.select("expr", "book_id", "term", six("m").alias("m"))


@query(_parts(sql.BOOKS, _trees(NESTED), sql.similar()) + " SELECT expr, book_id, term, round(m, 6) + 0.0 AS m FROM msim")
def query_similarity_arrow(spark: SparkSession, d: str) -> DataFrame:
    """The same for a compound expression, multiplied in Arrow batches."""
    means = _similar(spark, d, NESTED, "arrow")[2]
    return means.select("expr", "book_id", "term", six("m").alias("m"))


@query(_parts(sql.BOOKS, _trees(WORD, NESTED), sql.similar()) + " SELECT expr, book_id, seed_ix, term, round(s, 6) + 0.0 AS s FROM sim")
def batched_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Several expressions in one plan, seed by seed."""
    matrix, _ = _books(spark, d)
    q = similarity.query_vectors(matrix, {ex.serialise(t): t for t in (WORD, NESTED)})
    return similarity.similarities(matrix, q).select("expr", "book_id", "term", F.posexplode("s").alias("seed_ix", "s")).withColumn("s", six("s"))


def _vectors(tree: ex.Tree) -> str:
    return _parts(sql.BOOKS, _trees(tree)) + " SELECT book_id, seed_ix, (i - 1)::INT AS dim, round(qv[i], 6) + 0.0 AS x FROM q, (SELECT unnest(range(1, 17)) AS i)"


def _vector(spark: SparkSession, d: str, tree: ex.Tree) -> DataFrame:
    matrix, _ = _books(spark, d)
    q = similarity.query_vectors(matrix, {ex.serialise(tree): tree})
    return q.select("book_id", F.posexplode("qvs").alias("seed_ix", "qv")).select("book_id", "seed_ix", F.posexplode("qv").alias("dim", "x")).withColumn("x", six("x"))


@query(_vectors(SUM))
def expr_add(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d, SUM)


@query(_vectors(DIFFERENCE))
def expr_sub(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d, DIFFERENCE)


@query(_vectors(NESTED))
def expr_nested(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d, NESTED)


_DEEP_SIZE = 200
DEEP = ex.parse("t0007 + (t0011 - (t0013 + (t0017 - t0019)))")


@query(
    _parts(sql.books(_DEEP_SIZE), _trees(DEEP), sql.similar()) + f""" SELECT book_id, term, round(m, 6) + 0.0 AS m FROM msim"""
)
def query_similarity_deep(spark: SparkSession, d: str) -> DataFrame:
    """An expression as deep as may be, over vectors of the size that books are trained with."""
    matrix, _ = books.embedding_books(readers.table(spark, d, "embeddings"), _DEEP_SIZE)
    q = similarity.query_vectors(matrix, {ex.serialise(DEEP): DEEP})
    return similarity.similarities(matrix, q, "arrow").select("book_id", "term", six("m").alias("m"))


# ranking and statistics


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar(), sql.centred()) + " SELECT book_id, term, round(position, 6) + 0.0 AS position FROM pos")
def center_locally(spark: SparkSession, d: str) -> DataFrame:
    rows = similarity.centred(_similar(spark, d)[2], DEFAULT)
    return rows.select("book_id", "term", six("position").alias("position"))


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar(), sql.centred()) + " SELECT book_id, term, in_stable, in_unstable FROM pos")
def topk_membership(spark: SparkSession, d: str) -> DataFrame:
    rows = similarity.centred(_similar(spark, d)[2], DEFAULT)
    return rows.select("book_id", "term", "in_stable", "in_unstable")


_STATS = "term, n_books_in, n_books_as_top50, n_books_as_top100, round(stability, 6) + 0.0 AS stability, round(instability, 6) + 0.0 AS instability"


def _statistics(rows: DataFrame) -> DataFrame:
    return rows.select("term", "n_books_in", "n_books_as_top50", "n_books_as_top100", six("stability").alias("stability"), six("instability").alias("instability"))


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar(), sql.centred()) + f" SELECT {_STATS} FROM st")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = similarity.centred(_similar(spark, d)[2], DEFAULT)
    return _statistics(scores.term_statistics(rows))


def _comparative(spark: SparkSession, d: str, settings: Settings, selected: str | None = None) -> DataFrame:
    matrix, counts, similar = _similar(spark, d)
    if selected:
        similar = similar.where(F.col("book_id") != selected)
    rows = scores.term_statistics(similarity.centred(similar, settings))
    own = matrix.where(F.col("book_id") == selected).select("term") if selected else None
    return _statistics(scores.comparative_terms(rows, settings, own))


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar(), sql.centred(), sql.comparative()) + f" SELECT {_STATS} FROM comp")
def comparative_terms_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _comparative(spark, d, DEFAULT)


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar(books=f" AND nv.book_id <> '{PINNED}'"), sql.centred(), sql.comparative(selected=PINNED)) + f" SELECT {_STATS} FROM comp")
def comparative_terms_pinned(spark: SparkSession, d: str) -> DataFrame:
    return _comparative(spark, d, DEFAULT, PINNED)


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar(), sql.centred(SMALL), sql.comparative(SMALL)) + f" SELECT {_STATS} FROM comp")
def comparative_terms_small(spark: SparkSession, d: str) -> DataFrame:
    """With small constants, so that every gate binds."""
    return _comparative(spark, d, SMALL)


# joins


@query(_parts(sql.BOOKS) + " SELECT a.book_id AS a, b.book_id AS b, count(*) AS n FROM raw a JOIN raw b ON a.term = b.term AND a.book_id <> b.book_id GROUP BY ALL")
def shared_terms(spark: SparkSession, d: str) -> DataFrame:
    return scores.shared_terms(_books(spark, d)[1]).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    _parts(sql.BOOKS, "p AS (SELECT a.book_id, count(*) AS n FROM raw a JOIN raw b ON a.term = b.term AND a.book_id <> b.book_id GROUP BY a.book_id, b.book_id)")
    + " SELECT book_id, coalesce(max(n), 0) AS n_shared_terms FROM (SELECT DISTINCT book_id FROM raw) LEFT JOIN p USING (book_id) GROUP BY book_id"
)
def n_shared_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = _books(spark, d)[1]
    return scores.n_shared_terms(counts, counts.select("book_id").distinct())


_ASKED = ["rent", "wage", "labour", "no such term"]


@query(
    _parts(sql.TERMS)
    + f""" SELECT book_id, coalesce(string_agg(term, ',' ORDER BY term), '') AS missing FROM (SELECT DISTINCT book_id FROM bt)
  LEFT JOIN (SELECT b.book_id, t.term FROM (SELECT DISTINCT book_id FROM bt) b, (SELECT unnest({sql.strings(_ASKED)}) AS term) t
    WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.book_id = b.book_id AND bt.term = t.term)) USING (book_id) GROUP BY book_id"""
)
def missing_terms(spark: SparkSession, d: str) -> DataFrame:
    """Which of the asked terms each published book lacks."""
    counts = books.current_terms(readers.table(spark, d, "book_terms"))
    rows = scores.missing_terms(counts, counts.select("book_id").distinct(), _ASKED)
    return rows.select("book_id", F.array_join("missing_terms", ",").alias("missing"))


@query(_parts(sql.TERMS) + " SELECT book_id FROM bt WHERE term IN ('rent', 'wage') GROUP BY book_id HAVING count(DISTINCT term) = 2")
def books_carrying_query(spark: SparkSession, d: str) -> DataFrame:
    return scores.carrying(books.current_terms(readers.table(spark, d, "book_terms")), ["rent", "wage"])


# scores


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar(), sql.anchors()) + " SELECT a, b, term, place FROM anch")
def local_anchors(spark: SparkSession, d: str) -> DataFrame:
    means = _similar(spark, d)[2]
    return scores.anchors(means).select("a", "b", "term", F.col("place").cast("bigint").alias("place"))


@query(_parts(sql.BOOKS, _trees(WORD), sql.similar(), sql.anchors(), sql.local()) + " SELECT a, b, seed_ix, round(c, 6) + 0.0 AS c FROM loc")
def local_similarity(spark: SparkSession, d: str) -> DataFrame:
    return scores.local_similarities(scores.anchors(_similar(spark, d)[2])).select("a", "b", "seed_ix", six("c").alias("c"))


def _scores(spark: SparkSession, d: str, tree: ex.Tree, selected: str | None = None) -> DataFrame:
    local = scores.local_similarities(scores.anchors(_similar(spark, d, tree)[2], DEFAULT, selected))
    rows = scores.scores(local, selected is not None)
    return rows.select("book_id", six("mean_local_similarity").alias("mean_local_similarity"), six("ci_lo").alias("ci_lo"), six("ci_hi").alias("ci_hi"), "n_seeds", "n_books")


def _scores_sql(tree: ex.Tree, selected: str | None = None) -> str:
    return _parts(sql.BOOKS, _trees(tree), sql.similar(), sql.anchors(selected=selected), sql.local(), sql.scored(selected is not None)) + f" SELECT book_id, {sql.score_columns()} FROM score"


@query(_scores_sql(WORD))
def drift_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, WORD)


@query(_scores_sql(NESTED))
def drift_corpus_nested(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, NESTED)


@query(_scores_sql(WORD, PINNED))
def drift_pinned(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, WORD, PINNED)


@query(_scores_sql(NESTED, PINNED))
def drift_pinned_nested(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, NESTED, PINNED)


@query(_parts(sql.TERMS) + " SELECT book_id, sum(count_)::BIGINT AS occurrences FROM bt WHERE term IN ('rent', 'wage', 'labour') GROUP BY book_id")
def occurrences(spark: SparkSession, d: str) -> DataFrame:
    leaves = spark.createDataFrame([("e", t) for t in ("rent", "wage", "labour", "rent")], "expr string, term string")
    return scores.occurrences(books.current_terms(readers.table(spark, d, "book_terms")), leaves).select("book_id", "occurrences")


def _flagship_sql(tree: ex.Tree, selected: str | None = None) -> str:
    name, own = ex.serialise(tree), ex.leaves(tree)
    others = f" AND nv.book_id <> '{selected}'" if selected else ""
    every = "q2 AS (SELECT * FROM q UNION ALL SELECT term, [term], book_id, seed_ix, v FROM nv WHERE term IN (SELECT term FROM comp))"
    leaf = f"leaf AS (SELECT {sql.text(name)} AS expr, unnest({sql.strings(own)}) AS term UNION ALL SELECT term, term FROM comp)"
    occ = "occ AS (SELECT expr, book_id, sum(count_)::BIGINT AS occurrences FROM leaf JOIN raw USING (term) GROUP BY ALL)"
    parts = _parts(sql.BOOKS, _trees(tree), sql.similar(books=others), sql.centred(), sql.comparative(selected=selected), every, sql.similar("q2", "sim2", "msim2"), sql.anchors(selected=selected, msim="msim2"), sql.local("sim2"), sql.scored(selected is not None), leaf, occ)
    return parts + f""" SELECT expr, book_id, {sql.score_columns()}, coalesce(occurrences, 0) AS occurrences,
  n_books_in, round(stability, 6) + 0.0 AS stability, round(instability, 6) + 0.0 AS instability
  FROM score LEFT JOIN occ USING (expr, book_id) LEFT JOIN comp ON comp.term = score.expr"""


def _flagship(spark: SparkSession, d: str, tree: ex.Tree, selected: int | None = None) -> DataFrame:
    matrix, counts = _books(spark, d)
    found = drift(matrix, counts, tree, [b for b in range(1, 6) if b != selected], selected)
    schema = "expr string, n_books_in bigint, stability double, instability double"
    stats = spark.createDataFrame([(c["term"], c["n_books_in"], c["stability"], c["instability"]) for c in found.comparative], schema)
    rows = found.scores.join(stats, "expr", "left")
    rounded = [six(c).alias(c) for c in ("mean_local_similarity", "ci_lo", "ci_hi")]
    return rows.select("expr", "book_id", *rounded, "n_seeds", "n_books", "occurrences", "n_books_in", six("stability").alias("stability"), six("instability").alias("instability"))


@query(_flagship_sql(WORD))
def semantic_drift(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: a word and its comparative terms scored in every book against its peers."""
    return _flagship(spark, d, WORD)


@query(_flagship_sql(NESTED, PINNED))
def semantic_drift_pinned(spark: SparkSession, d: str) -> DataFrame:
    """A compound expression and its comparative terms, every book against one."""
    return _flagship(spark, d, NESTED, 1)


@query(
    _parts(sql.BOOKS, _trees(WORD), sql.similar(), sql.centred(), sql.comparative(), "asked AS (SELECT 't0007' AS term UNION SELECT term FROM comp)",
           "n AS (SELECT a.book_id, count(*) AS n FROM raw a JOIN raw b ON a.term = b.term AND a.book_id <> b.book_id GROUP BY a.book_id, b.book_id)")
    + """ SELECT book_id, max(n) AS n_shared_terms, (SELECT count(*) FROM asked WHERE NOT EXISTS (SELECT 1 FROM raw WHERE raw.book_id = n.book_id AND raw.term = asked.term)) AS n_missing
  FROM n GROUP BY book_id"""
)
def drift_roster(spark: SparkSession, d: str) -> DataFrame:
    """Per book of the flagship its largest shared vocabulary and how many of the scored terms it lacks."""
    matrix, counts = _books(spark, d)
    roster = drift(matrix, counts, WORD, [1, 2, 3, 4, 5]).roster
    return roster.select("book_id", "n_shared_terms", F.size("missing_terms").cast("bigint").alias("n_missing"))


@query()
def published_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift over the published books' own half-precision vectors: all that carry the word, in requests of books alike in size."""
    found = _batched(readers.table(spark, d, "book_terms"), ex.parse("rent"), Settings(anchors=10, centre=10, stable_rank=10, unstable_rank=20))
    rounded = [six(c).alias(c) for c in ("mean_local_similarity", "ci_lo", "ci_hi")]
    return found.select("expr", "book_id", *rounded, "n_seeds", "n_books", "occurrences")


def _batched(book_terms: DataFrame, word: ex.Term, settings: Settings) -> DataFrame:
    """The scores of all books that carry the word, every request at once. The books' ids come to the driver."""
    spark = book_terms.sparkSession
    # how many vectors a term has, without the vectors
    light = book_terms.select("book_id", "term", "count_", "tags", "published_at", F.when(F.col("vectors").isNotNull(), F.size("vectors")).alias("vectors"))
    own = books.with_vectors(books.current_terms(light).where(books.not_adverb_only(F.col("tags"))))
    rich = own.groupBy("book_id").agg(F.count("*").alias("n"), F.min("vectors").alias("seeds"), F.max((F.col("term") == word.term).cast("int")).alias("has"))
    rich = sorted(rich.where("has = 1").select("book_id", "n", "seeds").collect(), key=lambda r: (-r.n, r.book_id))
    asked = requests(list(range(len(rich))), settings.max_books) or [[]]
    if min(sum(rich[i].seeds > 0 for i in of) for of in asked) < settings.min_books:
        raise QueryInTooFewBooks(None)
    of = spark.createDataFrame([(rich[i].book_id, k) for k, own in enumerate(asked) for i in own], "book_id string, request int")
    rows = books.with_vectors(books.current_terms(book_terms).where(books.not_adverb_only(F.col("tags"))))
    rows = rows.select("book_id", "term", "count_", "vectors").join(of, "book_id")
    return batches.scored(rows, word, settings)


def requests(ids: list[int], most: int) -> list[list[int]]:
    """The ids in order, in as few requests of at most `most` as there can be, all about as large."""
    n = -(-len(ids) // most)
    return [ids[len(ids) * k // n : len(ids) * (k + 1) // n] for k in range(n)]


def _published_scores(matrix: DataFrame, counts: DataFrame, tree: ex.Tree, ids: list[int], settings: Settings) -> DataFrame:
    """The scores of every request, one after the other; each is written, so that the plan stays small."""
    asked = requests(ids, settings.max_books) or [ids]
    stored = matrix.sparkSession.sparkContext.getCheckpointDir() is not None

    def cut(df: DataFrame) -> DataFrame:
        return df.checkpoint() if stored else df

    rounded = [six(c).alias(c) for c in ("mean_local_similarity", "ci_lo", "ci_hi")]
    carrying = scores.carrying(counts, ex.leaves(tree))
    matrix, counts = cut(matrix.join(carrying, "book_id", "left_semi")), cut(counts.join(carrying, "book_id", "left_semi"))
    out = None
    for own in asked:
        found = drift(matrix, counts, tree, own, None, settings)
        scored = cut(found.scores.select("expr", "book_id", *rounded, "n_seeds", "n_books", "occurrences"))
        out = scored if out is None else out.unionByName(scored)
    return out


# list queries and filters


@query(_parts(sql.PIPELINE) + """ SELECT split_part(book_id, '-', -1)::BIGINT AS id, split_part(author, ',', 1) || ' (' || published_year || ')' AS label,
  author, title, published_year FROM pipe WHERE s3_prefix_models IS NOT NULL AND published_year IS NOT NULL""")
def books_list(spark: SparkSession, d: str) -> DataFrame:
    return books.books_list(readers.table(spark, d, "pipeline"))


_ALIGNED_TERMS = f"""altm AS (SELECT book_id, term FROM bt WHERE {sql.NOT_ADVERB} AND book_id IN (SELECT book_id FROM pipe WHERE s3_prefix_models IS NOT NULL))"""


@query(_parts(sql.PIPELINE, sql.TERMS, _ALIGNED_TERMS) + """ SELECT term, count(*)::INT AS n_books,
  string_agg(split_part(book_id, '-', -1), ',' ORDER BY split_part(book_id, '-', -1)::BIGINT) AS books FROM altm GROUP BY term HAVING count(*) > 1""")
def terms_list(spark: SparkSession, d: str) -> DataFrame:
    rows = books.terms_list(readers.table(spark, d, "book_terms"), readers.table(spark, d, "pipeline"))
    return rows.withColumn("books", F.array_join(F.col("books").cast("array<string>"), ","))


@query(_parts(sql.PIPELINE, sql.TERMS, _ALIGNED_TERMS) + " SELECT DISTINCT term FROM altm")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return books.vocabulary(readers.table(spark, d, "book_terms"), readers.table(spark, d, "pipeline"))


@query(_parts(sql.TERMS) + f" SELECT book_id, count(*) AS terms, count(*) FILTER ({sql.NOT_ADVERB}) AS kept, count(*) FILTER ({sql.NOT_ADVERB} AND vectors IS NOT NULL) AS usable FROM bt GROUP BY book_id")
def term_filters(spark: SparkSession, d: str) -> DataFrame:
    """How many terms of each book pass the adverb filter, and the vector filter after it."""
    rows = books.current_terms(readers.table(spark, d, "book_terms"))
    kept = books.not_adverb_only(F.col("tags"))
    return rows.groupBy("book_id").agg(F.count("*").alias("terms"), F.count_if(kept).alias("kept"), F.count_if(kept & F.col("vectors").isNotNull()).alias("usable"))


@query(_parts(sql.PIPELINE) + """ SELECT book_id, s3_text_key IS NULL AS to_scrape,
  s3_token_texts_key IS NULL OR s3_token_lemmas_key IS NULL OR s3_token_tags_key IS NULL AS to_tokenize, s3_metadata_key IS NOT NULL AS publishable FROM pipe""")
def stage_skips(spark: SparkSession, d: str) -> DataFrame:
    """Which stages still have work on each book; a stage that has run is skipped."""
    rows = books.current_pipeline(readers.table(spark, d, "pipeline"))
    lacks = F.col("s3_token_texts_key").isNull() | F.col("s3_token_lemmas_key").isNull() | F.col("s3_token_tags_key").isNull()
    return rows.select("book_id", F.col("s3_text_key").isNull().alias("to_scrape"), lacks.alias("to_tokenize"), F.col("s3_metadata_key").isNotNull().alias("publishable"))


# gets and sources


@query("SELECT term, count_, epoch_us(published_at) AS published_us FROM book_terms WHERE book_id = 'gutenberg-9000007'")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    """One book's term rows, columns and key pushed to the scan."""
    return readers.get(readers.table(spark, d, "book_terms"), {"book_id": "gutenberg-9000007"}, ["term", "count_", F.unix_micros("published_at").alias("published_us")])


@query("SELECT book_id, term, count_ FROM book_terms WHERE (book_id, term) IN (SELECT (book_id, 'rent') FROM pipeline)")
def batch_get(spark: SparkSession, d: str) -> DataFrame:
    keys = readers.table(spark, d, "pipeline").select("book_id", F.lit("rent").alias("term"))
    return readers.get_many(readers.table(spark, d, "book_terms"), keys, ["book_id", "term", "count_"])


@query("SELECT event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k')) AS value FROM events")
def event_payload(spark: SparkSession, d: str) -> DataFrame:
    """A field of an event's JSON, wherever it lies."""
    rows = readers.table(spark, d, "events")
    return rows.select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.k")).alias("value"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id::VARCHAR END AS index_ FROM events""")
def event_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of events that name it themselves, that carry it in the JSON of their body, and that are broken."""
    own = F.to_json(F.struct(F.col("event_id").alias("index")))
    kinds = F.when(F.col("event_id") % 3 == 0, own).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(own.alias("body")))).otherwise(F.substring(own, 1, 5))
    return readers.table(spark, d, "events").select("event_id", text.event_index(kinds).alias("index_"))


@query(_parts(sql.SENTENCES) + " SELECT s3_token_lemmas_key, sent_ix, array_to_string(list_transform(lemmas, lambda x: coalesce(x, '')), '|') AS fields FROM sent WHERE len(lemmas) > 0")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The sentences as they are read again from the CSV that they are written as."""
    rows = publish.current_sentences(readers.table(spark, d, "token_lemmas")).where(F.size("lemmas") > 0)
    lines = sinks.csv_lines(rows.select(F.struct("s3_token_lemmas_key", "sent_ix").alias("id"), "lemmas"), "lemmas")
    again = readers.csv_rows(lines, "id", "line").withColumnRenamed("sent_ix", "record")
    return again.select("id.*", F.array_join("tokens", "|").alias("fields"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.texts_of_pages(readers.table(spark, d, "book_pages"), "page_id")


@query()
def metadata_parse(spark: SparkSession, d: str) -> DataFrame:
    return readers.metadata_of_pages(readers.table(spark, d, "book_pages"), "page_id")


# text


@query(r"SELECT doc_id, (ix - 1)::INT AS sent_ix, sentence FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS ix FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS s FROM documents))")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "documents")
    return rows.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sent_ix", "sentence"))


@query(r"""SELECT token, count(*) AS n FROM (SELECT replace(lower(regexp_replace(w, '[^\p{L}]', '', 'g')), 'labor', 'labour') AS token
  FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> '') GROUP BY token""")
def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned and respelled tokens of all passages, the empty token included."""
    rows = readers.table(spark, d, "documents")
    tokens = rows.select(F.explode(text.words(F.col("text"))).alias("w")).select(text.respell(text.clean(F.col("w"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


@query(_parts(sql.SENTENCES) + r""" SELECT book_id, sent_ix, array_to_string(w, ' ') AS words FROM (SELECT book_id, sent_ix,
  list_filter(lemmas, lambda x: regexp_matches(x, '^\p{L}+$') AND length(x) > 3) AS w FROM sent) WHERE len(w) > 0""")
def training_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = training.training_sentences(readers.table(spark, d, "token_lemmas"))
    return rows.select("book_id", "sent_ix", F.array_join("words", " ").alias("words"))


@query(_parts(sql.SENTENCES) + r""" SELECT book_id, term, count(*) AS count_ FROM (SELECT book_id, unnest(lemmas) AS term FROM sent)
  WHERE regexp_matches(term, '^\p{L}+$') AND length(term) > 3 GROUP BY ALL HAVING count(*) >= 10""")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return publish.term_counts(readers.table(spark, d, "token_lemmas"))


@query(_parts(sql.SENTENCES) + """, n AS (SELECT book_id, sent_ix, lemmas, coalesce(sum(len(lemmas)) OVER (PARTITION BY book_id ORDER BY sent_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM sent)
  SELECT book_id, lemma, count(*) AS n, min(iloc)::BIGINT AS first_iloc, max(iloc)::BIGINT AS last_iloc, sum(iloc)::BIGINT AS sum_iloc FROM
  (SELECT book_id, unnest(lemmas) AS lemma, first + unnest(range(len(lemmas))) AS iloc FROM n) WHERE lemma <> '' GROUP BY ALL""")
def term_ilocs(spark: SparkSession, d: str) -> DataFrame:
    """Every lemma's places in its book, summed up."""
    rows = publish.positions(readers.table(spark, d, "token_lemmas"))
    return rows.groupBy("book_id", "lemma").agg(F.count("*").alias("n"), F.min("iloc").alias("first_iloc"), F.max("iloc").alias("last_iloc"), F.sum("iloc").alias("sum_iloc"))


@query(_parts(sql.SENTENCES) + """, z AS (SELECT book_id, unnest(list_zip(lemmas, coalesce(tags, []))[1 : least(len(lemmas), coalesce(len(tags), 0))]) AS t FROM sent),
  y AS (SELECT book_id, t[1] AS term, t[2] AS tag FROM z)
  SELECT book_id, term, string_agg(DISTINCT tag[1], ',' ORDER BY tag[1]) AS tags FROM y
  WHERE term <> '' AND (tag[1] IN ('N', 'V', 'J') OR contains(tag, 'RB')) GROUP BY ALL""")
def term_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = publish.term_tags(readers.table(spark, d, "token_lemmas"))
    return rows.select("book_id", "term", F.array_join("tags", ",").alias("tags"))


_TAGGED = """t AS (SELECT DISTINCT t[1] AS lemma, t[2] AS tag FROM (SELECT unnest(list_zip(lemmas, coalesce(tags, []))[1 : least(len(lemmas), coalesce(len(tags), 0))]) AS t FROM sent) WHERE t[1] <> '')"""
_KEPT = ", ".join(map(sql.text, lemmas.KEPT_NOUNS))


@query(_parts(sql.SENTENCES, _TAGGED, "n AS (SELECT DISTINCT lemma FROM t WHERE tag LIKE 'N%')", "v AS (SELECT DISTINCT lemma FROM t WHERE tag LIKE 'V%' AND length(lemma) > 2)")
       + f""" SELECT lemma, verb FROM (SELECT n.lemma, v.lemma AS verb, row_number() OVER (PARTITION BY n.lemma ORDER BY length(v.lemma), v.lemma) AS r
  FROM n JOIN v ON starts_with(n.lemma, v.lemma) AND length(v.lemma) < length(n.lemma) WHERE n.lemma NOT IN ({_KEPT})) WHERE r = 1""")  # fmt: skip
def noun_to_verb(spark: SparkSession, d: str) -> DataFrame:
    """Nouns collapsed to the shortest verb they begin with, which stands for a dictionary of derivations."""
    rows = publish.tokens(readers.table(spark, d, "token_lemmas")).where("lemma <> ''").select("lemma", "tag").distinct()
    nouns = rows.where("tag like 'N%'").select("lemma").distinct()
    starts = nouns.where("length(lemma) > 3").select("lemma", F.explode(F.transform(F.sequence(F.lit(3), F.length("lemma") - 1), lambda n: F.substring("lemma", F.lit(1), n))).alias("verb"))
    verbs = rows.where("tag like 'V%'").select(F.col("lemma").alias("verb")).distinct()
    return lemmas.shortest_verbs(starts.join(verbs, "verb").select("lemma", "verb"))


_COARSE_SQL = "CASE WHEN tag LIKE 'N%' THEN 'NOUN' WHEN tag LIKE 'V%' THEN 'VERB' WHEN tag LIKE 'J%' THEN 'ADJ' WHEN tag LIKE 'RB%' THEN 'ADV' ELSE 'X' END"


@query(_parts(sql.SENTENCES, _TAGGED, rf"c AS (SELECT DISTINCT lemma AS token, {_COARSE_SQL} AS coarse, replace(lower(regexp_replace(lemma, '[^\p{{L}}]', '', 'g')), 'labor', 'labour') AS clean FROM t WHERE tag IS NOT NULL)",
              "w AS (SELECT DISTINCT clean FROM c WHERE clean <> '')", "dict AS (SELECT clean, left(clean, -1) AS base FROM w WHERE clean LIKE '%s' AND length(clean) > 3 AND left(clean, -1) IN (SELECT clean FROM w))",
              "vb AS (SELECT DISTINCT clean AS verb FROM c WHERE coarse = 'VERB' AND length(clean) > 2)",
              f"der AS (SELECT clean, verb FROM (SELECT w.clean, verb, row_number() OVER (PARTITION BY w.clean ORDER BY length(verb), verb) AS r FROM w JOIN vb ON starts_with(w.clean, verb) AND length(verb) < length(w.clean) WHERE w.clean NOT IN ({_KEPT})) WHERE r = 1)",
              "l AS (SELECT token, coarse, c.clean, CASE WHEN coarse = 'NOUN' THEN coalesce(base, c.clean) ELSE c.clean END AS lemma FROM c LEFT JOIN dict ON dict.clean = c.clean)")
       + " SELECT token, coarse, l.clean, CASE WHEN coarse = 'NOUN' AND l.clean <> '' THEN coalesce(verb, lemma) ELSE lemma END AS lemma FROM l LEFT JOIN der ON der.clean = l.lemma")
def lemmatised(spark: SparkSession, d: str) -> DataFrame:
    """Every tagged token's clean form and lemma. Plurals in -s whose singular occurs, and verbs that nouns begin with, stand
    for dictionaries."""
    tags = F.when(F.col("tag").startswith("N"), "NOUN").when(F.col("tag").startswith("V"), "VERB").when(F.col("tag").startswith("J"), "ADJ").when(F.col("tag").startswith("RB"), "ADV").otherwise("X")
    rows = publish.tokens(readers.table(spark, d, "token_lemmas")).where("lemma <> '' and tag is not null").select(F.col("lemma").alias("token"), tags.alias("coarse")).distinct()
    clean = rows.select("coarse", text.respell(text.clean(F.col("token"))).alias("w")).where("w <> ''").distinct()
    words = clean.select("w").distinct()
    plurals = words.where("w like '%s' and length(w) > 3").select(F.col("w").alias("token"), F.lit("n").alias("pos"), F.expr("left(w, length(w) - 1)").alias("lemma"))
    known = plurals.join(words.select(F.col("w").alias("lemma")), "lemma", "left_semi").select("token", "pos", "lemma")
    starts = words.where("length(w) > 3").select(F.col("w").alias("lemma"), F.explode(F.transform(F.sequence(F.lit(3), F.length("w") - 1), lambda n: F.substring("w", F.lit(1), n))).alias("verb"))
    verbs = clean.where("coarse = 'VERB' and length(w) > 2").select(F.col("w").alias("verb"))
    return lemmas.lemmatised(rows, known, starts.join(verbs, "verb").select("lemma", "verb"))


# publishing


@query("SELECT term, string_agg(b, ',' ORDER BY b) AS book_ids, count(b)::INT AS book_count FROM (SELECT DISTINCT term, book_id AS b FROM book_terms) WHERE term IS NOT NULL AND b IS NOT NULL GROUP BY term")
def corpus_terms_built(spark: SparkSession, d: str) -> DataFrame:
    rows = publish.corpus_terms(readers.table(spark, d, "book_terms"))
    return rows.select("term", F.array_join("book_ids", ",").alias("book_ids"), "book_count")


_MERGED = """m AS (SELECT term, coalesce(list(b ORDER BY b) FILTER (b IS NOT NULL), []) AS book_ids FROM
  (SELECT DISTINCT term, b FROM (SELECT term, unnest(CASE WHEN len(book_ids) > 0 THEN book_ids ELSE [NULL] END) AS b FROM corpus_terms WHERE term IS NOT NULL)) GROUP BY term)"""
_HOT = "gutenberg-9000007"


@query(f"WITH {_MERGED} SELECT term, array_to_string(book_ids, ',') AS book_ids, len(book_ids)::INT AS n FROM m")
def corpus_terms_merged(spark: SparkSession, d: str) -> DataFrame:
    """One row per term: the union of all its batches."""
    rows = publish.merged_corpus(readers.table(spark, d, "corpus_terms"))
    return rows.select("term", F.array_join("book_ids", ",").alias("book_ids"), F.size("book_ids").alias("n"))


@query(f"""WITH {_MERGED}, t AS (SELECT DISTINCT term FROM book_terms WHERE book_id = '{_HOT}' UNION SELECT 'a new term')
  SELECT term, len(list_distinct(CASE WHEN t.term IS NULL THEN coalesce(book_ids, []) ELSE list_append(coalesce(book_ids, []), '{_HOT}') END))::INT AS n FROM m FULL JOIN t USING (term)""")
def corpus_terms_added(spark: SparkSession, d: str) -> DataFrame:
    merged = publish.merged_corpus(readers.table(spark, d, "corpus_terms"))
    own = readers.table(spark, d, "book_terms").where(F.col("book_id") == _HOT).select("term")
    rows = publish.add_book(merged, _HOT, own.unionByName(spark.createDataFrame([("a new term",)], "term string")))
    return rows.select("term", F.size("book_ids").alias("n"))


@query(f"SELECT term, count(*) FILTER (mine) > 0 AS touched FROM (SELECT term, false AS mine FROM corpus_terms UNION ALL SELECT term, true FROM book_terms WHERE book_id = '{_HOT}') WHERE term IS NOT NULL GROUP BY term")
def corpus_terms_touched(spark: SparkSession, d: str) -> DataFrame:
    """Which rows of the corpus get the time of the query when a book is added; the other rows keep theirs."""
    corpus = readers.table(spark, d, "corpus_terms")
    merged = publish.merged_corpus(corpus)
    own = readers.table(spark, d, "book_terms").where(F.col("book_id") == _HOT).select("term").where("term is not null")
    rows = publish.add_book(merged, _HOT, own).withColumnRenamed("updated_at", "after")
    both = rows.join(merged.select("term", F.col("updated_at").alias("before")), "term", "left")
    return both.select("term", (~F.col("after").eqNullSafe(F.col("before"))).alias("touched"))


@query(f"WITH {_MERGED} SELECT term, len(list_filter(book_ids, lambda x: x <> '{_HOT}'))::INT AS n FROM m")
def corpus_terms_removed(spark: SparkSession, d: str) -> DataFrame:
    merged = publish.merged_corpus(readers.table(spark, d, "corpus_terms"))
    return publish.remove_book(merged, _HOT).select("term", F.size("book_ids").alias("n"))


@query(f"""WITH {_MERGED}, t AS (SELECT DISTINCT term FROM book_terms WHERE book_id = '{_HOT}'),
  x AS (SELECT term, t.term IS NOT NULL AS gone, CASE WHEN t.term IS NULL THEN book_ids ELSE list_filter(book_ids, lambda x: x <> '{_HOT}') END AS b FROM m LEFT JOIN t USING (term))
  SELECT term, len(b)::INT AS n FROM x WHERE NOT gone OR len(b) > 0""")
def corpus_terms_pruned(spark: SparkSession, d: str) -> DataFrame:
    """A book's terms taken from the corpus; sets that are empty then go."""
    merged = publish.merged_corpus(readers.table(spark, d, "corpus_terms"))
    own = readers.table(spark, d, "book_terms").where(F.col("book_id") == _HOT).select("term")
    return publish.remove_book_terms(merged, _HOT, own).select("term", F.size("book_ids").alias("n"))


@query(_parts(sql.TERMS) + """ SELECT DISTINCT o.book_id, o.term FROM book_terms o WHERE o.book_id IN (SELECT book_id FROM bt WHERE count_ >= 20)
  AND NOT EXISTS (SELECT 1 FROM bt n WHERE n.count_ >= 20 AND n.book_id = o.book_id AND n.term = o.term)""")
def deprecated_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that go if every book is published anew with its more frequent terms."""
    rows = readers.table(spark, d, "book_terms")
    return publish.deprecated(rows, books.current_terms(rows).where("count_ >= 20"))


@query("""SELECT book_id, count(*) AS terms, sum(count_)::BIGINT AS total FROM (SELECT book_id, term, count_ FROM book_terms
  QUALIFY row_number() OVER (PARTITION BY book_id, term ORDER BY published_at DESC NULLS LAST, count_ DESC NULLS LAST) = 1) GROUP BY book_id""")
def batch_put(spark: SparkSession, d: str) -> DataFrame:
    """The table after all its rows were put one after the other, by key and time."""
    rows = readers.table(spark, d, "book_terms").select("book_id", "term", "count_", "published_at")
    now = books.latest(rows, ["book_id", "term"], "published_at", ["count_"])
    return now.groupBy("book_id").agg(F.count("*").alias("terms"), F.sum("count_").alias("total"))


@query("""SELECT b.book_id, p.book_id IS NULL AS inserted FROM (SELECT DISTINCT book_id FROM (SELECT book_id FROM book_terms UNION ALL SELECT 'gutenberg-1'))  b
  LEFT JOIN (SELECT DISTINCT book_id FROM pipeline WHERE title IS NOT NULL) p USING (book_id)""")
def conditional_insert(spark: SparkSession, d: str) -> DataFrame:
    new = readers.table(spark, d, "book_terms").select("book_id").unionByName(spark.createDataFrame([("gutenberg-1",)], "book_id string"))
    return sinks.inserted(readers.table(spark, d, "pipeline").where("title is not null").select("book_id"), new, ["book_id"])


@query(_parts(sql.PIPELINE) + """, c AS (SELECT book_id, max(scraped_at) AS updated_at FROM documents GROUP BY book_id)
  SELECT book_id, title, epoch_us(coalesce(c.updated_at, pipe.updated_at)) AS updated_us FROM pipe FULL JOIN c USING (book_id)""")
def field_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A field set from another table; books that are new get a row."""
    rows = books.current_pipeline(readers.table(spark, d, "pipeline")).select("book_id", "title", "updated_at")
    changes = readers.table(spark, d, "documents").groupBy("book_id").agg(F.max("scraped_at").alias("updated_at"))
    return sinks.update_fields(rows, changes, ["book_id"]).select("book_id", "title", F.unix_micros("updated_at").alias("updated_us"))


_HALF = """CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"""


@query(_parts(sql.BOOKS) + f" SELECT book_id, term, seed_ix, i::INT AS dim, {_HALF} + 0.0 AS x FROM (SELECT book_id, term, seed_ix, unnest(range(16)) AS i, unnest(w) AS x FROM cut)")
def float16_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every component as half precision stores it."""
    rows = readers.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    book = F.concat(F.lit("gutenberg-"), (F.col("vec_id") % 5 + 1).cast("string")).alias("book_id")
    term = F.format_string("t%04d", F.expr("vec_id div 5")).alias("term")
    return rows.select(book, term, F.expr("p div 16").cast("int").alias("seed_ix"), (F.col("p") % 16).alias("dim"), (vectors.to_half(F.col("x")) + F.lit(0.0)).alias("x"))


def _nibble(place: str) -> str:
    return f"(instr('0123456789ABCDEF', substr(h, {place}, 1)) - 1)"


@query(
    _parts(sql.TERMS)
    + f""", b AS (SELECT book_id, term, unnest(range(len(vectors)))::INT AS seed_ix, hex(unnest(vectors)) AS h FROM bt WHERE vectors IS NOT NULL),
  c AS (SELECT *, unnest(range(length(h) // 4)) AS i FROM b),
  y AS (SELECT *, {_nibble('4 * i + 1')} * 16 + {_nibble('4 * i + 2')} AS lo, {_nibble('4 * i + 3')} * 16 + {_nibble('4 * i + 4')} AS hi FROM c)
  SELECT book_id, term, seed_ix, i::INT AS dim, (CASE WHEN hi >= 128 THEN -1.0 ELSE 1.0 END * CASE WHEN (hi % 128) // 4 = 0 THEN ((hi % 4) * 256 + lo) * pow(2.0, -24)
    ELSE (1 + ((hi % 4) * 256 + lo) / 1024.0) * pow(2.0, (hi % 128) // 4 - 15) END)::DOUBLE + 0.0 AS x FROM y"""
)
def float16_decode(spark: SparkSession, d: str) -> DataFrame:
    """The published vectors, decoded from their bytes."""
    rows = books.with_vectors(books.current_terms(readers.table(spark, d, "book_terms")))
    each = rows.select("book_id", "term", F.posexplode("vectors").alias("seed_ix", "b"))
    return each.select("book_id", "term", "seed_ix", F.posexplode(vectors.from_half_bytes(F.col("b"))).alias("dim", "x")).withColumn("x", F.col("x") + F.lit(0.0))


@query(_parts(sql.SENTENCES, sql.TERMS) + r""", c AS (SELECT book_id, term, count(*) AS n FROM (SELECT book_id, unnest(lemmas) AS term FROM sent) WHERE regexp_matches(term, '^\p{L}+$') AND length(term) > 3 GROUP BY ALL),
  z AS (SELECT book_id, unnest(list_zip(lemmas, coalesce(tags, []))[1 : least(len(lemmas), coalesce(len(tags), 0))]) AS t FROM sent),
  g AS (SELECT book_id, t[1] AS term, string_agg(DISTINCT t[2][1], ',' ORDER BY t[2][1]) AS pos FROM z WHERE t[1] <> '' AND (t[2][1] IN ('N', 'V', 'J') OR contains(t[2], 'RB')) GROUP BY ALL)
  SELECT book_id, term, n AS count_, pos, array_to_string(seeds, ',') AS seeds, len(vectors)::INT AS n_vectors FROM c JOIN g USING (book_id, term) JOIN bt USING (book_id, term) WHERE vectors IS NOT NULL""")
def book_terms_row(spark: SparkSession, d: str) -> DataFrame:
    """Counts, tags and vectors of a book's terms joined into the rows that are published."""
    lemmas = readers.table(spark, d, "token_lemmas")
    stack = books.with_vectors(books.current_terms(readers.table(spark, d, "book_terms"))).select("book_id", "term", "seeds", "vectors")
    rows = publish.term_counts(lemmas, 1).join(publish.term_tags(lemmas), ["book_id", "term"]).join(stack, ["book_id", "term"])
    return rows.select("book_id", "term", "count_", F.array_join("tags", ",").alias("pos"), F.array_join(F.col("seeds").cast("array<string>"), ",").alias("seeds"), F.size("vectors").alias("n_vectors"))


@query(_parts(sql.PIPELINE) + " SELECT book_id, array_to_string(CASE WHEN author IS NULL THEN [] ELSE string_split(author, ', ') END, ';') AS author, title FROM pipe WHERE s3_metadata_key IS NOT NULL")
def metadata_publish(spark: SparkSession, d: str) -> DataFrame:
    """Author and title as published from a book's metadata map."""
    rows = books.current_pipeline(readers.table(spark, d, "pipeline")).where("s3_metadata_key is not null")
    empty = F.array().cast("array<string>")
    known = F.map_from_arrays(F.array(F.lit("author"), F.lit("title")), F.array(F.coalesce(F.split("author", ", "), empty), F.when(F.col("title").isNull(), empty).otherwise(F.array("title"))))
    author, title = publish.metadata_row(F.col("m"))
    return rows.select("book_id", known.alias("m")).select("book_id", author.alias("author"), title.alias("title"))


@query(_parts(sql.BOOKS) + " SELECT book_id || '::' || term AS id, split_part(book_id, '-', 2)::BIGINT AS source_id, count_::INT AS vector_count, 1 AS pos_count FROM raw")
def vector_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a vector index, their vectors checked for size."""
    matrix, counts = _books(spark, d)
    rows = matrix.select("book_id", "term", F.col("vs")[0].alias("vector")).join(counts, ["book_id", "term"])
    entries = publish.vector_entries(rows, 16).where("size(vector) = 16")
    book, _ = text.split_vector_id(F.col("id"))
    return entries.select("id", text.source_id(book).alias("source_id"), "vector_count", "pos_count")


@query(
    _parts(sql.BOOKS, "dm AS (SELECT term, i, avg(v[i]) AS x FROM nv, (SELECT unnest(range(1, 17)) AS i) WHERE book_id = 'gutenberg-1' GROUP BY ALL)",
           "mv AS (SELECT term, list(x ORDER BY i) AS w FROM dm GROUP BY term)", "un AS (SELECT term, list_transform(w, lambda x: x / greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS v FROM mv)")
    + """ SELECT un.term, round(list_dot_product(un.v, o.v), 6) + 0.0 AS score, count_ AS vector_count FROM un, (SELECT v FROM un WHERE term = 't0007') o
  JOIN raw ON raw.book_id = 'gutenberg-1' AND raw.term = un.term WHERE NOT (tags = ['R']) ORDER BY score DESC, un.term LIMIT 20"""
)
def vector_query_book(spark: SparkSession, d: str) -> DataFrame:
    """A book's terms nearest to one of its terms: a top-k report."""
    matrix, counts = _books(spark, d)
    return similarity.nearest(matrix, counts, "gutenberg-1", "t0007", 20).select("term", six("score").alias("score"), "vector_count")


# training and alignment


def stored_in(spark: SparkSession) -> str:
    """A new place for tables that a query writes and reads again: in the shared checkpoint folder where one is set."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or str(shared_folder(spark))).rstrip('/')}/wordtide-{uuid.uuid4().hex}"


def _seed_vectors(spark: SparkSession, d: str) -> DataFrame:
    return books.seed_rows(_books(spark, d)[0]).select("book_id", F.col("seed_ix").alias("seed"), "term", "v")


@query(_parts(sql.BOOKS) + " SELECT book_id, term, (i - 1)::INT AS dim, round(avg(v[i]), 6) + 0.0 AS x FROM nv, (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL")
def centroid_mean(spark: SparkSession, d: str) -> DataFrame:
    return alignment.centroids(_seed_vectors(spark, d)).select("book_id", "term", F.col("d").alias("dim"), six("x").alias("x"))


_SHIFTS = f"""own AS (SELECT book_id, term, v FROM nv WHERE seed_ix = 0)"""


def _turned(spark: SparkSession, d: str) -> DataFrame:
    """Four models of every book that are one model in frames turned against each other: its numbers moved by k places."""
    own = _books(spark, d)[0].select("book_id", "term", F.col("vs")[0].alias("w"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seed"))
    return own.select("book_id", "seed", "term", F.concat(F.slice("w", F.col("seed") + 1, 16), F.slice("w", F.lit(1), F.col("seed"))).alias("v"))


@query(_parts(sql.BOOKS, _SHIFTS) + """ SELECT a.book_id, seed::INT AS seed, a.term, round(list_dot_product(a.v, b.v), 6) + 0.0 AS with_first, 0.0::DOUBLE AS mean_disparity
  FROM own a JOIN own b ON b.book_id = a.book_id AND b.term = 't0000', (SELECT unnest(range(4)) AS seed)""")
def gpa_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Models turned against each other align exactly, and turning changes no product of two of a model's vectors."""
    rows = alignment.aligned_models(_turned(spark, d))
    first = rows.where("term = 't0000'").select("book_id", "seed", F.col("v").alias("w"))
    both = rows.join(F.broadcast(first), ["book_id", "seed"])  # one row a book and seed
    return both.select("book_id", "seed", "term", six(vectors.dot(F.col("v"), F.col("w"))).alias("with_first"), six("mean_disparity").alias("mean_disparity"))


@query(_parts(sql.BOOKS, _SHIFTS, "c AS (SELECT book_id, i, avg(v[i]) AS m FROM own, (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL)")
       + """ SELECT book_id, term, round(sum((v[i] - m) ** 2), 6) AS variance, 0.0::DOUBLE AS disparity, 1.0::DOUBLE AS r_squared FROM own JOIN c USING (book_id) GROUP BY ALL""")
def alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    """A term's distance from its book's centre and how far its seeds lie apart, for models turned against each other."""
    rows = alignment.term_statistics(_turned(spark, d))
    return rows.select("book_id", "term", *(six(x).alias(x) for x in ("variance", "disparity", "r_squared")))


@query()
def gpa_align(spark: SparkSession, d: str) -> DataFrame:
    return alignment.aligned_models(_seed_vectors(spark, d), max_iterations=400)


@query(_parts(sql.TERMS) + " SELECT count_, count(*) AS terms, round(sum(alignment_stats.r_squared), 6) + 0.0 AS total FROM bt GROUP BY count_")
def alignment_fit_by_count(spark: SparkSession, d: str) -> DataFrame:
    """How well the published terms fit, by how often they occur; the mean as its sum, which has no halves to round."""
    rows = books.current_terms(readers.table(spark, d, "book_terms"))
    fit = alignment.fit_by_count(rows.select("book_id", "term", "alignment_stats.r_squared"), rows.select("book_id", "term", "count_"))
    return fit.select("count_", "terms", six(F.coalesce("r_squared", F.lit(0.0)) * F.col("terms")).alias("total"))


@query(_parts(sql.BOOKS) + " SELECT book_id, seed_ix AS seed, term, round(list_sum(v), 6) + 0.0 AS total FROM nv")
def models_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every book's seed models as they are read again after they were written."""
    rows = _seed_vectors(spark, d)
    folder = f"{stored_in(spark)}/models"
    sinks.write_models(rows, alignment.centroids(rows), folder)
    again = readers.seed_models(spark, folder)
    return again.select("book_id", F.col("seed").cast("int").alias("seed"), "term", six(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(_parts(sql.BOOKS) + """ SELECT book_id, term, count_, array_to_string(tags, ',') AS pos, '0,1,2,3' AS seeds, 4 AS n_vectors,
  (SELECT round(sum(x), 3) + 0.0 FROM (SELECT unnest(v) AS x FROM nv WHERE nv.book_id = raw.book_id AND nv.term = raw.term AND seed_ix = 0)) AS total FROM raw""")
def published_rows(spark: SparkSession, d: str) -> DataFrame:
    """Term rows from a book's centroid, counts, tags and seed models, vectors in half precision."""
    _, counts = _books(spark, d)
    models = _seed_vectors(spark, d)
    nothing = [F.lit(None).cast("double").alias(x) for x in ("variance", "disparity", "r_squared")]
    rows = publish.term_rows(counts.select("book_id", "term", "count_", *nothing), counts.select("book_id", "term", "tags"), models)
    first = F.aggregate(F.col("vectors")[0], F.lit(0.0), lambda s, x: s + x)
    near = models.where("seed = 0").select("book_id", "term", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("exact"))
    out = rows.join(near, ["book_id", "term"]).withColumn("total", F.when(F.abs(first - F.col("exact")) < 0.01, F.col("exact")).otherwise(first))
    return out.select("book_id", "term", "count_", F.array_join("tags", ",").alias("pos"), F.array_join(F.col("seeds").cast("array<string>"), ",").alias("seeds"), F.size("vectors").alias("n_vectors"), (F.round("total", 3) + F.lit(0.0)).alias("total"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "token_lemmas")
    return training.train_all(training.training_sentences(rows), [0, 1, 2], most=training.most_words(rows))


@query()
def train_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Three seed models of every book."""
    return _models(spark, d)


@query()
def pipeline_align(spark: SparkSession, d: str) -> DataFrame:
    """Train, align and describe every book, one after the other; terms of books whose models do not align have nulls."""
    models = _models(spark, d).withColumn("v", F.col("v").cast("array<float>"))  # as they were trained: half as much to shuffle
    return alignment.term_statistics(models, strict=False, max_iterations=400).drop("vector")


# describing


@query(_parts(sql.PIPELINE, sql.TERMS, _ALIGNED_TERMS) + " SELECT a.term, a.term IN (SELECT term FROM altm) AS known FROM (SELECT unnest(['rent', 'wage', 'no such term']) AS term) a")
def resolve_exact(spark: SparkSession, d: str) -> DataFrame:
    """Asked terms that stand for themselves, by the resolver."""
    known = vocabulary(spark, d)

    def stands(term: str) -> bool:
        try:
            return describe.resolve(term, known) == term
        except TermResolutionError:
            return False

    return spark.createDataFrame([(t, stands(t)) for t in ("rent", "wage", "no such term")], "term string, known boolean")


@query(_parts(sql.PIPELINE, sql.TERMS, _ALIGNED_TERMS) + " SELECT 'rent - wage' AS expression, 'rent,wage' AS terms WHERE (SELECT count(DISTINCT term) FROM altm WHERE term IN ('rent', 'wage')) = 2")
def parse_describe(spark: SparkSession, d: str) -> DataFrame:
    """A message to an expression whose terms exist; a misspelt term is put right. The generator stands for a language model."""
    engine = Engine(readers.table(spark, d, "book_terms"), readers.table(spark, d, "pipeline"))
    found = engine.parse_describe("what land costs beside labour", generator=lambda message: "rentt - wage")
    return spark.createDataFrame([(found["expression"], ",".join(found["terms"]))], "expression string, terms string")


@query()
def resolve_close(spark: SparkSession, d: str) -> DataFrame:
    """The entries most like a misspelt term, a top-k report."""
    found = describe.alike(vocabulary(spark, d), "labor", 20, 0.3)
    return spark.createDataFrame(list(enumerate(found)), "place int, term string")
