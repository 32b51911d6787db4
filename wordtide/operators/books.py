"""The tables as books: current rows, matrices of unit vectors, vocabularies and the filters of the list queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors


def latest(rows: DataFrame, keys: list[str], version: str, tie: list[str] | None = None) -> DataFrame:
    """One whole row per key, the one of the latest version; of equal versions the greatest by `tie`.

    Only (version, tie) of each key is compared map-side before the shuffle, as a ranking limited to one row.
    """
    order = [F.desc_nulls_last(version), *(F.desc_nulls_last(t) for t in tie or [])]
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")


def current_pipeline(pipeline: DataFrame) -> DataFrame:
    return latest(pipeline.where("book_id is not null"), ["book_id"], "updated_at", ["s3_prefix_models", "title", "author"])


def current_terms(book_terms: DataFrame) -> DataFrame:
    """The latest publication of each (book_id, term) that has a count."""
    rows = book_terms.where("book_id is not null and term is not null and count_ is not null")
    return latest(rows, ["book_id", "term"], "published_at", ["count_"])


def aligned(pipeline: DataFrame) -> DataFrame:
    return pipeline.where("s3_prefix_models is not null")


def dated(pipeline: DataFrame) -> DataFrame:
    return pipeline.where("published_year is not null")


def not_adverb_only(tags: Column) -> Column:
    """False only for the tag set {R}; words without tags are kept."""
    return ~F.coalesce(F.array_distinct(tags) == F.array(F.lit("R")), F.lit(False))


def with_vectors(rows: DataFrame) -> DataFrame:
    return rows.where("vectors is not null")


def books_list(pipeline: DataFrame) -> DataFrame:
    """(id, label, author, title, published_year) of aligned and dated books."""
    rows = dated(aligned(current_pipeline(pipeline)))
    return rows.select(text.source_id(F.col("book_id")).alias("id"), text.label(F.col("author"), F.col("published_year")).alias("label"), "author", "title", "published_year")


def aligned_terms(book_terms: DataFrame, pipeline: DataFrame) -> DataFrame:
    """(book_id, term) of aligned books, dated or not, without words that are adverbs only."""
    rows = current_terms(book_terms).where(not_adverb_only(F.col("tags"))).select("book_id", "term")
    return rows.join(aligned(current_pipeline(pipeline)).select("book_id"), "book_id", "left_semi")


def terms_list(book_terms: DataFrame, pipeline: DataFrame) -> DataFrame:
    """(term, n_books, books): terms of more than one aligned book with the ids of those books in order."""
    found = aligned_terms(book_terms, pipeline).groupBy("term").agg(F.collect_set(text.source_id(F.col("book_id"))).alias("books"))
    return found.where(F.size("books") > 1).select("term", F.size("books").alias("n_books"), F.array_sort("books").alias("books"))


def vocabulary(book_terms: DataFrame, pipeline: DataFrame) -> DataFrame:
    return aligned_terms(book_terms, pipeline).select("term").distinct()


def embedding_books(embeddings: DataFrame, size: int = 16, seeds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Five books of the embeddings: term vec_id div 5 of book vec_id % 5 + 1, `seeds` seeds of `size` dimensions each.

    (book_id, term, vs) with a unit vector for each seed, and (book_id, term, count_, tags). Number i of an embedding's n
    is dimension i % size of seed i div size; where more are needed they begin anew, the k-th time k + 1 times as large
    in every second place.
    """
    rows = embeddings.select(
        F.concat(F.lit("gutenberg-"), (F.col("vec_id") % 5 + 1).cast("string")).alias("book_id"),
        F.format_string("t%04d", F.expr("vec_id div 5")).alias("term"),
        (F.col("vec_id") % 90 + 10).alias("count_"),
        F.when(F.col("vec_id") % 17 == 0, F.array(F.lit("R"))).otherwise(F.array(F.lit("N"))).alias("tags"),
        F.col("embedding").cast("array<double>").alias("e"),
    )

    def number(i: Column) -> Column:
        x = F.get("e", (i % F.size("e")).cast("int"))
        return F.when(i % 2 == 0, x).otherwise(x * (F.floor(i / F.size("e")) + 1))

    each = F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda k: vectors.unit(F.transform(F.sequence(k * size, k * size + size - 1), number)))
    return rows.select("book_id", "term", each.alias("vs")), rows.select("book_id", "term", "count_", "tags")


def seed_rows(matrix: DataFrame) -> DataFrame:
    """(book_id, term, seed_ix, v): a row for each seed."""
    return matrix.select("book_id", "term", F.posexplode("vs").alias("seed_ix", "v"))


def term_books(book_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The published books: half-precision vectors decoded, a book's seeds cut to those that all its terms have."""
    rows = with_vectors(current_terms(book_terms).where(not_adverb_only(F.col("tags")))).select("book_id", "term", "count_", "tags", "vectors")
    seeds = rows.groupBy("book_id").agg(F.min(F.size("vectors")).alias("n_seeds"))
    # as one blob a term, all of them of one size
    blob = F.aggregate(F.slice("vectors", F.lit(1), F.col("n_seeds")), F.lit(b""), lambda t, x: F.concat(t, x))
    each = rows.join(seeds, "book_id").select("book_id", "term", "n_seeds", vectors.from_half_bytes(blob).alias("all"))

    def one(k: Column) -> Column:
        size = F.expr("size(all) div n_seeds")
        return vectors.unit(F.slice("all", k * size + 1, size))

    some = F.transform(F.sequence(F.lit(0), F.col("n_seeds") - 1), one)
    matrix = each.where("n_seeds > 0").select("book_id", "term", some.alias("vs"))
    return matrix, rows.select("book_id", "term", "count_", "tags")
