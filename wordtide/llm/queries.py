"""The queries pN_... over the test tables, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from . import burst, dfr, leakage, norm, overlap, packing, sentences, splitting, stripes, wrapper
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    weights = dfr.term_weights(table(spark, d, "book_terms"))
    return weights.select("book_id", "term", "tf", "n_books", F.round("dfr", 6).alias("dfr"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dfr.standout_terms(dfr.term_weights(table(spark, d, "book_terms")))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return norm.consistent_texts(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "book_terms").select("term").distinct()
    return norm.consistent_texts(terms, "term", "term").select(F.col("key").alias("term"), F.col("text").alias("form"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return norm.lookalike_pairs(table(spark, d, "book_terms"), table(spark, d, "documents"))


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"), with_text=False).drop("sent_ix")


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return burst.term_frequencies(table(spark, d, "book_terms"), table(spark, d, "corpus_terms"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_frequencies(spark, d).where("mark is not null").select("term", "mark")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return wrapper.main_lines(table(spark, d, "book_pages"))


def p6_estimates(spark: SparkSession, d: str) -> DataFrame:
    estimates = overlap.overlap_estimates(table(spark, d, "corpus_terms"))
    return estimates.select("term_a", "term_b", "n_a", "n_b", F.round("shared", 3).alias("shared"), F.round("share", 6).alias("share"))


def p6_shared(spark: SparkSession, d: str) -> DataFrame:
    """The estimates of p6_estimates for all terms, with those whose sets are equal."""
    shared = overlap.shared_books(table(spark, d, "corpus_terms"))
    return shared.select("term_a", "term_b", "n_a", "n_b", F.round("shared", 3).alias("shared"), F.round("share", 6).alias("share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping_terms(table(spark, d, "corpus_terms"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = stripes.cooccurrences(table(spark, d, "token_lemmas"))
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.round("lift", 4).alias("lift"), F.round("llr", 3).alias("llr"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return stripes.bound_items(table(spark, d, "token_lemmas"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(p9_leaks(spark, d))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece_no = 0").select("doc_id")


_ALL = [p1_found, p1_scores, p2_found, p2_terms, p2_texts, p3_found, p3_sentences, p4_found, p4_frequencies, p5_found, p6_found, p6_estimates, p6_shared, p7_found, p7_pairs, p8_containers, p9_found, p9_leaks, p10_found, p10_pieces]


def _sent(f: Query) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    return query


def queries() -> dict[str, Query]:
    return {f.__name__: _sent(f) for f in _ALL}
