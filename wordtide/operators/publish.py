"""Publishing books: token streams to term rows, corpus rows and the sets they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors


def current_sentences(token_lemmas: DataFrame) -> DataFrame:
    """The latest load of each sentence that has lemmas."""
    from .books import latest

    rows = token_lemmas.where("lemmas is not null and s3_token_lemmas_key is not null and sent_ix is not null")
    return latest(rows, ["s3_token_lemmas_key", "sent_ix"], "loaded_at", ["lemmas", "tags"])


def tokens(token_lemmas: DataFrame) -> DataFrame:
    """(book_id, sent_ix, tok_ix, lemma, tag): lemmas and tags zipped by position, the shorter list deciding."""
    rows = current_sentences(token_lemmas)
    both = F.arrays_zip("lemmas", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    shorter = F.slice(both, 1, F.least(F.size("lemmas"), F.size(F.coalesce("tags", F.array().cast("array<string>")))))
    each = rows.select("book_id", "sent_ix", F.posexplode(shorter).alias("tok_ix", "t"))
    return each.select("book_id", "sent_ix", "tok_ix", F.col("t.lemmas").alias("lemma"), F.col("t.tags").alias("tag"))


def positions(token_lemmas: DataFrame) -> DataFrame:
    """(book_id, lemma, iloc): a token's place in its book; empty lemmas take places too but have no row.

    The places before a sentence are a running sum over sentences in ranges of 1,024, then over the ranges, so that a
    book with a large share of all sentences is not ordered in one task.
    """
    rows = current_sentences(token_lemmas).select("book_id", "sent_ix", "lemmas", F.size("lemmas").alias("n"), F.expr("sent_ix div 1024").alias("range"))
    ranges = rows.groupBy("book_id", "range").agg(F.sum("n").alias("r"))
    before = F.sum("r").over(Window.partitionBy("book_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("book_id", "range", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum("n").over(Window.partitionBy("book_id", "range").orderBy("sent_ix").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(within, F.lit(0))).join(ranges, ["book_id", "range"])
    each = rows.select("book_id", (F.col("base") + F.col("within")).alias("first"), F.posexplode("lemmas").alias("tok_ix", "lemma"))
    return each.where("lemma is not null and lemma <> ''").select("book_id", "lemma", (F.col("first") + F.col("tok_ix")).alias("iloc"))


def term_tags(token_lemmas: DataFrame) -> DataFrame:
    """(book_id, term, tags): the set of content tags of each lemma."""
    rows = tokens(token_lemmas).where("lemma <> ''").withColumn("pos", text.content_tag(F.col("tag"))).where("pos is not null")
    return rows.groupBy("book_id", F.col("lemma").alias("term")).agg(F.array_sort(F.collect_set("pos")).alias("tags"))


def term_counts(token_lemmas: DataFrame, min_count: int = 10) -> DataFrame:
    """(book_id, term, count_) of trainable lemmas with at least `min_count` occurrences in the book."""
    rows = current_sentences(token_lemmas).select("book_id", F.explode(text.trainable(F.col("lemmas"))).alias("term"))
    return rows.groupBy("book_id", "term").agg(F.count("*").alias("count_")).where(F.col("count_") >= min_count)


def term_rows(centroid: DataFrame, tags: DataFrame, seed_vectors: DataFrame) -> DataFrame:
    """Rows to publish, from (book_id, term, count_, variance, disparity, r_squared), tags and (book_id, term, seed, v).

    Only terms with content tags are published. Vectors are kept in half precision, in the order of their seeds.
    """
    stack = seed_vectors.groupBy("book_id", "term").agg(F.array_sort(F.collect_list(F.struct("seed", F.transform("v", vectors.to_half).alias("v")))).alias("s"))
    rows = centroid.join(tags, ["book_id", "term"]).join(stack, ["book_id", "term"])
    stats = F.struct("variance", "disparity", "r_squared").alias("alignment_stats")
    return rows.select("book_id", "term", stats, "count_", "tags", F.transform("s", lambda x: x.seed).alias("seeds"), F.transform("s", lambda x: x.v).alias("vectors"))


def corpus_terms(rows: DataFrame) -> DataFrame:
    """(term, book_ids, book_count) from (book_id, term)."""
    return rows.where("term is not null and book_id is not null").groupBy("term").agg(F.array_sort(F.collect_set("book_id")).alias("book_ids")).withColumn("book_count", F.size("book_ids"))


def merged_corpus(corpus: DataFrame) -> DataFrame:
    """(term, book_ids): one row per term, the union of its rows; a term without a book has an empty set. With the latest
    `updated_at` of a term's rows, where they have one.

    Pairs are made distinct before they are gathered, so repeated batches of a term cost no more than its books.
    """
    pairs = corpus.where("term is not null").select("term", F.explode_outer("book_ids").alias("b")).distinct()
    merged = pairs.groupBy("term").agg(F.array_sort(F.collect_set("b")).alias("book_ids"))
    if "updated_at" in corpus.columns:
        merged = merged.join(corpus.where("term is not null").groupBy("term").agg(F.max("updated_at").alias("updated_at")), "term")
    return merged


def add_book(corpus: DataFrame, book_id: str, terms: DataFrame) -> DataFrame:
    """Adds a book to the sets of `terms` (term), which appear if they are new; adding twice changes no set.

    Where the corpus has `updated_at`, the rows of `terms` get the time of the query.
    """
    new = terms.select("term").distinct().withColumn("_new", F.array(F.lit(book_id)))
    both = corpus.select("term", "book_ids", *_times(corpus)).join(new, "term", "full")
    empty = F.array().cast("array<string>")
    ids = F.array_sort(F.array_union(F.coalesce("book_ids", empty), F.coalesce("_new", empty))).alias("book_ids")
    return both.select("term", ids, *_touched(corpus, F.col("_new").isNotNull()))


def _times(corpus: DataFrame) -> list[str]:
    return ["updated_at"] if "updated_at" in corpus.columns else []


def _touched(corpus: DataFrame, change: Column) -> list[Column]:
    return [F.when(change, text.now()).otherwise(F.col(c)).alias(c) for c in _times(corpus)]


def remove_book(corpus: DataFrame, book_id: str) -> DataFrame:
    """Takes a book out of every set; the rows stay, perhaps without a book. `updated_at` changes where the set does."""
    return corpus.select("term", F.array_remove("book_ids", book_id).alias("book_ids"), *_touched(corpus, F.array_contains("book_ids", book_id)))


def remove_book_terms(corpus: DataFrame, book_id: str, terms: DataFrame) -> DataFrame:
    """Takes a book out of the sets of `terms`; a set that is empty then goes."""
    gone = terms.select("term", F.lit(True).alias("_gone")).distinct()
    rows = corpus.join(gone, "term", "left")
    rows = rows.withColumn("book_ids", F.when(F.col("_gone"), F.array_remove("book_ids", book_id)).otherwise(F.col("book_ids")))
    return rows.where(F.col("_gone").isNull() | (F.size("book_ids") > 0)).select("term", "book_ids", *_touched(corpus, F.coalesce("_gone", F.lit(False))))


def deprecated(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(book_id, term) of books published anew that are no longer among their terms."""
    again = existing.join(new.select("book_id").distinct(), "book_id", "left_semi")
    return again.select("book_id", "term").distinct().join(new.select("book_id", "term").distinct(), ["book_id", "term"], "left_anti")


def republished(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The term rows after publication: a published book's rows are replaced as a whole, other books' stay."""
    kept = existing.join(new.select("book_id").distinct(), "book_id", "left_anti")
    return kept.unionByName(new)


def metadata_row(metadata: Column) -> tuple[Column, Column]:
    """Author and title of map<string, array<string>>: authors joined by ';', the first title."""
    return F.array_join(F.try_element_at(metadata, F.lit("author")), ";"), F.try_element_at(F.try_element_at(metadata, F.lit("title")), F.lit(1))


def vector_entries(rows: DataFrame, size: int) -> DataFrame:
    """(id, book_id, term, vector, pos, vector_count, pos_count) with vectors checked to be of `size`."""
    checked = F.when(F.size("vector") == size, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector must have {size} numbers")).cast("array<double>"))
    pos = F.array_sort("tags")
    return rows.select(text.vector_id(F.col("book_id"), F.col("term")).alias("id"), "book_id", "term", checked.cast("array<float>").alias("vector"), pos.alias("pos"), F.col("count_").cast("int").alias("vector_count"), F.size("tags").alias("pos_count"))


def without_vectors(entries: DataFrame, book_id: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The index without a book's entries, or without those of `ids` (id); ids that are not there are no error."""
    if book_id is not None:
        entries = entries.where(~F.col("book_id").eqNullSafe(F.lit(book_id)))
    return entries if ids is None else entries.join(ids.select("id").distinct(), "id", "left_anti")
