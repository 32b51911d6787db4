"""Expressions evaluated per book and seed, and the similarity profiles they give."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import vectors


def query_vectors(matrix: DataFrame, trees: Mapping[str, ex.Tree]) -> DataFrame:
    """(expr, leaves, book_id, qvs) for the books that carry all leaves of the expression: one vector a seed.

    One pass finds the leaves of all expressions; a book's leaves become columns, so no join is needed.
    """
    terms = list(dict.fromkeys(t for tree in trees.values() for t in ex.leaves(tree)))
    held = matrix.where(F.col("term").isin(terms)).groupBy("book_id").agg(*(F.max(F.when(F.col("term") == t, F.col("vs"))).alias(f"_{i}") for i, t in enumerate(terms)))
    return evaluated(held, terms, trees)


def evaluated(held: DataFrame, terms: list[str], trees: Mapping[str, ex.Tree]) -> DataFrame:
    """The same from one row a book: (book_id, _0, _1, ...), the vectors of `terms` in order, null where the book lacks one."""
    place = {t: f"_{i}" for i, t in enumerate(terms)}
    out = None
    for expr, tree in trees.items():
        own = ex.leaves(tree)
        has_all = F.lit(True)
        for t in own:
            has_all = has_all & F.col(place[t]).isNotNull()
        if isinstance(tree, ex.Term):
            vs = F.col(place[tree.term])
        else:
            vs = F.transform(F.arrays_zip(*(place[t] for t in own)), lambda z: ex.compile_tree(tree, lambda t: z[place[t]]))  # noqa: B023
        part = held.where(has_all).select(F.lit(expr).alias("expr"), F.array(*map(F.lit, own)).alias("leaves"), "book_id", vs.alias("qvs"))
        out = part if out is None else out.unionByName(part)
    return out


def term_vectors(matrix: DataFrame, terms: list[str]) -> DataFrame:
    """The same for bare terms, which need no arithmetic: one filter for all of them."""
    rows = matrix.where(F.col("term").isin(terms))
    return rows.select(F.col("term").alias("expr"), F.array("term").alias("leaves"), "book_id", F.col("vs").alias("qvs"))


def similarities(matrix: DataFrame, queries: DataFrame, strategy: str = "native") -> DataFrame:
    """(expr, book_id, term, s, m): cosines of every term but the leaves to the expression, seed by seed, and their mean.

    A term's seeds lie in one row, so the mean needs no shuffle. 'native' keeps the products in the JVM; 'arrow'
    multiplies whole blocks in NumPy, for long vectors.
    """
    both = matrix.join(queries, "book_id").where(~F.array_contains("leaves", F.col("term")))
    if strategy == "native":
        rows = both.select("expr", "book_id", "term", F.zip_with("vs", "qvs", vectors.dot).alias("s"))
    else:
        rows = both.select("expr", "book_id", "term", "vs", "qvs").mapInArrow(_multiply, "expr string, book_id string, term string, s array<double>")
    return rows.withColumn("m", F.aggregate("s", F.lit(0.0), lambda t, x: t + x) / F.size("s"))


def _multiply(batches: Iterator) -> Iterator:
    for batch in batches:
        a, b = (batch.column(i).flatten() for i in (3, 4))
        if len(a):
            n = len(a)
            s = np.einsum("ij,ij->i", *(np.asarray(x.flatten()).reshape(n, -1) for x in (a, b)))
            sizes = np.asarray(batch.column(3).value_lengths())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["expr", "book_id", "term", "s"])


def profiles(matrix: DataFrame, queries: Mapping[str, tuple[list[str], Mapping[str, np.ndarray]]]) -> DataFrame:
    """The columns of `similarities` for the expressions of one request: expr -> (its leaves, book_id -> vectors by seed).

    The vectors go to every task with the plan: a request holds at most 17 books and about a dozen expressions, whatever
    the size of the tables. Each batch multiplies all of a book's terms by all expressions at once.
    """
    by_book: dict[str, list[tuple[str, list[str], np.ndarray]]] = {}
    for expr, (leaves, held) in queries.items():
        for book, vs in held.items():
            by_book.setdefault(book, []).append((expr, leaves, vs))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books, terms = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            sizes = np.asarray(batch.column(2).value_lengths())
            starts = np.cumsum(sizes) - sizes
            vectors_ = batch.column(2).flatten()
            values = np.asarray(vectors_.flatten())
            for book in np.unique(books):
                own = by_book.get(book, [])
                rows = np.flatnonzero(books == book)
                if not own or not len(rows):
                    continue
                seeds, dims = own[0][2].shape
                # a book's terms have one number of seeds
                block = values.reshape(-1, dims)[starts[rows][:, None] + np.arange(seeds)]
                s = np.einsum("nsd,esd->ens", block, np.stack([vs for _, _, vs in own]), optimize=True)
                for (expr, leaves, _), part in zip(own, s):
                    keep = ~np.isin(terms[rows], leaves)
                    n = int(keep.sum())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * seeds, pa.int32()), pa.array(part[keep].ravel()))
                    columns = [pa.array([expr] * n, pa.string()), pa.array([book] * n, pa.string()), pa.array(terms[rows][keep], pa.string()), lists, pa.array(part[keep].mean(axis=1))]
                    yield pa.RecordBatch.from_arrays(columns, ["expr", "book_id", "term", "s", "m"])

    rows = matrix.where(F.col("book_id").isin(list(by_book))).select("book_id", "term", "vs")
    return rows.mapInArrow(multiply, "expr string, book_id string, term string, s array<double>, m double")


def ranked(means: DataFrame) -> DataFrame:
    """Adds rank (ties share it) and place (ties by term) within each expression and book."""
    order = F.col("m").desc()
    by = Window.partitionBy("expr", "book_id")
    return means.withColumn("rank", F.rank().over(by.orderBy(order))).withColumn("place", F.row_number().over(by.orderBy(order, "term")))


def centred(means: DataFrame, settings) -> DataFrame:  # noqa: ANN001
    """Adds position, m less the mean of the book's highest, and the two memberships at the top."""
    rows = ranked(means)
    best = F.avg(F.when(F.col("place") <= settings.centre, F.col("m"))).over(Window.partitionBy("expr", "book_id"))
    return rows.withColumn("position", F.col("m") - best).withColumn("in_stable", F.col("rank") <= settings.stable_rank).withColumn("in_unstable", F.col("rank") <= settings.unstable_rank)


def nearest(matrix: DataFrame, counts: DataFrame, book_id: str, term: str, k: int = 100) -> DataFrame:
    """(term, score, pos, vector_count): a book's k terms nearest to one of its terms by mean vector, not adverb-only."""
    from .books import not_adverb_only

    total = F.aggregate(F.slice("vs", 2, F.size("vs")), F.col("vs")[0], vectors.add)
    mean = matrix.where(F.col("book_id") == book_id).select("term", vectors.unit(F.transform(total, lambda x: x / F.size("vs"))).alias("v"))
    own = mean.where(F.col("term") == term).select("v").scalar()
    scored = mean.withColumn("q", own).where("q is not null").select("term", vectors.dot(F.col("v"), F.col("q")).alias("score"))
    rows = scored.join(counts.where(F.col("book_id") == book_id).where(not_adverb_only(F.col("tags"))), "term")
    return rows.select("term", "score", F.array_sort("tags").alias("pos"), F.col("count_").alias("vector_count")).orderBy(F.desc("score"), "term").limit(k)
