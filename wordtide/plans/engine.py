"""The drift query and the list queries behind one object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import books as books_of
from ..operators import describe, scores, similarity
from .errors import ExpressionAbsent, InvalidRequest, ParseError, QueryInTooFewBooks
from .settings import DEFAULT, Settings


def book_key(number: int) -> str:
    return f"gutenberg-{int(number)}"


@dataclass
class Drift:
    """A drift query's parts, each a lazy DataFrame; `comparative` was needed to plan the rest."""

    expr: str
    leaves: list[str]
    book_ids: list[int]
    comparative: list[dict]
    scores: DataFrame
    roster: DataFrame
    pinned: bool

    def response(self) -> dict:
        """The nested answer: books in the order asked for, comparative terms in order of term."""
        order = {book_key(b): i for i, b in enumerate(self.book_ids)}
        by_expr: dict[str, list[dict]] = {}
        for r in sorted(self.scores.collect(), key=lambda r: order[r.book_id]):
            row = {"book_id": int(r.book_id.rpartition("-")[2]), "mean_local_similarity": r.mean_local_similarity, "ci": (r.ci_lo, r.ci_hi), "occurrences": r.occurrences, "n_seeds": r.n_seeds}
            by_expr.setdefault(r.expr, []).append(row if self.pinned else row | {"n_books": r.n_books})
        roster = sorted(self.roster.collect(), key=lambda r: order[r.book_id])
        return {
            "expr": {"expr": self.expr, "terms": self.leaves, "books": by_expr.get(self.expr, [])},
            "comparative_terms": [c | {"books": by_expr.get(c["term"], [])} for c in self.comparative],
            "books": [{"id": int(r.book_id.rpartition("-")[2]), "n_shared_terms": r.n_shared_terms, "missing_terms": r.missing_terms} for r in roster],
        }


def check_request(tree: ex.Tree, book_ids: list[int], selected: int | None, settings: Settings) -> None:
    try:
        ex.check_depth(tree)
    except ValueError as e:
        raise InvalidRequest(str(e)) from e
    if not 1 <= len(book_ids) <= settings.max_books:
        raise InvalidRequest(f"from 1 to {settings.max_books} books may be asked for")
    repeated = sorted({b for b in book_ids if book_ids.count(b) > 1})
    if repeated:
        raise InvalidRequest(f"repeated books: {', '.join(map(str, repeated))}")
    if selected in book_ids:
        raise InvalidRequest(f"the selected book {selected} is among the books asked for")


def drift(matrix: DataFrame, counts: DataFrame, tree: ex.Tree, book_ids: list[int], selected: int | None = None, settings: Settings = DEFAULT) -> Drift:
    """Scores of `book_ids` for an expression and its comparative terms, against their peers or against `selected`.

    Brought to the driver on the way: the expression's leaves in the at most 17 books, the at most
    2 x settings.comparative comparative terms and their vectors in these books. All of it is bounded by the request.
    """
    check_request(tree, book_ids, selected, settings)
    spark = matrix.sparkSession
    asked, chosen = [book_key(b) for b in book_ids], None if selected is None else book_key(selected)
    every = asked + ([chosen] if chosen else [])
    matrix, counts = matrix.where(F.col("book_id").isin(every)), counts.where(F.col("book_id").isin(every))
    leaves, name = ex.leaves(tree), ex.serialise(tree)
    held: dict[str, dict[str, list]] = {}
    for r in matrix.where(F.col("term").isin(leaves)).collect():
        held.setdefault(r.book_id, {})[r.term] = r.vs
    if chosen and (lacking := set(leaves) - held.get(chosen, {}).keys()):
        raise ExpressionAbsent(selected, sorted(lacking))
    valid = [b for b in asked if held.get(b, {}).keys() >= set(leaves)]
    if len(valid) < settings.min_books:
        raise QueryInTooFewBooks(selected)
    query = {name: (leaves, {b: ex.evaluate(tree, {t: np.array(own[t]) for t in leaves}) for b, own in held.items() if own.keys() >= set(leaves)})}
    similar = similarity.profiles(matrix.where(F.col("book_id").isin(valid)), query)
    statistics = scores.term_statistics(similarity.centred(similar, settings))
    own = counts.where(F.col("book_id") == chosen).select("term") if chosen else None
    comparative = [r.asDict() for r in scores.comparative_terms(statistics, settings, own).collect()]
    comparative.sort(key=lambda r: r["term"])
    terms = [c["term"] for c in comparative]
    own_vectors: dict[str, dict[str, np.ndarray]] = {t: {} for t in terms}
    for r in matrix.where(F.col("term").isin(terms)).collect() if terms else ():
        own_vectors[r.term][r.book_id] = np.array(r.vs)
    similar = similarity.profiles(matrix, query | {t: ([t], own) for t, own in own_vectors.items()})
    local = scores.local_similarities(scores.anchors(similar, settings, chosen))
    rows = scores.scores(local, chosen is not None).where(F.col("book_id").isin(asked))
    pairs = [(name, t) for t in leaves] + [(t, t) for t in terms]
    counted = scores.occurrences(counts, F.broadcast(spark.createDataFrame(pairs, "expr string, term string")))
    rows = rows.join(F.broadcast(counted), ["expr", "book_id"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    books = spark.createDataFrame([(b,) for b in asked], "book_id string")
    shared = scores.shared_terms(counts).where(F.col("a").isin(asked) & F.col("b").isin([chosen] if chosen else valid))
    most = shared.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy(F.col("a").alias("book_id")).agg(F.max("n").alias("n"))
    roster = scores.missing_terms(counts, books, sorted({*leaves, *terms})).join(most, "book_id", "left").withColumn("n_shared_terms", F.coalesce("n", F.lit(0))).drop("n")
    return Drift(name, leaves, list(book_ids), comparative, rows, roster, chosen is not None)


class Engine:
    """Queries over published books. `generator` and `chooser` stand for a language model and are given by the caller."""

    def __init__(self, book_terms: DataFrame, pipeline: DataFrame, settings: Settings = DEFAULT) -> None:
        self.book_terms, self.pipeline, self.settings = book_terms, pipeline, settings
        self._vocabulary: list[str] | None = None

    def books(self) -> DataFrame:
        return books_of.books_list(self.pipeline)

    def terms(self) -> DataFrame:
        return books_of.terms_list(self.book_terms, self.pipeline)

    def vocabulary(self) -> DataFrame:
        return books_of.vocabulary(self.book_terms, self.pipeline)

    def semantic_drift(self, tree: ex.Tree | str, book_ids: list[int], source_book_id: int | None = None) -> dict:
        if isinstance(tree, str):
            parsed = ex.parse(tree)
            if parsed is None:
                raise ParseError(f"{tree!r} is no expression")
            tree = parsed
        matrix, counts = books_of.term_books(self.book_terms)
        return drift(matrix, counts, tree, book_ids, source_book_id, self.settings).response()

    def parse_describe(self, message: str, generator: Callable[[str], str], chooser: describe.Chooser | None = None) -> dict:
        """Natural language to an expression whose terms all exist."""
        tree = ex.parse(generator(message))
        if tree is None:
            raise ParseError("no expression was found")
        return describe.resolve_tree(tree, self.vocabulary(), chooser)
