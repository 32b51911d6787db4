"""How distinctive a term is per record: divergence from randomness.

Model G (geometric collection model), after-effect L (Laplace), normalisation 2 (length-normalised term frequency):

    lambda = F / N                                F occurrences of the term in N records
    tfn    = tf * log2(1 + c * mean length / length of the record)
    inf    = log2(1 + lambda) + tfn * log2((1 + lambda) / lambda)
    dfr    = inf / (tfn + 1)

The terms that stand out of a book are found by the information content. A term's count x ln(N / n), n its books, lies
between tf x ln(1 + N / F) - tf x F / N + tf x ln(F / n) and tf x ln(1 + N / F) + tf x ln(F / n), and the first part is the
information content in nats, without its constant, divided by tfn / tf. So a term whose upper bound is below another's
lower bound by the margin cannot matter, and only what is left is scored exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import spread_join
from .common import current_terms


def term_weights(book_terms: DataFrame, c: float = 1.0) -> DataFrame:
    """(book_id, term, tf, n_books, all_books, all_tf, n_terms, tfn, information, dfr): every current term of every book with its weight.

    Rows with null book_id, term or count_ do not count, negative counts count as 0, repeated rows count once, an
    empty table gives no row, and columns beyond those of `current_terms` are ignored whatever their names.
    A term of a book without any occurrence has information and dfr 0.
    """
    rows = current_terms(book_terms).select("book_id", "term", F.greatest("count_", F.lit(0)).alias("tf"))
    terms = rows.groupBy("term").agg(F.count("*").alias("n_books"), F.sum("tf").alias("all_tf"))
    books = rows.groupBy("book_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("length"))
    whole = books.agg(F.struct(F.count("*").alias("n"), F.sum("length").alias("t")).alias("w"))
    every = spread_join(spread_join(rows, books, "book_id", "n_terms", ["term"]), terms, "term", "n_books", ["book_id"])
    every = every.withColumn("_w", whole.scalar())
    rate = F.col("all_tf") / F.col("_w.n")
    mean = F.col("_w.t") / F.col("_w.n")
    tfn = F.col("tf") * F.log2(1 + c * mean / F.greatest("length", F.lit(1)))
    every = every.withColumn("_rate", rate).withColumn("_tfn", tfn)
    inf = F.log2(1 + F.col("_rate")) + F.col("_tfn") * F.log2((1 + F.col("_rate")) / F.col("_rate"))
    every = every.withColumn("information", F.when(F.col("tf") > 0, inf).otherwise(0.0))
    dfr = F.col("information") / (F.col("_tfn") + 1)
    return every.select("book_id", "term", "tf", "n_books", F.col("_w.n").alias("all_books"), "all_tf", "n_terms", F.col("_tfn").alias("tfn"), "information", dfr.alias("dfr"))


#: Parts in which a book's terms are compared before those left of the whole book are.
PARTS = 16


def candidates(weights: DataFrame, ratio: float) -> DataFrame:
    """The operator's terms that may lead a book or come within `ratio` of its leader, by the bounds that their
    information content sets to their count x ln(N / n).

    Terms are compared within parts of a book, so that no book is gathered: the best of a part is at most the best of
    the book, so no term that matters goes.
    """
    tf, rate = F.col("tf").cast("double"), F.col("all_tf") / F.col("all_books")
    own = (F.col("information") - F.log2(1 + rate)) * math.log(2) * tf / F.col("tfn")  # tf x ln(1 + N / F)
    high = F.when(F.col("tf") > 0, own + tf * F.log(F.col("all_tf") / F.col("n_books"))).otherwise(0.0)
    rows = weights.withColumn("_high", high).withColumn("_low", F.when(F.col("tf") > 0, F.col("_high") - tf * rate).otherwise(0.0))
    by = Window.partitionBy("book_id", F.pmod(F.xxhash64("term"), F.lit(PARTS)))
    # a rounding error is far below the margin left here
    return rows.withColumn("_best", F.max("_low").over(by)).where(F.col("_high") * (ratio * (1 + 1e-6)) + 1e-6 >= F.col("_best")).drop("_best", "_high", "_low")


def standout_terms(weights: DataFrame, ratio: float = 1.57) -> DataFrame:
    """(book_id, term): of the operator's candidates, the one that leads its book by `ratio`, by count x ln(N / n).

    Terms without information and books with one term give no case; nor does a shared first place.
    Two rows a book leave each task that ranks, so a large book is not gathered anywhere.
    """
    by = Window.partitionBy("book_id").orderBy(F.desc("score"), "term")
    score = F.when(F.col("dfr") > 0, F.col("tf") * F.log(F.col("all_books") / F.col("n_books"))).otherwise(0.0)
    best = candidates(weights, ratio).select("book_id", "term", "n_terms", score.alias("score")).withColumn("place", F.row_number().over(by)).where("place <= 2")
    two = best.groupBy("book_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("place") == 1, F.col("term"))).alias("term"), F.max("n_terms").alias("n_terms")
    )
    # a book of several terms of which all but the first were too low has a second, which is too low
    two = two.where("n_terms > 1").withColumn("second", F.coalesce("second", F.lit(0.0)))
    return two.where((F.col("first") > F.col("second")) & (F.col("first") >= ratio * F.col("second"))).select("book_id", "term")
