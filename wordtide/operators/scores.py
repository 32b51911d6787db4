"""Comparative terms and scores of books: statistics over similarity profiles, never over vectors of two books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import FLOOR
from ..plans.settings import DEFAULT, T_95, T_BEYOND, Settings


def t_critical(df: Column) -> Column:
    table = F.array(*map(F.lit, T_95))
    return F.when(df > len(T_95) - 1, F.lit(T_BEYOND)).otherwise(F.element_at(table, F.greatest(F.least(df, F.lit(len(T_95) - 1)), F.lit(0)).cast("int") + 1))


def half_width(n: Column, sd: Column) -> Column:
    """Of the 95 % interval of a mean; 0 for fewer than two values."""
    return F.coalesce(F.when(n > 1, t_critical(n - 1) * sd / F.sqrt(n.cast("double"))), F.lit(0.0))


def term_statistics(positions: DataFrame) -> DataFrame:
    """(term, n_books_in, n_books_as_top50, n_books_as_top100, stability, instability) over books."""
    return positions.groupBy("term").agg(
        F.count("*").alias("n_books_in"),
        F.sum(F.col("in_stable").cast("int")).alias("n_books_as_top50"),
        F.sum(F.col("in_unstable").cast("int")).alias("n_books_as_top100"),
        F.avg("position").alias("stability"),
        F.coalesce(F.var_samp("position"), F.lit(0.0)).alias("instability"),
    )


def comparative_terms(statistics: DataFrame, settings: Settings = DEFAULT, vocabulary: DataFrame | None = None) -> DataFrame:
    """The statistics of the most stable and the most unstable terms.

    `vocabulary` (term): of the selected book, to which the terms are then confined. Each selection is a limit of a few
    rows over an order, which Spark takes per partition first.
    """
    rows = statistics.where(F.col("n_books_in") >= settings.min_books)
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("term").distinct(), "term", "left_semi")
    stable = rows.where(F.col("n_books_as_top50") >= settings.min_books_ranked).orderBy(F.desc("stability"), "term").limit(settings.comparative)
    pool = rows.where((F.col("n_books_as_top100") >= settings.min_books_ranked) & (F.col("n_books_as_top50") >= settings.min_unstable_top50))
    pool = pool.orderBy(F.desc("stability"), "term").limit(settings.pool)
    unstable = pool.orderBy(F.desc("instability"), "term").limit(settings.comparative)
    return stable.unionByName(unstable).distinct()


#: Books that a request compares at most: those asked for and the selected one. Pairs of books are formed only within it.
MOST_BOOKS = 17


def _of_a_request(books: Column) -> Column:
    return F.when(F.size(books) <= MOST_BOOKS, books).otherwise(F.raise_error(F.lit(f"pairs are formed between at most {MOST_BOOKS} books")))


def anchors(similar: DataFrame, settings: Settings = DEFAULT, selected: str | None = None) -> DataFrame:
    """(expr, a, b, term, place, x, y): the terms nearest to the expression in the measuring book a that the peer b has
    too, with the similarities of both, seed by seed.

    Pairs with fewer shared terms than anchors are left out. Ties go by term. A term's books meet in one row, at most
    MOST_BOOKS of them, so the table is read once and no join follows.
    """
    held = similar.groupBy("expr", "term").agg(_of_a_request(F.collect_list(F.struct("book_id", "m", "s"))).alias("books"))
    a = held.select("expr", "term", "books", F.explode("books").alias("p"))
    if selected is not None:
        a = a.where(F.col("p.book_id") != selected)
    pairs = a.select("expr", "term", "p", F.explode("books").alias("q")).where("p.book_id <> q.book_id")
    if selected is not None:
        pairs = pairs.where(F.col("q.book_id") == selected)
    pairs = pairs.select("expr", F.col("p.book_id").alias("a"), F.col("q.book_id").alias("b"), "term", F.col("p.m").alias("m_a"), F.col("p.s").alias("x"), F.col("q.s").alias("y"))
    by = Window.partitionBy("expr", "a", "b")
    pairs = pairs.withColumn("place", F.row_number().over(by.orderBy(F.desc("m_a"), "term")))
    # the last place of a pair is its number of shared terms
    pairs = pairs.where(F.col("place") <= settings.anchors).withColumn("shared", F.max("place").over(by))
    return pairs.where(F.col("shared") >= settings.anchors).select("expr", "a", "b", "term", "place", "x", "y")


def local_similarities(chosen: DataFrame) -> DataFrame:
    """(expr, a, b, seed_ix, c, n_seeds): correlation of the two books' similarities over the anchors, seed by seed;
    n_seeds: how many both have."""
    n = F.least(F.size("x"), F.size("y"))
    each = chosen.select("expr", "a", "b", n.alias("n_seeds"), F.posexplode(F.slice(F.arrays_zip("x", "y"), F.lit(1), n)).alias("seed_ix", "z"))
    x, y = F.col("z.x"), F.col("z.y")
    sums = each.groupBy("expr", "a", "b", "seed_ix").agg(F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.count("*").alias("n"), F.min("n_seeds").alias("n_seeds"))
    # clamped sums rather than corr, which fails on a constant column
    return sums.select("expr", "a", "b", "seed_ix", (F.col("xy") * F.col("n") / F.greatest(F.sqrt(F.col("xx") * F.col("yy")) * F.col("n"), F.lit(FLOOR))).alias("c"), "n_seeds")


def scores(local: DataFrame, pinned: bool) -> DataFrame:
    """(expr, book_id, mean_local_similarity, ci_lo, ci_hi, n_seeds, n_books).

    A book's seeds are cut to the fewest of it and its comparable peers. The interval is over peers, or over seeds if
    the query is pinned to one book or only one peer is left.
    """
    # one shuffle: the finer windows and the aggregate below keep the partitioning by expression and book
    own = Window.partitionBy("expr", "a")
    pairs = local.withColumn("n_seeds", F.min("n_seeds").over(own)).where("seed_ix < n_seeds")
    pairs = pairs.withColumn("by_seed", F.avg("c").over(Window.partitionBy("expr", "a", "seed_ix"))).withColumn("by_peer", F.avg("c").over(Window.partitionBy("expr", "a", "b")))
    # every peer has every seed, so each mean stands equally often and the variance over rows is that over means
    rows = pairs.groupBy("expr", "a").agg(F.avg("c").alias("mean"), F.count("*").alias("n"), F.max("n_seeds").alias("n_seeds"), F.var_pop("by_seed").alias("v_seed"), F.var_pop("by_peer").alias("v_peer"))
    rows = rows.withColumn("n_books", F.expr("n div n_seeds"))

    def width_of(n: Column, v: Column) -> Column:
        return half_width(n, F.sqrt(v * n / F.greatest(n - 1, F.lit(1))))

    width = width_of(F.col("n_seeds"), F.col("v_seed"))
    if not pinned:
        width = F.when(F.col("n_books") > 1, width_of(F.col("n_books"), F.col("v_peer"))).otherwise(width)
    return rows.select("expr", F.col("a").alias("book_id"), F.col("mean").alias("mean_local_similarity"), (F.col("mean") - width).alias("ci_lo"), (F.col("mean") + width).alias("ci_hi"), "n_seeds", "n_books")


def occurrences(counts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(expr, book_id, occurrences): of the distinct leaves of each expression; leaves (expr, term)."""
    return leaves.distinct().join(counts, "term").groupBy("expr", "book_id").agg(F.sum("count_").alias("occurrences"))


def shared_terms(counts: DataFrame) -> DataFrame:
    """(a, b, term): every term that two books share, in both directions; for the books of a request, at most MOST_BOOKS."""
    held = counts.groupBy("term").agg(_of_a_request(F.collect_set("book_id")).alias("books")).where(F.size("books") > 1)
    return held.select("term", "books", F.explode("books").alias("a")).select("a", F.explode("books").alias("b"), "term").where("a <> b")


def n_shared_terms(counts: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, n_shared_terms): the largest vocabulary shared with another book, 0 without one."""
    most = shared_terms(counts).groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max("n").alias("n"))
    return books.join(most.select(F.col("a").alias("book_id"), "n"), "book_id", "left").select("book_id", F.coalesce("n", F.lit(0)).alias("n_shared_terms"))


def missing_terms(counts: DataFrame, books: DataFrame, terms: list[str]) -> DataFrame:
    """(book_id, missing_terms): which of `terms` a book lacks, in order."""
    asked = books.select("book_id", F.explode(F.array(*map(F.lit, terms))).alias("term"))
    lacking = asked.join(counts.where(F.col("term").isin(terms)).select("book_id", "term"), ["book_id", "term"], "left_anti")
    found = lacking.groupBy("book_id").agg(F.array_sort(F.collect_set("term")).alias("missing_terms"))
    return books.select("book_id").join(found, "book_id", "left").select("book_id", F.coalesce("missing_terms", F.array().cast("array<string>")).alias("missing_terms"))


def carrying(counts: DataFrame, terms: list[str]) -> DataFrame:
    """(book_id): the books that have all of `terms`."""
    held = counts.where(F.col("term").isin(terms)).groupBy("book_id").agg(F.count_distinct("term").alias("n"))
    return held.where(F.col("n") == len(set(terms))).select("book_id")
