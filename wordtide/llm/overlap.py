"""Overlap sizes between many sets: bottom-k sketches.

A set's sketch is its k smallest hashes. Merging two sketches and keeping the k smallest gives the sketch of the
union: its k-th hash estimates the size of the union, the share of it present in both the Jaccard similarity, and their
product the intersection. Where two sets together have at most k members the figures are exact.

Candidate pairs come from the sketches too, so what is done for a set does not grow with it. Of two sets of which a share
t of the union is common, the union's first r hashes hold runs of common ones, and two that follow each other
there follow each other in both sketches. So each set offers the neighbours among its first r hashes as keys, and a pair
must meet in several of them: so many that a pair at t or above has fewer with a chance of 1e-13. Small sets offer
single hashes instead: the smallest n - ceil(t n) + 1 (n its size), of which two sets at t have one in common for certain.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, meet

#: Hashes in a sketch: its standard error at a similarity of 3/4 is 0.027.
K = 256
#: Hashes whose neighbours are keys, at least; sets of fewer members offer single hashes.
HEAD = 128
#: Chance that a pair at the share asked for meets in too few keys.
MISSED = 1e-13
#: A member of more than this share of all pairs (set, member) comes last among single hashes; at most 1 / share can.
HOT = 1 / 512


def memberships(corpus_terms: DataFrame) -> DataFrame:
    """(term, book, h): distinct members of the sets, with their hash."""
    pairs = corpus_terms.select("term", F.explode("book_ids").alias("book")).where("term is not null and book is not null").distinct()
    return pairs.withColumn("h", F.xxhash64("book"))


def meetings(share: float, head: int) -> int:
    """The neighbouring pairs of common hashes among a union's first `head` that a pair of sets at `share` has, but for
    a chance of MISSED."""
    n = np.zeros((2, head + 1))  # by whether the last hash is common, and by the meetings so far
    n[0, 0] = 1.0
    for _ in range(head):
        apart = (n[0] + n[1]) * (1 - share)
        common = n[0] * share
        common[1:] += n[1, :-1] * share
        n = np.stack([apart, common])
    return int(np.searchsorted(np.cumsum(n.sum(axis=0)), MISSED, "right"))


def keys_needed(share: float) -> tuple[int, int]:
    """(r, meetings): how many first hashes of a set offer neighbours, and how many of these keys must meet."""
    head = HEAD
    while not (n := meetings(share, head)):
        head *= 2
    return head, n


def sketches(members: DataFrame, k: int) -> DataFrame:
    """(term, sketch): the k smallest hashes in order. Each task keeps k of a set before the shuffle."""
    place = F.row_number().over(Window.partitionBy("term").orderBy("h"))
    return members.select("term", "h").withColumn("place", place).where(F.col("place") <= k).groupBy("term").agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def _heads(sets: DataFrame, late: list[int], share: float) -> DataFrame:
    """(term, n, level, key, single): the keys that a set offers."""
    head, _ = keys_needed(share)
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / share)).cast("int")
    sets = sets.select("term", "n", level.alias("level"), "sketch")
    small = sets.where(F.col("n") <= head / share + 1e-9)
    # members of very many sets come last, so that they seldom form pairs; any one order will do
    order = F.array_sort(F.transform("sketch", lambda h: F.struct(F.array_contains(F.array(*map(F.lit, late)).cast("array<bigint>"), h).alias("late"), h.alias("h"))))
    prefix = (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).cast("int")
    single = small.select("term", "n", "level", F.explode(F.slice(order, F.lit(1), prefix)).alias("x"))
    first = F.slice("sketch", 1, head)
    neighbours = F.zip_with(F.slice(first, F.lit(1), F.size(first) - 1), F.slice(first, F.lit(2), F.size(first) - 1), lambda x, y: F.xxhash64(x, y))
    double = sets.where(F.col("n") >= head).select("term", "n", "level", F.explode(neighbours).alias("key"), F.lit(0).alias("single"))
    return single.select("term", "n", "level", F.xxhash64("x.h").alias("key"), F.lit(1).alias("single")).unionByName(double)


def overlaps(corpus_terms: DataFrame, min_books: int = 6, min_share: float = 0.75, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, classes, members).

    pairs (a, b, n_a, n_b, union, share, shared, exact): estimates for every pair of different sets whose share may
    reach `min_share`; a and b stand for all terms with the same set. classes (term, of, n): each term, the one that
    stands for its set, and the set's size. members (term, book): all sets.
    Duplicate ids and rows count once; null ids, null arrays and null terms do not count; an empty table gives none.
    """
    # each cut keeps the plans short: the driver's memory grows with the plan, not with the data
    members = cut(memberships(corpus_terms))
    sign = [F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64(F.lit(7), F.col("book"))).alias("y")]
    signed = members.groupBy("term").agg(F.count("*").alias("n"), *sign).where(F.col("n") >= min_books)
    same = Window.partitionBy("n", "s", "x", "y")
    classes = cut(signed.select("term", F.min("term").over(same).alias("of"), "n"))
    head, least = keys_needed(min_share)
    # enough hashes for the estimates, for the keys and for the prefixes of all sets that offer single hashes
    held = max(k, head, math.ceil(head * (1 / min_share - 1)) + 2)
    sets = cut(classes.where("term = of").select("term", "n").join(sketches(members, held), "term"))

    wide = sets.where(F.col("n") <= head / min_share + 1e-9).select(F.explode("sketch").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    late = [r.h for r in wide.where(F.col("c") > F.greatest(wide.agg(F.sum("c") * HOT).scalar(), F.lit(1000))).select("h").collect()]
    heads = _heads(sets, late, min_share)
    near = heads.select(F.col("term").alias("b"), F.col("n").alias("n_b"), "key", "single", F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"))
    own = heads.select(F.col("term").alias("a"), F.col("n").alias("n_a"), "key", "single", "level")
    # a is the larger set, or as large and of the smaller key; so each pair comes once
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    met = meet(own, near, ["key", "single", "level"], "a").where(larger & (F.col("n_b") >= F.col("n_a") * min_share - 1e-9))
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.max("single").alias("single"), F.count("*").alias("keys"))
    pairs = met.where((F.col("single") == 1) | (F.col("keys") >= least)).select("a", "b", "n_a", "n_b")

    bottom = F.slice("sketch", 1, k)
    pairs = pairs.join(sets.select(F.col("term").alias("a"), bottom.alias("s_a")), "a")
    pairs = pairs.join(sets.select(F.col("term").alias("b"), bottom.alias("s_b")), "b")
    pairs = pairs.withColumn("u", F.array_union("s_a", "s_b")).withColumn("m", F.slice(F.array_sort("u"), 1, k))
    pairs = pairs.withColumn("both", F.size(F.array_intersect(F.array_intersect("m", "s_a"), "s_b"))).withColumn("seen", F.size("m"))
    pairs = pairs.withColumn("exact", (F.col("n_a") <= k) & (F.col("n_b") <= k) & (F.size("u") <= k))
    # the k-th hash as a share of the range of hashes
    reach = (F.element_at("m", -1).cast("double") / F.lit(2.0**64)) + 0.5
    union = F.when(F.col("exact"), F.col("seen").cast("double")).otherwise((F.col("seen") - 1) / F.greatest(reach, F.lit(1e-300)))
    pairs = pairs.withColumn("share", F.col("both") / F.col("seen")).withColumn("union", union)
    pairs = pairs.where(F.when(F.col("exact"), F.col("share") >= min_share - 1e-9).otherwise(F.col("share") >= min_share - slack(min_share, k)))
    pairs = cut(pairs.select("a", "b", "n_a", "n_b", "union", "share", (F.col("union") * F.col("share")).alias("shared"), "exact"))
    return pairs, classes, members.select("term", "book")


def slack(share: float, k: int) -> float:
    """Five standard errors of an estimated share: within them of the share asked for, the sets themselves decide."""
    return 5 * math.sqrt(share * (1 - share) / k)


def overlap_estimates(corpus_terms: DataFrame, min_books: int = 6, min_share: float = 0.75, k: int = K) -> DataFrame:
    """(term_a, term_b, n_a, n_b, shared, share): estimates per pair of different sets, the larger first; `shared_books` has all terms."""
    pairs, _, _ = overlaps(corpus_terms, min_books, min_share, k)
    return pairs.select(F.col("a").alias("term_a"), F.col("b").alias("term_b"), "n_a", "n_b", "shared", "share").where(F.col("share") >= min_share - 1e-9)


def _terms_of(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The terms x and y of the sets a and b, every one with every one."""
    out = meet(classes.select(F.col("of").alias("a"), F.col("term").alias("x")), pairs, ["a"], "x")
    return meet(classes.select(F.col("of").alias("b"), F.col("term").alias("y")), out, ["b"], "y")


def _of_one_set(classes: DataFrame) -> DataFrame:
    """(x, y, n): pairs of terms, in order, whose sets are equal."""
    many = classes.groupBy("of").agg(F.count("*").alias("c")).where("c > 1").select("of")
    copies = classes.join(many, "of", "left_semi")
    return meet(copies.select("of", "n", F.col("term").alias("x")), copies.select("of", F.col("term").alias("y")), ["of"], "x").where("x < y").select("x", "y", "n")


def shared_books(corpus_terms: DataFrame, min_books: int = 6, min_share: float = 0.75, k: int = K) -> DataFrame:
    """(term_a, term_b, n_a, n_b, shared, share): the same for every pair of terms, those of equal sets too, in order of term."""
    pairs, classes, _ = overlaps(corpus_terms, min_books, min_share, k)
    across = _terms_of(pairs.where(F.col("share") >= min_share - 1e-9), classes).select("x", "y", F.col("n_a").alias("n_x"), F.col("n_b").alias("n_y"), "shared", "share")
    within = _of_one_set(classes).select("x", "y", F.col("n").alias("n_x"), F.col("n").alias("n_y"), F.col("n").cast("double").alias("shared"), F.lit(1.0).alias("share"))
    first = F.col("x") < F.col("y")

    def ordered(a: str, b: str, name: str) -> Column:
        return F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)

    return across.unionByName(within).select(ordered("x", "y", "term_a"), ordered("y", "x", "term_b"), ordered("n_x", "n_y", "n_a"), ordered("n_y", "n_x", "n_b"), "shared", "share")


def overlapping_terms(corpus_terms: DataFrame, min_books: int = 6, min_share: float = 0.75, k: int = K) -> DataFrame:
    """(term_a, term_b): the sketches' pairs and all terms of equal sets. Only pairs whose estimate lies within its error
    of the share asked for are checked on the sets."""
    pairs, classes, members = overlaps(corpus_terms, min_books, min_share, k)
    clear = F.col("exact") | (F.col("share") > min_share + slack(min_share, k))
    near = pairs.where(~clear).select("a", "b", "n_a", "n_b")
    own = near.select(F.col("a").alias("term")).union(near.select("b")).distinct()
    members = members.join(own, "term", "left_semi")
    a = meet(members.select(F.col("term").alias("a"), "book"), near, ["a"], "book")
    shared = a.join(members.select(F.col("term").alias("b"), "book"), ["b", "book"]).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c"))
    sure = pairs.where(clear).select("a", "b").unionByName(shared.where(F.col("c") >= (F.col("n_a") + F.col("n_b") - F.col("c")) * min_share - 1e-9).select("a", "b"))
    every = _terms_of(sure, classes).select("x", "y").unionByName(_of_one_set(classes).select("x", "y"))
    return every.select(F.least("x", "y").alias("term_a"), F.greatest("x", "y").alias("term_b"))
