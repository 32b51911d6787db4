"""Generalised Procrustes: a book's seed models rotated into one frame. One book is one group; NumPy inside the group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITERATIONS, MIN_GRADIENT, EPS = 40, 1e-4, 1e-6


class NotAligned(RuntimeError):
    pass


def rotation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The orthogonal R that brings a R closest to b."""
    if a.ndim != 2 or a.shape != b.shape or not len(a):
        raise ValueError("two matrices of one shape with at least a row are needed")
    u, _, v = np.linalg.svd(a.T @ b)
    return u @ v


def disparity(a: np.ndarray, b: np.ndarray) -> float:
    """Squared error of a against b as a share of b's squared spread; infinite for a b without spread."""
    spread = float(((b - b.mean(axis=0)) ** 2).sum())
    return float(((b - a) ** 2).sum()) / spread if spread > EPS else float("inf")


def turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a R of the orthogonal R that brings it closest to b. Where there are fewer rows than dimensions, only the spaces that the rows span are turned."""
    if len(a) >= a.shape[1]:
        return a @ rotation(a, b)
    (_, ra), (qb, rb) = np.linalg.qr(a.T), np.linalg.qr(b.T)
    return ra.T @ rotation(ra.T, rb.T) @ qb.T


def align(models: np.ndarray, max_iterations: int = MAX_ITERATIONS, min_gradient: float = MIN_GRADIENT) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Models (seed, term, dim), NaN where a model lacks a term: the rotated models, centroid, mean disparity, iterations.

    The centroid is the mean at the start of the last iteration; the models have been rotated to it once more. All of it
    lies in the space that the models' rows span, so it is computed there.
    """
    seeds, terms, dims = models.shape
    missing = np.isnan(models).any(axis=2)
    if (terms - missing.sum(axis=1) == 1).any():  # a single row has no spread, so its disparity is infinite in every iteration
        raise NotAligned(f"models not aligned after {max_iterations} iterations")
    basis = np.linalg.qr(np.where(missing[:, :, None], 0.0, models).reshape(-1, dims).T)[0] if seeds * terms < dims else None
    models = models.copy() if basis is None else models @ basis
    mean_of = np.nanmean if missing.any() else np.mean
    before = np.inf
    for i in range(1, max_iterations + 1):
        centroid = mean_of(models, axis=0)
        each = []
        for k, own in enumerate(models):
            have = ~missing[k]
            models[k][have] = turned(own[have], centroid[have])
            each.append(disparity(models[k][have], centroid[have]))
        mean = float(np.mean(each))
        if before - mean <= min_gradient:
            return (models, centroid, mean, i) if basis is None else (models @ basis.T, centroid @ basis.T, mean, i)
        before = mean
    raise NotAligned(f"models not aligned after {max_iterations} iterations")


def _stack(rows: pd.DataFrame) -> tuple[list[str], list[int], np.ndarray]:
    terms, seeds = sorted(rows.term.unique()), sorted(rows.seed.unique())
    at, of = {t: i for i, t in enumerate(terms)}, {s: i for i, s in enumerate(seeds)}
    models = np.full((len(seeds), len(terms), len(rows.v.iloc[0])), np.nan)
    for t, s, v in zip(rows.term, rows.seed, rows.v):
        models[of[s], at[t]] = v
    return terms, seeds, models


def aligned_models(seed_vectors: DataFrame, **limits) -> DataFrame:  # noqa: ANN003
    """(book_id, seed, term, v, mean_disparity, iterations) from (book_id, seed, term, v)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        terms, seeds, models = _stack(rows)
        models, _, mean, n = align(models, **limits)
        out = [(rows.book_id.iloc[0], int(s), t, models[i, j].tolist(), mean, n) for i, s in enumerate(seeds) for j, t in enumerate(terms) if not np.isnan(models[i, j, 0])]
        return pd.DataFrame(out, columns=["book_id", "seed", "term", "v", "mean_disparity", "iterations"])

    return seed_vectors.groupBy("book_id").applyInPandas(one, "book_id string, seed int, term string, v array<double>, mean_disparity double, iterations int")


def term_statistics(seed_vectors: DataFrame, strict: bool = True, **limits) -> DataFrame:  # noqa: ANN003
    """(book_id, term, vector, variance, disparity, r_squared): the centroid and how well the seeds agree on each term.

    A book whose models do not align fails the query or, unless `strict`, gives its terms with nulls.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        terms, _, models = _stack(rows)
        try:
            models, centroid, _, _ = align(models, **limits)
        except NotAligned:
            if strict:
                raise
            return pd.DataFrame({"book_id": rows.book_id.iloc[0], "term": terms, "vector": None, "variance": np.nan, "disparity": np.nan, "r_squared": np.nan})
        residual = np.nanmean(((models - centroid) ** 2).sum(axis=2), axis=0)
        variance = ((centroid - centroid.mean(axis=0)) ** 2).sum(axis=1)
        r2 = 1 - residual / np.maximum(variance, EPS)
        return pd.DataFrame({"book_id": rows.book_id.iloc[0], "term": terms, "vector": list(centroid), "variance": variance, "disparity": residual, "r_squared": r2})

    return seed_vectors.groupBy("book_id").applyInPandas(one, "book_id string, term string, vector array<double>, variance double, disparity double, r_squared double")


def centroids(seed_vectors: DataFrame) -> DataFrame:
    """(book_id, term, d, x): mean over the seed models that have the term, dimension by dimension."""
    dims = seed_vectors.select("book_id", "term", F.posexplode("v").alias("d", "x"))
    return dims.groupBy("book_id", "term", "d").agg(F.avg("x").alias("x"))


def fit_by_count(statistics: DataFrame, counts: DataFrame) -> DataFrame:
    """(count_, terms, r_squared): how the fit depends on how often a term occurs."""
    return statistics.join(counts, ["book_id", "term"]).groupBy("count_").agg(F.count("*").alias("terms"), F.avg("r_squared").alias("r_squared"))
