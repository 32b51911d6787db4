"""The drift query for many requests at once: a request is one group, scored in NumPy as `plans.engine.drift` scores it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import expressions as ex
from ..functions.vectors import FLOOR
from ..plans.errors import QueryInTooFewBooks
from ..plans.settings import T_95, T_BEYOND, Settings

SCHEMA = "expr string, book_id string, mean_local_similarity double, ci_lo double, ci_hi double, n_seeds int, n_books bigint, occurrences bigint"


class Book:
    """A book's terms in order, their counts and unit vectors (term, seed, dim), of the seeds that all terms have; none without seeds."""

    def __init__(self, terms: list[str], counts: list[int], blobs: list[list[bytes]]) -> None:
        self.count = dict(zip(terms, counts))
        self.seeds = min(map(len, blobs))
        order = sorted(range(len(terms)), key=terms.__getitem__) if self.seeds else []
        self.terms = np.array([terms[i] for i in order], dtype=object)
        self.at = {t: i for i, t in enumerate(self.terms)}
        if order:
            whole = [b"".join(blobs[i][: self.seeds]) for i in order]
            size = min(map(len, whole)) // 2 // self.seeds
            v = np.stack([np.frombuffer(b, "<f2", self.seeds * size) for b in whole]).astype(np.float64).reshape(len(order), self.seeds, size)
            self.vectors = v / np.maximum(np.sqrt((v * v).sum(axis=2, keepdims=True)), FLOOR)


def scored(rows: DataFrame, tree: ex.Tree, settings: Settings) -> DataFrame:
    """The scores (SCHEMA) of every request in `rows` (request, book_id, term, count_, vectors); vectors in half precision, a book's all in one request.

    A request holds at most settings.max_books books, so a task holds no more than these at once.
    """

    def one(table: pa.Table) -> pa.Table:
        by_book: dict[str, tuple[list, list, list]] = {}
        for b, *x in zip(*(table.column(c).to_pylist() for c in ("book_id", "term", "count_", "vectors"))):
            for to, y in zip(by_book.setdefault(b, ([], [], [])), x):
                to.append(y)
        found = list(_request({b: Book(*x) for b, x in sorted(by_book.items())}, tree, settings))
        names = [x.partition(" ")[0] for x in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}
        return pa.table([pa.array([r[i] for r in found], kinds[x.rpartition(" ")[2]]) for i, x in enumerate(SCHEMA.split(", "))], names)

    return rows.groupBy("request").applyInArrow(one, SCHEMA)


def _highest(m: np.ndarray) -> np.ndarray:
    """Order by descending value, NaN first as in Spark, ties by place."""
    return np.argsort(-np.where(np.isnan(m), np.inf, m), kind="stable")


def _request(books: dict[str, Book], tree: ex.Tree, settings: Settings) -> Iterator[tuple]:
    leaves, name = ex.leaves(tree), ex.serialise(tree)
    valid = [b for b, own in books.items() if all(t in own.at for t in leaves)]
    if len(valid) < settings.min_books:
        raise QueryInTooFewBooks(None)
    asked = {b: ex.evaluate(tree, {t: books[b].vectors[books[b].at[t]] for t in leaves}) for b in valid}
    every = sorted({t for own in books.values() for t in own.at})
    place = {t: i for i, t in enumerate(every)}
    where = {b: np.array([place[t] for t in own.terms], dtype=np.int64) for b, own in books.items()}
    terms = _comparative(books, valid, asked, leaves, where, every, settings)
    held = {name: (leaves, asked)} | {t: ([t], {b: own.vectors[own.at[t]] for b, own in books.items() if t in own.at}) for t in terms}
    for expr, (own_leaves, vectors) in held.items():
        n_of = [books[b].count for b in books]
        scores = _scores(books, own_leaves, vectors, where, place, len(every), settings)
        for b, count in zip(books, n_of):
            if b in scores:
                yield expr, b, *scores[b], sum(count.get(t, 0) for t in own_leaves)


def _comparative(books: dict[str, Book], valid: list[str], asked: dict, leaves: list[str], where: dict, every: list[str], settings: Settings) -> list[str]:
    """The most stable and the most unstable terms over the books that carry the expression."""
    position = np.zeros((len(valid), len(every)))
    has, stable, unstable = (np.zeros((len(valid), len(every)), dtype=bool) for _ in range(3))
    for i, b in enumerate(valid):
        use = ~np.isin(books[b].terms, leaves)
        m = np.einsum("nsd,sd->ns", books[b].vectors[use], asked[b]).mean(axis=1)
        at, order = where[b][use], _highest(m)
        key = np.where(np.isnan(m), np.inf, m)
        rank = 1 + len(m) - np.searchsorted(np.sort(key), key, side="right")
        has[i, at], stable[i, at], unstable[i, at] = True, rank <= settings.stable_rank, rank <= settings.unstable_rank
        position[i, at] = m - m[order[: settings.centre]].mean() if len(m) else 0.0
    n = has.sum(axis=0)
    mean = position.sum(axis=0) / np.maximum(n, 1)
    spread = (np.where(has, position - mean, 0.0) ** 2).sum(axis=0) / np.maximum(n - 1, 1)
    enough = n >= settings.min_books
    first = np.flatnonzero(enough & (stable.sum(axis=0) >= settings.min_books_ranked))
    pool = np.flatnonzero(enough & (unstable.sum(axis=0) >= settings.min_books_ranked) & (stable.sum(axis=0) >= settings.min_unstable_top50))
    first = first[_highest(mean[first])][: settings.comparative]
    pool = np.sort(pool[_highest(mean[pool])][: settings.pool])
    pool = pool[_highest(spread[pool])][: settings.comparative]
    return [every[i] for i in sorted({*first.tolist(), *pool.tolist()})]


def _scores(books: dict[str, Book], leaves: list[str], vectors: dict, where: dict, place: dict, n_terms: int, settings: Settings) -> dict[str, tuple]:
    """By book: mean, interval, seeds and comparable peers; the similarities of two books over the measuring book's anchors, seed by seed."""
    names = list(vectors)
    most = max((len(v) for v in vectors.values()), default=0)
    s = np.full((len(names), n_terms, most), np.nan)
    has = np.zeros((len(names), n_terms), dtype=bool)
    for i, b in enumerate(names):
        s[i, where[b], : len(vectors[b])] = np.einsum("nsd,sd->ns", books[b].vectors, vectors[b])
        has[i, where[b]] = True
    has[:, [place[t] for t in leaves if t in place]] = False
    seeds = np.array([len(v) for v in vectors.values()])
    out = {}
    for i, b in enumerate(names):
        own = np.flatnonzero(has[i])
        own = own[_highest(s[i, own, : seeds[i]].mean(axis=1))]
        shared = has[:, own]
        peers = np.flatnonzero((shared.sum(axis=1) >= settings.anchors) & (np.arange(len(names)) != i))
        if not len(peers):
            continue
        near = shared[peers] & (np.cumsum(shared[peers], axis=1) <= settings.anchors)
        near = own[np.nonzero(near)[1]].reshape(len(peers), settings.anchors)
        n = int(min(seeds[i], seeds[peers].min()))
        x, y = s[i, near, :n], s[peers[:, None], near, :n]
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        c = (x * y).sum(axis=1) / np.maximum(np.sqrt((x * x).mean(axis=1) * (y * y).mean(axis=1)) * settings.anchors, FLOOR)
        mean, k = float(c.mean()), c.size
        by_seed, by_peer = (float(np.broadcast_to(c.mean(axis=a, keepdims=True), c.shape).var()) for a in (0, 1))
        width = _half_width(len(peers), by_peer) if len(peers) > 1 else _half_width(n, by_seed)
        out[b] = mean, mean - width, mean + width, n, k // n
    return out


def _half_width(n: int, v: float) -> float:
    if n < 2:
        return 0.0
    t = T_95[n - 1] if n - 1 < len(T_95) else T_BEYOND
    return float(t * np.sqrt(v * n / (n - 1)) / np.sqrt(n))
