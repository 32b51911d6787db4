"""Resolving the terms of an expression against the vocabulary: exact, then alike, then by a given chooser."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..plans.errors import TermResolutionError

Chooser = Callable[[str, list[str]], str]
CLOSE, FAR, FAR_N, SHOWN = 0.6, 0.3, 20, 5


def alike(vocabulary: DataFrame, term: str, n: int, cutoff: float) -> list[str]:
    """The n entries most like `term` by the ratio of matching blocks, best first, of equal ratios the greater term first.

    The ratio is computed where the vocabulary lies; each task sends its n best only.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, found = difflib.SequenceMatcher(), []
        matcher.set_seq2(term)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                matcher.set_seq1(x)
                if matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff and (ratio := matcher.ratio()) >= cutoff:
                    found.append((ratio, x))
            found = sorted(found, reverse=True)[:n]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.float64()), pa.array([x for _, x in found], pa.string())], ["ratio", "term"])

    rows = vocabulary.select("term").where("term is not null").mapInArrow(best, "ratio double, term string")
    return [r.term for r in rows.orderBy(F.desc("ratio"), F.desc("term")).limit(n).collect()]


def candidates(vocabulary: DataFrame, term: str) -> list[str]:
    """What to offer for an unknown term: like it, or at least of the same first letter."""
    near = alike(vocabulary, term, FAR_N, FAR)
    if near:
        return near
    same = vocabulary.where(F.col("term").startswith(term[:1])).select("term").distinct().orderBy("term").limit(SHOWN)
    return [r.term for r in same.collect()]


def resolve(term: str, vocabulary: DataFrame, chooser: Chooser | None = None) -> str:
    if vocabulary.where(F.col("term") == term).limit(1).count():
        return term
    close = alike(vocabulary, term, 1, CLOSE)
    if close:
        return close[0]
    offered = candidates(vocabulary, term)
    if chooser and offered:
        answer = chooser(term, offered).strip().lower()
        if vocabulary.where(F.col("term") == answer).limit(1).count():
            return answer
    raise TermResolutionError(term, offered[:SHOWN])


def resolve_tree(tree: ex.Tree, vocabulary: DataFrame, chooser: Chooser | None = None) -> dict:
    """The expression with every leaf resolved, its terms, and the substitutions made."""
    known = {t: resolve(t, vocabulary, chooser) for t in ex.leaves(tree)}
    out = ex.rewrite(tree, known.__getitem__)
    changed = [{"original": a, "resolved": b} for a, b in known.items() if a != b]
    return {"expression": ex.serialise(out), "terms": ex.leaves(out), "substitutions": changed, "tree": out}
