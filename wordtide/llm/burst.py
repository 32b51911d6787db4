"""Frequency of every distinct term: counting in burst tries.

Each task counts its rows in a burst trie: inner nodes branch on a character, containers hold the rest of a term and
its counters, and a container that grows too large bursts into an inner node. Finished tries are cut into subtrees at
routing prefixes and sent, front-coded, to the task that merges the subtrees of that prefix. The prefixes adapt to the
vocabulary: one that would hold too many terms is extended, as far as its terms go, so no subtree outgrows a task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import current_terms, cut

#: Entries of a container before it bursts; entries of a task's trie before it is sent on and begun anew.
CONTAINER, TRIE = 256, 400_000
#: A prefix with more than 1 / ROUTES of the different terms, or more than ENTRIES of them, is extended.
ROUTES, ENTRIES = 128, 50_000
#: Characters by which prefixes are extended at once when they are counted.
STEP = 4


class BurstTrie:
    """Adds (occurrences, records, rows) per term. Inner nodes and containers are dicts; inner nodes are of class Inner."""

    class Inner(dict):
        __slots__ = ()

    def __init__(self, container: int = CONTAINER) -> None:
        self.root: dict = {}
        self.container, self.entries = container, 0

    def add(self, term: str, occurrences: int, records: int, rows: int) -> None:
        node, at, above, key = self.root, 0, None, ""
        while type(node) is self.Inner:
            above, key = node, term[at : at + 1]
            node, at = above.setdefault(key, {}), at + 1
        rest = term[at:]
        found = node.get(rest)
        if found is None:
            node[rest] = [occurrences, records, rows]
            self.entries += 1
            if len(node) > self.container and (len(node) > 1):
                self._burst(node, above, key)
        else:
            found[0] += occurrences
            found[1] += records
            found[2] += rows

    def _burst(self, node: dict, above: dict | None, key: str) -> None:
        inner = self.Inner()
        for rest, counters in node.items():
            inner.setdefault(rest[:1], {})[rest[1:]] = counters
        if above is None:
            self.root = inner
        elif key:
            above[key] = inner

    def items(self) -> Iterator[tuple[str, list[int]]]:
        """In the order of code points."""
        stack: list[tuple[str, object]] = [("", self.root)]
        while stack:
            path, node = stack.pop()
            if type(node) is self.Inner:
                stack += [(path + k, node[k]) for k in sorted(node, reverse=True)]
            else:
                for rest in sorted(node):
                    yield path + rest, node[rest]


def pack(items: list[tuple[str, list[int]]]) -> bytes:
    """Front-coded: how much of the term before is kept, and the rest."""
    kept, rests, last = [], [], ""
    for term, _ in items:
        n = 0
        for a, b in zip(last, term):
            if a != b:
                break
            n += 1
        kept.append(n)
        rests.append(term[n:].encode("utf-8", "surrogatepass"))
        last = term
    counters = np.array([c for _, c in items], dtype="<i8").reshape(-1, 3)
    head = np.array([len(items)], dtype="<u4").tobytes()
    body = np.array(kept, dtype="<u4").tobytes() + np.array([len(r) for r in rests], dtype="<u4").tobytes() + counters.tobytes() + b"".join(rests)
    return zlib.compress(head + body, 1)


def unpack(blob: bytes) -> Iterator[tuple[str, list[int]]]:
    data = zlib.decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    kept = np.frombuffer(data, "<u4", n, 4).tolist()
    sizes = np.frombuffer(data, "<u4", n, 4 + 4 * n).tolist()
    counters = np.frombuffer(data, "<i8", 3 * n, 4 + 8 * n).reshape(-1, 3).tolist()
    at, last = 4 + 32 * n, ""
    for k, size, c in zip(kept, sizes, counters):
        last = last[:k] + data[at : at + size].decode("utf-8", "surrogatepass")
        at += size
        yield last, c


def route(term: str, heavy: frozenset[str]) -> str:
    """The longest heavy prefix of the term and one character more."""
    n = 0
    while n < len(term) and term[:n] in heavy:
        n += 1
    return term[:n]


def count_terms(rows: DataFrame, heavy: frozenset[str]) -> DataFrame:
    """(term, occurrences, records, rows): the sums of `rows` (term, occurrences, records, rows) per term."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()

        def flush() -> Iterator[pa.RecordBatch]:
            routes: dict[str, list] = {}
            for term, counters in trie.items():
                routes.setdefault(route(term, heavy), []).append((term, counters))
            if routes:
                yield pa.RecordBatch.from_arrays([pa.array(list(routes), pa.string()), pa.array([pack(x) for x in routes.values()], pa.binary())], ["route", "trie"])

        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum"), ("rows", "sum")])
            for x in zip(sums["term"].to_pylist(), sums["occurrences_sum"].to_pylist(), sums["records_sum"].to_pylist(), sums["rows_sum"].to_pylist()):
                trie.add(*x)
            if trie.entries > TRIE:
                yield from flush()
                trie = BurstTrie()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = BurstTrie(), None

        def out() -> Iterator[pa.RecordBatch]:
            items = list(trie.items())
            if items:
                sums = np.array([c for _, c in items], dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in items], pa.string()), *(pa.array(sums[:, k]) for k in range(3))], ["term", "occurrences", "records", "rows"])

        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != now:
                    yield from out()
                    trie, now = BurstTrie(), key
                for term, c in unpack(blob.as_py()):
                    trie.add(term, *c)
        yield from out()

    sent = rows.mapInArrow(build, "route string, trie binary").repartition(F.col("route")).sortWithinPartitions("route")
    return sent.mapInArrow(merge, "term string, occurrences bigint, records bigint, rows bigint")


def heavy_prefixes(terms: DataFrame, routes: int = ROUTES, entries: int = ENTRIES) -> frozenset[str]:
    """Prefixes with more than 1 / routes, or more than `entries`, of the different terms, the empty one included.

    Prefixes of any length are found, STEP characters at a time; where all terms of a heavy prefix go on alike, as URLs
    of one site do, the common part is passed over at once. There are as many as terms / limit times their length.
    """
    different = cut(terms.where("term is not null").select("term").distinct())
    limit = max(1, min(entries, different.count() / routes))
    heavy, edge = {""}, {""}
    while edge:
        by_length: dict[int, list[str]] = {}
        for p in edge:
            by_length.setdefault(len(p), []).append(p)
        # code points are counted alike here and in Spark
        known = F.coalesce(*(F.when(F.substring("term", 1, n).isin(own) if n else F.lit(True), F.lit(n)) for n, own in sorted(by_length.items(), reverse=True)), F.lit(None).cast("int"))
        rows = different.withColumn("n", known).where((F.col("n") >= 0) & (F.length("term") > F.col("n")))
        ends = F.sequence(F.col("n") + 1, F.least(F.length("term"), F.col("n") + STEP))
        parts = rows.select("term", "n", F.explode(F.transform(ends, lambda k: F.substring("term", F.lit(1), k))).alias("p"))
        found = parts.groupBy("p").agg(F.count("*").alias("c"), F.min("term").alias("low"), F.max("term").alias("high"), F.max("n").alias("n")).where(F.col("c") > limit).collect()
        edge = set()
        for r in found:
            heavy.add(r.p)
            if len(r.p) == r.n + STEP:
                far = len(os.path.commonprefix([r.low, r.high]))
                heavy |= {r.low[:k] for k in range(len(r.p), far + 1)}
                edge.add(r.low[: max(far, len(r.p))])
    return frozenset(heavy)


def term_frequencies(book_terms: DataFrame, corpus_terms: DataFrame, min_books: int = 3, min_occurrences: int = 60, max_share: float = 0.5) -> DataFrame:
    """(term, occurrences, books, mark) for every term of `corpus_terms`.

    books: distinct non-null ids over all rows of the term; 0 for null or empty arrays. occurrences: sum of count_ over
    the current rows of `book_terms`, 0 without any. mark: 'common' over max_share of the books with a current row,
    otherwise 'rare' under min_books or min_occurrences, otherwise null. Null terms are left out, the empty string is a
    term, repeated rows change nothing, empty tables give no row, further columns are ignored.
    """
    corpus = corpus_terms.where("term is not null").select("term", "book_ids")
    ids = corpus.select("term", F.explode("book_ids").alias("b")).where("b is not null").distinct()
    current = current_terms(book_terms)
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    rows = ids.select("term", zero.alias("occurrences"), one.alias("records"), one.alias("rows"))
    rows = rows.unionByName(corpus.select("term", zero.alias("occurrences"), zero.alias("records"), one.alias("rows")))
    rows = rows.unionByName(current.select("term", F.col("count_").alias("occurrences"), zero.alias("records"), zero.alias("rows")))
    counted = count_terms(rows, heavy_prefixes(corpus.select("term").unionByName(book_terms.select("term")))).where("rows > 0")
    books = current.agg(F.count_distinct("book_id").alias("n")).scalar()
    mark = F.when(F.col("records") > books * F.lit(max_share), "common").when((F.col("records") < min_books) | (F.col("occurrences") < min_occurrences), "rare")
    return counted.select("term", "occurrences", F.col("records").alias("books"), mark.alias("mark"))
