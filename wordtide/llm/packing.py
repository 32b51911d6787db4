"""Filling fixed-capacity containers with items: non-negative least squares over shallow combinations of lengths.

Lengths are put into classes and counted. Combinations of up to three classes that fill a container are enumerated,
and how often each is to be repeated is solved against the histogram by non-negative least squares (an active set, so
that few combinations are used), then rounded down. What is left of the histogram is packed greedily, class by class. All
of this works on the histogram, whose size depends on the capacity only. Items then find their container by their rank
within their class: a combination owns ranges of ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import FOLDER, NAME, tokens_of

CAPACITY, WIDTH = 2048, 8
#: Items that one task ranks, about.
RANKED = 500_000


def combinations(present: np.ndarray, units: int, most: int = 8) -> np.ndarray:
    """Rows (class, count, class, count, class, count), counts up to `most`, that fill `units` but for at most one unit."""
    out: list[np.ndarray] = []
    have = np.zeros(units + 1, dtype=bool)
    have[present] = True
    second, n = (x.ravel() for x in np.meshgrid(present, np.arange(0, most + 1), indexing="ij"))
    keep = (n > 0) | (second == present[0])
    second, n = second[keep], n[keep]
    for first in present:
        for m in range(1, min(most, units // int(first)) + 1):
            rest = units - m * int(first) - n * second
            fine = (rest >= 0) & ((n == 0) | (second < first))
            b, k, r = second[fine], n[fine], rest[fine]
            full = r <= 1
            third = np.where(full, 0, np.where(have[np.minimum(r, units)], r, np.where(have[np.maximum(r - 1, 0)], r - 1, 0)))
            good = full | (third > 0)
            one = np.full(int(good.sum()), first)
            out.append(np.stack([one, np.full_like(one, m), b[good], k[good], np.where(full, first, third)[good], np.where(full, 0, 1)[good]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 6), dtype=np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x of the combinations with the least squares of A x - histogram, by an active set."""
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    total = max(float(histogram.sum()), 1.0)
    h = histogram / total
    at, n = combos[:, 0::2], combos[:, 1::2].astype(np.float64)
    size = np.sqrt((n**2).sum(axis=1))

    def column(j: int) -> np.ndarray:
        c = np.zeros(len(h))
        np.add.at(c, at[j], n[j])
        return c

    active: list[int] = []
    columns = np.zeros((len(h), 0))
    values = np.zeros(0)
    left = h.copy()
    for _ in range(rounds):
        pull = (left[at] * n).sum(axis=1) / size
        if active:
            pull[active] = -np.inf
        j = int(np.argmax(pull))
        if pull[j] < 1e-7 or len(active) >= len(h):
            break
        active.append(j)
        columns = np.concatenate([columns, column(j)[:, None]], axis=1)
        values = np.append(values, 0.0)
        while True:
            gram = columns.T @ columns
            best = np.linalg.solve(gram + np.eye(len(gram)) * 1e-10, columns.T @ h)
            if (best > 1e-12).all():
                values = best
                break
            low = best <= 1e-12
            gap = values[low] - best[low]
            step = float(np.min(np.where(gap > 0, values[low] / np.maximum(gap, 1e-300), 0.0)))
            values = values + step * (best - values)
            keep = values > 1e-12
            if keep.all():
                keep[int(np.argmin(values))] = False
            active = [a for a, k in zip(active, keep) if k]
            columns, values = columns[:, keep], values[keep]
            if not active:
                break
        left = h - columns @ values if active else h.copy()
    for a, v in zip(active, values):
        x[a] = v * total
    return x


def plan(histogram: np.ndarray, units: int) -> list[tuple[dict[int, int], int]]:
    """Combinations {class: items} with repeats that place every item of the histogram (index: class, in units)."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def take(combo: dict[int, int], repeats: int) -> None:
        repeats = min(repeats, *(int(left[c]) // k for c, k in combo.items()))
        if repeats > 0:
            for c, k in combo.items():
                left[c] -= k * repeats
            out.append((combo, repeats))

    if left[units]:
        take({units: 1}, int(left[units]))
    present = np.flatnonzero(left)
    combos = combinations(present, units) if len(present) else np.zeros((0, 6), dtype=np.int64)
    x = solve(combos, left.astype(np.float64))
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        combo: dict[int, int] = {}
        for c, k in zip(combos[j, 0::2].tolist(), combos[j, 1::2].tolist()):
            if k:
                combo[c] = combo.get(c, 0) + k
        take(combo, int(x[j]))
    # the residue: the largest class first, then the largest that still fits, the pattern as often as it lasts
    while left.any():
        room, combo, c = units, {}, int(np.flatnonzero(left)[-1])
        while c:
            k = min(room // c, int(left[c]))
            if k:
                combo[c] = k
                room -= k * c
            fit = np.flatnonzero(left[1 : min(room, c - 1) + 1])
            c = int(fit[-1]) + 1 if len(fit) else 0
        take(combo, int(left.max()))
    return out


def sizes(documents: DataFrame, capacity: int = CAPACITY, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(doc_id, piece_no, first_token, tokens): each text as one item, or, over the capacity, as full pieces and a rest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = len(tokens_of(text.as_py(), folder, name))
                rows += [(doc_id, i, at, min(capacity, n - at)) for i, at in enumerate(range(0, n, capacity))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.int64)) for c in zip(*rows)], ["doc_id", "piece_no", "first_token", "tokens"])

    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id bigint, piece_no bigint, first_token bigint, tokens bigint")


def containers(documents: DataFrame, capacity: int = CAPACITY, width: int = WIDTH, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(container_id, doc_id, piece_no, first_token, tokens): where each item lies; no container holds more than `capacity`.

    Texts are whole but for those over the capacity, which come as full pieces and a rest. Null ids, null texts and texts
    without tokens are not placed; a repeated row is placed again; an empty table gives no row.
    """
    units = -(-capacity // width)
    items = cut(sizes(documents, capacity, folder, name)).withColumn("class", F.ceil(F.col("tokens") / width).cast("int"))
    counts = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most `units` rows
    histogram = np.zeros(units + 1, dtype=np.int64)
    for c, n in counts.items():
        histogram[c] = n
    ranges: dict[int, tuple[list[int], list[int], list[int]]] = {}
    base, used = 0, np.zeros(units + 1, dtype=np.int64)
    for combo, repeats in plan(histogram, units):
        for c, k in combo.items():
            for own, x in zip(ranges.setdefault(int(c), ([], [], [])), (int(used[c]), base, repeats)):
                own.append(x)
            used[c] += k * repeats
        base += repeats
    schema = "class int, lows array<bigint>, bases array<bigint>, repeats array<bigint>"
    # one row a class, a few ranges for each combination: bounded by the capacity, not by the data
    owners = F.broadcast(items.sparkSession.createDataFrame([(c, *own) for c, own in ranges.items()], schema))
    # ranks within a class without gathering it: ranked in parts, each part begins where those before it end
    parts = max(8, int(histogram.sum()) // RANKED + 1)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = items.groupBy("class", "part").agg(F.count("*").alias("n")).select("class", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = items.withColumn("place", F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "piece_no")) - 1)
    ranked = ranked.join(offsets, ["class", "part"]).withColumn("rank", F.col("offset") + F.col("place"))
    # a class's ranges follow each other, so an item's is the last that begins at or before its rank
    placed = ranked.join(owners, "class").withColumn("at", F.size(F.filter("lows", lambda low: low <= F.col("rank"))))
    container = F.element_at("bases", F.col("at")) + (F.col("rank") - F.element_at("lows", F.col("at"))) % F.element_at("repeats", F.col("at"))
    return placed.select(container.alias("container_id"), "doc_id", "piece_no", "first_token", "tokens")
