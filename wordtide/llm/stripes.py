"""Items that appear together: stripes.

Each task turns its records into stripes, an associative array of neighbours per item, adds them up in memory and sends
them as sorted, packed arrays; the task that owns an item merges its stripes. Items are 64-bit hashes until the end. A
pair is held once, under the smaller hash. The stripe of an item that holds a large share of all tokens is cut into
segments by its neighbours' hashes, in proportion to that share, so that it is merged by many tasks. Stripes travel in
blocks sorted by their first neighbour, so merging streams: what lies before the next block is done with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pairs that a task holds before it adds them up, and different pairs before it sends them on.
HELD, SENT = 4_000_000, 3_000_000
#: An item with more than this share of all tokens is cut into segments, one for each such share, up to 2 ** BITS.
SHARE, BITS = 1 / 512, 16
#: Neighbours in a block of a stripe, and pairs that a merging task gathers before it adds them up.
BLOCK, GATHERED = 65_536, 400_000


def _add(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by distinct code, a structured array of two hashes."""
    order = np.lexsort((codes[:, 1], codes[:, 0]))
    codes, counts = codes[order], counts[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


def _joined(lists: Column) -> Column:
    """One string a record, a third of the size of an array in a shuffle; a U+0000 within an item is left out."""
    joined = F.array_join(lists, "\0")
    clean = F.array_join(F.transform(lists, lambda x: F.replace(x, F.lit("\0"), F.lit(""))), "\0")
    return F.when(F.instr(F.array_join(lists, ""), "\0") > 0, clean).otherwise(joined)


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int]]:
    """The lists of each batch's records and how many. Rows come sorted by key, the latest of a key first."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        new[0] = last is None or tuple(keys[0]) != last
        last = tuple(keys[-1])
        yield pc.split_pattern(batch.column(2).filter(pa.array(new)), "\0"), int(new.sum())


def _pairs(row: np.ndarray, at_once: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within each record, each with itself too, in blocks; rows are sorted by record.

    A block has about `at_once` pairs, also where one record has very many items.
    """
    if not len(row):
        return
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1
    place = np.arange(len(row))
    reach = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - place  # to the end of its record
    before = np.cumsum(reach) - reach
    start = 0
    while start < len(row):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + at_once)))
        own = reach[start:stop]
        left = np.repeat(place[start:stop], own)
        yield left, left + np.arange(len(left)) - np.repeat(before[start:stop] - before[start], own)
        start = stop


def segments(token_lemmas: DataFrame) -> dict[int, int]:
    """Hash -> bits of the neighbours' hashes that cut the item's stripe, for items with more than SHARE of all tokens: at
    most 1 / SHARE of them, counted before the shuffle."""
    import xxhash

    items = token_lemmas.select(F.explode("lemmas").alias("item")).where("item <> ''").groupBy("item").agg(F.count("*").alias("n"))
    total = items.agg(F.sum("n")).scalar()
    rows = items.where(F.col("n") > total * F.lit(SHARE)).select("item", (F.col("n") / total).alias("share")).collect()
    out = {}
    for r in rows:
        code = xxhash.xxh64_intdigest(r.item.replace("\0", "").encode("utf-8", "surrogatepass"))
        out[code - (code >> 63 << 64)] = min(BITS, max(1, int(np.ceil(np.log2(r.share / SHARE)))))
    return out


def stripe_counts(token_lemmas: DataFrame) -> DataFrame:
    """(a, b, item, segment, n): the merged stripes. segment >= 0: n records hold the items of hash a and b, a below b;
    -1: n records hold `item`, of hash a; -2: there are n records.

    A record is one (s3_token_lemmas_key, sent_ix) with non-null lemmas, the latest loaded_at of it; an item counts
    once in it; null and empty items do not count. Rows whose key is null are left out. An empty table gives no row.
    """
    rows = token_lemmas.where("lemmas is not null and s3_token_lemmas_key is not null and sent_ix is not null")
    rows = rows.select(F.xxhash64("s3_token_lemmas_key").alias("k"), F.col("sent_ix").cast("bigint").alias("s"), F.col("loaded_at").alias("at"), _joined(F.col("lemmas")).alias("lemmas"))
    rows = rows.repartition("k", "s").sortWithinPartitions("k", "s", F.desc_nulls_last("at")).select("k", "s", "lemmas")
    hot = segments(token_lemmas)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids: dict[str, int] = {}
        items = np.zeros(0, dtype=np.int64)  # by number of the item in this task
        names: list[str] = []
        held: list[np.ndarray] = []
        size, sums, counts = 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        records = 0
        names_ = ["a", "segment", "first", "item", "neighbours", "counts"]

        def add_up() -> None:
            nonlocal held, size, sums, counts
            if held:
                codes, n = np.unique(np.concatenate(held), return_counts=True)
                if len(sums):
                    every, back = np.unique(np.concatenate([sums, codes]), return_inverse=True)
                    total = np.zeros(len(every), dtype=np.int64)
                    np.add.at(total, back, np.concatenate([counts, n]))
                    sums, counts = every, total
                else:
                    sums, counts = codes, n
            held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal sums, counts
            a, b = items[sums >> 32], items[sums & 0xFFFFFFFF]
            low, high = np.minimum(a, b), np.maximum(a, b)
            segment = np.where(low == high, -1, 0)
            for item, bits in hot.items():
                of = np.flatnonzero((low == item) & (high != item))
                segment[of] = (high[of] >> np.int64(64 - bits)) & ((1 << bits) - 1)
            order = np.lexsort((high, segment, low))
            low, high, segment, n = low[order], high[order], segment[order], counts[order]
            cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (segment[1:] != segment[:-1])])) if len(low) else np.zeros(0, dtype=np.int64)
            long = np.append(cut[1:], len(low)) - cut > BLOCK
            if long.any():
                cut = np.unique(np.concatenate([cut, *(np.arange(s, e, BLOCK) for s, e in zip(cut[long], np.append(cut[1:], len(low))[long]))]))
            ends = np.append(cut[1:], len(low))
            name = {int(i): x for i, x in zip(items, names)}
            for at in range(0, len(cut), 2000):
                block = [(int(low[s]), int(segment[s]), s, e) for s, e in zip(cut[at : at + 2000], ends[at : at + 2000])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in block], pa.int64()),
                        pa.array([x[1] for x in block], pa.int32()),
                        pa.array([int(high[x[2]]) for x in block], pa.int64()),
                        pa.array([name[x[0]] if x[1] == -1 else None for x in block], pa.string()),
                        pa.array([high[s:e].tobytes() for _, _, s, e in block], pa.binary()),
                        pa.array([n[s:e].astype("<u4").tobytes() for _, _, s, e in block], pa.binary()),
                    ],
                    names_,
                )
            sums, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        for lists, n in _sentences(batches):
            records += n
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            words = pc.list_flatten(lists).dictionary_encode()
            known = words.dictionary.to_pylist()
            local = np.zeros(len(known) + 1, dtype=np.int64)
            for i, w in enumerate(known):
                if w:
                    j = ids.get(w)
                    if j is None:
                        j = ids[w] = len(names)
                        names.append(w)
                    local[i] = j
                else:
                    local[i] = -1
            local[-1] = -1
            code = local[words.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)]
            keep = code >= 0
            both = np.unique((row[keep].astype(np.int64) << 32) | code[keep])
            row, code = both >> 32, both & 0xFFFFFFFF
            if len(items) < len(names):
                items = np.concatenate([items, np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names[len(items) :]], dtype=np.uint64).astype(np.int64)])
            for left, right in _pairs(row):
                held.append((code[left] << 32) | code[right])
                size += len(left)
                if size > HELD:
                    add_up()
                    if len(sums) > SENT:
                        yield from send()
        add_up()
        yield from send()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([-2], pa.int32()), pa.array([0], pa.int64()), pa.array([None], pa.string()), pa.array([np.array([0], dtype=np.int64).tobytes()], pa.binary()), pa.array([np.array([records], dtype="<u8").tobytes()], pa.binary())], names_)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, high, n, held = None, None, [], [], 0

        def out(before: int | None = None) -> Iterator[pa.RecordBatch]:
            """The sums of what is gathered, or only of the neighbours below `before`."""
            nonlocal high, n, held
            if now is None:
                return
            a, segment = now
            if segment == -2:
                b, total = np.zeros(1, dtype=np.int64), np.array([sum(int(np.frombuffer(x, "<u8")[0]) for x in n)])
            else:
                b, back = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in high]), return_inverse=True)
                total = np.zeros(len(b), dtype=np.int64)
                # sums held back have 8 bytes a count, as many as a neighbour's hash; what was sent has 4
                np.add.at(total, back, np.concatenate([np.frombuffer(x, "<i8" if len(x) == len(y) else "<u4").astype(np.int64) for x, y in zip(n, high)]))
                if before is not None:
                    at = int(np.searchsorted(b, before))
                    high, n, held = [b[at:].tobytes()], [total[at:].astype("<i8").tobytes()], len(b) - at
                    b, total = b[:at], total[:at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b), pa.array([name] * len(b), pa.string()), pa.array(np.full(len(b), segment, dtype=np.int32)), pa.array(total)], ["a", "b", "item", "segment", "n"])

        def whole() -> Iterator[pa.RecordBatch]:
            nonlocal now, name, high, n, held
            for batch in batches:
                for a, segment, first, item, neighbours, counts in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if (a, segment) != now:
                        yield from out()
                        now, name, high, n, held = (a, segment), None, [], [], 0
                    elif held > GATHERED:
                        yield from out(first)
                    name = name if name is not None else item
                    high.append(neighbours)
                    n.append(counts)
                    held += len(neighbours) // 8
            yield from out()

        # few large batches rather than one for each stripe
        wait, size = [], 0
        for x in whole():
            wait.append(x)
            size += x.num_rows
            if size > 50_000:
                yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
                wait, size = [], 0
        if wait:
            yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]

    sent = rows.mapInArrow(build, "a bigint, segment int, first bigint, item string, neighbours binary, counts binary")
    sent = sent.repartition("a", "segment").sortWithinPartitions("a", "segment", "first")
    return sent.mapInArrow(merge, "a bigint, b bigint, item string, segment int, n bigint")


def cooccurrences(token_lemmas: DataFrame, min_records: int = 10, min_llr: float = 10.83) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, lift, llr): pairs in at least `min_records` records, significant by the
    log-likelihood ratio of their 2 x 2 table (10.83 is the 0.001 point of chi-square with one degree of freedom).

    The stripes are written to the checkpoint folder once, then joined with the items' own counts.
    """
    counts = stripe_counts(token_lemmas)
    merged = cut(counts.where((F.col("segment") < 0) | (F.col("n") >= min_records)))
    items = merged.where("segment = -1").select(F.col("a").alias("id"), "item", "n")
    records = merged.where("segment = -2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    pairs = merged.where(F.col("segment") >= 0).where(F.col("n") >= min_records).select("a", "b", F.col("n").alias("n_ab"))
    pairs = pairs.join(items.select(F.col("id").alias("a"), F.col("item").alias("x"), F.col("n").alias("n_x")), "a")
    pairs = pairs.join(items.select(F.col("id").alias("b"), F.col("item").alias("y"), F.col("n").alias("n_y")), "b")
    first = F.col("x") < F.col("y")
    pairs = pairs.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"), "n_ab")
    n = F.lit(float(records))

    def xlogx(x: Column) -> Column:
        return F.when(x > 0, x * F.log(F.greatest(x, F.lit(1e-9)))).otherwise(0.0)

    k11, k12, k21 = F.col("n_ab").cast("double"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    k22 = n - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    cells = xlogx(k11) + xlogx(k12.cast("double")) + xlogx(k21.cast("double")) + xlogx(k22)
    margins = xlogx(F.col("n_a").cast("double")) + xlogx(n - F.col("n_a")) + xlogx(F.col("n_b").cast("double")) + xlogx(n - F.col("n_b"))
    pairs = pairs.withColumn("lift", F.col("n_ab") * n / (F.col("n_a").cast("double") * F.col("n_b")))
    pairs = pairs.withColumn("llr", F.greatest(2 * (cells - margins + xlogx(n)), F.lit(0.0)))
    return pairs.where(F.col("llr") >= min_llr)


def bound_items(token_lemmas: DataFrame, min_records: int = 10, min_lift: float = 6.0) -> DataFrame:
    """(lemma_a, lemma_b): of the operator's pairs, those `min_lift` times as often together as chance has it.

    Ten records at six times chance have a ratio above 19, so the significance test drops none of them.
    """
    pairs = cooccurrences(token_lemmas, min_records).where(F.col("lift") >= min_lift)
    return pairs.select(F.col("item_a").alias("lemma_a"), F.col("item_b").alias("lemma_b"))
