"""Seed models of a book: skip-gram with hierarchical softmax, one model per seed."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import kernel
from .publish import current_sentences

SIZE, WINDOW, MIN_COUNT, EPOCHS, SAMPLE = 200, 10, 10, 30, 5e-4
RATE, LEAST = 0.025, 1e-4
#: Words of a book from which on no single Python task is to hold it.
LONG = 20_000_000


def training_sentences(token_lemmas: DataFrame) -> DataFrame:
    """(book_id, sent_ix, words): trainable lemmas of every sentence that has any.

    Tags are left out from the start: of two loads that differ in tags only, either has the words.
    """
    rows = current_sentences(token_lemmas.withColumn("tags", F.lit(None).cast("array<string>"))).select("book_id", "sent_ix", text.trainable(F.col("lemmas")).alias("words"))
    return rows.where(F.size("words") > 0)


def most_words(token_lemmas: DataFrame) -> DataFrame:
    """(book_id, n): no fewer words than a book has to train; counted without a comparison of loads."""
    return token_lemmas.where("lemmas is not null").groupBy("book_id").agg(F.sum(F.size("lemmas")).alias("n"))


def subsampled(sentences: DataFrame, seed: int, sample: float = SAMPLE) -> DataFrame:
    """Frequent words thinned out at random, each occurrence kept with p = (sqrt(f / (s N)) + 1) s N / f.

    Drawn once for a model, where other implementations draw anew in every epoch.
    """
    words = sentences.select("book_id", "sent_ix", F.posexplode("words").alias("i", "w"))
    counts = words.groupBy("book_id", "w").agg(F.count("*").alias("f"))
    totals = words.groupBy("book_id").agg(F.count("*").alias("total"))
    rows = words.join(counts, ["book_id", "w"]).join(totals, "book_id")
    share = F.col("f") / (F.lit(sample) * F.col("total"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "book_id", "sent_ix", "i"), F.lit(1_000_003)) / 1_000_003.0
    kept = rows.where(draw < F.least(F.lit(1.0), (F.sqrt(share) + 1) / share))
    return kept.groupBy("book_id", "sent_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x.w).alias("words"))


def _codes(counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Huffman path and code of every word, the most frequent words having the shortest."""
    n = len(counts)
    if n == 1:
        return [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above, bit = {}, {}
    for inner in range(n, 2 * n - 1):
        (c0, a), (c1, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a] = above[b] = inner
        bit[a], bit[b] = 0.0, 1.0
        heapq.heappush(heap, (c0 + c1, inner))
    paths, codes = [], []
    for i in range(n):
        path, code, at = [], [], i
        while at in above:
            code.append(bit[at])
            at = above[at]
            path.append(at - n)
        paths.append(np.array(path[::-1], dtype=np.int64))
        codes.append(np.array(code[::-1]))
    return paths, codes


def _unit(key: int, i: np.ndarray) -> np.ndarray:
    """Random numbers from 0 to 1, the i-th of a key: the same in the JVM."""
    with np.errstate(over="ignore"):
        z = np.uint64(key) + i.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _key(seed: int) -> int:
    return int(np.random.SeedSequence(seed).generate_state(1, np.uint64)[0])


class Model:
    """A model before training: its terms and what the loop needs, from numbers of different `words`, all sentences in one array."""

    def __init__(self, words: list[str], codes: np.ndarray, lengths: np.ndarray, min_count: int, sample: float | None) -> None:
        n_of = np.bincount(codes, minlength=len(words))
        found = sorted((words[i], i) for i in np.flatnonzero(n_of >= max(1, min_count)))
        self.terms, of = [w for w, _ in found], np.array([i for _, i in found], dtype=np.int64)
        if not found:
            return
        at = np.full(len(words), -1, dtype=np.int32)
        at[of] = np.arange(len(of), dtype=np.int32)
        counts = n_of[of]
        self.paths, self.codes = _codes(counts)
        self.keep = np.ones(len(of), dtype=np.float32)
        if sample:
            share = counts / (sample * counts.sum())
            self.keep = np.minimum(1.0, (np.sqrt(share) + 1) / share).astype(np.float32)
        known = at[codes]
        has = known >= 0
        self.lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[has], minlength=len(lengths))
        self.lengths, self.words = self.lengths[self.lengths > 0], known[has]

    def packed(self, seed: int, size: int, epochs: int, window: int, rate: float, least: float) -> bytes:
        ends = np.cumsum([len(x) for x in self.paths])
        key = _key(seed)
        ints = [len(self.words), len(self.terms), int(ends[-1]), size, epochs, window, key & 0xFFFFFFFF, key >> 32]
        parts = [np.array(ints).astype("<u4"), np.array([rate, least], "<f4"), self.keep.astype("<f4"), np.array([len(self.lengths)], "<i4"), self.lengths, self.words, ends, np.concatenate(self.paths), np.concatenate(self.codes)]
        return b"".join((x if x.dtype.kind != "i" and x.dtype.itemsize == 4 else x.astype("<i4")).tobytes() for x in parts)


def skip_gram(sentences: list[list[str]], seed: int, size: int, min_count: int, epochs: int, window: int, sample: float | None, rate: float = RATE, least: float = LEAST) -> tuple[list[str], np.ndarray]:
    """Terms and vectors: skip-gram with hierarchical softmax, one pass after the other, the rate falling to `least`.

    Frequent words are thinned out anew in every epoch and the window shrinks at random, both by the seed alone. This is
    what the loop in `kernel` does, in NumPy and in double precision: a measure for it.
    """
    at: dict[str, int] = {}
    numbers = np.array([at.setdefault(w, len(at)) for words in sentences for w in words], dtype=np.int32)
    model = Model(list(at), numbers, np.array([len(words) for words in sentences], dtype=np.int64), min_count, sample)
    terms, key = model.terms, _key(seed)
    if not terms:
        return terms, np.zeros((0, size))
    vectors = (_unit(key, -1 - np.arange(len(terms) * size)).reshape(-1, size) - 0.5) / size
    inner = np.zeros((max(1, len(terms) - 1), size))
    n, ends = len(model.words), np.cumsum(model.lengths)
    for e in range(epochs):
        draws = e * n + np.arange(n)
        kept = _unit(key, 2 * draws) < model.keep[model.words]
        reaches = 1 + (_unit(key, 2 * draws + 1) * window).astype(np.int64)
        for begin, end in zip(ends - model.lengths, ends):
            alpha = max(least, rate * (1 - (e * n + begin) / (epochs * n)))
            own = kept[begin:end]
            words, reach = model.words[begin:end][own], reaches[begin:end][own]
            for i, w in enumerate(words):
                near = np.concatenate([words[max(0, i - reach[i]) : i], words[i + 1 : i + 1 + reach[i]]])
                path = model.paths[w]
                if len(near):
                    mine, nodes = vectors[near], inner[path]
                    pull = alpha * (1 - model.codes[w] - 1 / (1 + np.exp(-np.clip(mine @ nodes.T, -30, 30))))
                    inner[path] += pull.T @ mine
                    np.add.at(vectors, near, pull @ nodes)
    return terms, vectors


def train_books(sentences: DataFrame, seeds: list[int], size: int = SIZE, min_count: int = MIN_COUNT, epochs: int = EPOCHS, window: int = WINDOW, sample: float | None = SAMPLE) -> DataFrame:
    """(book_id, seed, term, v) of every book, from (book_id, sent_ix, words) and, if there is one, the column `place`.

    A book's models train one after the other in its task; a book that has a place has a task for each model, and these
    start first. Sentences come to Python as a stream in their order, so a seed gives one result, and a book is held as
    four bytes a word. There it becomes numbers; the loop itself runs in the JVM.
    """

    def models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, seed, words, codes, lengths in _streamed(batches):
            model = Model(words, codes, lengths, min_count, sample)
            for own in (seeds if seed is None else [seed]) if model.terms else []:
                packed = model.packed(own, size, epochs, window, RATE, LEAST)
                yield pa.RecordBatch.from_arrays([pa.array([book]), pa.array([own], pa.int32()), pa.array([model.terms], pa.list_(pa.string())), pa.array([packed], pa.binary())], ["book_id", "seed", "terms", "packed"])

    kernel.ready(sentences.sparkSession)
    tasks = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = sentences if "place" in sentences.columns else sentences.withColumn("place", F.lit(None).cast("int"))
    own = F.array(*(F.struct((F.col("place") * len(seeds) + i).alias("task"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)))
    all_in_one = F.array(F.struct((tasks * len(seeds) + F.pmod(F.hash("book_id"), F.lit(tasks))).alias("task"), F.lit(None).cast("int").alias("seed")))
    line = F.array_join("words", " ")  # trainable words are letters; a third of an array's bytes
    each = each.select("book_id", "sent_ix", line.alias("line"), F.explode(F.when(F.col("place").isNotNull(), own).otherwise(all_in_one)).alias("m"))
    each = each.select("book_id", F.col("m.seed").alias("seed"), "sent_ix", "line", F.col("m.task").cast("int").alias("task"))
    each = each.repartitionById(tasks * (len(seeds) + 1), F.col("task")).sortWithinPartitions("book_id", "seed", "sent_ix")
    packed = each.select("book_id", "seed", "line").mapInArrow(models, "book_id string, seed int, terms array<string>, packed binary")
    # outer, so that no filter is made of the vectors, for which they would be trained twice
    rows = packed.select("book_id", "seed", F.explode_outer(F.arrays_zip("terms", kernel.trained(F.col("packed")).alias("vs"))).alias("t"))
    return rows.select("book_id", "seed", F.col("t.terms").alias("term"), F.col("t.vs").alias("v"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, list[str], np.ndarray, np.ndarray]]:
    """(book, seed, different words, their numbers in order, lengths of sentences) of rows sorted by book and seed."""
    now, at, codes, lengths = None, {}, [], []

    def whole() -> tuple[str, int | None, list[str], np.ndarray, np.ndarray]:
        return *now, list(at), np.concatenate(codes), np.concatenate(lengths)

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = pc.split_pattern(batch.column(2), " ")
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        ends = np.cumsum(sizes)
        coded = lists.flatten().dictionary_encode()
        numbers, values = np.asarray(coded.indices), coded.dictionary.to_pylist()
        of_book = batch.column(0).dictionary_encode()
        books, book, seed = of_book.dictionary, np.asarray(of_book.indices), np.asarray(batch.column(1).fill_null(-(2**31)))
        starts = np.flatnonzero(np.concatenate([[True], (book[1:] != book[:-1]) | (seed[1:] != seed[:-1])]))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = books[int(book[a])].as_py(), batch.column(1)[int(a)].as_py()
            if key != now:
                if now is not None:
                    yield whole()
                now, at, codes, lengths = key, {}, [], []
            own, inverse = np.unique(numbers[ends[a] - sizes[a] : ends[b - 1]], return_inverse=True)
            codes.append(np.array([at.setdefault(values[i], len(at)) for i in own], dtype=np.int32)[inverse])
            lengths.append(sizes[a:b])
    if now is not None:
        yield whole()


def train_all(sentences: DataFrame, seeds: list[int], long: int = LONG, most: DataFrame | None = None, **parameters) -> DataFrame:  # noqa: ANN003
    """The same, where books of more than `long` words train by `train_book`, which gathers none; their ids come to the driver.

    So do those of books with more than a task's share of all words, fewer than there are tasks; they get a place.
    `most` (book_id, n): no fewer words than a book has, if that is known at less cost than counting `sentences`.
    """
    spark = sentences.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = sentences.groupBy("book_id").agg(F.sum(F.size("words")).alias("n"))
    bound = sizes if most is None else most
    large = bound.where((F.col("n") > long) | (F.col("n") * tasks > bound.agg(F.sum("n").alias("t")).scalar())).collect()
    ids = sorted(r.book_id for r in large if r.n > long)
    if ids and most is not None:
        ids = sorted(r.book_id for r in sizes.where(F.col("book_id").isin(ids) & (F.col("n") > long)).collect())
    places = [(r.book_id, k) for k, r in enumerate(sorted((r for r in large if r.book_id is not None and r.book_id not in ids), key=lambda r: (-r.n, r.book_id))[:tasks])]
    rest = sentences.where(~F.col("book_id").isin(ids))
    if places:
        rest = rest.join(F.broadcast(spark.createDataFrame(places, "book_id string, place int")), "book_id", "left")
    out = train_books(rest, seeds, **parameters)
    for book_id in ids:
        out = out.unionByName(train_book(sentences, book_id, seeds, **parameters))
    return out


def train_book(sentences: DataFrame, book_id: str, seeds: list[int], size: int = SIZE, min_count: int = MIN_COUNT, epochs: int = EPOCHS, window: int = WINDOW, sample: float | None = SAMPLE) -> DataFrame:
    """The same for one book by MLlib, whose matrices lie in the JVM: for books too long for `train_books`. A model is trained in one ordered partition, so a seed gives one result."""
    own = sentences.where(F.col("book_id") == book_id)
    out = None
    for seed in seeds:
        rows = subsampled(own, seed, sample) if sample else own
        model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=1, inputCol="words", outputCol="x").fit(rows.orderBy("sent_ix").coalesce(1).select("words"))
        found = model.getVectors()
        part = found.select(F.lit(book_id).alias("book_id"), F.lit(seed).alias("seed"), F.col("word").alias("term"), vector_to_array("vector").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out
