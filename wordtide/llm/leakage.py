"""Evaluation texts leaking into training text: SimHash windows under a multi-index of Hamming blocks.

Items and documents are cut into windows of 13 words, one at every word, and each window gets a 64-bit SimHash of its
words. Two fingerprints within 3 bits of each other agree on at least two of five blocks of bits, so the items'
fingerprints are indexed under all ten pairs of blocks and no window within that radius is missed. Windows found so are
verified by the weighted similarity of their five-word shingles; equal windows are counted apart.

Items are a query set. Their index is made in parts of bounded size, each a file that Spark's file server hands to the
executors and that their Python workers map into memory together; documents are read and fingerprinted once, whatever
the number of parts.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import shared_folder
from .norm import LOOKALIKES, transducer

WINDOW, RADIUS, SHINGLE, SIMILARITY = 13, 3, 5, 0.8
#: Bits of the five blocks.
BLOCKS = (13, 13, 13, 13, 12)
#: Item words that one part of the index holds, about.
INDEXED = 200_000
#: Words that are fingerprinted at once, and different words that a task remembers.
AT_ONCE, WORDS = 40_000, 400_000

_ASCII = bytes((c if chr(c).isalnum() else 32) for c in range(128)).lower() + bytes([32] * 128)
_WORD = re.compile(r"(?:[^\W_][\u0300-\u036f]*)+")
_OTHER = re.compile("[Ͱ-ԯἀ-῿]")
#: Small letters whose capitals look like a letter that they do not look like themselves: they go with their capitals.
_SMALL = {c.casefold(): x.casefold() for c, x in LOOKALIKES.items() if len(c) == len(c.casefold()) == 1 and c.casefold() not in LOOKALIKES and c != c.casefold() and len(x) == 1}
_SMALLS = str.maketrans(_SMALL)
#: Capitals that look like another letter than their small ones do; within a word without Latin letters they are those.
_APART = {c: c.casefold() for c, x in LOOKALIKES.items() if c != c.casefold() and LOOKALIKES.get(c.casefold(), x).casefold() != x.casefold()}
_APARTS, _ANY_APART, _LATIN = str.maketrans(_APART), re.compile("[" + "".join(_APART) + "]"), re.compile("[A-Za-z]")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in one form and case."""
    if not text.isascii() and _ANY_APART.search(text):
        text = _WORD.sub(lambda m: m[0] if _LATIN.search(m[0]) else m[0].translate(_APARTS), text)
    text = transducer(True).rewrite(text)
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    text = text.casefold()
    if _OTHER.search(text):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SMALLS))
    return _WORD.findall(text)


class Lexicon(dict):
    """word -> number; codes[number] is the word's hash, vectors[number] has +1 or -1 for each of its bits."""

    def __init__(self) -> None:
        super().__init__()
        self.vectors = np.zeros((1024, 64), dtype=np.int8)
        self.codes = np.zeros(1024, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        import xxhash

        n = len(self)
        if n == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        digest = xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"))
        self.codes[n] = int.from_bytes(digest, "big")
        self.vectors[n] = np.unpackbits(np.frombuffer(digest, dtype=np.uint8)).astype(np.int8) * 2 - 1
        self[word] = n
        return n


def fingerprints(numbers: np.ndarray, vectors: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The SimHash of the window that begins at each word, for all but the last window - 1."""
    if len(numbers) < window:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros((len(numbers) + 1, 64), dtype=np.int16)
    # wraps around for long texts; differences of nearby sums stay right
    np.cumsum(vectors[numbers], axis=0, dtype=np.int16, out=sums[1:])
    return np.packbits((sums[window:] - sums[:-window]) > 0, axis=1).view(">u8").ravel().astype(np.uint64)


class Index:
    """Fingerprints of the items' windows under every pair of blocks. A table of folded keys turns most windows away."""

    FOLD = 20

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.tables, self.maps = [], []
        parts = self._parts(prints)
        for i, j in combinations(range(len(BLOCKS)), 2):
            key = (parts[i] << BLOCKS[j]) | parts[j]  # 26 bits at most
            order = np.argsort(key, kind="stable").astype(np.int32)
            seen = np.zeros(1 << self.FOLD, dtype=bool)
            seen[parts[i] ^ (parts[j] << (self.FOLD - 13))] = True
            self.tables.append((key[order], order))
            self.maps.append(seen)

    def arrays(self) -> list[np.ndarray]:
        return [self.prints, *(x for pair in self.tables for x in pair), *self.maps]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Index:
        out = cls.__new__(cls)
        n = len(BLOCKS) * (len(BLOCKS) - 1) // 2
        out.prints, out.maps = arrays[0], arrays[1 + 2 * n :]
        out.tables = list(zip(arrays[1 : 1 + 2 * n : 2], arrays[2 : 2 + 2 * n : 2]))
        return out

    @staticmethod
    def _parts(prints: np.ndarray) -> list[np.ndarray]:
        at, parts = 0, []
        for bits in BLOCKS:
            parts.append(((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int32))
            at += bits
        return parts

    def near(self, prints: np.ndarray) -> np.ndarray:
        """Rows (position in prints, position in the index) with at most RADIUS bits between."""
        found = []
        parts = self._parts(prints)
        raised = [x << (self.FOLD - 13) for x in parts]
        for (i, j), seen, (keys, order) in zip(combinations(range(len(BLOCKS)), 2), self.maps, self.tables):
            maybe = np.flatnonzero(seen.take(parts[i] ^ raised[j]))
            if len(maybe):
                key = (parts[i][maybe] << BLOCKS[j]) | parts[j][maybe]
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = high - low
                if n.any():
                    left = np.repeat(maybe, n)
                    right = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    close = np.bitwise_count(prints[left] ^ self.prints[right]) <= RADIUS
                    found.append((left[close] << 32) | right[close])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return np.stack([both >> 32, both & 0xFFFFFFFF], axis=1)


def shingles(numbers: np.ndarray) -> np.ndarray:
    """A hash of the five words from each word on."""
    out = np.zeros(max(0, len(numbers) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[k : k + len(out)].astype(np.uint64) + np.uint64(1)
    return out


def _counted(rows: np.ndarray) -> np.ndarray:
    """Each value of a row with how many times it stood before in the row, so that rows of values become sets."""
    same = rows[:, :, None] == rows[:, None, :]
    before = np.tril(np.ones(same.shape[1:], dtype=bool), -1)
    return rows + (same & before).sum(axis=2).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted similarity of rows of shingles: shared weight over joint weight, a shingle weighing as often as it stands."""
    if not len(a):
        return np.zeros(0)
    x, y = _counted(a), _counted(b)
    shared = (x[:, :, None] == y[:, None, :]).any(axis=2).sum(axis=1)
    return shared / (2 * a.shape[1] - shared)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with windows, block by block: a partition of the query set is on the driver at a time."""
    block, size = [], 0
    for item_id, text in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        words = words_of(text)
        if len(words) >= WINDOW:
            block.append((item_id, words))
            size += len(words)
            if size > INDEXED:
                yield block
                block, size = [], 0
    if block:
        yield block


def _packed(block: list[tuple[int, list[str]]], lexicon: Lexicon) -> list[np.ndarray]:
    """Item ids, their words' hashes, each window's item and where it begins among the words, and the index of the windows."""
    item_ids = np.array([i for i, _ in block], dtype=np.int64)
    sizes = [len(words) for _, words in block]
    owner = np.repeat(np.arange(len(block)), [n - WINDOW + 1 for n in sizes])
    begin = np.concatenate([np.arange(n - WINDOW + 1) + at for n, at in zip(sizes, np.cumsum(sizes) - sizes)])
    numbers = np.array([lexicon[w] for _, words in block for w in words], dtype=np.int64)
    index = Index(fingerprints(numbers, lexicon.vectors)[begin])
    return [item_ids, lexicon.codes[numbers], owner, begin, *index.arrays()]


def _write(arrays: list[np.ndarray], folder: Path) -> str:
    """One file with all arrays, named by its content; where they lie in it comes first."""
    head, at = [], 0
    for x in arrays:
        head.append((x.dtype.str, len(x), at))
        at += -(-x.nbytes // 8) * 8
    first = pickle.dumps(head)
    start = -(-(8 + len(first)) // 8) * 8
    data = bytearray(start + at)
    data[:8] = len(first).to_bytes(8, "little")
    data[8 : 8 + len(first)] = first
    for x, (_, _, where) in zip(arrays, head):
        data[start + where : start + where + x.nbytes] = np.ascontiguousarray(x).tobytes()
    path = folder / f"items-{hashlib.blake2b(data, digest_size=12).hexdigest()}.index"
    path.write_bytes(data)
    return str(path)


def _read(path: str) -> list[np.ndarray]:
    """The arrays, mapped: the workers of an executor share the pages."""
    with open(path, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        head = pickle.loads(f.read(size))
    start = -(-(8 + size) // 8) * 8
    whole = np.memmap(path, dtype=np.uint8, mode="r")
    return [whole[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for kind, n, at in head]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, equal, similarity): documents with windows like an item's.

    windows: how many pairs of windows pass the verification; equal: how many of them agree word for word; similarity:
    the highest. Null texts and ids and texts of fewer than 13 words give no row; a repeated doc_id counts as one
    document; no items, no rows. Documents are read once, however many parts the items' index has.
    """
    schema = "doc_id bigint, item_id bigint, windows bigint, equal bigint, similarity double"
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    context, names = rows.sparkSession.sparkContext, []
    folder, lexicon = shared_folder(rows.sparkSession), Lexicon()
    for block in _item_blocks(items):
        path = Path(_write(_packed(block, lexicon), folder))
        # a file is named by its content, and Spark takes a name once
        sent = context.__dict__.setdefault("_wordtide_indexes", set())
        if path.name in sent:
            path.unlink()
        else:
            context.addFile(str(path))
            sent.add(path.name)
        names.append(path.name)
        if len(lexicon) > WORDS:
            lexicon = Lexicon()
    if not names:
        return rows.sparkSession.createDataFrame([], schema)
    sums = [F.sum("windows").alias("windows"), F.sum("equal").alias("equal"), F.max("similarity").alias("similarity")]
    return rows.mapInArrow(_search(names), schema).groupBy("doc_id", "item_id").agg(*sums)


def _search(names: list[str]):  # noqa: ANN202
    inside, parts = np.arange(WINDOW), np.arange(WINDOW - SHINGLE + 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        lexicon, blocks = Lexicon(), []
        for name in names:
            item_ids, codes, owner, begin, *index = _read(SparkFiles.get(name))
            blocks.append((item_ids, codes, owner, begin, Index.of(index)))

        def look(ids: list[int], texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
            numbers = np.array([lexicon[w] for words in texts for w in words], dtype=np.int64)
            codes = lexicon.codes[numbers]
            lengths = np.array([len(words) for words in texts])
            starts = np.cumsum(lengths) - lengths
            prints = fingerprints(numbers, lexicon.vectors)
            for item_ids, item_codes, owner, begin, index in blocks:
                found = index.near(prints)
                doc = np.searchsorted(starts, found[:, 0], "right") - 1
                within = found[:, 0] + WINDOW <= (starts + lengths)[doc]
                found, own = found[within], doc[within]
                if not len(found):
                    continue
                a, b = found[:, 0, None], begin[found[:, 1]][:, None]
                like = (codes[a + inside] == item_codes[b + inside]).all(axis=1).astype(np.float64)
                rest = like == 0
                if rest.any():
                    like[rest] = similarities(_windows(codes, a[rest], parts), _windows(item_codes, b[rest], parts))
                good = like >= SIMILARITY
                pair = (own[good] << 32) | owner[found[good, 1]]
                pairs, back = np.unique(pair, return_inverse=True)
                best = np.zeros(len(pairs))
                np.maximum.at(best, back, like[good])
                if len(pairs):
                    columns = [np.array(ids, dtype=np.int64)[pairs >> 32], item_ids[pairs & 0xFFFFFFFF], np.bincount(back), np.bincount(back, like[good] == 1.0).astype(np.int64), best]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "item_id", "windows", "equal", "similarity"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                # a very long text in parts that share all but one word of a window
                for at in range(0, max(1, len(words) - WINDOW + 1), AT_ONCE):
                    part = words[at : at + AT_ONCE + WINDOW - 1]
                    if len(part) < WINDOW:
                        continue
                    ids.append(doc_id)
                    texts.append(part)
                    size += len(part)
                    if size > AT_ONCE:
                        yield from look(ids, texts)
                        ids, texts, size = [], [], 0
            if ids:
                yield from look(ids, texts)
            if len(lexicon) > WORDS:
                lexicon = Lexicon()

    return search


def _windows(codes: np.ndarray, at: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of the windows that begin at `at`."""
    out = np.zeros((len(at), len(parts)), dtype=np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[at + parts + k] + np.uint64(1)
    return out


def leaked(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) of those with a window, 13 consecutive words, in common."""
    return found.where(F.col("equal") > 0).select("doc_id", "item_id")
