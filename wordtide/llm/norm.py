"""Visually identical text with different characters: one consistent form.

The mapping is compiled once into a longest-match transducer over grapheme clusters: a cluster is a character with the
combining marks and invisible characters that follow it. Building it checks for conflicts: no target may itself be
mapped, so a second pass changes nothing. Text is rewritten in one pass; what needs no change is never touched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, meet

# Letters of other scripts that look like a Latin letter, in pairs.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Armenian, Coptic, Cherokee and Latin
    "Օ": "O", "օ": "o", "Տ": "S", "Լ": "L", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i",
    "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲭ": "X", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S",
    "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K",
    "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W",
    "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
# Hyphens that look like the hyphen-minus.
HYPHENS = "‐‑﹣－"
# Characters that show nothing, besides those of category Cf.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Signs of category Cf that do show.
SEEN = "؀؁؂؃؄؅۝܏࢐࢑࣢"
#: Code points looked through when the mapping is compiled: all planes that have characters, without ASCII, surrogates
#: and the areas for private use, for which there is no form.
SPAN = [*range(0x80, 0xD800), *range(0xF900, 0x40000), *range(0xE0000, 0xE0200)]
_KINDS = ("<wide>", "<narrow>", "<font>")


def _single(c: str, lookalikes: bool) -> str:
    """What one character becomes."""
    if c in UNSEEN or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or (unicodedata.category(c) == "Cf" and c not in SEEN):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    kind = unicodedata.decomposition(c).partition(" ")[0]
    if kind in _KINDS or (kind == "<compat>" and (0xFB00 <= ord(c) <= 0xFB06 or 0x2160 <= ord(c) <= 0x217F)):
        c = unicodedata.normalize("NFKC", c)
    if lookalikes:
        c = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFD", c))
    return unicodedata.normalize("NFC", c)


class Transducer:
    """rewrite(text): the consistent form. `lookalikes`: whether letters of other scripts become the Latin ones."""

    def __init__(self, lookalikes: bool) -> None:
        self.lookalikes = lookalikes
        # only what has a decomposition, is a mark, a blank, a sign of category Cf or on a list can map or join
        listed = {*LOOKALIKES, *HYPHENS, *UNSEEN}
        special = [c for c in map(chr, SPAN) if c in listed or unicodedata.decomposition(c) or unicodedata.category(c) in ("Cf", "Zs", "Mn", "Mc")]
        table: dict[str, str] = {}
        for c in special:
            to = _single(c, lookalikes)
            if to != c:
                table[c] = to
        for c, to in table.items():
            if any(x in table for x in to):
                raise ValueError(f"conflict: {c!r} becomes {to!r}, which is mapped itself")
        # what can join the character before it: combining marks, the second halves of composed characters, and whatever
        # becomes or is composed of these, such as half-width voicing marks and half-width vowels
        marks = {c for c in special if unicodedata.combining(c)} | {chr(c) for c in range(0x1161, 0x1200)}
        composed = {c: unicodedata.normalize("NFD", c) for c in special if unicodedata.decomposition(c)[:1] not in ("", "<")}
        marks |= {d[-1] for d in composed.values() if len(d) > 1}
        marks |= {c for c, d in composed.items() if d[0] in marks} | {c for c, to in table.items() if to and to[0] in marks}
        mark, unseen, any_of = (_ranges(x) for x in (sorted(marks), [c for c, to in table.items() if not to], list(table)))
        self.table, self.mark = table, mark
        self.plain = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
        self.unseen = re.compile(f"[{unseen}]")
        # only what is not ASCII, with the character before it, is looked at closely
        self.run = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
        self.cluster = re.compile(f"[{any_of}][{mark}{unseen}]*|[^{mark}][{unseen}]*[{mark}][{mark}{unseen}]*")
        self.known, self.runs = dict(table), {}

    def _rewrite(self, m: re.Match) -> str:
        cluster = m[0]
        to = self.known.get(cluster)
        if to is None:
            to = unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in unicodedata.normalize("NFD", cluster)))
            to = "".join(self.table.get(c, c) for c in to)
            if len(self.known) < 200_000:
                self.known[cluster] = to
        return to

    def _run(self, m: re.Match) -> str:
        run = m[0]
        to = self.runs.get(run)
        if to is None:
            to = self.cluster.sub(self._rewrite, run)
            if len(run) < 16 and len(self.runs) < 200_000:
                self.runs[run] = to
        return to

    def rewrite(self, text: str) -> str:
        if self.plain.search(text):
            text = self.plain.sub("", text)
        return text if text.isascii() else self.run.sub(self._run, text)


def _ranges(chars: list[str]) -> str:
    codes, out = sorted({ord(c) for c in chars}), []
    while codes:
        n = 1
        while n < len(codes) and codes[n] == codes[0] + n:
            n += 1
        out.append(f"{re.escape(chr(codes[0]))}-{re.escape(chr(codes[n - 1]))}")
        codes = codes[n:]
    return "".join(out)


@cache
def transducer(lookalikes: bool) -> Transducer:
    return Transducer(lookalikes)


@cache
def _mixed() -> tuple[re.Pattern, re.Pattern, dict[int, str]]:
    other = "".join(c for c in LOOKALIKES if "LATIN" not in unicodedata.name(c)) + "Ͱ-֏ἀ-῿"
    word = rf"[\w{transducer(False).mark}]"
    return re.compile(rf"(?={word}*[A-Za-z])(?={word}*[{other}]){word}+"), re.compile(f"[{other}]"), {ord(c): to for c, to in LOOKALIKES.items()}


def consistent(text: str) -> str:
    """The form for reading: a look-alike letter becomes Latin only within a word that has Latin letters too."""
    text = transducer(False).rewrite(text)
    if text.isascii():
        return text
    words, other, table = _mixed()
    if not other.search(text):
        return text
    return words.sub(lambda m: unicodedata.normalize("NFC", unicodedata.normalize("NFD", m[0]).translate(table)), text)


def skeleton(text: str) -> str:
    """The form for comparing: two texts that look alike have the same one, whatever scripts their letters are of."""
    return transducer(True).rewrite(text)


def consistent_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): the consistent form of a column; null stays null, the empty text empty."""
    kind = dict(df.dtypes)[key]

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [None if t is None else consistent(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], ["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(form, f"key {kind}, text string")


def lookalike_pairs(book_terms: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, book_id, key_a, key_b): different strings of one book whose skeletons are equal.

    Terms are compared without blank space at their ends, texts whole. Null books, terms and texts give no case; copies
    of one string are not a case, but each of two copies is one with a third string that looks like it. Pairs are formed
    between different strings only, however many rows hold them; large groups are spread over tasks.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rewrite, seen = transducer(True).rewrite, {}
        digest = lambda s: xxhash.xxh128_digest(s.encode("utf-8", "surrogatepass"))
        for batch in batches:
            kind, text, own, raw = batch.column(0).to_pylist(), batch.column(3).to_pylist(), [], []
            for k, t in zip(kind, text):
                if k == "term":
                    x = seen.get(t)
                    if x is None:
                        x = digest(rewrite(t).strip()), digest(t)
                        if len(seen) < 200_000:
                            seen[t] = x
                    own.append(x[0])
                    raw.append(x[1])
                else:
                    raw.append(d := digest(t))
                    form = rewrite(t)
                    own.append(d if form is t else digest(form))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.binary()), pa.array(raw, pa.binary())], ["kind", "book_id", "key", "form", "raw"])

    terms = book_terms.where("book_id is not null and term is not null").select(F.lit("term").alias("kind"), "book_id", F.col("term").alias("key"), F.col("term").alias("text"))
    texts = documents.where("book_id is not null and text is not null and doc_id is not null")
    texts = texts.select(F.lit("text").alias("kind"), "book_id", F.col("doc_id").cast("string").alias("key"), "text")
    # read three times below, so it is written once: 32 bytes of digests instead of each text
    rows = cut(terms.unionByName(texts).mapInArrow(forms, "kind string, book_id string, key string, form binary, raw binary"))
    by = ["kind", "book_id", "form"]
    many = rows.groupBy(*by).agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select(*by)
    rows = cut(rows.join(many, by, "left_semi").distinct())
    # pairs of different strings first, then the rows of either: copies of one string never meet
    texts = rows.select(*by, "raw").distinct()
    unlike = meet(texts.withColumnRenamed("raw", "raw_a"), texts.withColumnRenamed("raw", "raw_b"), by, "raw_a").where("raw_a < raw_b")
    # Spark broadcasts the pairs of strings where they are few and splits large partitions of copies where they are many
    pairs = rows.select(*by, F.col("key").alias("x"), F.col("raw").alias("raw_a")).join(unlike, [*by, "raw_a"])
    pairs = pairs.join(rows.select(*by, F.col("key").alias("y"), F.col("raw").alias("raw_b")), [*by, "raw_b"])
    return pairs.select("kind", "book_id", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
