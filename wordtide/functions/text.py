"""Text functions as Column expressions, and the parsers of a book's page that need a real HTML reader."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of the two coarse part-of-speech systems.
CONTENT_TAGS = ("N", "V", "J")
# Coarse tag to dictionary part of speech.
COARSE = {"NOUN": "n", "VERB": "v", "ADJ": "a", "ADV": "r"}


def source_id(book_id: Column) -> Column:
    """The number after the last hyphen, which must be a number: 'gutenberg-007' -> 7."""
    return F.trim(F.substring_index(book_id, "-", -1)).cast("bigint")


def book_id(source: Column) -> Column:
    return F.concat(F.lit("gutenberg-"), F.trim(source.cast("string")).cast("bigint").cast("string"))


def sentences(text: Column) -> Column:
    """Runs up to and with their stops."""
    return F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def clean(token: Column) -> Column:
    """Letters only, in lower case; '' where nothing is left, so that positions stay."""
    return F.lower(F.regexp_replace(token, r"[^\p{L}]", ""))


def respell(token: Column) -> Column:
    """The American spelling of one word made British, also within other words."""
    return F.replace(token, F.lit("labor"), F.lit("labour"))


def trainable(tokens: Column) -> Column:
    """Tokens of at least four letters and nothing else."""
    return F.filter(tokens, lambda w: w.rlike(r"^\p{L}+$") & (F.length(w) > 3))


def content_tag(tag: Column) -> Column:
    """The initial of a content word's tag; null for other words. 'RB' anywhere marks an adverb, so 'WRB' gives 'W'."""
    first = F.substring(tag, 1, 1)
    return F.when(first.isin(*CONTENT_TAGS) | tag.contains("RB"), first)


def now() -> Column:
    """The time of the query in whole seconds; session time zone UTC gives UTC."""
    return F.date_trunc("second", F.current_timestamp())


def label(author: Column, year: Column) -> Column:
    """'Smith, Adam', 1776 -> 'Smith (1776)'."""
    return F.concat(F.substring_index(author, ",", 1), F.lit(" ("), year.cast("string"), F.lit(")"))


def vector_id(book: Column, term: Column) -> Column:
    return F.concat_ws("::", book, term)


def split_vector_id(identifier: Column) -> tuple[Column, Column]:
    """Book and term; the term may hold '::' itself."""
    parts = F.split(identifier, "::", 2)
    return F.element_at(parts, 1), F.element_at(parts, 2)


def seed_of_path(path: Column) -> Column:
    """The number a model's file name begins with."""
    return F.substring_index(F.regexp_extract(path, "[^/]+$", 0), "-", 1).cast("int")


def event_index(event: Column) -> Column:
    """The 'index' of an event, or else of the JSON in its body; null for anything else, broken JSON too."""
    own = F.get_json_object(event, "$.index")
    return F.coalesce(own, F.get_json_object(F.get_json_object(event, "$.body"), "$.index"))


def metadata_key(name: Column) -> Column:
    return F.replace(F.replace(F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("-")), F.lit("."), F.lit("")), F.lit("-"), F.lit("_"))


class _Text(HTMLParser):
    """The text of a page without its header and footer, scripts and styles."""

    SKIPPED = ("script", "style", "head", "title")
    EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.open: list[tuple[str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.EMPTY:
            skip = tag in self.SKIPPED or dict(attrs).get("id") in ("pg-header", "pg-footer")
            self.open.append((tag, skip or bool(self.open and self.open[-1][1])))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]) and data.strip():
            self.parts.append(data.strip())


def html_text(page: str | None) -> str | None:
    """Text of a page, one blank between words; null for an empty one."""
    if page is None:
        return None
    reader = _Text()
    reader.feed(page)
    reader.close()
    return " ".join(" ".join(reader.parts).split()) or None


class _Metadata(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, list[str]] = {}
        self.inside = self.depth = 0
        self.key, self.cell, self.link, self.text = "", "", None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag == "table":
            self.depth += 1
            if "bibrec" in (own.get("class") or "").split():
                self.inside = self.depth
        elif self.inside:
            if tag == "tr":
                self.key = ""
            elif tag in ("th", "td"):
                self.cell, self.text, self.link = tag, [], None
            elif tag == "a" and self.cell == "td" and self.link is None:
                self.link = own.get("href")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.inside = 0 if self.inside == self.depth else self.inside
            self.depth -= 1
        elif self.inside and tag == self.cell:
            text = "".join(self.text).strip()
            if tag == "th":
                self.key = text.lower().replace(" ", "-").replace(".", "").replace("-", "_")
            elif self.key and text:
                self.found.setdefault(self.key, []).extend(x.strip() for x in text.splitlines() if x.strip())
                if self.link:
                    self.found.setdefault(f"{self.key}_link", []).append(self.link)
            self.cell = ""

    def handle_data(self, data: str) -> None:
        if self.inside and self.cell:
            self.text.append(data)


def html_metadata(page: str | None) -> dict[str, list[str]]:
    """Rows of the bibliographic table: name of the field to its lines, and to its first link under '<name>_link'."""
    reader = _Metadata()
    reader.feed(page or "")
    reader.close()
    return reader.found
