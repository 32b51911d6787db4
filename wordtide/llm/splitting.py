"""Splitting oversized items at natural boundaries: structure-tree packing.

A text is parsed into a tree: sections under their headings, paragraphs and lists, list items, sentences, words, parts
of words. From the bottom up, sibling subtrees that fit are merged up to the limit, and only nodes over the limit are
descended into. What is left over of a node that was descended into joins its siblings only where it is too small to
stand alone, so pieces keep to sections. Each piece begins with the last tokens of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import spans
from .tokens import FOLDER, NAME, starts_of, tokens_of

LIMIT, OVERLAP = 2048, 64
_BLOCK = re.compile(r"\S(?:.*\S)?(?:[ \t]*\r?\n(?![ \t]*\r?\n)[ \t]*\S.*)*")
_MARKED = re.compile(r"(#{1,6})\s|<h([1-6])\b", re.I)
# Words that head a part of a book, with the depth of that part.
_NAMED = {"book": 1, "part": 1, "livre": 1, "buch": 1, "chapter": 2, "chapitre": 2, "kapitel": 2, "capítulo": 2, "глава": 2, "κεφάλαιο": 2}
_ITEM = re.compile(r"[ \t]*(?:[-*•–]|\d{1,3}[.)]|<li\b)\s*", re.I)
_STOP = ".!?…。！？।॥؟;:,”\"»“’')）」]"


class Node:
    __slots__ = ("start", "end", "kind", "parts")

    def __init__(self, start: int, end: int, kind: str) -> None:
        self.start, self.end, self.kind, self.parts = start, end, kind, []


def _heading(block: str) -> int:
    """The depth of the section that a block heads, 0 if it is no heading."""
    m = _MARKED.match(block)
    if m:
        return len(m[1]) if m[1] else int(m[2])
    if "\n" in block or len(block) > 100 or block[-1] in _STOP:
        return 0
    return next((_NAMED[w] for w in re.findall(r"\w+", block.lower())[:2] if w in _NAMED), 3)


def tree(text: str) -> Node:
    """Sections within the text, blocks within sections. Sentences and words are parsed only where they are needed."""
    root = Node(0, len(text), "text")
    path = [(0, root)]
    for m in _BLOCK.finditer(text):
        block = m[0]
        depth = _heading(block)
        if depth:
            while path[-1][0] >= depth:
                path.pop()
            section = Node(m.start(), m.end(), "section")
            path[-1][1].parts.append(section)
            path.append((depth, section))
        lines = block.split("\n")
        kind = "heading" if depth else "list" if len(lines) > 1 and sum(bool(_ITEM.match(x)) for x in lines) * 2 > len(lines) else "paragraph"
        path[-1][1].parts.append(Node(m.start(), m.end(), kind))
        for _, node in path:
            node.end = max(node.end, m.end())
    return root


def _descend(text: str, node: Node) -> list[Node]:
    if node.kind in ("text", "section"):
        return node.parts
    own = text[node.start : node.end]
    if node.kind == "list":
        return [Node(node.start + m.start(), node.start + m.end(), "item") for m in re.finditer(r"\S.*", own)]
    if node.kind in ("paragraph", "heading", "item"):
        found = [Node(node.start + a, node.start + b, "sentence") for a, b in spans(own)]
        if len(found) > 1:
            return found
    if node.kind != "word":
        found = [Node(node.start + m.start(), node.start + m.end(), "word") for m in re.finditer(r"\S+", own)]
        if len(found) > 1:
            return found
    if node.kind != "part":
        found = [Node(node.start + m.start(), node.start + m.end(), "part") for m in re.finditer(r"\w+\W*|\W+", own)]
        if len(found) > 1:
            return found
    return []


class _Packer:
    """Ends of pieces of at most `room` tokens. A node that fits is never cut."""

    def __init__(self, text: str, begins: np.ndarray, whole: np.ndarray, room: int) -> None:
        self.text, self.begins, self.whole, self.room = text, begins, whole, room

    def _last(self, node: Node) -> int:
        return int(np.searchsorted(self.begins, node.end))

    def pack(self, node: Node, start: int, lead: int | None = None) -> list[tuple[int, str, str]]:
        """(end, kind, standing) of the pieces of an oversized node, from token `start`, or from `lead` if something small
        begins there that belongs to the first of them. Standing: 'whole' for merged subtrees, 'heading' for a heading
        without anything under it yet, 'rest' for the last piece of a subtree that was descended into."""
        begin = start if lead is None else lead
        out: list[tuple[int, str, str]] = [] if lead is None else [(start, "heading", "heading")]
        at = start
        for part in _descend(self.text, node):
            last = self._last(part)
            if last <= at:
                continue
            if last - at <= self.room:
                out.append((last, part.kind, "heading" if part.kind == "heading" else "whole"))
            else:
                # a heading, or too little to stand alone, leads the first piece of what follows
                head, out = None, self._merged(out, begin)
                if out:
                    first = out[-2][0] if len(out) > 1 else begin
                    if out[-1][2] == "heading" or at - first <= self.room // 4:
                        head = first
                        out.pop()
                own = self.pack(part, at, head)
                out += own[:-1] + [(own[-1][0], own[-1][1], "rest")]
            at = last
        last = self._last(node)
        if out and last > out[-1][0] and last - out[-1][0] <= self.room:
            out.append((last, out[-1][1], "whole"))  # blank space at the end
        elif not out or last > out[-1][0]:
            out += self._tokens(out[-1][0] if out else begin, last)
        return self._merged(out, begin)

    def _merged(self, parts: list[tuple[int, str, str]], begin: int) -> list[tuple[int, str, str]]:
        out: list[tuple[int, str, str]] = []
        first = before = begin  # where the last piece of `out` begins, and where its last part does
        for end, kind, standing in parts:
            size = out[-1][0] - first if out else 0
            rest = bool(out) and out[-1][2] == "rest" and size > self.room // 2
            if out and end - first <= self.room and not rest:
                before = out[-1][0]
                out[-1] = (end, kind, standing)
                continue
            if out and out[-1][2] == "heading" and before > first and end - before <= self.room:
                # a heading goes with what follows it
                out[-1] = (before, "section", "whole")
                first = before
                out.append((end, kind, standing))
                continue
            first = out[-1][0] if out else begin
            before = first
            out.append((end, kind, standing))
        return out

    def _tokens(self, start: int, last: int) -> list[tuple[int, str, str]]:
        """What has no parts is cut between tokens, at a whole character."""
        out = []
        while last - start > self.room:
            cut = start + self.room
            while cut > start + 1 and not self.whole[cut]:
                cut -= 1
            out.append((cut, "token", "rest"))
            start = cut
        return [*out, (last, "token", "rest")]

    def ends(self) -> list[tuple[int, str]]:
        root = tree(self.text)
        root.end = len(self.text)
        found = self.pack(root, 0)
        return [(end, kind) for end, kind, _ in found]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = FOLDER, name: str = NAME) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, kind of node at whose end it is cut) of each piece; none if the text is within the limit.

    Every piece, tokenized by itself, has at most `limit` tokens; it shares `overlap` tokens of the text's own
    tokenization with the piece before, up to three more where a character would otherwise be cut.
    """
    if len(text.encode("utf-8", "surrogatepass")) <= limit:
        return []  # a byte-level token holds at least a byte
    ids = tokens_of(text, folder, name)
    if len(ids) <= limit:
        return []
    begins, whole = starts_of(text, ids, folder, name)
    room = limit - overlap - 8
    while True:
        out, fits = [], True
        at = 0
        for end, kind in _Packer(text, begins, whole, room).ends():
            start = max(0, at - overlap) if out else 0
            while start and not whole[start]:
                start -= 1
            a, b = int(begins[start]), int(begins[end])
            n = len(tokens_of(text[a:b], folder, name))
            fits = fits and n <= limit
            out.append((a, b, n, kind))
            at = end
        if fits or room <= 1:
            return out
        room = room * 15 // 16


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(doc_id, piece_no, start_pos, end_pos, tokens, cut_at, piece) of every text over the limit.

    Null ids, null texts and texts within the limit give no row; a repeated doc_id gives its pieces again.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                rows += [(doc_id, i, a, b, n, kind, text[a:b]) for i, (a, b, n, kind) in enumerate(pieces(text, limit, overlap, folder, name))]
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece_no", "start_pos", "end_pos", "tokens", "cut_at", "piece"])

    rows = documents.where("doc_id is not null and text is not null").where(F.octet_length("text") > limit)
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(split, "doc_id bigint, piece_no bigint, start_pos bigint, end_pos bigint, tokens bigint, cut_at string, piece string")
