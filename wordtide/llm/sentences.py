"""Sentence boundaries across languages and scripts: semi-Markov dynamic programming over whole sentence spans.

Blank lines divide a text into blocks. In each block every stop is a candidate end of a span. The best division of the
block into spans is chosen by dynamic programming; a span scores by its length, by the word it closes with, by the
word the next one opens with, and by whether the quotations and brackets in it balance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .norm import LOOKALIKES, transducer

# Abbreviations that a name, number or further word follows.
NEVER = frozenset(
    """mr mrs ms messrs dr prof st mt capt col gen lt sgt maj rev hon gov sen pres fig figs vol vols ch chap chs sect sec
    art arts bk pt pp nos approx ca cf viz vs ed eds trans dept est lb lbs ex mme mlle mgr vgl bd bde nr hr fr dr hrsg abs
    bzw sog geb gest tel str jh evtl ggf zzgl inkl sr sra srta dña ud uds pág págs núm cap av см стр гл ул им рис табл руб
    коп тыс млн проф акад гг вв κα κος βλ σελ αρ κεφ डॉ श्री पं प्रो""".split()
)
# Abbreviations that may also end a sentence.
MAYBE = frozenset("""etc usw co ltd bros jr esq inc corp cent oz ff al a.m p.m ecc ud.s dgl u.a др пр κλπ κτλ ибн""".split())
# Abbreviations only before a number, words otherwise.
NUMBERED = frozenset("""no n art p s pag col bl abb kap teil tom т п ст рис""".split())
# Month names that follow a day written with a stop.
MONTHS = frozenset("""Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Kapitel Jahrhundert Jahrhunderts Auflage""".split())
# What reports speech after a closing quotation in scripts without letter case: how such a clause begins,
# and how a short one ends.
REPORT_BEGINS = ("قال", "وقال", "قالت", "فقال", "と", "って")
REPORT_ENDS = ("कहा", "पूछा", "बोला", "बोली", "说", "說", "道", "问", "問", "说道", "问道")
#: Gains of a boundary, and what an unbalanced span loses.
SURE, LIKELY, WEAK, AGAINST, UNBALANCED = 4.0, 3.0, 1.5, -6.0, -8.0
#: Size from which on a span loses, and from which on it loses no more.
LONG, LONGEST = 800, 1200

_SPACE = "\t\x0b\x0c\r\x85" + "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs")
_TO_ASCII = {c: " " for c in _SPACE} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c) not in "（）！？；，：［］"} | {"｡": "。"}
_LATIN = {k: v for k, v in LOOKALIKES.items() if len(v) == 1}
_STOPS = ".!?…。！？।॥؟"
_QUOTES = r"[\"“”„«»‹›‚「」『』（）()\[\]［］【】《》〈〉]|(?<![\w])['‘](?=\w)|(?<=[\w.,!?…;])['’](?!\w)"
_TOKENS = re.compile(rf"[{_STOPS}]+|{_QUOTES}")
_GREEK_TOKENS = re.compile(rf"[{_STOPS}]+|(?<=[Ͱ-Ͽἀ-῿]);|;|{_QUOTES}")
_GREEK = re.compile("[Ͱ-Ͽ]")
_CYRILLIC_GREEK = re.compile("[Ͱ-ӿ]")
_LATIN_LETTER = re.compile("[A-Za-z]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΫА-ЯЁІЄЇ]")
_THAI = re.compile("[฀-๿຀-໿ក-៿က-႟]")
_BLANK_LINE = re.compile(r"\n[ \t]*\n\s*")
_OPENERS = "\"“„«‹‚「『（([［【《〈'‘¿¡"
_CLOSING = {"(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉"}
_CLOSERS = set(_CLOSING.values())
_ROMAN = re.compile(r"[IVXLCDM]+$")
_NUMBER = re.compile(r"[£$€]?\d[\d.,]*[sd]?$")
_MONEY = re.compile(r"\d+[sd]\b")
_LAST_WORD = re.compile(r"\S+$")
_RUN = re.compile(r"\w*")
_STOP = re.compile(rf"[{_STOPS}]")
_CLAUSE_END = re.compile(rf"[{_STOPS}\n]")


def _quote(stack: list[str], q: str, opening: bool) -> bool:
    """Keeps the stack of what must close; true if q closed something."""
    if q in _CLOSING:
        stack.append(_CLOSING[q])
        return False
    if q == "„":
        stack.append("“")
        return False
    if q == "‚":
        stack.append("‘")
        return False
    if q == "“":
        if "“" not in stack:
            stack.append("”")
            return False
    elif q in "«»‹›":
        if q not in stack:
            stack.append({"«": "»", "»": "«", "‹": "›", "›": "‹"}[q])
            return False
    elif q == '"':
        if q not in stack:
            stack.append(q)
            return False
    elif q in "'‘’":
        if opening and q != "’":
            stack.append("'" if q == "'" else "’")
            return False
    if q in stack:
        while stack.pop() != q:
            pass
        return True
    return False


def _gain(text: str, start: int, at: int, end: int, stop: str, last: int, quoted: bool, lower: bool) -> float | None:
    """What a boundary at `end` is worth, where the stop begins at `at`; None: it is none. The block is start to last."""
    n = end
    while n < last and (text[n] == " " or text[n] == "\n"):
        n += 1
    if n >= last:
        return 0.0
    c = text[n]
    gap = n > end
    full = stop[0] in "。！？।॥؟"
    if c in ",;:，；：、،؛)]}»”’" and not (c == ";" and gap):
        return None
    if c in "—–-":
        m = n + 1
        while m < last and text[m] in " \n":
            m += 1
        return WEAK if m < last and text[m].isupper() and not quoted else None
    opener = c in _OPENERS
    if opener:
        m = n
        while m < last and (text[m] in _OPENERS or text[m] == " "):
            m += 1
        c = text[m] if m < last else c
    small = c.islower() and not lower
    if small and (quoted or stop[0] not in ".!?" or len(stop) > 1):
        return None
    if not full and not gap and not opener and not (quoted and not c.isascii()):
        return None
    if quoted and not c.isupper() and not c.isdigit() and not opener:
        # scripts without case: a short clause that reports the speech belongs to it
        m = _CLAUSE_END.search(text, n, min(last, n + 40))
        clause = text[n : m.start() if m else min(last, n + 40)]
        if clause.startswith(REPORT_BEGINS) or (len(clause) <= 24 and clause.endswith(REPORT_ENDS)):
            return None
    if full:
        return SURE
    if stop[0] in "!?;;":
        return SURE
    if stop[0] == "…" or stop.startswith(".."):
        return LIKELY if c.isupper() or opener or c.isdigit() else (AGAINST if ord(c) > 0x2E7F else WEAK)
    if quoted:
        return SURE
    # a single stop: what does it close?
    m = _LAST_WORD.search(text, max(start, at - 40), at)
    if m is None:
        return None
    word = m[0].lstrip("\"“„«‹‚「（(['‘¿¡")
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    low = word.lower()
    if small:
        # a word that is no abbreviation ends a sentence even before a small letter
        return WEAK if len(word) > 2 and word.isalpha() and not (low in NEVER or low in MAYBE or low in NUMBERED or _ROMAN.match(word)) else None
    tail = re.split(r"['’]", low)[-1]
    if len(word) == 1 and word.isalpha():
        before = text[max(start, at - 8) : at - 1]
        ends = word in "дп" and re.search(r"т\.\s*$", before) is not None
        return WEAK if ends and (c.isupper() or opener) else AGAINST
    if low in MAYBE:
        if c.isdigit():
            return AGAINST if low in ("oz", "cent") else WEAK
        return WEAK if not lower else AGAINST
    if low in NEVER or tail in NEVER:
        if low in ("art", "ex", "ch", "cap", "ed") and not c.isdigit() and not opener and not _ROMAN.match(_RUN.match(text, n, min(last, n + 40))[0]):
            return AGAINST / 2
        return AGAINST
    if (low in NUMBERED or tail in NUMBERED) and (c.isdigit() or _ROMAN.match(_RUN.match(text, n, min(last, n + 40))[0])):
        return AGAINST
    if "." in word and not any(x.isdigit() for x in word) and all(len(x) <= 2 for x in word.split(".")):
        return AGAINST
    if _NUMBER.match(word):
        if m.start() <= start + 1 and at - start < 8:
            return AGAINST
        if c.isdigit():
            return AGAINST if word[0] in "£$€" or word[-1] in "sd" or _MONEY.match(text, n) else WEAK
        if _RUN.match(unicodedata.normalize("NFC", text[n : n + 20]))[0] in MONTHS:
            return AGAINST
        # a line of its own without a closing stop is a heading
        alone = last - start < 100 and text[last - 1] not in _STOPS + "”\"»“’')]" and "\n" not in text[start:last] and not _STOP.search(text, start, at)
        return AGAINST if alone else LIKELY
    if _ROMAN.match(word) and word != "I":
        before = text[max(start, m.start() - 12) : m.start()].rstrip()
        return AGAINST if not before or not c.isupper() and not opener else WEAK
    return SURE if c.isupper() or not c.isascii() or opener else LIKELY


def _block(text: str, start: int, last: int, lower: bool, tokens: re.Pattern, spaced: bool) -> list[tuple[int, int]]:
    """Spans of one block, in which every division scores as the sum of its spans."""
    ends, gains, depths = [start], [0.0], [0]
    stack: list[str] = []
    stop_at = stop_end = -1
    stop, quoted = "", False

    def close() -> None:
        gain = _gain(text, start, stop_at, stop_end, stop, last, quoted, lower)
        if gain is not None and stop_end < last:
            ends.append(stop_end)
            gains.append(gain)
            depths.append(len(stack))

    if spaced:
        tokens = re.compile(rf"[ \n]+|{tokens.pattern}")
    for m in tokens.finditer(text, start, last):
        t, at = m[0], m.start()
        if spaced and t[0] in " \n":
            a, b = text[at - 1], text[m.end()] if m.end() < last else "x"
            if not (a.isascii() and a.isalnum() and b.isascii() and b.isalnum()) and a != "." and a not in _OPENERS:
                if stop_end == at:
                    stop_at = -1
                if ends[-1] != at:
                    ends.append(at)
                    gains.append(LIKELY)
                    depths.append(len(stack))
            continue
        if t[0] in _STOPS or t in ";;":
            if stop_at >= 0:
                close()
            stop_at, stop_end, stop, quoted = at, m.end(), t, False
            continue
        if stop_at >= 0 and at != stop_end and not (t in "»›”" and not text[stop_end:at].strip()):
            close()
            stop_at = -1
        closed = _quote(stack, t, at == start or not text[at - 1].isalnum() and text[at - 1] not in ".,!?…;")
        if stop_at >= 0:
            if closed:
                stop_end, quoted = m.end(), quoted or t not in ")]）］"
            else:
                # it opens the next sentence: the boundary lies before it
                stack_now, stack[:] = stack[:], stack[:-1] if stack else []
                close()
                stack[:] = stack_now
                stop_at = -1
    if stop_at >= 0 and stop_end < last:
        close()
    ends.append(last)
    gains.append(0.0)
    depths.append(len(stack))
    n = len(ends)
    if n == 2:
        return [(start, last)]
    best, back = [0.0] * n, [0] * n
    # spans of LONGEST or more lose the same, so of their starts only the best is needed: of all, and of each depth
    far, any_far, level_far = 0, (-1e18, 0), []
    for j in range(1, n):
        top, arg, depth, end = -1e18, 0, depths[j], ends[j]
        while end - ends[far] >= LONGEST:
            d, own = depths[far], (best[far], far)
            any_far = max(any_far, own)
            del level_far[d + 1 :]
            level_far += [(-1e18, 0)] * (d + 1 - len(level_far))
            level_far[d] = max(level_far[d], own)
            far += 1
        shallow = depth
        for i in range(j - 1, far - 1, -1):
            size = end - ends[i]
            s = best[i]
            if depths[i] != depth or shallow < depth:
                s += UNBALANCED
            if size > LONG:
                s -= (size - LONG) / 100  # never enough to cut at an abbreviation
            elif size < 2:
                s -= 3
            if s > top:
                top, arg = s, i
            shallow = min(shallow, depths[i])
        if far:
            loss = (LONGEST - LONG) / 100
            if any_far[0] + UNBALANCED - loss > top:
                top, arg = any_far[0] + UNBALANCED - loss, any_far[1]
            if shallow >= depth and depth < len(level_far) and level_far[depth][0] - loss > top:
                top, arg = level_far[depth][0] - loss, level_far[depth][1]
        best[j], back[j] = top + gains[j], arg
    spans, j = [], n - 1
    while j:
        spans.append((ends[back[j]], ends[j]))
        j = back[j]
    spans.reverse()
    return spans


_PLAIN = str.maketrans(_TO_ASCII)
_ODD = re.compile("[" + re.escape("".join(sorted(_TO_ASCII))) + "]")
_LATINISED = str.maketrans(_TO_ASCII | _LATIN)


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, in code points of the text, without blank space around it."""
    places = None
    view = text
    if not text.isascii():
        unseen = transducer(False).unseen
        if unseen.search(text):
            places = [i for i, c in enumerate(text) if not unseen.match(c)]
            view = "".join([text[i] for i in places])
        if _CYRILLIC_GREEK.search(view) and 2 * len(_LATIN_LETTER.findall(view)) > len(view) * 0.5:
            view = view.translate(_LATINISED)
        elif _ODD.search(view):
            view = view.translate(_PLAIN)
    elif "\r" in text or "\t" in text:
        view = text.replace("\r", " ").replace("\t", " ")
    tokens = _GREEK_TOKENS if not view.isascii() and _GREEK.search(view) else _TOKENS
    lower = _UPPER.search(view) is None
    spaced_text = not view.isascii() and _THAI.search(view) is not None
    out, at, size = [], 0, len(view)
    while at < size:
        m = _BLANK_LINE.search(view, at)
        end = m.start() if m else size
        while at < end and view[at] in " \n":
            at += 1
        last = end
        while last > at and view[last - 1] in " \n":
            last -= 1
        if last > at:
            spaced = spaced_text and 3 * len(_THAI.findall(view, at, last)) > last - at
            for a, b in _block(view, at, last, lower, tokens, spaced):
                while a < b and view[a] in " \n":
                    a += 1
                while b > a and view[b - 1] in " \n":
                    b -= 1
                if b > a:
                    out.append((a, b))
        at = m.end() if m else size
    if places is not None:
        out = [(places[a], places[b - 1] + 1) for a, b in out]
    return out


def sentences(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, sent_ix, start_pos, end_pos[, sentence]) of every text.

    Null texts and texts without anything but blank space give no row; a repeated doc_id gives its sentences again; long
    texts take time in proportion to their length.
    """
    schema = "doc_id bigint, sent_ix bigint, start_pos bigint, end_pos bigint" + ", sentence string" * with_text

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, order, starts, ends, texts = [], [], [], [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                found = spans(text)
                ids += [doc_id] * len(found)
                order += range(len(found))
                for a, b in found:
                    starts.append(a)
                    ends.append(b)
                if with_text:
                    texts += [text[a:b] for a, b in found]
            columns = [pa.array(np.array(x, dtype=np.int64)) for x in (ids, order, starts, ends)]
            names = ["doc_id", "sent_ix", "start_pos", "end_pos"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("sentence")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(split, schema)
