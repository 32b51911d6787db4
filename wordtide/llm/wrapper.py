"""Page boilerplate mixed with main content: wrappers by union-free regular-expression inference.

A page is read, once, as a stream of tokens: containers, each a tag with its text units. The streams of one host are
aligned one after the other into a wrapper, and every mismatch is resolved: a container that follows one like it is a
repetition of the same part, any other that does not align is an optional part, and where texts differ they become a
text slot. A slot remembers the values that recur, in a summary of bounded size, so a wrapper is a regular expression
without unions: tags, optional parts, repeated parts and slots. Wrappers of parts of the data align with each other in
the same way, so every page of a host is learned from and no host is gathered. Pages go to parts by their content
and are learned in its order, so the result depends on the pages alone, not on how they are stored or partitioned.
Beside the wrappers the pages of every value are counted in full; copies of a page count as one page.

A page is then aligned with its host's wrapper. Units that recur as constants of the template, and units in slots that
hold such constants on other pages, are boilerplate; the rest is the main body.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .norm import skeleton

#: Values that a slot's summary holds for the alignment. A value is lost only if it makes up less than 1 / KEPT of the
#: slot's units. Constants are not taken from here but counted in full.
KEPT = 4000
#: Nodes of a wrapper; the optional parts seen on the fewest pages go first, half of the nodes at once. Counts stay whole.
NODES = 2000
#: A value on this share of a host's pages, or of all pages, is a constant of the template.
HOST_SHARE, ALL_SHARE = 0.01, 0.012
#: Where a page has one unit of new text only, on this share of the host's pages, or of all, it is a message, not a body.
MESSAGE_SHARE = 0.001
#: Share of units without constants from which a slot holds content.
CONTENT = 0.3
#: Tasks over which the pages of all large hosts are spread, at most twice as many.
TASKS = 1024
#: Counts of values that a task holds before it sends them on.
COUNTS = 400_000
#: Pages of a host that one wrapper learns from before it is merged with the host's others, about, and how many merge at once.
LEARNED, MERGED = 500, 32

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|title|noscript|template)\b.*?(?:</\1\s*>|$)|</?[a-zA-Z!][^<>]*>|[^<]+|<", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_CONTAINERS = frozenset("div section article main aside nav header footer table center ul ol dl form td".split())
_LISTS = frozenset("table ul ol dl form td".split())
_INLINE = frozenset("a b i em strong span sup sub font small u tt code cite q abbr img".split())
_DIGITS = re.compile(r"\d+")
_ITEMS, _ITEM_MARK = re.compile(r"\s*[|»·•]\s*"), re.compile("[|»·•]")


class Unit:
    """A text between block tags: its lines, its value without digits, whether it is all link or all heading."""

    __slots__ = ("lines", "value", "lead", "link", "head", "nav", "words")

    def __init__(self, text: str, lines: list[int], link: int, head: bool, bold: int) -> None:
        words = skeleton(entities.unescape(text) if "&" in text else text).split()
        shown = " ".join(words)
        self.lines = lines
        value = _DIGITS.sub("#", shown.lower())
        # a long text is known by its beginning and its hash
        self.value = value if len(value) <= 64 else f"{value[:32]}…{xxhash.xxh64_hexdigest(value.encode('utf-8', 'surrogatepass'))}"
        self.words = len(words)
        self.lead = ""
        if self.words <= 18 and ":" in value:
            lead = value.partition(":")[0]
            if len(lead.split()) <= 4:
                self.lead = lead.strip() + ":"
        size = sum(map(len, text.split())) if link or bold else 0
        self.link = link >= size > 0
        self.head = (head or bold >= size > 0) and self.words <= 14
        self.nav = False
        if _ITEM_MARK.search(shown):
            parts = [x for x in _ITEMS.split(shown) if x]
            self.nav = len(parts) > 2 and self.words <= 4 * len(parts)


def read(page: str) -> list[tuple[str, list[Unit]]]:
    """The page's stream: (tag, units) of each container with text of its own, in order.

    Lists and tables belong to the container they lie in; so does a container that is no more than the tag of one unit.
    Text right under the body makes a run up to the next container.
    """
    stream: list[tuple[str, list[Unit]]] = []
    stack: list[list] = []  # a container's name, its place in the stream or None, whether it has tags within
    body: list[Unit] | None = None
    text, lines, link, bold, head = [], [], 0, 0, False
    in_link = in_bold = 0
    line = 0

    def flush() -> None:
        nonlocal text, lines, link, bold, head, body
        if lines:
            unit = Unit("".join(text), lines, link, head, bold)
            depth = len(stack) - 1
            if depth >= 0 and not stack[depth][2] and stack[depth][1] is None and stack[depth][0] in ("div", "td"):
                # undecided whether it is a container or one unit's tag
                stack[depth][3].append(unit)
            else:
                put(depth, unit)
        text, lines, link, bold, head = [], [], 0, 0, False

    def put(depth: int, unit: Unit) -> None:
        nonlocal body
        while depth >= 0 and stack[depth][0] in _LISTS and depth > 0:
            depth -= 1
        if depth < 0:
            if body is None:
                body = []
                stream.append(("body", body))
            body.append(unit)
            return
        own = stack[depth]
        if own[1] is None:
            own[1] = []
            stream.append((own[0], own[1]))
            body = None
        own[1].append(unit)

    def settle(depth: int) -> None:
        """Its tags within show that it is a container."""
        if depth >= 0 and not stack[depth][2]:
            stack[depth][2] = True
            waiting, stack[depth][3] = stack[depth][3], []
            for unit in waiting:
                put(depth, unit)

    for m in _TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or token == "<":
            if lines and not in_bold and token.lstrip(" \t\r").startswith("\n") and bold >= len("".join("".join(text).split())):
                flush()  # a bold line by itself
            for i, part in enumerate(token.split("\n")):
                if part and not part.isspace():
                    if not lines or lines[-1] != line + i:
                        lines.append(line + i)
            if in_link or in_bold:
                size = sum(map(len, token.split()))
                link += size * in_link
                bold += size * in_bold
            text.append(token)
        else:
            tag = _TAG.match(token)
            if tag and not m[1]:
                close, name = tag[1], tag[2].lower()
                if name in _INLINE:
                    if name == "a":
                        in_link = 0 if close else 1
                    elif name in ("b", "strong"):
                        in_bold = 0 if close else 1
                elif name not in ("html", "body"):
                    flush()
                    in_link = in_bold = 0
                    head = not close and len(name) == 2 and name[0] == "h" and name[1].isdigit()
                    if name not in _CONTAINERS:
                        settle(len(stack) - 1)
                    elif not close:
                        settle(len(stack) - 1)
                        stack.append([name, None, False, []])
                    elif any(x[0] == name for x in stack):
                        while stack:
                            own = stack.pop()
                            for unit in own[3]:
                                put(len(stack) - 1, unit)
                            if own[0] == name:
                                break
                elif name == "body":
                    flush()
        line += token.count("\n")
    flush()
    while stack:
        own = stack.pop()
        for unit in own[3]:
            put(len(stack) - 1, unit)
    return stream


class Slot:
    """How many units a slot saw, how many were boilerplate by their form, and the values and leads that recur."""

    __slots__ = ("n", "formal", "known", "fresh", "words", "lost", "values")

    def __init__(self) -> None:
        # fresh: units seen when there was nothing yet to know them by
        # lost: by how much the summary has lowered the counts of the values it holds
        self.n = self.formal = self.known = self.fresh = self.words = self.lost = 0
        self.values: dict[str, int] = {}

    def add(self, units: list[Unit]) -> None:
        if not self.n:
            self.fresh = len(units)
        for u in units:
            self.n += 1
            self.words += u.words
            self.known += self.n > self.fresh and (u.value in self.values or u.lead in self.values)
            if u.link or u.nav:
                self.formal += 1
            for key in {u.value, u.lead}:
                if key:
                    self.values[key] = self.values.get(key, 0) + 1
        if len(self.values) > 2 * KEPT:
            self._shrink()

    def merge(self, other: Slot) -> None:
        self.n += other.n
        self.known += other.known
        self.fresh += other.fresh
        self.words += other.words
        self.formal += other.formal
        self.lost += other.lost
        for k, v in other.values.items():
            self.values[k] = self.values.get(k, 0) + v
        if len(self.values) > 2 * KEPT:
            self._shrink()

    def _shrink(self) -> None:
        """Keeps the KEPT most frequent, lowered by the count of the first that goes (frequent-items summary)."""
        order = sorted(self.values.items(), key=lambda x: (-x[1], x[0]))
        less = order[KEPT][1]
        self.lost += less
        self.values = {k: v - less for k, v in order[:KEPT] if v > less}

    def usual(self) -> float:
        """The share of units that were known from pages before."""
        return self.known / max(1, self.n - self.fresh)

    def gain(self, rate: float, words: float) -> float:
        """What it is worth to align units of which the share `rate` is known here, of `words` words on average.

        A slot of constants takes no run of new texts, a slot of new texts no run of constants.
        """
        usual, size = self.usual(), self.words / max(1, self.n)
        if self.n - self.fresh >= 8 and abs(rate - usual) > 0.6:
            return -1.0
        length = min(words, size) / max(words, size, 1)
        if length < 0.4 and min(rate, usual) < 0.5:
            return -1.0
        return 0.2 + 2 * min(rate, usual) + (1 - abs(rate - usual)) + length

    def likeness(self, units: list[Unit]) -> float:
        known = sum(u.value in self.values or u.lead in self.values for u in units) / len(units)
        return self.gain(known, sum(u.words for u in units) / len(units))


def least(pages: int) -> float:
    """Pages of a host of `pages` from which on a value's count is needed."""
    return max(2, pages * MESSAGE_SHARE)


class Wrapper:
    """nodes: [tag, pages it was seen on, Slot of its units, whether it repeats]; a node seen on fewer pages than `pages`
    is optional."""

    def __init__(self) -> None:
        self.nodes: list[list] = []
        self.pages = 0
        self.seen: dict[tuple, list[int | None]] = {}

    def match(self, stream: list[tuple[str, list[Unit] | Slot]], like) -> list[int | None]:  # noqa: ANN001
        """For each item of the stream the node it aligns with, by dynamic programming."""
        n, m = len(self.nodes), len(stream)
        best = [[0.0] * (m + 1) for _ in range(n + 1)]
        gain: dict[tuple[int, int], float] = {}
        for i in range(n - 1, -1, -1):
            tag, row, below = self.nodes[i][0], best[i], best[i + 1]
            for j in range(m - 1, -1, -1):
                s = below[j] if below[j] >= row[j + 1] else row[j + 1]
                if stream[j][0] == tag:
                    g = like(i, j)
                    if g > 0:
                        gain[i, j] = g
                    if g > 0 and g + below[j + 1] > s:
                        s = g + below[j + 1]
                row[j] = s
        out: list[int | None] = [None] * m
        i = j = 0
        while i < n and j < m:
            if (i, j) in gain and best[i][j] == gain[i, j] + best[i + 1][j + 1]:
                out[j] = i
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
        return out

    def _insert(self, stream: list, at: list[int | None], weight) -> list[list]:  # noqa: ANN001
        """Puts what did not align between the nodes that did; gives the node of each item."""
        nodes, out, i = [], [], 0
        for item, k in zip(stream, at):
            if k is None:
                node = [item[0], 0, Slot(), False]
                nodes.append(node)
            else:
                nodes += self.nodes[i : k + 1]
                node, i = self.nodes[k], k + 1
            node[1] += weight(item)
            out.append(node)
        self.nodes = nodes + self.nodes[i:]
        if len(self.nodes) > NODES:
            often = sorted(range(len(self.nodes)), key=lambda k: (-self.nodes[k][1], k))[: NODES // 2]
            self.nodes = [self.nodes[k] for k in sorted(often)]
        return out

    def learn(self, stream: list[tuple[str, list[Unit]]]) -> None:
        self.pages += 1
        at = self.match(stream, lambda i, j: self.nodes[i][2].likeness(stream[j][1]))
        repeats = self._repeats(stream, at, False)
        rest = [x for x, r in zip(stream, repeats) if r is None]
        own = self._insert(rest, [k for k, r in zip(at, repeats) if r is None], lambda item: 1)
        for node, (_, units) in zip(own, rest):
            node[2].add(units)
        for (_, units), k in zip(stream, repeats):
            if k is not None:
                k[3] = True
                k[2].add(units)

    def _repeats(self, stream: list[tuple[str, list[Unit]]], at: list[int | None], known: bool) -> list[list | None]:
        """For each item that did not align the node that it repeats: that of the item before it, or else after it, if both
        are alike; known: only nodes that are known to repeat."""
        out: list[list | None] = [None] * len(stream)
        for order in (range(len(stream)), range(len(stream) - 1, -1, -1)):
            last = None
            for j in order:
                tag, units = stream[j]
                if at[j] is not None:
                    last = self.nodes[at[j]]
                elif out[j] is not None:
                    last = out[j]
                elif last is not None and last[0] == tag and (last[3] or not known) and last[2].likeness(units) > 0:
                    out[j] = last
                else:
                    last = None
        return out

    def merge(self, other: Wrapper) -> None:
        self.pages += other.pages
        stream = [(tag, slot, seen, again) for tag, seen, slot, again in other.nodes]
        # the share of a slot's values, as often as they were seen, that each node holds too
        places: dict[str, list[int]] = {}
        for i, node in enumerate(self.nodes):
            for k in node[2].values:
                places.setdefault(k, []).append(i)
        shared: list[dict[int, int]] = []
        for _, slot, _, _ in stream:
            own: dict[int, int] = {}
            for k, v in slot.values.items():
                for i in places.get(k, ()):
                    own[i] = own.get(i, 0) + v
            shared.append(own)
        totals = [max(1, sum(slot.values.values())) for _, slot, _, _ in stream]

        def like(i: int, j: int) -> float:
            a, b = self.nodes[i][2], stream[j][1]
            share = shared[j].get(i, 0) / totals[j]
            return a.gain(min(share, b.usual()), b.words / max(1, b.n)) + share

        at = self.match(stream, like)
        for node, (_, slot, _, again) in zip(self._insert(stream, at, lambda item: item[2]), stream):
            node[2].merge(slot)
            node[3] = node[3] or again

    def constants(self) -> dict[str, int]:
        """Units of every value or lead that the slots' summaries hold."""
        out: dict[str, int] = {}
        for _, _, slot, _ in self.nodes:
            for k, v in slot.values.items():
                out[k] = out.get(k, 0) + v
        return out

    def finish(self, everywhere: frozenset[str], counts: dict[str, int], messages: frozenset[str] = frozenset()) -> None:
        """What applying needs: the host's constants and, for each slot, the share of units without any.

        counts: the pages of each value or lead; those on fewer than `least(pages)` pages may be missing. everywhere:
        constants of all hosts; messages: values that recur among the pages of all hosts.
        """
        need = max(2, self.pages * HOST_SHARE)
        self.fixed = {k for k, v in counts.items() if v >= need} | everywhere
        self.often = {k for k, v in counts.items() if v >= least(self.pages)} | messages
        self.content: dict[int, float] = {}
        for node in self.nodes:
            slot = node[2]
            held = slot.formal + sum(v + slot.lost for k, v in slot.values.items() if k in self.fixed)
            self.content[id(node)] = 1 - min(1.0, held / max(1, slot.n))

    def main_lines(self, stream: list[tuple[str, list[Unit]]]) -> list[int]:
        at = self.match(stream, lambda i, j: self.nodes[i][2].likeness(stream[j][1]))
        body: list[Unit] = []
        closed: list[tuple[int, list[Unit]]] = []
        for (_, units), k, again in zip(stream, at, self._repeats(stream, at, True)):
            node = again if k is None else self.nodes[k]
            plain = [not (u.link or u.nav or u.value in self.fixed or u.lead in self.fixed) for u in units]
            # a heading belongs to the body that follows it
            last = max((i for i, (u, p) in enumerate(zip(units, plain)) if p and not u.head), default=-1)
            own = [u for i, (u, p) in enumerate(zip(units, plain)) if (p and not u.head) or (u.head and not (u.link or u.nav) and i < last)]
            words = sum(u.words for u, p in zip(units, plain) if p)
            mostly = 2 * sum(plain) >= len(units)
            # much new text counts as content even where the wrapper has too few pages to tell
            if node is None or self.content[id(node)] >= CONTENT or (mostly and words >= 60):
                body += own
            elif mostly and len(own) > 1:
                closed.append((words, own))
        if not body and closed:
            body = max(closed, key=lambda x: x[0])[1]
        if len(body) == 1 and body[0].value in self.often:
            return []
        return sorted({n for u in body for n in u.lines})

    def pack(self) -> bytes:
        return zlib.compress(pickle.dumps((self.pages, [(t, n, (s.n, s.formal, s.known, s.fresh, s.words, s.lost, s.values), again) for t, n, s, again in self.nodes])), 1)

    @staticmethod
    def unpack(blob: bytes) -> Wrapper:
        out = Wrapper()
        out.pages, nodes = pickle.loads(zlib.decompress(blob))
        for tag, seen, own, again in nodes:
            slot = Slot()
            slot.n, slot.formal, slot.known, slot.fresh, slot.words, slot.lost, slot.values = own
            out.nodes.append([tag, seen, slot, again])
        return out


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, host, content, place, stream): the page's hash, the hash of its url and longest text (the page's hash
    without a url), what is read from it."""
    for batch in batches:
        contents, places, streams = [], [], []
        for url, page in zip(batch.column(2).to_pylist(), batch.column(3)):
            html = page.as_py()
            stream = read(html)
            longest = max((u for _, units in stream for u in units), key=lambda u: (u.words, u.value), default=None)
            contents.append(xxhash.xxh128_digest(html.encode("utf-8", "surrogatepass")))
            places.append(xxhash.xxh128_digest(f"{url}\n{longest.value if longest else ''}".encode("utf-8", "surrogatepass")) if url else contents[-1])
            short = [(tag, [(u.value, u.lead, u.link, u.head, u.nav, u.words, u.lines) for u in units]) for tag, units in stream]
            streams.append(zlib.compress(pickle.dumps(short), 1))
        columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (contents, places, streams))]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "content", "place", "stream"])


def _stream(blob: bytes) -> list[tuple[str, list[Unit]]]:
    """What `_streams` packed."""
    out = []
    for tag, rows in pickle.loads(zlib.decompress(blob)):
        units = []
        for row in rows:
            u = Unit.__new__(Unit)
            u.value, u.lead, u.link, u.head, u.nav, u.words, u.lines = row
            units.append(u)
        out.append((tag, units))
    return out


_LEARNED = "host string, part int, wrapper binary, value string, pages bigint, firsts bigint"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (host, part, first, stream) of different pages, sorted by host and part: a wrapper for each part, and the
    pages of each value or lead of a host.

    firsts: of these pages, those that are on no host before.
    """
    now, own = None, Wrapper()
    counts: dict[tuple[str, str], list[int]] = {}
    names = ["host", "part", "wrapper", "value", "pages", "firsts"]

    def out() -> Iterator[pa.RecordBatch]:
        if now is not None:
            columns = [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int32()), pa.array([own.pack()], pa.binary()), pa.nulls(1, pa.string()), pa.array([own.pages], pa.int64()), pa.nulls(1, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    def counted() -> Iterator[pa.RecordBatch]:
        keys, n = list(counts), list(counts.values())
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), pa.array([k[1] for k in keys], pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in n], pa.int64()) for i in (0, 1))], names)

    for batch in batches:
        for host, part, first, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            stream = _stream(blob.as_py())
            if (host, part) != now:
                yield from out()
                now, own = (host, part), Wrapper()
            own.learn(stream)
            for value in {x for _, units in stream for u in units for x in (u.value, u.lead) if x}:
                n = counts.setdefault((host, value), [0, 0])
                n[0] += 1
                n[1] += first
            if len(counts) > COUNTS:
                yield from counted()
                counts = {}
    yield from out()
    yield from counted()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, part, wrapper, pages). Rows come sorted by host and group; the wrapper of one group is held at a time."""

    def out() -> Iterator[pa.RecordBatch]:
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int32()), pa.array([whole.pack()], pa.binary()), pa.array([whole.pages], pa.int64())], ["host", "part", "wrapper", "pages"])

    now, whole = None, None
    for batch in batches:
        for host, group, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = Wrapper.unpack(blob.as_py())
            if (host, group) == now:
                whole.merge(own)
            else:
                yield from out()
                now, whole = (host, group), own
    yield from out()


def different(parsed: DataFrame) -> DataFrame:
    """(host, page, first, stream) of the different pages among (host, content, place, stream); first: 1 on the first host of a page.

    A page with the same html, or the same url and longest text, as another of its host is the same page, and so are
    copies of either, so what is on a page does not recur by being copied, fetched again or stored twice. Of copies
    the stream that is least, as bytes, stands for all.
    """
    each = parsed.groupBy("host", "content", "place").agg(F.min("stream").alias("stream"))
    each = each.withColumn("page", F.min("content").over(Window.partitionBy("host", "place")))
    once = each.groupBy("host", "content").agg(F.min("page").alias("page"), F.min("stream").alias("stream"))
    once = once.withColumn("first", (F.row_number().over(Window.partitionBy("content").orderBy("host")) == 1).cast("int"))
    return once.groupBy("host", "page").agg(F.max("first").alias("first"), F.min("stream").alias("stream"))


def wrappers(learned: DataFrame, parts: int) -> DataFrame:
    """(host, wrapper, pages) from the parts of each host's wrapper (host, part, wrapper), merged in the order of the
    parts, MERGED at a time, as often as `parts`, the most that a host has, needs."""
    while True:
        groups = learned.select("host", "part", F.floor(F.col("part") / MERGED).cast("int").alias("group"), "wrapper")
        groups = groups.repartition("host", "group").sortWithinPartitions("host", "group", "part").select("host", "group", "wrapper")
        learned = groups.mapInArrow(_merge, "host string, part int, wrapper binary, pages bigint")
        if parts <= MERGED:
            return learned.select("host", "wrapper", "pages")
        parts = -(-parts // MERGED)


def _spread(rows: DataFrame, sizes: DataFrame, size: int, by: str) -> DataFrame:
    """Adds part: rows of a host of more than `size` rows go, by column `by`, to as many parts as it is times as large.

    sizes (host, n): hosts of more than `size` rows only; of these there are at most as many as rows / size. Spark
    broadcasts them if they are few and joins by shuffle otherwise.
    """
    parts = F.ceil(F.coalesce("n", F.lit(1)) / size).cast("int")
    return rows.join(sizes.where(F.col("n") > size), "host", "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("n")


def main_lines(book_pages: DataFrame) -> DataFrame:
    """(page_id, line_no): lines of `html` that hold text of the page's main body.

    Null ids and null pages give no row, nor do pages without a main body; a null or broken url is a host of its own;
    a repeated page_id gives its lines again. The pages of a large host are spread over tasks in proportion, each of
    which gets a copy of the wrapper.
    """
    from .common import cut

    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1), F.lit(""))
    pages = book_pages.where("page_id is not null and html is not null").select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), "url", "html")
    # the only time that pages are parsed; the streams, which are far smaller, are read for learning and for applying
    parsed = cut(pages.mapInArrow(_streams, "page_id bigint, host string, content binary, place binary, stream binary"))
    unlike = cut(different(parsed))
    sizes = unlike.groupBy("host").agg(F.count("*").alias("n"))
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    parts = _spread(unlike, sizes, LEARNED, "page").repartition("host", "part").sortWithinPartitions("host", "part", "page")
    learned = cut(parts.select("host", "part", "first", "stream").mapInArrow(_learn, _LEARNED))
    known = cut(wrappers(learned.where("wrapper is not null").select("host", "part", "wrapper"), -(-most // LEARNED)))
    counts = cut(learned.where("value is not null").groupBy("host", "value").agg(F.sum("pages").alias("n"), F.sum("firsts").alias("firsts")))
    # at most (units on a page) / MESSAGE_SHARE values are on that share of all pages
    total = known.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n")).first().n
    recurring = counts.groupBy("value").agg(F.sum("firsts").alias("f")).where(F.col("f") >= least(total)).collect()
    messages = frozenset(r.value for r in recurring)
    everywhere = frozenset(r.value for r in recurring if r.f >= max(3, total * ALL_SHARE))
    # at most (units on a page) / MESSAGE_SHARE values of a host are on that share of its pages
    often = counts.join(known.select("host", "pages"), "host").where((F.col("n") >= 2) & (F.col("n") >= F.col("pages") * MESSAGE_SHARE))
    often = often.groupBy("host").agg(F.collect_list(F.struct("value", "n")).alias("often"))
    rows = parsed.groupBy("host").agg(F.count("*").alias("rows"))
    known = cut(known.join(often, "host", "left").join(rows, "host"))
    total = known.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    # at most TASKS hosts have more pages than one task is to take
    share = max(total // TASKS, 500)
    large = F.broadcast(known.where(F.col("rows") > share).select("host", F.ceil(F.col("rows") / share).cast("int").alias("copies")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            ids, lines = [], []
            for key, page_id, stream, blob, often in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5)):
                if page_id is None:
                    if key != now:
                        now, own = key, Wrapper.unpack(blob.as_py())
                        own.finish(everywhere, {x["value"]: x["n"] for x in often.as_py() or ()}, messages)
                elif key == now:
                    found = own.main_lines(_stream(stream.as_py()))
                    ids += [page_id] * len(found)
                    lines += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], ["page_id", "line_no"])

    # the wrapper comes first, then the pages of its host
    one = F.coalesce("copies", F.lit(1))
    first = known.join(large, "host", "left").select("host", F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("binary").alias("stream"), "wrapper", "often", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    spread = parsed.join(large, "host", "left").select("host", "page_id", "stream", F.lit(None).cast("binary").alias("wrapper"), F.lit(None).cast("array<struct<value:string,n:bigint>>").alias("often"), F.pmod(F.xxhash64("page_id"), one).cast("int").alias("part"))
    both = first.unionByName(spread).repartition("host", "part").sortWithinPartitions("host", "part", F.col("page_id").asc_nulls_first())
    return both.select("host", "part", "page_id", "stream", "wrapper", "often").mapInArrow(apply, "page_id bigint, line_no bigint")
