"""A data source of book pages over HTTP: spark.read.format("book_pages").option("base", ...).option("ids", "1,2").load()."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Book(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class BookPages(DataSource):
    """One task a book. `path` is the template of a page's place under `base`, with {id}."""

    @classmethod
    def name(cls) -> str:
        return "book_pages"

    def schema(self) -> str:
        return "source_id bigint, url string, html string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.path = options["base"].rstrip("/"), options.get("path", "cache/epub/{id}/pg{id}-images.html")
        self.ids = [int(x) for x in options["ids"].split(",") if x.strip()]

    def partitions(self) -> list[_Book]:
        return [_Book(i) for i in self.ids]

    def read(self, partition: _Book) -> Iterator[tuple]:
        from urllib.request import urlopen

        url = f"{self.base}/{self.path.format(id=partition.number)}"
        with urlopen(url, timeout=60) as r:  # noqa: S310
            yield partition.number, url, r.read().decode("utf-8", "replace")


def listed_ids(fetch: Callable[[int], str], per_page: int = 25, pause: float = 1.0) -> list[int]:
    """Book numbers of a paged listing, each once in the order met. fetch(start) gives the page that begins at `start`, from 1.

    The listing ends with a page that adds nothing or that leaves the last one short.
    """
    found: dict[int, None] = {}
    while True:
        before = len(found)
        found |= dict.fromkeys(int(x) for x in re.findall(r"/ebooks/(\d+)", fetch(before + 1)))
        if len(found) == before or len(found) % per_page:
            return list(found)
        time.sleep(pause)
