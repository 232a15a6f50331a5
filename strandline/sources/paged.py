"""A source of pages with offsets of its own: what a provider's paged interface is to a stream.

Options: ``streams`` (comma-separated), ``pager`` (``module:class``), ``pages_at_once``, and whatever the pager reads.  A
pager is made from the options in each task; ``head(stream)`` is the number of pages that are complete by
now, ``page(stream, n)`` the bodies of one of them.  Offsets are the next page of each stream, so that a page
is read again whenever a batch is, and always as the same rows.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stream string, page bigint, position bigint, body string"


class Pager(Protocol):
    def head(self, stream: str) -> int: ...

    def page(self, stream: str, number: int) -> list[str]: ...


class FolderPager:
    """Pages as files ``<root>/<stream>/<number>.json`` in a folder that driver and executors share, each a JSON array."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = Path(options["root"])

    def head(self, stream: str) -> int:
        n = 0
        while (self.root / stream / f"{n}.json").exists():
            n += 1
        return n

    def page(self, stream: str, number: int) -> list[str]:
        return [json.dumps(x) for x in json.loads((self.root / stream / f"{number}.json").read_text())]


def pager_of(options: dict[str, str]) -> Pager:
    module, _, name = options.get("pager", "strandline.sources.paged:FolderPager").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Page(InputPartition):
    def __init__(self, stream: str, number: int) -> None:
        self.stream, self.number = stream, number


class PagedReader(DataSourceStreamReader):
    """Offsets are ``{stream: next page}``; every page is a partition of its own, so that tasks read them side by side."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.streams = [s for s in options["streams"].split(",") if s]
        self.most = int(options.get("pages_at_once", "64"))
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.streams, 0)

    def latestOffset(self) -> dict:  # noqa: N802
        pager = pager_of(self.options)
        for s in self.streams:
            self.at[s] = min(pager.head(s), self.at.get(s, 0) + self.most)
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = {s: max(n, self.at.get(s, 0)) for s, n in end.items()}  # a restart goes on from what the checkpoint has
        return [Page(s, n) for s in sorted(end) for n in range(start.get(s, 0), end[s])]

    def read(self, partition: Page) -> Iterator[tuple]:
        for k, body in enumerate(pager_of(self.options).page(partition.stream, partition.number)):
            yield partition.stream, partition.number, k, body

    def commit(self, end: dict) -> None:
        """What was read is kept by the store that it went to; the provider needs no word of it."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PagedReader:  # noqa: ANN001, N802
        return PagedReader(dict(self.options))
