"""Paged sources with a cursor as a Python data source."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(DataSource):
    """``spark.read.format("pages")``: JSON pages that name the next cursor.

    Options: ``url`` (with or without query), or several separated by blanks, each read by its
    own task; ``items`` and ``next``, the dotted paths of the list and of the next cursor;
    ``cursor``, the name of the parameter; ``most``, the items of one url at most.  A row is
    (url, item), the item being a JSON text.  Files serve as pages too: the cursor is then
    the name of the next file beside the first.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, item string"

    def reader(self, schema):  # noqa: ARG002
        return _Reader(self.options)


class _Url(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self):
        return [_Url(u) for u in self.options["url"].split()]

    def read(self, partition) -> Iterator[tuple[str, str]]:
        most, url, left = int(self.options.get("most", 1 << 62)), partition.url, 0
        seen: set[str] = set()
        while url and url not in seen and left < most:
            seen.add(url)
            page = json.loads(_read(url))
            for item in _at(page, self.options.get("items", "results")) or []:
                if left >= most:
                    return
                left += 1
                yield partition.url, json.dumps(item, ensure_ascii=False, sort_keys=True)
            after = _at(page, self.options.get("next", "meta.next_cursor"))
            if not after:
                return
            if not url.startswith(("http:", "https:")):
                url = f"{url.rpartition('/')[0]}/{after}"
            else:
                parts = urllib.parse.urlsplit(partition.url)
                query = dict(urllib.parse.parse_qsl(parts.query)) | {self.options.get("cursor", "cursor"): str(after)}
                url = urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))


def _read(url: str) -> bytes:
    if url.startswith(("http:", "https:")):
        with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
            return r.read()
    from corpusloom.sources.files import _input

    with _input(url) as f:
        return f.read()


def _at(page: object, path: str) -> object:
    for name in path.split("."):
        page = page.get(name) if isinstance(page, dict) else None
    return page


def register(spark) -> None:
    spark.dataSource.register(Pages)
