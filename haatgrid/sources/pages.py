"""A paged REST source as a Python data source."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader

#: HTTP answers worth another try.
RETRY = (429, 500, 502, 503, 504)


def pages(fetch: Callable[[int, int], tuple[int, list[dict]]], size: int = 1000, retries: int = 5, most: int = 10_000, wait: float = 0.5) -> Iterator[dict]:
    """Records of a source that may send short pages: the offset moves by what came, an empty page ends it, some failures are tried again
    with growing waits, and a source that never ends is an error. ``fetch(offset, size)`` gives status and records."""
    offset = 0
    for _ in range(most):
        for k in range(retries + 1):
            try:
                status, got = fetch(offset, size)
            except TimeoutError:
                status, got = 503, []
            if status == 200:
                break
            if status not in RETRY or k == retries:
                raise OSError(f"status {status} at offset {offset}")
            time.sleep(wait * 2**k)
        if not got:
            return
        yield from got
        offset += len(got)
    raise OSError(f"no end after {most} pages")


class PagedSource(DataSource):
    """``spark.read.format("paged")`` with options url (may hold {offset} and {size}), fields (a DDL schema) and size."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["fields"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, [f.name for f in schema])


class _Reader(DataSourceReader):
    def __init__(self, options, names: list[str]) -> None:
        self.options, self.names = dict(options), names

    def read(self, partition) -> Iterator[tuple]:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        def fetch(offset: int, size: int) -> tuple[int, list[dict]]:
            try:
                with urlopen(self.options["url"].format(offset=offset, size=size), timeout=30) as r:
                    return r.status, json.load(r).get("records", [])
            except HTTPError as e:
                return e.code, []

        for r in pages(fetch, int(self.options.get("size", 1000))):
            yield tuple(r.get(n) for n in self.names)
