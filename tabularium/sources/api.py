"""A paged JSON search interface as a Spark data source: one input partition per page.

The pages come over HTTP, or from files ``page-N.json`` under a folder, which tests use. Option ``details`` also
fetches each record by its id. Over HTTP a task rests ``page_wait`` seconds after a page and ``item_wait`` before a record.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id bigint, numero int, ano int, tipoescrito string, tiposlug string, titulo string, ementa string, integra string, dataoriginal string, datapublicacao string, url string"
_NAMES = {"tipo_escrito": "tipoescrito", "tipo_slug": "tiposlug", "data_original": "dataoriginal", "data_publicacao": "datapublicacao"}


def fetch(address: str, body: dict | None = None, first_wait: float = 0.4, step: float = 0.15, longest: float = 3.0, tries: int = 20) -> dict | None:
    """The JSON at address; null where the interface has none (404).

    429 waits, longer each time, and tries again, as do errors of the connection and of the server. What still fails
    after the last try is an error: no page and no record goes missing unnoticed.
    """
    wait, last = first_wait, None
    for _ in range(tries):
        request = urllib.request.Request(address, data=None if body is None else json.dumps(body).encode(), headers={"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code != 429 and e.code < 500:
                raise
            last = e
        except urllib.error.URLError as e:
            last = e
        time.sleep(wait)
        wait = min(wait + step, longest)
    raise OSError(f"no answer from {address} after {tries} tries: {last}")


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.columns, self.o = [f.name for f in schema.fields], dict(options)

    def _page(self, n: int) -> dict:
        at = self.o["path"]
        if at.startswith("http"):
            body = {"limit": int(self.o.get("limit", 100)), "page": n, "q": self.o.get("q", ""), "data_inicial": self.o.get("from", "2013-01-01"), "data_final": self.o.get("until", "2021-01-06"), "score_first": False, "cidade": int(self.o.get("city", 0)), "sort": ["ano", "numero"]}
            return fetch(at, body) or {}
        p = Path(at) / f"page-{n}.json"
        return json.loads(p.read_text()) if p.exists() else {}

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(1, int(self._page(1).get("pages") or 0) + 1)]

    def read(self, page: Page) -> Iterator[tuple]:
        for item in self._page(page.number).get("data") or []:
            if self.o.get("details"):
                time.sleep(float(self.o.get("item_wait", 0.5)))
                full = fetch(f"{self.o['details'].rstrip('/')}/{item.get('id')}")
                if full is None:
                    continue  # the interface no longer has it
                item = (full.get("data") or {}).get("norma") or item
            row = {_NAMES.get(k, k): v for k, v in item.items()}
            yield tuple(row.get(c) for c in self.columns)
        if self.o["path"].startswith("http"):
            time.sleep(float(self.o.get("page_wait", 10)))


class SearchSource(DataSource):
    """``spark.dataSource.register(SearchSource)``, then ``spark.read.format("paged_search").load(address)``."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)
