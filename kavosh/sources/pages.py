"""Pages as a data source: ``spark.read.format("kavosh_pages")`` calls a fetching function for each URL of a list, in parallel.

The function is named by its module path (``package.module:function``), takes a URL and returns a mapping with any of ``status``,
``headers``, ``html``, ``redirect_urls`` and ``url`` (where it ended up); what it raises becomes the page's ``error``. Nothing here knows
a network: the function does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, request_url string, redirect_urls array<string>, status int, headers map<string,string>, html string, error string, message string, fetched_at timestamp"


class UrlPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetcher, self.size = options["fetcher"], int(options.get("partitionsize", 50))
        self.urls = json.loads(options["urls"])

    def partitions(self) -> list[UrlPartition]:
        return [UrlPartition(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        module, name = self.fetcher.split(":")
        fetch = getattr(import_module(module), name)
        for url in partition.urls:
            now = datetime.now(timezone.utc)
            try:
                page = fetch(url)
                headers = {str(k): str(v[0] if isinstance(v, (list, tuple)) else v) for k, v in (page.get("headers") or {}).items()}  # the first value of each
                yield (page.get("url") or url, url, list(page.get("redirect_urls") or []), page.get("status"), headers, page.get("html"), None, None, now)
            except Exception as e:  # a page that can't be had is a row as well
                yield (url, url, [], None, {}, None, type(e).__name__, str(e), now)


class PageSource(DataSource):
    """Options: urls (a JSON list), fetcher, partitionSize."""

    @classmethod
    def name(cls) -> str:
        return "kavosh_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
