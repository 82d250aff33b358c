"""Series from web services as a Spark data source, with retries and a cache keyed by what was asked.

Each request is a partition, so requests spread over tasks. The formats take the addresses from their options; none is built in.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = frozenset((429, 500, 502, 503, 504))


class BodyCache:
    """Bodies by address in a folder that the tasks share, for ``hours`` (for ever if None): a second run asks the service for nothing."""

    def __init__(self, folder: str, hours: float | None = None):
        self.folder, self.hours = Path(folder), hours

    def _file(self, url: str) -> Path:
        name = hashlib.blake2b(url.encode(), digest_size=20).hexdigest()
        return self.folder / name[:2] / name

    def get(self, url: str, load: Callable[[str], bytes]) -> bytes:
        """The body that is kept, or else what ``load`` brings, which is kept from then on; readers never see half a file."""
        kept = self._file(url)
        if kept.exists() and (self.hours is None or time.time() - kept.stat().st_mtime < 3600 * self.hours):
            return kept.read_bytes()
        body = load(url)
        kept.parent.mkdir(parents=True, exist_ok=True)
        fresh = kept.with_suffix(f".{uuid.uuid4().hex}")
        fresh.write_bytes(body)
        fresh.replace(kept)
        return body


def fetch(url: str, tries: int = 3, opener: Callable = urllib.request.urlopen, wait: Callable = time.sleep) -> bytes:
    """The body; what may pass is tried again after 1, 2, 4 ... seconds."""
    for k in range(tries):
        try:
            with opener(url, timeout=30) as reply:
                return reply.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or k == tries - 1:
                raise
        except urllib.error.URLError:
            if k == tries - 1:
                raise
        wait(2**k)
    raise AssertionError("no tries")


class _Request(InputPartition):
    def __init__(self, series: str, url: str):
        self.series, self.url = series, url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Request(s.strip(), self.options["url"].replace("{series}", s.strip())) for s in self.options["series"].split(",")]

    def read(self, partition: _Request) -> Iterator[tuple]:
        import datetime

        date, value = self.options.get("date", "date"), self.options.get("value", "value")
        folder, hours = self.options.get("cache"), self.options.get("cache_hours")
        body = (BodyCache(folder, float(hours) if hours else None).get(partition.url, fetch) if folder else fetch(partition.url)).decode()
        rows = json.loads(body) if self.options.get("form", "csv") == "json" else csv.DictReader(io.StringIO(body))
        for row in rows:
            try:
                number = float(row[value])
            except (TypeError, ValueError):
                number = None
            yield partition.series, datetime.date.fromisoformat(str(row[date])[:10]), number


class WebSeries(DataSource):
    """spark.read.format("web_series").option("url", ".../{series}.csv").option("series", "a,b"): a partition for each series. option("cache", folder) keeps bodies, see BodyCache."""

    @classmethod
    def name(cls) -> str:
        return "web_series"

    def schema(self) -> str:
        return "series_id string, obs_date date, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(WebSeries)
