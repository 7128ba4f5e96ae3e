"""A paged JSON source as a Spark data source: a partition for each shard, pages by their links, offsets when streaming.

A page is an object with ``hits.hits`` (the records), ``hits.total`` and ``links.next``.  A batch read follows each shard's links until
there is no next page, a page is empty, or the shard's limit is reached; a task that is lost reads its shard again.  A stream reads pages
by their number, so many of each shard a batch, and remembers how many it has had; it goes no further than each shard's last page.
What fetches a page is a function of its address; a failed fetch is tried again after a pause that doubles.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry.sources.landing import page_size as within

SCHEMA = "shard string, page int, position int, value string"


def by_http(url: str) -> str:
    """A page over HTTP."""
    with urlopen(Request(url, headers={"Accept": "application/json"}), timeout=60) as answer:  # noqa: S310
        return answer.read().decode()


def numbered(url: str, page: int, size: int) -> str:
    """The address of a page by its number."""
    return f"{url}{'&' if '?' in url else '?'}{urlencode({'size': size, 'page': page})}"


@dataclass(frozen=True)
class Plan:
    """Which shards to read and how: (name, address) of each, how many records of each at most, records a page, tries, first pause."""

    shards: tuple[tuple[str, str], ...]
    fetch: Callable[[str], str] = by_http
    address: Callable[[str, int, int], str] = numbered
    limit: int = 1_000_000
    size: int = 25
    tries: int = 3
    pause: float = 0.2
    pages_a_batch: int = 4


class Shard(InputPartition):
    def __init__(self, name: str, url: str, first: int = 1, last: int | None = None):
        super().__init__(None)
        self.name, self.url, self.first, self.last = name, url, first, last


def fetched(plan: Plan, url: str) -> dict:
    """A page, tried again as often as the plan says; anything that isn't an object is an empty page."""
    for left in range(plan.tries - 1, -1, -1):
        try:
            found = json.loads(plan.fetch(url))
            return found if isinstance(found, dict) else {}
        except (OSError, ValueError):
            if not left:
                raise
            time.sleep(plan.pause * 2 ** (plan.tries - 1 - left))
    return {}


def hits(page: dict) -> list:
    return ((page.get("hits") or {}).get("hits")) or []


def rows(shard: str, page: int, records: Sequence) -> Iterator[tuple]:
    for i, r in enumerate(records):
        yield shard, page, i, json.dumps(r, sort_keys=True)


class Reader(DataSourceReader):
    def __init__(self, plan: Plan):
        self.plan = plan

    def partitions(self) -> Sequence[InputPartition]:
        return [Shard(name, url) for name, url in self.plan.shards]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Shard):  # without shards Spark makes one empty partition
            return
        size, had, number = within(self.plan.size), 0, 1
        url = self.plan.address(partition.url, 1, size)
        while url and had < self.plan.limit:
            page = fetched(self.plan, url)
            found = hits(page)[: self.plan.limit - had]
            yield from rows(partition.name, number, found)
            had, number = had + len(found), number + 1
            url = str((page.get("links") or {}).get("next") or "").strip() if found else ""


class StreamReader(DataSourceStreamReader):
    def __init__(self, plan: Plan):
        self.plan = plan
        self.seen: dict[str, int] = {}
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {name: 0 for name, _ in self.plan.shards}

    def _end(self, name: str, url: str) -> int:
        """The shard's last page as its first one tells it: one small fetch a shard and run."""
        if name not in self.ends:
            size = within(self.plan.size)
            total = int(((fetched(self.plan, self.plan.address(url, 1, size)).get("hits") or {}).get("total")) or 0)
            self.ends[name] = -(-min(total, self.plan.limit) // size)
        return self.ends[name]

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = {name: min(self._end(name, url), self.seen.get(name, 0) + self.plan.pages_a_batch) for name, url in self.plan.shards}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.seen = {name: max(self.seen.get(name, 0), end.get(name, 0)) for name, _ in self.plan.shards}
        return [Shard(name, url, start.get(name, 0) + 1, end[name]) for name, url in self.plan.shards if end.get(name, 0) > start.get(name, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        size = within(self.plan.size)
        for number in range(partition.first, partition.last + 1):
            found = hits(fetched(self.plan, self.plan.address(partition.url, number, size)))
            yield from rows(partition.name, number, found[: self.plan.limit - (number - 1) * size])


def source(plan: Plan, name: str) -> type[DataSource]:
    """The data source of a plan."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader(plan)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
            return StreamReader(plan)

    return Paged


def pages(spark: SparkSession, plan: Plan, name: str = "paged") -> DataFrame:
    """(shard, page, position, value): the records of all shards, value as JSON."""
    spark.dataSource.register(source(plan, name))
    return spark.read.format(name).load()


def page_stream(spark: SparkSession, plan: Plan, name: str = "paged") -> DataFrame:
    spark.dataSource.register(source(plan, name))
    return spark.readStream.format(name).load()
