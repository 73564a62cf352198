"""Paged feeds as a data source: a partition for each feed, drained page after page by the task that has it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from opinara.plans.jobs import drain

#: Gives the rows of a feed's page that begins at an offset, the feed's total if it tells it, and an error.
Fetch = Callable[[str, int], tuple[list[Any], int | None, str | None]]
SCHEMA = "feed string, place long, row string"


class Feed(InputPartition):
    def __init__(self, name: str, start: int, end: int | None) -> None:
        self.name, self.start, self.end = name, start, end


def paged_feeds(name: str, fetch: Fetch, sizes: Callable[[], dict[str, int | None]], size: int = 10, most: int = 200) -> type[DataSource]:
    """A data source of that name over many feeds, to be registered by spark.dataSource.register and read by spark.read.format(name)
    or spark.readStream.format(name): (feed, place, row), row as JSON and place its position among the feed's raw rows.

    sizes() names the feeds, with how many rows each has now or None where that isn't known. A batch drains each feed from its
    beginning by drain's rules: it ends on an error, an empty or short page, at the total, after two pages of blank rows (None), or
    after most pages. A stream's offset is the number of raw rows that it has had of each feed; a batch of it reads up to the
    sizes of now, and a repeated one reads the same rows again; a feed of unknown size is left to batches. Only names and numbers
    pass through the driver: tasks fetch pages. fetch and sizes must be serialisable; a lost task's feed is fetched again.
    """

    def rows(feed: Feed) -> Iterator[tuple[str, int, str]]:
        place = feed.start

        def page(offset: int) -> tuple[list[Any], int | None, str | None]:
            found, told, error = fetch(feed.name, offset)
            cut = found if feed.end is None else found[: feed.end - offset]
            placed = [None if row is None else (offset + i, row) for i, row in enumerate(cut)]
            return placed + [None] * (len(found) - len(cut)), told if feed.end is None else feed.end, error

        for place, row in drain(page, offset=feed.start, size=size, total=feed.end, most=most):
            yield feed.name, place, json.dumps(row, ensure_ascii=False)

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Feed(feed, 0, None) for feed in sorted(sizes())]

        def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
            return rows(partition)

    class StreamReader(DataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802
            return {}

        def latestOffset(self) -> dict:  # noqa: N802
            return {feed: n for feed, n in sizes().items() if n is not None}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Feed(feed, start.get(feed, 0), n) for feed, n in sorted(end.items()) if n > start.get(feed, 0)]

        def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
            return rows(partition)

        def commit(self, end: dict) -> None:
            pass

    class PagedFeeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return StreamReader()

    return PagedFeeds
