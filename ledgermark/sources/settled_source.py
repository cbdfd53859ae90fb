"""Settled lines as a data source: ``spark.read.format("settled_lines")``, a partition for each day.

Options: ``transport``, ``module:function`` of a ``fetch(url, auth)`` that executors can import
and that returns the parsed answer; ``base``, ``key_id``, ``key_secret``; ``first`` and ``last``, the
days to read, both included (``yyyy-mm-dd``); ``count``, lines a page. A day is read page by page
until one is short, so no day is cut off, and a day that is tried again gives the same
rows and no others. As a stream, offsets are days: each batch has the days that have
ended since, up to ``last`` if that is given.

Only test keys are taken, and lines without a settlement are left out, as in
:func:`ledgermark.sources.settled.fetch_settled`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgermark.sources.settled import MOST, SCHEMA, TEST_PREFIX


class Day(InputPartition):
    pass


class _Lines:
    """What the batch and the stream reader share: options, and the rows of a day."""

    def __init__(self, options):
        given = dict(options)
        missing = [k for k in ("transport", "base", "key_id", "key_secret", "first") if not given.get(k)]
        if missing:
            raise ValueError(f"missing options: {', '.join(missing)}")
        if not given["key_id"].startswith(TEST_PREFIX):
            raise ValueError("only test keys are allowed")
        self.transport, self.base, self.auth = given["transport"], given["base"], (given["key_id"], given["key_secret"])
        self.first = dt.date.fromisoformat(given["first"])
        self.last = dt.date.fromisoformat(given["last"]) if given.get("last") else None
        self.count = int(given.get("count", 100))
        if not 1 <= self.count <= MOST:
            raise ValueError("count out of range")

    def days(self, first: dt.date, last: dt.date) -> list[InputPartition]:
        return [Day((first + dt.timedelta(i)).isoformat()) for i in range((last - first).days + 1)]

    def read(self, partition):
        import importlib

        module, name = self.transport.split(":")
        fetch = getattr(importlib.import_module(module), name)
        day, skip = dt.date.fromisoformat(partition.value), 0
        while True:
            items = fetch(f"{self.base}?year={day.year}&month={day.month}&day={day.day}&count={self.count}&skip={skip}", self.auth).get("items") or []
            for x in items:
                if x.get("settlement_id"):
                    yield (str(x.get("entity_id")), x["settlement_id"], x.get("type"), int(x.get("credit") or 0), int(x.get("debit") or 0), int(x.get("fee") or 0), x.get("currency"), int(x["settled_at"]) if x.get("settled_at") else None)
            if len(items) < self.count:
                return
            skip += len(items)


class _Batch(_Lines, DataSourceReader):
    def partitions(self):
        if self.last is None:
            raise ValueError("missing options: last")
        return self.days(self.first, self.last)


class _Stream(_Lines, DataSourceStreamReader):
    """Offsets name the first day that is still to come."""

    def initialOffset(self):
        return {"next": self.first.isoformat()}

    def latestOffset(self):
        ended = dt.datetime.now(dt.timezone.utc).date()  # today hasn't
        after = min(ended, self.last + dt.timedelta(1)) if self.last else ended
        return {"next": max(after, self.first).isoformat()}

    def partitions(self, start, end):
        return self.days(dt.date.fromisoformat(start["next"]), dt.date.fromisoformat(end["next"]) - dt.timedelta(1))

    def commit(self, end):
        pass


class SettledLines(DataSource):
    @classmethod
    def name(cls):
        return "settled_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SettledLines)
