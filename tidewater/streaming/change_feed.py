"""A change feed by modified time as a streaming source: ``spark.readStream.format("change_feed")``.

The feed is asked through a client that the ``client`` option names (``module:callable``); called with the options it
returns an object with ``page(since_ms, limit)``: the first records (ms, id, body) with ms >= since_ms in order of time
and id, and ``newest()``: the time of the last record, or None. Executors read windows of time side by side.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "modified long, id string, body string"
DAY = 86_400_000


class _Window(InputPartition):
    def __init__(self, since: int, until: int, known: dict[str, int], final: dict[str, int] | None):
        self.since, self.until, self.known, self.final = since, until, known, final


def pages(client, since: int, until: int, limit: int) -> Iterator[tuple[int, str, str]]:
    """All records from ``since`` to ``until``, both included, each once.

    The cursor is inclusive: ids met at its time are not given twice. A full page of one time only means that more may
    stand there than a page holds; the cursor then steps on by a millisecond, as the feed offers no other way.
    """
    at, met = since, set()
    while True:
        page = client.page(at, limit)
        new = [r for r in page if r[0] <= until and not (r[0] == at and r[1] in met)]
        yield from new
        last = page[-1][0] if page else until + 1
        if not page or last > until or len(page) < limit:
            return
        if last == at:
            at, met = at + 1, set()
        else:
            at, met = last, {r[1] for r in page if r[0] == last}


class ChangeFeedReader(DataSourceStreamReader):
    """Offsets are the time reached and the records of the last ``overlap`` before it, which is read again for late ones.

    A batch holds the records between two offsets without those that the first one knows; near its end it holds only
    those that the second one knows. So a replay of any batch gives the same records, and each revision comes once,
    however late within the overlap it appears.
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.since, self.limit = int(options.get("since", 0)), int(options.get("limit", 100))
        self.overlap, self.window = int(options.get("overlapms", 300_000)), int(options.get("windowdays", 1)) * DAY

    def _client(self):
        module, name = self.options["client"].split(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def initialOffset(self) -> dict:
        return {"at": self.since - 1, "recent": "{}"}

    def latestOffset(self) -> dict:
        client = self._client()
        newest = client.newest()
        if newest is None or newest < self.since:
            return self.initialOffset()
        recent = {f"{i}@{ms}": ms for ms, i, _ in pages(client, max(self.since, newest - self.overlap), newest, self.limit)}
        return {"at": newest, "recent": json.dumps(recent, sort_keys=True)}  # bounded by the feed's rate times the overlap

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known, final = json.loads(start["recent"]), json.loads(end["recent"])
        first, edge = max(self.since, start["at"] - self.overlap if start["at"] >= self.since else self.since), end["at"] - self.overlap
        out = [_Window(a, min(a + self.window, edge) - 1, known, None) for a in range(first, edge, self.window)]
        return [*out, _Window(max(first, edge), end["at"], known, final)]

    def read(self, partition: _Window) -> Iterator[tuple]:
        for ms, i, body in pages(self._client(), partition.since, partition.until, self.limit):
            name = f"{i}@{ms}"
            if name not in partition.known and (partition.final is None or name in partition.final):
                yield (ms, i, body)

    def commit(self, end: dict) -> None:
        pass


class ChangeFeed(DataSource):
    """Options: client, since (ms), limit (records a page), overlapMs (300,000) and windowDays (1)."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeFeedReader(self.options)
