"""Seen sets and budgets as state of a stream: nothing is read back from folders, and a restart goes on from the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstSeen(StatefulProcessor):
    """The time a key was first seen; it is forgotten a retention after that, by an event-time timer."""

    def __init__(self, ts: str, retention_ms: int):
        self.ts, self.retention = ts, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.exists()
        least = None
        for pdf in rows:  # Spark hands a key's rows over in parts
            if not known and len(pdf):
                best = pdf.sort_values(list(pdf.columns), kind="stable").nsmallest(1, self.ts, keep="first")
                least = best if least is None or best[self.ts].iloc[0] < least[self.ts].iloc[0] else least
        if least is not None:
            at = int(least[self.ts].iloc[0].timestamp() * 1000)
            self.first.update((at,))
            self.handle.registerTimer(at + self.retention)
            yield least

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_sightings(stream: DataFrame, key: str, ts: str, days: int, late: str = "5 minutes") -> DataFrame:
    """The first row of each key that was not seen within ``days`` of event time before; of a batch's rows the earliest.

    State is a time a key, kept until the watermark passes it by the retention. Rows later than ``late`` go; rows with a
    null key are one key.
    """
    out = stream.withWatermark(ts, late)
    return out.groupBy(key).transformWithStateInPandas(_FirstSeen(ts, days * 86_400_000), outputStructType=stream.schema, outputMode="Append", timeMode="EventTime")


class _Budget(StatefulProcessor):
    """A queue a source: rows wait by number, and a batch takes the next ones up to the budget."""

    def __init__(self, schema: str, columns: list[str], budget: int):
        self.schema, self.columns, self.budget = schema, columns, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "head long, tail long")
        self.waiting = handle.getMapState("waiting", "n long", self.schema)

    def _delivered(self, tail: int, timerValues) -> Iterator[pd.DataFrame]:
        head = self.ends.get()[0] if self.ends.exists() else 0
        until = min(tail, head + self.budget)
        rows = [self.waiting.getValue((n,)) for n in range(head, until)]
        for n in range(head, until):
            self.waiting.removeKey((n,))
        self.ends.update((until, tail))
        if until < tail:  # the rest comes when time has gone on, or with the next rows of the source
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        if rows:
            yield pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(self.columns)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail = self.ends.get()[1] if self.ends.exists() else 0
        if not self.ends.exists():
            self.ends.update((0, 0))
        for pdf in rows:
            for row in pdf[self.columns].sort_values(self.columns, kind="stable").itertuples(index=False, name=None):
                self.waiting.updateValue((tail,), tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row))
                tail += 1
        yield from self._delivered(tail, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._delivered(self.ends.get()[1] if self.ends.exists() else 0, timerValues)

    def close(self) -> None:
        pass


def within_budget(stream: DataFrame, source: str, ts: str, budget: int, late: str = "5 minutes") -> DataFrame:
    """At most ``budget`` rows of each source a batch, first come first served; the others wait in the state.

    Waiting rows come with later batches of the stream, whether or not their source has new rows. A batch reads and
    writes its own rows and those that it delivers, never the whole queue. A source is one task's work a batch, so name
    sources by part where one may hold most rows.
    """
    columns = stream.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    out = stream.withWatermark(ts, late).groupBy(source)
    return out.transformWithStateInPandas(_Budget(schema, columns, budget), outputStructType=stream.schema, outputMode="Append", timeMode="EventTime")
