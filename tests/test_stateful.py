"""Stateful streams and the change feed: restart from the checkpoint, retention, budgets, replays, late rows."""

import datetime
import json

import feed_client
import pytest
from pyspark.sql import functions as F

from tidewater.streaming import change_feed, feeds, stateful

SCHEMA = "id long, ts timestamp, source string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, path, n, rows):
    made = [(i, datetime.datetime.fromisoformat(t), s) for i, t, s in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{path}/{n}")


def run(spark, make, tmp_path, until):
    rows = feeds.read_rows(spark, f"{tmp_path}/in/{{{','.join(str(i) for i in range(until))}}}", SCHEMA, "ts")
    q = make(rows).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return sorted((r["id"], str(r["ts"])[:10]) for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())


def test_first_sightings_with_retention(rocks, tmp_path):
    """Each run is a restart from the checkpoint; a key comes again once the watermark has passed its retention."""
    make = lambda rows: stateful.first_sightings(rows, "id", "ts", days=10)
    put(rocks, f"{tmp_path}/in", 0, [(1, "2024-01-01T00:00:00", "a"), (1, "2024-01-01T01:00:00", "a"), (2, "2024-01-02T00:00:00", "a")])
    assert run(rocks, make, tmp_path, 1) == [(1, "2024-01-01"), (2, "2024-01-02")]
    put(rocks, f"{tmp_path}/in", 1, [(1, "2024-01-05T00:00:00", "a"), (3, "2024-01-05T00:00:00", "a")])
    assert run(rocks, make, tmp_path, 2) == [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-05")]
    put(rocks, f"{tmp_path}/in", 2, [(4, "2024-02-01T00:00:00", "a")])
    run(rocks, make, tmp_path, 3)
    put(rocks, f"{tmp_path}/in", 3, [(1, "2024-02-02T00:00:00", "a"), (4, "2024-02-02T00:00:00", "a")])
    assert run(rocks, make, tmp_path, 4) == [(1, "2024-01-01"), (1, "2024-02-02"), (2, "2024-01-02"), (3, "2024-01-05"), (4, "2024-02-01")]


def test_budget_waits_in_the_state(rocks, tmp_path):
    make = lambda rows: stateful.within_budget(rows, "source", "ts", budget=2)
    put(rocks, f"{tmp_path}/in", 0, [(i, "2024-01-01T00:00:00", "a") for i in range(5)] + [(10, "2024-01-01T00:00:00", "b")])
    first = [i for i, _ in run(rocks, make, tmp_path, 1)]
    assert {10} < set(first) and first[:2] == [0, 1]
    for n in range(1, 5):  # time goes on with rows of another source
        put(rocks, f"{tmp_path}/in", n, [(100 + n, f"2024-01-{n + 1:02d}T00:00:00", "c")])
        got = [i for i, _ in run(rocks, make, tmp_path, n + 1)]
        assert len(got) == len(set(got))
    assert {0, 1, 2, 3, 4, 10} <= set(got)


def feed(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_pages_and_the_millisecond_step():
    class Client(feed_client.FileFeed):
        def __init__(self, rows):
            self.rows = sorted(rows)

    rows = [(t, f"i{k}", "") for t, n in ((1, 3), (2, 1), (5, 2), (9, 4)) for k in range(n)]
    assert list(change_feed.pages(Client(rows), 0, 9, 5)) == rows  # a page ends within one time
    assert list(change_feed.pages(Client(rows), 2, 5, 2)) == rows[3:6]
    crowded = [(1, f"i{k}", "") for k in range(7)] + [(2, "last", "")]
    assert [r[1] for r in change_feed.pages(Client(crowded), 1, 2, 3)] == ["i0", "i1", "i2", "last"]  # the feed gives no more of that time


def test_replay_from_any_offset():
    minute = 60_000
    shown = [(10 * minute * i, f"d{i}", str(i)) for i in range(30)]
    late = [(10 * minute * 9 + 6 * minute, "late", "x")]
    options = {"client": "x:y", "since": "0", "limit": "4"}
    batches, at = [], None
    reader = change_feed.ChangeFeedReader(options)

    def client(rows):
        c = feed_client.FileFeed.__new__(feed_client.FileFeed)
        c.rows = sorted(rows)
        return c

    offset = reader.initialOffset()
    for rows in (shown[:5], shown[:11], shown[:11] + late, shown + late):
        reader._client = lambda rows=rows: client(rows)
        end = reader.latestOffset()
        read = lambda: sorted(r for p in reader.partitions(offset, end) for r in reader.read(p))  # noqa: B023, E731
        first = read()
        reader._client = lambda: client(shown + late)  # the feed has gone on when the batch is run again
        again = read()
        assert again == first
        batches.append(first)
        offset = json.loads(json.dumps(end))
    got = [r for b in batches for r in b]
    assert sorted(got) == sorted(shown + late) and len(got) == len(set(got)) and at is None


def test_stream_of_the_feed(spark, tmp_path):
    spark.dataSource.register(change_feed.ChangeFeed)
    path = tmp_path / "feed.jsonl"
    day = change_feed.DAY

    def run_once():
        rows = spark.readStream.format("change_feed").options(client="feed_client:FileFeed", path=str(path), limit="3").load()
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r["modified"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    rows = [(day * i // 2, f"d{i}", "{}") for i in range(7)]
    feed(path, rows)
    assert run_once() == sorted((a, b) for a, b, _ in rows)
    rows += [(day * 3, "same-time", "{}"), (day * 3 - 1000, "late", "{}"), (day * 5, "d9", "{}")]
    feed(path, rows)
    assert run_once() == sorted((a, b) for a, b, _ in rows)
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("id") == "late").count() == 1
