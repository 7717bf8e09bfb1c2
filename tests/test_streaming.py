"""Streams under availableNow give what the batch forms give."""

import datetime
import time

from pyspark.sql import functions as F

from tidewater.sources.seen import SeenStore
from tidewater.streaming import feeds

SCHEMA = "id long, ts timestamp, link string"


def _put(spark, path, rows):
    spark.createDataFrame(rows, "id long, ts string, link string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def _run(writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(90)


def _ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


def test_once_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    _put(spark, src, [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:01:00", "b"), (1, "2024-01-01 00:02:00", "a")])
    _put(spark, src, [(2, "2024-01-01 00:03:00", "b"), (3, "2024-01-09 00:00:00", "c")])
    rows = feeds.read_rows(spark, src, SCHEMA, "ts")
    for name, made in (("once", feeds.once(rows, "ts", ["id"])), ("feeds", feeds.once_across_feeds(rows.withColumn("article", F.lit(" ")), "ts", "article", "link"))):
        _run(made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c_{name}")))
        assert _ids(spark, str(tmp_path / name)) == [1, 2, 3]


def test_monitor(spark, tmp_path):
    src, out, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))

    def run(**kw):
        _run(feeds.monitor_stream(feeds.read_rows(spark, src, SCHEMA, "ts"), out, seen, str(tmp_path / "check"), "id", **kw))

    _put(spark, src, [(i, "2024-01-01 00:00:00", "x") for i in range(5)])
    run()
    assert SeenStore(spark, seen).load("id", "long").count() == 5 and not (tmp_path / "out").exists()  # silent baseline
    _put(spark, src, [(i, "2024-01-02 00:00:00", "x") for i in (3, 4, 5, 6, 7)])
    run(budget=2)
    assert _ids(spark, out) == [5, 6]
    _put(spark, src, [(i, "2024-01-03 00:00:00", "x") for i in (6, 7)])
    run(budget=2)
    assert _ids(spark, out) == [5, 6, 7]  # what the budget cut came back, nothing twice
    batch = spark.createDataFrame([(7,), (8,)], "id long")
    deliver = feeds._delivery(out, seen, "id", None, False, None, None)
    deliver(batch, 9)
    deliver(batch, 9)
    assert _ids(spark, out) == [5, 6, 7, 8]  # a batch run again gives the same rows


def test_sources_apart(spark):
    got = []
    status = feeds.run_sources(spark, {"bad": lambda: 1 / 0, "good": lambda: spark.range(2)}, lambda n, df: got.append((n, df.count())))
    assert got == [("good", 2)] and status["good"] == "ok" and status["bad"].startswith("failed: ZeroDivisionError")


def test_hanging_source_delays_none(spark, tmp_path):
    """One source that never ends is cancelled; the others, more than there are places, are done long before."""
    def slow():
        return spark.range(0, 4, 1, 1).select(F.expr("reflect('java.lang.Thread', 'sleep', 600000L)").alias("x"))

    done = {}
    began = time.monotonic()
    sources = {"hangs": slow} | {f"s{i}": (lambda i=i: spark.range(i + 1)) for i in range(5)}
    status = feeds.run_sources(spark, sources, lambda n, df: done.__setitem__(n, (len(df.collect()), time.monotonic() - began)), together=2, limit=8)
    assert status.pop("hangs").startswith("failed: TimeoutError") and set(status.values()) == {"ok"} and {n: c for n, (c, _) in done.items()} == {f"s{i}": i + 1 for i in range(5)}
    assert all(at < 8 for _, at in done.values()) and time.monotonic() - began < 60


def test_rows_over_the_budget_wait(spark, tmp_path):
    """What a batch could not deliver comes with the next one, though the source does not write it again."""
    schema = "id long, ts timestamp, n int"
    for k, ids in enumerate(([1, 2, 3, 4, 5], [6], [7, 5])):
        spark.createDataFrame([(i, datetime.datetime(2024, 1, 1 + k), i) for i in ids], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    got = []
    for k in range(3):
        rows = feeds.read_rows(spark, f"{tmp_path}/in/{{{','.join(str(i) for i in range(k + 1))}}}", schema, "ts")
        feeds.monitor_stream(rows, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/check", "id", report_all=True, budget=3, order="n").trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [[1, 2, 3], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 7]]
