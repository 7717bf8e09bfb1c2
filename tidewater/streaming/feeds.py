"""Streams of records: repeats, first sightings with retention, windows, and monitors that deliver batch by batch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewater.operators import monitor, windows
from tidewater.scratch import delete
from tidewater.sources.seen import SeenStore


def read_rows(spark: SparkSession, path: str, schema: str, ts: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream; ``ts`` becomes a timestamp with zone, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def once(stream: DataFrame, ts: str, keys: list[str], late: str = "5 minutes") -> DataFrame:
    """The first row of each key; repeats within ``late`` of it are dropped, and the state forgets it afterwards.

    With a delay of "180 days" this is a seen-set with retention.
    """
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def once_across_feeds(stream: DataFrame, ts: str, article: str, link: str, late: str = "1 day") -> DataFrame:
    """One row an article over all feeds: by id, or by link where there is none."""
    return once(stream.withColumn("_article", F.coalesce(F.nullif(F.trim(article), F.lit("")), link)), ts, ["_article"], late).drop("_article")


def day_windows(stream: DataFrame, ts: str, days: int, late: str = "5 minutes") -> DataFrame:
    """(start, until, n): rows in each window of ``days`` days, final once the watermark has passed."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, f"{days} days").alias("w")).agg(F.count("*").alias("n"))
    return counts.select("w.start", F.col("w.end").alias("until"), "n")


def _waiting(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows that the last batch before this one left undelivered."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path).where(F.col("batch") < batch_id)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    last = rows.agg(F.max("batch").alias("b")).first()["b"]
    return None if last is None else rows.where(F.col("batch") == last).drop("batch")


def _delivery(results: str, store_path: str, key: str, settings: str | None, report_all: bool, budget: int | None, order: str | None) -> Callable[[DataFrame, int], None]:
    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = SeenStore(spark, store_path)
        target, left = f"{results}/batch={batch_id}", f"{store_path}/waiting"
        waiting = _waiting(spark, left, batch_id) if budget is not None else None
        if batch.isEmpty() and waiting is None:
            return  # an empty source never means that all rows are gone
        rows = windows.top_n(batch if waiting is None else batch.unionByName(waiting.select(batch.columns)), [key], [order or key], 1, "_n").drop("_n")
        if not store.known(settings) and not report_all:
            store.add(rows, key, batch_id, settings=settings)
            return
        new = store.unseen(rows, key, batch_id, settings)  # a batch that is run again delivers the same rows again
        out = new if budget is None else new.orderBy(order or key, key).limit(budget)
        out.write.mode("overwrite").parquet(target)
        done = spark.read.schema(out.schema).parquet(target)
        if budget is not None:  # what is over the budget waits for the next batch
            monitor.unseen(new, done, key).write.mode("overwrite").parquet(f"{left}/batch={batch_id}")
        store.add(done, key, batch_id, settings=settings)
        if budget is not None:
            delete(spark, f"{left}/batch={batch_id - 2}")

    return deliver


def monitor_stream(stream: DataFrame, results: str, store_path: str, checkpoint: str, key: str, settings: str | None = None, report_all: bool = False, budget: int | None = None, order: str | None = None) -> DataStreamWriter:
    """A writer that delivers keys never seen before to ``results``, a folder a batch.

    The first batch is a silent baseline unless ``report_all``; other settings make a new one. Results are
    written first (overwriting the folder of the batch), then the batch's keys are added to the seen ones; after a
    failure the batch runs again and gives the same rows. A batch writes as much as it delivers, and reads the parts
    of the seen set that its keys fall in. With a ``budget`` only that many rows of a batch
    are delivered, and only those are remembered: the rest is kept beside the store and comes with the next batch.
    Of rows with one key the first in ``order`` counts.
    """
    return stream.writeStream.foreachBatch(_delivery(results, store_path, key, settings, report_all, budget, order)).option("checkpointLocation", checkpoint)


def run_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], each: Callable[[str, DataFrame], None], together: int = 8, limit: float | None = None) -> dict[str, str]:
    """Sources side by side, each in its own scheduler pool: what failed is reported by name, and none delays another.

    ``together`` sources run at once; one that takes more than ``limit`` seconds has its jobs cancelled, counts as failed
    and gives its place to the next. A source that fails keeps no state, so its baseline is still to be made at the next
    run. Pools share the cluster where spark.scheduler.mode is FAIR.
    """
    sc, status, run = spark.sparkContext, {}, uuid.uuid4().hex
    waiting, running = list(sources), {}

    def work(name: str) -> None:
        sc.setLocalProperty("spark.scheduler.pool", f"source-{name}")
        sc.addJobTag(f"{run}-{list(sources).index(name)}")
        try:
            each(name, sources[name]())
            status.setdefault(name, "ok")
        except Exception as e:  # noqa: BLE001 - the status of a source is the result here
            status.setdefault(name, f"failed: {type(e).__name__}: {str(e)[:300]}")

    while waiting or running:
        while waiting and len(running) < together:
            name = waiting.pop(0)
            thread = InheritableThread(target=work, args=(name,), session=spark)
            thread.daemon = True
            thread.start()
            running[name] = (thread, time.monotonic())
        for name, (thread, began) in list(running.items()):
            if not thread.is_alive():
                thread.join()
                del running[name]
            elif limit is not None and time.monotonic() - began > limit:
                status[name] = f"failed: TimeoutError: over {limit:g} seconds"
                sc.cancelJobsWithTag(f"{run}-{list(sources).index(name)}")
                del running[name]
        time.sleep(0.02)
    return {name: status[name] for name in sources}


def coverage(rows: DataFrame, ts: str, since: str | None = None, keys: list[str] | None = None, truncated: Column | None = None) -> DataFrame:
    """(keys, scanned_from, scanned_to, n, reached, reason): what a run covered, and whether it got back to ``since``.

    One grouped pass over the rows, whatever the number of keys. ``truncated`` marks rows of a page that was cut; where
    ``since`` was not reached the reason is ``truncated`` if there are any, else ``end of feed``.
    """
    reached = F.lit(True) if since is None else F.coalesce(F.min(ts) <= F.lit(since).cast("timestamp_ntz"), F.lit(False))
    cut = F.lit(False) if truncated is None else F.coalesce(F.max(truncated), F.lit(False))
    reason = F.when(~reached, F.when(cut, "truncated").otherwise("end of feed"))
    return rows.groupBy(*(keys or [])).agg(F.min(ts).alias("scanned_from"), F.max(ts).alias("scanned_to"), F.count("*").alias("n"), reached.alias("reached"), reason.alias("reason"))
