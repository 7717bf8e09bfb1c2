"""Incremental monitors: cursors, seen sets with retention or cap, and partial delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def alerts(df: DataFrame, seen: DataFrame, key: str, published: str, baseline_from: Column, mode: str = "newly_published") -> DataFrame:
    """Unseen rows; with newly_published only those published since the baseline, with newly_matching all of them."""
    if mode not in ("newly_published", "newly_matching"):
        raise ValueError(f"unknown alert mode {mode}")
    new = unseen(df, seen, key)
    return new.where(F.col(published) >= baseline_from) if mode == "newly_published" else new


def quality_counters(df: DataFrame, key: str, valid: Column) -> DataFrame:
    """One row (compared, duplicates, without_key, invalid): invalid rows are not compared, nor are those without a key."""
    ok = F.coalesce(valid, F.lit(False))
    per = df.groupBy(key, ok.alias("_ok")).agg(F.count("*").alias("_n"))
    keyed = F.col("_ok") & F.col(key).isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return per.agg(total(keyed).alias("compared"), (total(keyed) - F.count_if(keyed)).alias("duplicates"), total(F.col("_ok") & F.col(key).isNull()).alias("without_key"), total(~F.col("_ok")).alias("invalid"))


def run_report(df: DataFrame, source: str, matched: Column, output: Column, failed: Column) -> DataFrame:
    """(source, n_read, n_matched, n_output, n_failed, status): failed if nothing but failures came, partial with some, else ok."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = df.groupBy(source).agg(F.count("*").alias("n_read"), n(matched).alias("n_matched"), n(output).alias("n_output"), n(failed).alias("n_failed"))
    return out.withColumn("status", F.when(F.col("n_failed") == F.col("n_read"), "failed").when(F.col("n_failed") > 0, "partial").otherwise("ok"))


def next_cursor(page: DataFrame, ts: str, cursor: Column, full: int) -> Column:
    """Where the next read of a change feed starts: the last time of the page, 1 ms later if a full page holds only the cursor's own time.

    Evaluated on the driver from one row; the literal it returns is null for an empty page.
    """
    row = page.agg(F.max(ts).alias("last"), F.count("*").alias("n"), F.count_if(F.col(ts) > cursor).alias("later")).first()
    last = F.lit(row["last"]).cast("timestamp_ntz")
    return last + F.expr("interval 1 millisecond") if row["n"] >= full and not row["later"] else last


def increment(df: DataFrame, ts: str, key: str, cursor: Column, at_cursor: DataFrame) -> DataFrame:
    """Rows from the cursor on, without the ids already delivered at the cursor itself."""
    return df.where(F.col(ts) >= cursor).join(at_cursor.select(key), key, "left_anti")


def retain(first_seen: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return first_seen.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def newest(seen: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The cap newest remembered rows (the cap is the feature)."""
    return seen.orderBy(*order).limit(cap)


def deliver(candidates: DataFrame, seen: DataFrame, key: str, order: list[Column], budget: int) -> tuple[DataFrame, DataFrame]:
    """(delivered, next seen): at most budget unseen rows in order; only delivered ids are remembered."""
    out = unseen(candidates, seen, key).orderBy(*order).limit(budget)
    return out, seen.select(key).union(out.select(key))


def interleaved(changes: DataFrame, kind: str, key: str, most: int) -> DataFrame:
    """changes with ``position``: the first of each kind, then the second of each, up to ``most`` (the preview).

    Every kind is cut to ``most`` rows within its partitions before the rows meet.
    """
    n = F.row_number().over(Window.partitionBy(kind).orderBy(key))
    few = changes.withColumn("_n", n).where(F.col("_n") <= most)
    return few.withColumn("position", F.row_number().over(Window.orderBy("_n", kind))).where(F.col("position") <= most).drop("_n")


def digest(changes: DataFrame, kind: str, key: str, most: int) -> DataFrame:
    """(body): one row: counts of each kind, up to ``most`` lines, and how many more there are."""
    counts = changes.groupBy(kind).agg(F.count("*").alias("_c"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col(kind) == k, F.col("_c"))), F.lit(0)).cast("string")
    more = F.coalesce(F.sum(F.when(F.col(kind) != "unchanged", F.col("_c"))), F.lit(0)) - most
    head = counts.agg(F.concat(of("new"), F.lit(" new, "), of("changed"), F.lit(" changed, "), of("removed"), F.lit(" removed")).alias("_head"), more.alias("_more"))
    few = interleaved(changes.where(F.col(kind) != "unchanged"), kind, key, most)
    line = F.concat(F.lit("- "), F.col(kind), F.lit(": "), F.col(key))
    lines = few.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("t")))), lambda x: x["t"]), "\n").alias("_lines"))
    tail = F.when(F.col("_more") > 0, F.concat(F.lit("…and "), F.col("_more").cast("string"), F.lit(" more")))
    return head.join(F.broadcast(lines)).select(F.concat_ws("\n", "_head", F.when(F.col("_lines") != "", F.col("_lines")), tail).alias("body"))  # one row each


def truncated(previous: DataFrame, current: DataFrame, key: str, most: int) -> DataFrame:
    """(key, kind): new, known or carried, when only the first ``most`` current rows were read.

    What was not read cannot be called removed: previous rows beyond the cut are carried over.
    """
    read = current.select(key).orderBy(key).limit(most).withColumn("_c", F.lit(True))
    both = previous.select(key).withColumn("_p", F.lit(True)).join(read, key, "full_outer")
    return both.select(key, F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "carried").otherwise("known").alias("kind"))
