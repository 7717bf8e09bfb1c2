"""Snapshot queries over orders: two derived snapshots, their diff, its summary and field changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import diff


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("price"), F.col("o_orderpriority").alias("priority"))
    previous = o.where("o_orderkey % 10 <> 0")
    current = o.where("o_orderkey % 7 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)"))
    return previous, current


def _changes(spark: SparkSession, d: str, keep: list[str] | None = None) -> DataFrame:
    return diff.snapshot_diff(*_snapshots(spark, d), ["o_orderkey"], ["o_orderkey"], keep=keep)


_SQL = """
with o as (select o_orderkey, o_orderstatus, round(o_totalprice, 2)::decimal(18,2) as price, o_orderpriority as priority from orders),
p as (select * from o where o_orderkey % 10 <> 0),
c as (select o_orderkey, o_orderstatus, case when o_orderkey % 5 = 0 then price + 1 else price end::decimal(18,2) as price, priority from o where o_orderkey % 7 <> 0),
j as (select coalesce(p.o_orderkey, c.o_orderkey)::varchar as key, case when p.o_orderkey is null then 'new' when c.o_orderkey is null then 'removed' when p.price <> c.price then 'changed' else 'unchanged' end as change_type,
  p.price::varchar as before_price, c.price::varchar as after_price from p full join c on p.o_orderkey = c.o_orderkey)
"""


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d, ["price"]).select("key", "change_type", F.col("before_price").cast("string").alias("before_price"), F.col("after_price").cast("string").alias("after_price"))


def snapshot_summary(spark: SparkSession, d: str) -> DataFrame:
    return diff.summarize_changes(_changes(spark, d, []))


def field_changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.field_changes(_changes(spark, d, ["o_orderstatus", "price", "priority"]), ["o_orderstatus", "price", "priority"])


QUERIES = {"snapshot_diff": snapshot_diff, "snapshot_summary": snapshot_summary, "field_changes": field_changes}
ORACLE = {
    "snapshot_diff": _SQL + "select key, change_type, before_price, after_price from j",
    "snapshot_summary": _SQL + "select count_if(change_type='new') as n_new, count_if(change_type='changed') as n_changed, count_if(change_type='removed') as n_removed, count_if(change_type='unchanged') as n_unchanged, count_if(change_type<>'new') as previous_items, count_if(change_type<>'removed') as current_items from j",
    "field_changes": _SQL + "select key, 'price' as field, before_price as before, after_price as after, 1 as total from j where change_type = 'changed'",
}
