"""Registered queries over what is written and read again: record files, snapshots, histories, sinks and the seen store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import diff
from tidewater.plans.records import _t
from tidewater.plans.registry import registry
from tidewater.scratch import session_folder
from tidewater.sources import items, store
from tidewater.sources.seen import SeenStore

QUERIES, ORACLE, query = registry()


@query("select case when p_size % 2 = 0 then 'lines' else 'csv' end as form, p_partkey::varchar as id, p_name as name, p_type as type from part")
def items_read(spark, d):
    """Parts as JSON Lines and as CSV with blanks around its headers, told apart and read back."""
    folder = session_folder(spark)
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), "p_size")
    p.where("p_size % 2 = 0").drop("p_size").write.json(f"{folder}/lines")
    p.where("p_size % 2 <> 0").select(F.col("id").alias(" id "), F.col("name").alias("name "), "type").write.csv(f"{folder}/csv", header=True)
    read = lambda form: items.read_items(spark, f"{folder}/{form}").select(F.lit(form).alias("form"), "id", "name", "type")
    return read("lines").unionByName(read("csv"))


@query("select generation, n from (select 1::bigint as generation, count(*) as n from orders where o_orderkey % 2 = 0 union all select 2, count(*) from orders where o_orderkey % 3 = 0 or o_orderkey % 2 = 0 union all select 3, 0)")
def snapshot_generations(spark, d):
    """Two generations, the second made from the first; other settings find none."""
    s = store.SnapshotStore(spark, session_folder(spark))
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    s.save(o.where("o_orderkey % 2 = 0"), "a")
    first = s.load("a").agg(F.lit(1).cast("long").alias("generation"), F.count("*").alias("n"))
    s.save(s.load("a").unionByName(o.where("o_orderkey % 3 = 0")).distinct(), "a")
    none = F.lit(0 if s.load("b") is None else 1).cast("long")
    return first.union(s.load("a").agg(F.lit(2).cast("long"), F.count("*"))).union(spark.range(1).select(F.lit(3).cast("long"), none))


@query("select p_partkey, day, case when p_size % 5 <> 0 or day = '2024-01-02' then p_retailprice end as price from part, (select unnest(['2024-01-01', '2024-01-02']) as day)")
def price_history(spark, d):
    """Two checks of prices as a history by day; a missing price stays a row."""
    folder = session_folder(spark)
    p = _t(spark, d, "part")
    for day in ("2024-01-01", "2024-01-02"):
        price = F.when((F.col("p_size") % 5 != 0) | F.lit(day == "2024-01-02"), F.col("p_retailprice"))
        store.append_history(p.select("p_partkey", price.alias("price"), F.lit(day).alias("day")), folder, "day")
    return spark.read.parquet(folder).select("p_partkey", F.col("day").cast("string").alias("day"), "price")


@query("select p_partkey::varchar as id, p_name as name, null as error from part where p_size % 4 <> 0 union all select p_partkey::varchar, null, 'no size' from part where p_size % 4 = 0")
def results_and_errors(spark, d):
    """Results and error rows in one folder of JSON with fixed columns."""
    folder = session_folder(spark)
    p = _t(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string"))
    good, bad = p.where("p_size % 4 <> 0").select("id", F.col("p_name").alias("name")), p.where("p_size % 4 = 0").select("id", F.lit("no size").alias("error"))
    store.write_results(good, bad, f"{folder}/out", ["id", "name", "error"], "json")
    return spark.read.schema("id string, name string, error string").json(f"{folder}/out")


@query("select event_id from events where event_id % 3 = 1 and event_id % 2 = 0")
def seen_by_batches(spark, d):
    """Batches of events against a growing set of seen ones: what the third batch brings that neither of the others had."""
    s = SeenStore(spark, session_folder(spark), parts=8, merge_every=2)
    e = _t(spark, d, "events").select("event_id")
    for n, where in enumerate(("event_id % 3 = 0", "event_id % 2 = 1", "event_id % 3 = 2")):
        s.add(s.unseen(e.where(where), "event_id", n), "event_id", n)
    return s.unseen(e.where("event_id % 2 = 0"), "event_id", 3)


@query("select change_type, count(*) as n from (select case when a.o_orderkey is null then 'new' when b.o_orderkey is null then 'removed' when b.o_orderkey % 5 = 0 then 'changed' else 'unchanged' end as change_type from (select o_orderkey from orders where o_orderkey % 10 <> 0) a full join (select o_orderkey from orders where o_orderkey % 7 <> 0) b on a.o_orderkey = b.o_orderkey) group by 1")
def bucketed_diff(spark, d):
    """A crawl against a snapshot stored by buckets of its key."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    side = lambda df: diff.prepared(df, ["o_orderkey"], ["o_orderkey"], ["o_custkey"], keep=[])
    folder = session_folder(spark)
    kept = store.SnapshotTable(spark, folder, "tidewater_" + folder.rpartition("-")[2], buckets=8)
    kept.save(side(o.where("o_orderkey % 10 <> 0")))
    current = o.where("o_orderkey % 7 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return diff.diff_prepared(kept.load(), side(current)).groupBy("change_type").agg(F.count("*").alias("n"))
