"""The seen store: what a batch writes and reads, merging, lost commits, batches run again, other settings."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from tidewater.sources.seen import SeenStore
from tidewater.streaming import feeds


def _rows(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def _folders(path):
    return sorted(p.name for p in Path(path).iterdir() if p.name != "manifest")


def test_batches_append(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path), parts=8, merge_every=4)
    assert not store.known() and _ids(store.unseen(_rows(spark, [1, 2]), "id", 0)) == [1, 2]
    store.add(_rows(spark, [*range(2000), None, 5]), "id", 0)
    size = sum(f.stat().st_size for f in Path(tmp_path, "gen=batch-000000000000").rglob("*.parquet"))
    store.add(_rows(spark, [5000]), "id", 1)
    added = list(Path(tmp_path, "gen=batch-000000000001").rglob("*.parquet"))
    assert len(added) == 1 and added[0].stat().st_size < size / 4  # a batch writes its own keys only
    assert _ids(store.unseen(_rows(spark, [7, 5000, 6000, 6000]), "id", 2)) == [6000, 6000]
    assert _ids(store.unseen(_rows(spark, [7, 5000, 6000]), "id", 1)) == [5000, 6000]  # its own keys do not count
    plan = store.unseen(_rows(spark, [5000]), "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:200]
    assert store.load("id", "long").count() == 2001


def test_merging_and_retention(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path), parts=4, merge_every=3)
    store.add(_rows(spark, range(500)), "id", 0)
    for b in range(1, 10):
        store.add(_rows(spark, [1000 + b, 1]), "id", b)
        assert len(_folders(tmp_path)) <= 4  # old generations go
    assert "gen=batch-000000000000" in _folders(tmp_path)  # the large one is not written again for a few keys
    seen = store.load("id", "long")
    assert seen.select("id").distinct().count() == 509 and len(os.listdir(tmp_path / "manifest")) <= 2 + sum(n.startswith(".") or n.startswith("_") for n in os.listdir(tmp_path / "manifest"))
    for b in (10, 11):
        store.add(_rows(spark, range(2000 + 300 * b, 2300 + 300 * b)), "id", b)
    for _ in range(2):
        store.merge("id", "bigint")
    assert [f.split("-")[0] for f in _folders(tmp_path)] == ["gen=merged"] and store.load("id", "long").count() == 1109
    store.merge("id", "bigint", since=F.current_timestamp())
    assert store.load("id", "long").count() == 0 and store.known()


def test_lost_before_the_commit(spark, tmp_path, monkeypatch):
    store = SeenStore(spark, str(tmp_path))
    store.add(_rows(spark, [1]), "id", 0)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(SeenStore, "_commit", lost)
        try:
            store.add(_rows(spark, [2]), "id", 1)
        except RuntimeError:
            pass
    again = SeenStore(spark, str(tmp_path))
    assert _ids(again.unseen(_rows(spark, [1, 2]), "id", 1)) == [2]  # what was written without a commit does not count
    again.add(_rows(spark, [2]), "id", 1)
    again.add(_rows(spark, [2]), "id", 1)
    assert sorted(r["id"] for r in again.load("id", "long").collect()) == [1, 2]


def test_monitor_lost_between_results_and_keys(spark, tmp_path, monkeypatch):
    deliver = feeds._delivery(f"{tmp_path}/out", f"{tmp_path}/seen", "id", None, True, None, None)
    deliver(_rows(spark, [1, 2]), 0)
    with monkeypatch.context() as m:
        m.setattr(SeenStore, "add", lambda *a, **k: 1 / 0)
        try:
            deliver(_rows(spark, [2, 3]), 1)
        except ZeroDivisionError:
            pass
    deliver(_rows(spark, [2, 3]), 1)
    deliver(_rows(spark, [3, 4]), 2)
    assert _ids(spark.read.parquet(f"{tmp_path}/out")) == [1, 2, 3, 4]


def test_other_settings_begin_anew(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path))
    store.add(_rows(spark, [1, 2]), "id", 0, settings="a")
    assert store.known("a") and not store.known("b") and _ids(store.unseen(_rows(spark, [1, 9]), "id", 1, "b")) == [1, 9]
    store.add(_rows(spark, [9]), "id", 1, settings="b")
    assert _ids(store.load("id", "long")) == [9] and _folders(tmp_path) == ["gen=batch-000000000001"]


def test_snapshot_in_buckets(spark, tmp_path):
    """The stored side of a comparison is read without an exchange or sort; generations go; settings begin anew."""
    from tidewater.operators import diff
    from tidewater.sources.store import SnapshotTable

    store = SnapshotTable(spark, str(tmp_path), "tidewater_test_snap", buckets=8)
    crawl = lambda shift: spark.range(5000).select((F.col("id") + shift).alias("id"), (F.col("id") % (7 + shift)).alias("v"))
    assert store.load() is None
    first, second = (diff.prepared(crawl(s), ["id"], ["id"], keep=["v"]) for s in (0, 3))
    store.save(first, "a")
    assert store.load("b") is None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = diff.diff_prepared(store.load("a"), second)
        got = {r["change_type"]: r["count"] for r in joined.groupBy("change_type").count().collect()}
        want = {r["change_type"]: r["count"] for r in diff.diff_prepared(first, second).groupBy("change_type").count().collect()}
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and got["new"] == got["removed"] == 3
    stored = next(part for part in plan.split("SortMergeJoin")[1].split("Sort [") if "Bucketed: true" in part)
    assert "Exchange" not in plan[: plan.index("Bucketed: true")].split("SortMergeJoin")[1] and stored
    for _ in range(3):
        store.save(diff.prepared(crawl(3), ["id"], ["id"], keep=["v"]), "a")
    assert sorted(t.name for t in spark.catalog.listTables() if t.name.startswith("tidewater_test_snap")) == ["tidewater_test_snap_3", "tidewater_test_snap_4"]
    for t in ("tidewater_test_snap_3", "tidewater_test_snap_4"):
        spark.sql(f"drop table {t}")
