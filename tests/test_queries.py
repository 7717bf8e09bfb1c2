"""Every registered query of the reference operators against its SQL, and small goldens."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.operators import diff, series, windows
from tidewater.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query(spark, name):
    assert compare(spark, SF, name, catalog.QUERIES[name], catalog.ORACLE[name]) == ""


def test_snapshot_golden(spark):
    cols = "url string, name string, price double, inStock boolean"
    before = spark.createDataFrame([("/1", "Blue mug", 12.5, True), ("/2", "Red mug", 9.9, True), ("/3", "Green mug", 11.0, True), ("/4", "Yellow mug", 10.0, True)], cols)
    after = spark.createDataFrame([("/1", "Blue mug", 10.99, True), ("/2", "Red mug", 9.9, False), ("/3", "Green mug", 11.0, True), ("/5", "Black mug", 14.0, True)], cols)
    changes = diff.snapshot_diff(before, after, ["url"], ["url"])
    assert diff.summarize_changes(changes).first().asDict() == {"n_new": 1, "n_changed": 2, "n_removed": 1, "n_unchanged": 1, "previous_items": 4, "current_items": 4}
    got = {(r["key"], r["field"], r["before"], r["after"]) for r in diff.field_changes(changes, ["name", "price", "inStock"]).collect()}
    assert got == {("/1", "price", "12.5", "10.99"), ("/2", "inStock", "true", "false")}


def test_anchor_golden(spark):
    rows = [(g, t, i, float(v), False) for g, t, vs in ((1, "A", (50, 50)), (1, "big", (100, 100)), (2, "A", (100, 100)), (2, "small", (10, 10))) for i, v in enumerate(vs)]
    values, marks = series.anchor_rescale(spark.createDataFrame(rows, "grp int, term string, ts int, value double, partial boolean"), "A")
    assert {(r["term"], r["value"]) for r in values.collect()} == {("big", 100.0), ("A", 50.0), ("small", 5.0)}
    assert sorted(r["scale"] for r in marks.collect()) == [0.5, 1.0]


def test_text_and_ranges(spark):
    row = spark.range(1).select(tx.html_to_text(F.lit("<p>A&amp;B</p><script>x</script><b>c</b>")).alias("h"), tx.strip_suffix(F.lit("Head - Pub"), F.lit("Pub")).alias("s"), tx.fold(F.lit("Élan  Ñ")).alias("f")).first()
    assert (row["h"], row["s"], row["f"]) == ("A&B\nc", "Head", "elan n")
    df = spark.createDataFrame([("a", n) for n in (3, 1, 2, 7, 7, None)], "k string, n long")
    assert windows.compact_ranges(df, ["k"], "n").first()["ranges"] == "1-3, 7"


def test_ranges_keep_no_map_of_all_values(spark):
    df = spark.createDataFrame([(k, n) for k, ns in (("a", (5, 5, 9, 10, 10, 11, -2)), ("b", (4,)), (None, (1, 2)), ("c", (None,))) for n in ns], "k string, n long")
    got = windows.compact_ranges(df, ["k"], "n")
    assert {r["k"]: r["ranges"] for r in got.collect()} == {"a": "-2, 5, 9-11", "b": "4", None: "1-2"}
    assert " HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_whole_listing_has_every_part(spark):
    got = catalog.QUERIES["whole_listing"](spark, SF)
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert n > 0 and sorted(r["position"] for r in got.collect()) == list(range(1, n + 1))


def test_numbered_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(2.5, 1), (None, 2), (2.1, 3), (0.5, 4), (2.5, 0)], "p double, k int")
    got = windows.numbered(df, [F.asc_nulls_last("p"), "k"]).collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["position"])] == [4, 3, 0, 1, 2]
    assert windows.numbered(df.limit(0), ["p"]).count() == 0


def test_numbered_beyond_latin_letters(spark):
    names = ["až", "b", "ba", "aa", "žx", "z", "", "я", "a\U0001F600"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, _at int")
    got = windows.numbered(df, [F.desc("name")]).collect()
    assert [r["name"] for r in sorted(got, key=lambda r: r["position"])] == sorted(names, key=lambda n: n.encode(), reverse=True)
    assert set(got[0].asDict()) == {"name", "_at", "position"}


def test_numbered_within_keys_and_hot_values(spark):
    rows = [("hot", 1.0, i) for i in range(3000)] + [(None, float(i), i) for i in range(50)] + [(f"k{i % 40}", float(-i), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = windows.numbered(df, ["v"], "n", ["k"], size="of")
        got = out.collect()
        dealt = [f["n"] for f in spark.read.parquet(*{x.rpartition("/")[0] for x in out.inputFiles()}).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["n"], r["v"], r["of"]))
    assert len(got) == len(rows) and len(by) == 42
    for x in by.values():
        x.sort()
        assert [n for n, _, _ in x] == list(range(1, len(x) + 1)) and [v for _, v, _ in x] == sorted(v for _, v, _ in x) and {of for _, _, of in x} == {len(x)}
    assert len(dealt) > 1 and max(dealt) <= 2 * sum(dealt) / len(dealt)  # one value in most rows is spread
