"""SQL table functions against the DataFrame forms, nested Markdown, urls, entities, addresses and parties."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from tidewater.functions import auctions, markdown, tables, terms
from tidewater.functions import records as rc
from tidewater.functions import text as tx
from tidewater.functions import variants as va
from tidewater.operators import documents as dc
from tidewater.operators import listing
from tidewater.plans import catalog
from tidewater.sources import links

STATES = ("FL", "KY", "CA")


def test_chunk_document(spark):
    tables.register(spark)
    rows = [(i, "g", "# One\n\n" + "A sentence of words. " * (5 * i) + "\n\n## Two\n\n" + "word " * 60) for i in range(1, 6)] + [(9, "g", "")]
    blocks = dc.md_blocks(spark.createDataFrame(rows, "doc_id int, grp string, text string"), ["doc_id", "grp"])
    dc.pathed_blocks(blocks, ["doc_id", "grp"]).createOrReplaceTempView("test_blocks")
    for mode in ("fixed", "heading", "none"):
        want = {tuple(r) for r in dc.chunk_blocks(blocks, ["doc_id", "grp"], mode, 200, 40).collect()}
        assert {tuple(r) for r in spark.sql(f"select * from chunk_document(table(test_blocks), '{mode}', 200, 40)").collect()} == want
    with pytest.raises(Exception, match="unknown mode"):
        spark.sql("select * from chunk_document(table(test_blocks), 'other')").collect()


def test_flatten_changes(spark):
    tables.register(spark)
    pairs = [('{"a":{"b":1,"c":[1]},"x":"t"}', '{"x":"t","a":{"c":[1,2],"b":1}}'), ("[1]", "{}"), ('{"a":null}', "{}"), ('{"b":1,"a":1}', '{"c":2}'), (None, '{"a":1}'), ("{", "{}")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, b string, a string")
    df.createOrReplaceTempView("test_pairs")
    got = {tuple(r) for r in spark.sql("select k, f.* from test_pairs, lateral flatten_changes(b, a, 2) f").collect()}
    c = df.select("k", va.nested_changes(F.try_parse_json("b"), F.try_parse_json("a"), most=2).alias("c")).select("k", "c.total", F.explode("c.changes").alias("f"))
    assert got == {(r["k"], r["field"], r["before"], r["after"], r["total"]) for r in c.select("k", "f.*", "total").collect()} and len(got) == 6


def test_nested_markdown(spark):
    html = "<main><p>short</p></main><ul><li>a<ol><li>b<ul><li>c</ul></ol><li>d</ul><p>one<p>two <i>x</i><pre>a\n\n\n  b</pre><table><tr><td>1<td>2<tr><td>3</table><span role='banner'>no <b>none</b></span>"
    long = "<title>T</title><div>out</div><article><h2>In</h2>" + "<p>word word word</p>" * 30 + "<article>inner " + "x " * 150 + "</article></article>"
    odd = "<li>loose</li></ul></p><a href='ftp://x'>f</a><a href='http://x'></a><ol start='x'><li>n</ol><td>cell"
    r = spark.createDataFrame([(html,), (long,), (odd,), (None,), ("",)], "h string").select(markdown.page_markdown(F.col("h")).alias("m")).collect()
    assert r[0]["m"]["markdown"] == "short\n\n- a\n  1. b\n     - c\n- d\n\none\n\ntwo *x*\n\n```\na\n\n\n  b\n```\n\n| 1 | 2 |\n| --- | --- |\n| 3 |  |"
    assert r[1]["m"]["title"] == "T" and r[1]["m"]["markdown"].startswith("## In\n\nword") and "out" not in r[1]["m"]["markdown"] and "inner" in r[1]["m"]["markdown"]
    assert "1. n" in r[2]["m"]["markdown"] and "ftp" not in r[2]["m"]["markdown"] and r[3]["m"]["markdown"] is None and r[4]["m"]["markdown"] == ""


def test_urls(spark):
    given = ["example.com", " http://a.b/c ", "//host.org/x", "localhost:8080/a", "mailto:a@b.com", "word", "ftp://a.b", "http://[::1]:80/", "a.b:99", "https://u:p@c.d/?q", "javascript:alert(1)", "http://a b.c", "", "http://.com"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    got = [r["u"] for r in rows.select(links.absolute(F.col("g")).alias("u")).collect()]
    assert got == ["https://example.com", "http://a.b/c", "https://host.org/x", "https://localhost:8080/a", None, None, None, "http://[::1]:80/", "https://a.b:99", "https://u:p@c.d/?q", None, None, None, None]
    valid, invalid = links.frontier(rows.union(rows), "g", "i")
    assert valid.count() == 7 and {r["g"] for r in invalid.collect()} == {"mailto:a@b.com", "word", "ftp://a.b", "javascript:alert(1)", "http://a b.c", "http://.com"}
    key = rows.limit(1).select(links.readable_key(F.lit("https://Ex.org/" + "ä/" * 5 + "b" * 300)).alias("k"), links.readable_key(F.lit("https:///")).alias("e")).first()
    assert key["k"].startswith("ex.org-b") and len(key["k"]) == 191 and key["e"].startswith("page-")


def test_entities_and_addresses(spark):
    one = spark.range(1)
    r = one.select(tx.unescaped(F.lit("a&#8217;b&#x41;&eacute;&amp;amp;&&nope;&#xD800;&#9999999;&apos;&")).alias("e"), tx.unescaped(F.lit(None).cast("string")).alias("n")).first()
    assert r["e"] == "a’bAé&amp;&&nope;&#xD800;&#9999999;'&" and r["n"] is None
    cases = {
        "123 Main St, Palm Harbor, FL, 34683-1234": ("123 Main St", "Palm Harbor", "FL", "34683"),
        "3920 PFLANZ AVE, LOUISVILLE KY 40212 *": ("3920 PFLANZ AVE", "Louisville", "KY", "40212"),
        "123 MAIN ST TAMPA, FL 33602": ("123 MAIN ST", "Tampa", "FL", "33602"),
        "5 Oak Boulevard NW Unit 4 San Mateo CA 94401": ("5 Oak Boulevard NW Unit 4", "San Mateo", "CA", "94401"),
        "somewhere 33602": ("somewhere 33602", None, None, "33602"),
        "1 A St, X ZZ 33602": ("1 A St, X ZZ 33602", None, None, "33602"),
    }
    df = spark.createDataFrame([(a,) for a in cases], "a string").select("a", rc.address_parts(F.col("a"), STATES).alias("p"))
    assert {r["a"]: tuple(r["p"]) for r in df.collect()} == cases


def test_orders_and_participants(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, "a", None), (3, "c", 1.0)], "n int, name string, price double")
    got = {c: [r["n"] for r in df.orderBy(*listing.chosen_order(c, "name", "price", "n")).collect()] for c in ("relevance", "name_asc", "name_desc", "price_asc", "price_desc")}
    assert got == {"relevance": [1, 2, 3], "name_asc": [2, 1, 3], "name_desc": [3, 1, 2], "price_asc": [3, 1, 2], "price_desc": [1, 3, 2]}
    with pytest.raises(ValueError, match="unknown order"):
        listing.chosen_order("x", "name", "price", "n")
    org = "struct<name:string,id:string,email:string,phone:string>"
    doc = "array<struct<id:string,title:string,url:string>>"
    p = spark.createDataFrame([((("W", "1", "a***", None), None, None, [("x", "t", "u")]),)], f"p struct<organiser:{org},awards:array<struct<status:string,supplier:{org},documents:{doc}>>,bids:array<struct<amount:double>>,documents:{doc}>")
    r = p.select(auctions.participants(F.col("p")).alias("r")).first()["r"]
    assert r["winner"] is None and r["organiser"]["name"] == "W" and r["organiser"]["email"] is None and [(d["origin"], d["id"]) for d in r["documents"]] == [("procedure", "x")]


def test_terms(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    points = spark.createDataFrame([("a", [("2024-01-01", 5.0, None, None), ("2024-01-02", 9.0, False, True), ("2024-01-03", 99.0, True, True), ("2024-01-04", 80.0, False, False), ("2024-01-05", 9.0, None, None)]), ("b", [])], f"term string, timeline {terms.TIMELINE}")
    regions = spark.createDataFrame([("a", [("X", "x", 7.0, False), ("Y", "y", 3.0, None)])], f"term string, regions {terms.REGIONS}")
    items = terms.term_items(keys, ["term"], {"timeline": points, "regions": regions})
    got = {r["term"]: (r["status"], r["average"], r["peak_date"], r["top_region"]) for r in items.collect()}
    assert got == {"a": ("ok", 7.67, "2024-01-02", "y"), "b": ("partial", None, None, None), "c": ("failed", None, None, None)}
    rows = terms.long_rows(items, ["term"]).groupBy("term", "row_type").count().collect()
    assert {(r["term"], r["row_type"]): r["count"] for r in rows} == {("a", "term"): 1, ("b", "term"): 1, ("c", "term"): 1, ("a", "timeline"): 5, ("a", "region"): 2}
    assert {r["status"] for r in terms.term_items(keys, ["term"], {}).collect()} == {"ok"}


def test_url_frontier_of_many_pages(spark, tmp_path):
    pages = spark.range(1, 130_001).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), (F.col("id") % 7).cast("string"), F.lit(".example/p/"), F.col("id").cast("string")).alias("url"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert compare(spark, str(tmp_path), "url_frontier", catalog.QUERIES["url_frontier"], catalog.ORACLE["url_frontier"]) == ""


@pytest.mark.parametrize("name", ["nested_markdown"])
def test_heavy_rows_of_a_small_file_are_dealt_over_all_cores(spark, name):
    """One small file is one task; what is done to its rows is not."""
    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_headers_and_orders_are_dealt_over_cores(spark):
    from tidewater.plans import catalog

    for name, key in (("column_roles", "p_partkey"), ("invoice_fields", "o_orderkey")):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert f"RepartitionByExpression [{key}" in plan  # one small file is one task, whatever its rows cost


def test_arrays_of_lines_sort_by_flat_fields(spark):
    from tidewater.plans import sourced

    df = spark.createDataFrame([(2, 1, 1.0, "b"), (1, 9, 2.0, "z"), (1, 9, 1.0, "a"), (1, 2, 3.0, None)], "l_linenumber int, l_partkey int, l_extendedprice double, t string").withColumn("o", F.struct(*"l_linenumber l_partkey l_extendedprice".split()))
    out = df.groupBy().agg(sourced._list("o", "t"))
    assert [x["t"] for x in out.first()["rows"]] == [None, "a", "z", "b"]
    assert "struct" not in str(out.schema["rows"].dataType.elementType.fields[0].dataType).lower()


def test_party_names_puts_words_into_lines_once(spark):
    from tidewater.plans import catalog

    plan = catalog.QUERIES["party_names"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # segments are written once and read by each of the three searches
