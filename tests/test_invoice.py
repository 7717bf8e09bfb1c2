"""Goldens of invoices, criteria and Markdown."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import criteria as c
from tidewater.functions import markdown as md
from tidewater.functions import values as v
from tidewater.operators import invoice


def test_invoice(spark):
    text = ["INVOICE No. INV-2026/17", "Date: 15 Sept. 2026", "Due date: 2026-10-14", "VAT ID: DE123456789", "Subtotal: $100.00", "VAT 19% $19.00", "Total: $120.00", "Grand total $119.00", "pay EUR"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "Subtotal 10.00"), (2, 1, "")], "d int, n int, t string")
    f = invoice.labelled_fields(lines, ["d"], "n", "t").where("d = 1").first()
    assert (f["number"], str(f["date"]), str(f["due_date"]), f["tax_id"]) == ("INV-2026/17", "2026-09-15", "2026-10-14", "DE123456789")
    t = {r["d"]: (r["subtotal"], r["tax"], r["total"]) for r in invoice.totals(lines, ["d"], "n", "t").collect()}
    assert t == {1: (100.0, 19.0, 119.0), 2: (10.0, None, 10.0)}
    assert invoice.document_currency(lines, ["d"], "n", "t").first()["currency"] == "USD"
    heads = spark.createDataFrame([(1, i, h) for i, h in enumerate(["Item", "Qty", "Unit price", "Amount", "Total"])], "d int, p int, h string")
    assert {(r["role"], r["p"]) for r in invoice.header_roles(heads, ["d"], "p", "h").collect()} == {("description", 0), ("quantity", 1), ("unit_price", 2), ("line_total", 4)}
    assert [r[0] for r in lines.where("n = 0").orderBy("d").select(invoice.document_type(F.col("t"))).collect()] == ["invoice", "other"]


def test_dates_and_numbers_are_read_where_they_stand(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 0, "Date: soon it will be"), (1, 1, "Date: 5 March 2026"), (1, 2, "Total: x"), (1, 3, "Total 1,234.50"), (2, 0, "net amount 3")], "d int, n int, t string")
    f = {r["d"]: r["date"] for r in invoice.labelled_fields(lines, ["d"], "n", "t").collect()}
    assert f == {1: dt.date(2026, 3, 5), 2: None}
    assert sorted((r["d"], r["total"]) for r in invoice.totals(lines, ["d"], "n", "t").collect()) == [(1, 1234.5), (2, 3.0)]
    asked, whole = [], invoice.v.parse_date
    monkeypatch.setattr(invoice.v, "parse_date", lambda t: asked.append(t) or whole(t))
    plan = invoice.labelled_fields(lines, ["d"], "n", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 2 and plan.count("isnotnull(") >= 2  # lines without a value are not scanned for a date
    assert " Generate" not in invoice.totals(lines, ["d"], "n", "t")._jdf.queryExecution().optimizedPlan().toString()


def test_plain_numbers_and_dates_as_by_scanning(spark):
    texts = ["0", "007.5", "$1,234.50", "1,234", "12,34.5", "1234567.8", "$12", "1,234,567.89", "9.", "1.234", "", None, " 5.25 ", "123,4567.1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(v.parse_number(F.col("t")).alias("a"), v._scanned(F.trim("t"), F.lit(False)).alias("b"), v.parse_number(F.col("t"), True).alias("c"), v._scanned(F.trim("t"), F.lit(True)).alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in both) and [r["a"] for r in both][:3] == [0.0, 7.5, 1234.5]
    dates = ["5 March 2026", "05 marzo 2026", "31 feb 2026", "1 Mayonnaise 0000", "5 foo 2026", "29 Dez 2024", "12 Août 2025", "5 mar 26"]
    near = spark.createDataFrame([(t,) for t in dates], "t string").select(v.parse_date(F.col("t")).cast("string").alias("a"), v.parse_date(F.concat("t", F.lit(" "))).cast("string").alias("b"))  # a space more is scanned
    assert all(r["a"] == r["b"] for r in near.collect()) and [str(r["a"]) for r in near.collect()][:3] == ["2026-03-05", "2026-03-05", "None"]


def test_criteria(spark):
    df = spark.createDataFrame([(1, "lease-english", 5.0, ["Kyïv"], "x"), (2, "lease", None, [], "Lviv"), (3, "leasehold", 7.0, None, None)], "i int, m string, p double, r array<string>, s string")
    ids = lambda x: {r["i"] for r in df.where(x).collect()}
    assert ids(c.exact_or_prefix(F.col("m"), ["lease"])) == {1, 2} and ids(c.bounds(F.col("p"), least=6)) == {3} and ids(c.every(None, c.one_of(F.col("m"), []))) == {1, 2, 3}
    assert ids(c.in_region(F.col("r"), F.col("s"), ["kyiv", "lviv"])) == {1, 2} and ids(c.holds_all(F.col("m"), ["LEASE", "hold"])) == {3}
    x = spark.range(1).select(c.shares_word(F.lit("new phones"), F.lit("phone case")).alias("a"), c.shares_word(F.lit("tea"), F.lit("teapots")).alias("b"), c.query_kind(F.lit("ex.ample.com")).alias("d")).first()
    assert (x["a"], x["b"], x["d"]) == (True, False, "domain")
    now = dt.date(2026, 1, 10)
    assert [c.resolve_date(t, now) for t in ("today", "7 days", "+14 days", "2026-02-03", "")] == [now, dt.date(2026, 1, 3), dt.date(2026, 1, 24), dt.date(2026, 2, 3), None]
    with pytest.raises(ValueError):
        c.resolve_date("soon", now)


def test_markdown(spark):
    html = "<html><body><nav>menu</nav><h1>Top &amp; more</h1><p>See <a href='http://x.y'>this</a> and <a href='/z'>that</a><img alt='pic'></p><ul><li>one</li></ul><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table><script>x</script></body></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "k int, h string")
    got = [r["m"] for r in df.select(md.html_to_markdown(F.col("h")).alias("m")).collect()]
    assert got[1:] == [None, ""] and got[0] == "# Top & more\n\nSee [this](http://x.y) and that[Image: pic]\n\n- one\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"
    assert [(r["row_no"], r["cells"]) for r in md.html_tables(df, "h", ["k"]).collect()] == [(1, ["a", "b|c"]), (2, ["1", "2"])]
    assert spark.range(1).select(md.table_row(F.array(F.lit("a|b"), F.lit(None).cast("string")))).first()[0] == "| a\\|b |  |"
