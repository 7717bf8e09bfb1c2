"""Goldens of numbers, dates, names and chunks."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import values as v
from tidewater.operators import documents as dc
from tidewater.operators import layout, match

NUMBERS = [("1,234.50", False, 1234.5), ("1.234,50", True, 1234.5), ("$24.90", False, 24.9), ("EUR 3.800,90", True, 3800.9), ("(15.00)", False, -15.0), ("-4.0", False, -4.0), ("6,5", True, 6.5), ("1,234", False, 1234.0), ("12.500", True, 12500.0), ("13,490", False, 13490.0), ("1 234,56", True, 1234.56), ("450,00 €", True, 450.0), ("21%", False, 21.0), ("61.00 - 94.00", False, None), ("PAP-A4-80", False, None), ("9/25/2026", False, None), ("Total", False, None), ("", False, None), ("12 pcs extra", False, None), ("(15", False, None), (None, False, None)]
DATES = [("September 15, 2026", "auto", "2026-09-15"), ("15 Sept. 2026", "auto", "2026-09-15"), ("30.09.2026", "auto", "2026-09-30"), ("2026-10-14", "auto", "2026-10-14"), ("03/04/2026", "auto", "2026-03-04"), ("03/04/2026", "DMY", "2026-04-03"), ("25/09/2026", "auto", "2026-09-25"), ("5 août 26, 3 août 2026", "auto", "2026-08-03"), ("31/02/2026", "DMY", None), ("no date here", "auto", None), (None, "auto", None)]


def test_numbers(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(NUMBERS)], "i int, t string, c boolean, want double")
    got = {r["i"]: (r["got"], r["want"]) for r in df.withColumn("got", v.parse_number(F.col("t"), F.col("c"))).collect()}
    assert all(a == b for a, b in got.values()), got
    row = spark.range(1).select(v.currency_of(F.lit("3.800,90 EUR")).alias("e"), v.currency_of(F.lit("$11.25")).alias("u"), v.is_percent(F.lit("21%")).alias("p"), v.price_text(F.lit("€ 99,50")).alias("a"), v.price_text(F.lit("1.234 €")).alias("b"), v.traffic_number(F.lit("10K+")).alias("t"), v.round_half_up(F.lit(-2.5), 0).alias("h")).first()
    assert (row["e"], row["u"], row["p"], row["a"], row["b"], row["t"], row["h"]) == ("EUR", "USD", True, 99.5, 1234.0, 10000, -2.0)


@pytest.mark.parametrize("prefer", ["auto", "DMY"])
def test_dates(spark, prefer):
    df = spark.createDataFrame([(t, w) for t, p, w in DATES if p == prefer], "t string, want string")
    assert [(r["t"], r["got"]) for r in df.withColumn("got", v.parse_date(F.col("t"), prefer).cast("string")).collect()] == [(t, w) for t, p, w in DATES if p == prefer]


def test_token_match(spark):
    wanted = spark.createDataFrame([("Hotel Blue Bay",), ("The Hotel",), ("Zzz",), (None,)], "w string")
    listing = spark.createDataFrame([("Blue Lagoon", 1), ("Bay Blué Resort", 2), ("the hotel", 3), (None, 4)], "l string, o int")
    got = {r["w"]: (r["match"], r["score"]) for r in match.token_match(wanted, "w", listing, "l", "o").collect()}
    assert got == {"Hotel Blue Bay": ("Bay Blué Resort", 1.0), "The Hotel": ("the hotel", 1.0), "Zzz": (None, None)}


def test_chunks(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 20} |" for i in range(30))
    text = "# One\n\n" + "A sentence of words. " * 40 + "\n\n## Two\n\n" + "word " * 100 + "\n\n```\n# no heading\n\ncode\n```\n\n" + table + "\n\n# Alone"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "# only")], "doc_id int, text string")
    blocks = dc.md_blocks(docs, ["doc_id"])
    assert [(r["level"], r["is_table"]) for r in blocks.where("doc_id = 1").orderBy("block_no").collect()] == [(1, False), (0, False), (2, False), (0, False), (0, False), (0, True), (1, False)]
    for mode, overlap in (("fixed", 0), ("fixed", 60), ("heading", 40)):
        rows = dc.chunk_blocks(blocks, ["doc_id"], mode, 200, overlap).orderBy("chunk_no").collect()
        assert {r["doc_id"] for r in rows} == {1} and all(len(r["md"]) <= 200 for r in rows)
        joined = " ".join(r["md"] for r in rows)
        assert all(f"| {i} |" in joined for i in range(30)) and joined.count("A sentence of words.") >= 40 and joined.count("word ") >= 80
        assert all("| a | b |" in r["md"] for r in rows if "xxxx" in r["md"])
    assert dc.chunk_blocks(blocks, ["doc_id"], "heading", 5000, 0).orderBy("chunk_no").first()["path"] == "One"
    assert dc.chunk_blocks(blocks.where("doc_id = 1"), ["doc_id"], "none").count() == 1


def test_tables_of_words(spark):
    words = [(1, x * 100.0, x * 100.0 + 40, 20.0 * y, 10.0, f"r{y}c{x}") for y in range(4) for x in range(3)] + [(1, 0.0, 300.0, 200.0, 10.0, "prose")]
    df = spark.createDataFrame(words, "page int, x0 double, x1 double, y double, size double, text string")
    cells = dc.line_tables(df, ["page"]).collect()
    assert {(r["line_no"], r["column_no"], r["text"]) for r in cells} == {(y + 1, x + 1, f"r{y}c{x}") for y in range(4) for x in range(3)}
    assert dc.body_size(df.withColumn("size", F.when(F.col("text") == "prose", 14.0).otherwise(F.col("size"))), ["page"]).first()["heading_sizes"] == [14.0]


def test_tables_by_layout(spark):
    """Gutters free on all rows, a header over a gutter, prose and short blocks rejected, two tables on a page."""
    words = [(1, x * 100.0, x * 100.0 + 40, 20.0 + 12 * y, 10.0, f"r{y}c{x}") for y in range(1, 5) for x in range(3)]
    words += [(1, 0.0, 30.0, 20.0, 10.0, "A"), (1, 85.0, 130.0, 20.0, 10.0, "wide"), (1, 165.0, 230.0, 20.0, 10.0, "heading")]
    words += [(1, x * 150.0, x * 150.0 + 40, 200.0 + 12 * y, 10.0, f"s{y}{x}") for y in range(4) for x in range(2)]
    words += [(2, 0.0, 100.0 + 30 * i, 12.0 * i, 10.0, "prose") for i in range(6)] + [(2, 120.0 + 30 * i, 300.0, 12.0 * i, 10.0, "goes on") for i in range(6)]
    words += [(3, x * 100.0, x * 100.0 + 40, 12.0 * y, 10.0, "few") for y in range(3) for x in range(2)] + [(4, 0.0, 10.0, 0.0, 10.0, "x" * 200)]
    df = spark.createDataFrame(words, "page int, x0 double, x1 double, y double, size double, text string")
    got = layout.layout_tables(df, ["page"]).collect()
    assert {r["page"] for r in got} == {1} and {r["table_no"] for r in got} == {1, 2}
    first = {(r["line_no"], r["column_no"]): r["text"] for r in got if r["table_no"] == 1}
    assert first == {(y + 1, x + 1): f"r{y}c{x}" for y in range(1, 5) for x in range(3)} | {(1, 1): "A", (1, 2): "wide", (1, 3): "heading"}
    assert {r["text"] for r in got if r["table_no"] == 2 and r["is_header"]} == {"s00", "s01"}
    assert {r["page"]: r["gap"] for r in layout.line_gaps(df, ["page"]).collect()}[2] == 12.0
    lines = spark.createDataFrame([("d", p, n, t, z) for p in range(4) for n, t, z in ((1, "Head 1", 9.0), (2, "Big title", 20.0), (3, f"own {p} text", 10.0), (4, f"{p + 1}", 9.0))], "doc string, page int, n int, line string, size double")
    edges = {r["edge_text"]: r["running"] for r in dc.edge_lines(lines, "doc", "page", large=F.col("size") > 11.5).collect()}
    assert edges["head #"] and not edges["big title"] and edges["#"]


def test_layout_tables_numbers_lines_once(spark):
    df = spark.createDataFrame([(1, x * 100.0, x * 100.0 + 40, 12.0 * y, 10.0, "w") for y in range(5) for x in range(2)], "page int, x0 double, x1 double, y double, size double, text string")
    got = layout.layout_tables(df, ["page"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") <= 1 and got.count() == 10
