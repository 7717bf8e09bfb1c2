"""Goldens of records, links, listings and texts that the given tables cannot show."""

import datetime

from pyspark.sql import functions as F

from tidewater.functions import pages, products, trends
from tidewater.functions import text as tx
from tidewater.operators import documents as dc
from tidewater.operators import diff, listing, match, monitor
from tidewater.sources import links


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_fold_strips_every_mark(spark):
    got = one(spark, a=tx.fold(F.lit("București ȘȚ Łódź č ő Їжак’s")), b=tx.slug(F.lit("Crème & Brûlée č")), c=match.normal_name(F.lit("Château Ő-Bar")))
    assert got == {"a": "bucuresti st łodz c o іжак's", "b": "creme-and-brulee-c", "c": "chateau o bar"}


def test_category_of_several_texts(spark):
    rules = {"roof": ["roof"], "solar": ["solar", "c++"]}
    got = one(spark, a=tx.category(F.lit("(roof) repair"), rules), b=tx.category(F.lit("Permit"), rules, F.lit("new,solar panel")), c=tx.category(F.lit("x"), rules, F.lit(None).cast("string")), d=tx.category(F.lit("uses c++"), rules), e=tx.category(F.lit("solar"), rules, F.lit("roof")), f=tx.category(F.lit("proof"), rules))
    assert got == {"a": "roof", "b": "solar", "c": "other", "d": "solar", "e": "solar", "f": "other"}


def test_permit_matcher(spark):
    def found(text, category, status="Issued"):
        return match.matched_keywords(F.lit(text), {"roof": ["roof"], "deck": ["deck"]}, ["demo"], F.lit(category), ("other", "building"), F.lit(status), ("issued", "final"))

    got = one(spark, a=found("a roof", "roof"), b=found("a deck", "roof"), c=found("a deck", "building"), d=found("demolition, roof", "roof"), e=found("x", "roof", "Void"))
    assert got == {"a": ["roof"], "b": ["roof"], "c": ["deck"], "d": [], "e": []}


def test_share_links_keep_their_keys(spark):
    urls = {"https://www.dropbox.com/s/x/a.pdf?rlkey=k1&dl=0&st=z": "https://www.dropbox.com/s/x/a.pdf?rlkey=k1&st=z&dl=1", "https://dropbox.com/s/x": "https://dropbox.com/s/x?dl=1", "https://t.sharepoint.com/:w:/g/a?e=tok#f": "https://t.sharepoint.com/:w:/g/a?e=tok&download=1#f", "https://drive.google.com/open?usp=s&id=F1": "https://drive.usercontent.google.com/download?id=F1&export=download&confirm=t", "https://app.box.com/s/abc": "https://app.box.com/shared/static/abc", "https://docs.google.com/document/d/D1/export?format=pdf": "https://docs.google.com/document/d/D1/export?format=pdf", "https://x.com/a": "https://x.com/a"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["d"] for r in df.withColumn("d", links.direct_link(F.col("u"))).collect()} == urls


def test_block_kinds(spark):
    kind = lambda u, s, h: pages.block_kind(F.lit(u), F.lit(s).cast("int"), F.lit(h))
    got = one(spark, a=kind("https://consent.x.com/m", 200, ""), b=kind("https://x.com/sorry/index", 429, ""), c=kind(None, 429, None), d=kind("https://x.com", 403, "consent captcha"), e=kind("https://x.com/consent", 200, "no form"), f=kind("https://x.com/consent?x", 200, '<form method=post action="https://x.com/save">'), g=kind("u", 401, ""), h=kind("u", 500, ""), i=kind("u", None, "fine"))
    assert list(got.values()) == ["consent", "captcha", "rate-limited", "blocked", "ok", "consent", "unauthorized", "http-error", "ok"]


def test_markdown_marks(spark):
    text = "<!-- page 3 -->\n## Head *er*\n> **bold** and __strong__ `code`\n\n\n\n* a\n  + b\n- c\n```py\nx = 1\n```\n| a \\| b | c |\n|---|:-:|\n| d | e |\n![alt](i.png) [text](u) 2 \\* 3 \\# 5"
    got = one(spark, t=dc.markdown_to_text(F.lit(text)))["t"]
    assert got == "Head er\nbold and strong code\n\n- a\n  - b\n- c\nx = 1\na | b | c\nd | e\nalt text 2 * 3 # 5"
    numbers = {"3": True, "Page 12 of 40": True, "- 7 -": True, "12 / 30": True, "12345": False, "Chapter 3": False, "": False, "1 2 3": False}
    df = spark.createDataFrame([(k,) for k in numbers], "s string")
    assert {r["s"]: r["p"] for r in df.withColumn("p", dc.is_page_number(F.col("s"))).collect()} == numbers


def test_money_and_labels(spark):
    got = one(spark, a=products.money(F.lit("Was $1,250.50 each")), b=products.money(F.lit("3,99 €")), c=products.money(F.lit("none")), d=trends.volume_label(F.lit(1500)), e=trends.volume_label(F.lit(2_000_000)), f=trends.volume_label(F.lit(90)), g=trends.explore_link("https://t.x", F.lit("a b&c"), F.lit(4), F.lit(None).cast("string")))
    assert got == {"a": 1250.5, "b": 3.99, "c": None, "d": "1.5K+", "e": "2M+", "f": "90+", "g": "https://t.x/trends/explore?q=a+b%26c&date=now+4-H&geo="}


def test_sponsored_rows_take_no_key(spark):
    df = spark.createDataFrame([("a", 1, True, True), ("a", 2, False, False), ("a", 3, False, True), ("b", 4, None, True)], "k string, o int, ad boolean, special boolean")
    pick = lambda **o: sorted((r["k"], r["o"]) for r in listing.fresh_products(df, "k", "o", "ad", "special", **o).collect())
    assert pick() == [("a", 2), ("b", 4)] and pick(only_specials=True) == [("b", 4)] and pick(with_sponsored=True) == [("a", 1), ("b", 4)]


def test_nested_changes_and_long_values(spark):
    schema = "id int, a struct<b: struct<c: struct<d: struct<e: int>>>, f: array<int>>, t string"
    long = "x" * 1500
    before, after = (spark.createDataFrame([(1, ((((e,),),), f), t)], schema) for e, f, t in ((1, [1], long), (2, [1, 2], long + "y")))
    changes = diff.snapshot_diff(before, after, ["id"], ["id"])
    got = {r["field"]: (r["before"], r["after"], r["total"]) for r in diff.field_changes(changes, ["a", "t"]).collect()}
    assert got["a.b.c.d"] == ('{"e":1}', '{"e":2}', 3) and got["a.f"][:2] == ("[1]", "[1,2]") and got["t"][0] != got["t"][1] and len(got["t"][0]) < 300
    assert diff.field_changes(changes, ["a"], most=1).first()["total"] == 2


def test_lines_start_from_their_first_word(spark):
    """A slow drift of the baseline ends the line where it is too far from the first word, not from the neighbour."""
    words = spark.createDataFrame([(1, float(10 * i), 10.0 * i + 8, 100 + 1.2 * i, 10.0, f"w{i}") for i in range(6)], "p int, x0 double, x1 double, y double, size double, text string")
    assert [r["line_no"] for r in dc.word_lines(words, ["p"]).orderBy("x0").collect()] == [1, 1, 1, 2, 2, 2]


def test_cursor_steps_over_a_full_page(spark):
    page = spark.createDataFrame([(datetime.datetime(2024, 1, 1),)] * 3, "ts timestamp_ntz")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    step = lambda full: spark.range(1).select(monitor.next_cursor(page, "ts", at, full)).first()[0]
    assert step(3) == datetime.datetime(2024, 1, 1, 0, 0, 0, 1000) and step(4) == datetime.datetime(2024, 1, 1)


def test_token_counts(spark):
    import pytest

    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("one two",), ("",), (None,)], "t string")
    got = [r["n"] for r in df.select(dc.token_count(F.col("t"), str(public.path("piece_bpe_32k.model"))).alias("n")).collect()]
    assert got[0] >= 2 and got[1:] == [0, 0]
