"""Readers on small files, link forms, and the snapshot store."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.sources import bodies, items, links, store


@pytest.mark.parametrize("name, text", [
    ("a.json", json.dumps([{"id": 1, "n": "x"}, {"id": 2, "n": "y"}])),
    ("b.json", json.dumps({"items": [{"id": 1, "n": "x"}, {"id": 2, "n": "y"}]})),
    ("c.json", json.dumps({"data": {"items": [{"id": 1, "n": "x"}, {"id": 2, "n": "y"}]}}, indent=1)),
    ("d.json", json.dumps({"data": [{"id": 1, "n": "x"}, {"id": 2, "n": "y"}]})),
    ("e.jsonl", '{"id": 1, "n": "x"}\n\n{"id": 2, "n": "y"}\n'),
    ("f.csv", "﻿id , n\n1,x\n,\n\n2,y\n"),
])
def test_items(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    got = items.read_items(spark, str(tmp_path / name))
    assert {(str(r["id"]), r["n"]) for r in got.collect()} == {("1", "x"), ("2", "y")}


def test_items_refused(spark, tmp_path):
    (tmp_path / "h.html").write_text("<html></html>")
    (tmp_path / "e.txt").write_text("\n")
    for f in ("h.html", "e.txt"):
        with pytest.raises(ValueError):
            items.read_items(spark, str(tmp_path / f))


def test_headers(spark):
    df = spark.createDataFrame([("1", " ", "A"), ("", "x", "B")], "`Permit No.` string, `Type` string, `Work  Type` string")
    rows = items.with_header_map(df, {"number": "permit no|record no", "type": "type|work type"}, "number").collect()
    assert [r.asDict() for r in rows] == [{"number": "1", "type": "A"}]
    cells = items.cells_by_header(spark.createDataFrame([(["extra", "a", "b"],), (["b"],)], "c array<string>"), "c", ["x", "y"]).collect()
    assert [(r["x"], r["y"]) for r in cells] == [("a", "b"), (None, "b")]


def test_feeds(spark):
    rss = '<rss><channel><item><title>T &amp; U - S</title><link>http://l</link><guid isPermaLink="false">g</guid><source url="http://s">S</source></item><item><title>V</title></item></channel></rss>'
    rows = bodies.read_feed(spark.createDataFrame([(1, rss), (2, "<html>"), (3, None)], "k int, b string"), "b", ["k"]).orderBy("k", "position").collect()
    assert [(r["k"], r["ok"], r["title"], r["source_url"]) for r in rows] == [(1, True, "T & U - S", "http://s"), (1, True, "V", None), (2, False, None, None), (3, False, None, None)]
    hot = "<rss><item><title>q</title><ht:approx_traffic>10K+</ht:approx_traffic><ht:news_item><ht:news_item_title><![CDATA[A &amp; B]]></ht:news_item_title></ht:news_item></item></rss>"
    row = bodies.read_trending_feed(spark.createDataFrame([(1, hot)], "k int, b string"), "b", ["k"]).first()
    assert (row["title"], row["traffic"], row["news"][0]["title"]) == ("q", "10K+", "A & B")


def test_json_bodies(spark):
    frames = ")]}'\n\n" + json.dumps([["wrb.fr", "abc", json.dumps([1, [2]]), None]]) + "\n" + json.dumps([["wrb.fr", "other", "[9]"]])
    df = spark.createDataFrame([(1, frames), (2, "<html>"), (3, "")], "k int, b string")
    assert [r["p"] for r in bodies.framed_call(df, "b", "abc", ["k"]).select(F.to_json("payload").alias("p")).collect()] == ["[1,[2]]"]
    row = spark.range(1).select(F.to_json(bodies.prefixed_json(F.lit(')]}\'\n{"a":1}'))).alias("a"), bodies.prefixed_json(F.lit("<html>")).isNull().alias("h"), F.to_json(bodies.embedded_json(F.lit('<script id="__NEXT_DATA__" type="application/json">{"z":2}</script>'))).alias("n")).first()
    assert (row["a"], row["h"], row["n"]) == ('{"a":1}', True, '{"z":2}')


def test_types_and_charsets(spark):
    rows = [(b"%PDF-1.7", "x", None, "pdf"), (b"PK\x03\x04..word/document.xml", "x", None, "docx"), (b"a,b", "x.csv", None, "csv"), (b" <!DOCTYPE html>", "x", None, "html"), (b"plain", "x", None, "text"), (b"\x00\x00\xff", "x", None, "unknown")]
    df = spark.createDataFrame([(bytearray(c), n, t, w) for c, n, t, w in rows], "c binary, n string, t string, w string")
    assert all(r["got"] == r["w"] for r in df.withColumn("got", bodies.file_type(F.col("c"), F.col("n"), F.col("t"))).collect())
    texts = [("é".encode(), None), ("﻿é".encode(), None), ("é".encode("cp1252"), None), (b'<meta charset="iso-8859-2">\xb1', None), (None, None)]
    got = [r["text"] for r in bodies.decode(spark.createDataFrame([(bytearray(c) if c else None, t) for c, t in texts], "c binary, t string"), "c", "t").collect()]
    assert got == ["é", "é", "é", '<meta charset="iso-8859-2">ą', None]


def test_links(spark):
    df = spark.createDataFrame([(1, "example.com/a"), (2, "https://example.com/a"), (3, "word"), (4, "ftp://x.y"), (5, ""), (6, None)], "i int, u string")
    valid, invalid = links.frontier(df, "u", "i")
    assert [tuple(r) for r in valid.collect()] == [("https://example.com/a", 1)] and {r["i"] for r in invalid.collect()} == {3, 4}
    u = lambda x: spark.range(1).select(links.direct_link(F.lit(x))).first()[0]
    assert u("https://github.com/a/b/blob/main/c.md") == "https://raw.githubusercontent.com/a/b/main/c.md" and u("https://x.y") == "https://x.y"


def test_store(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    assert s.load() is None and s.current() == (0, None)
    s.save(spark.range(3), "a")
    s.save(s.load("a").where("id > 0"), "a")
    assert s.current() == (2, "a") and s.load("a").count() == 2 and s.load("b") is None
    spark.range(9).write.parquet(str(tmp_path / "s" / "generation=3"))  # written, but never committed
    assert s.load().count() == 2
    store.write_results(spark.range(2), spark.createDataFrame([("bad",)], "error string"), str(tmp_path / "r"), ["id", "error", "note"], "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 3
