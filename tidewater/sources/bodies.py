"""Bodies of answers as columns: feeds, prefixed JSON, framed calls, JSON inside pages, types and charsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RSS_ITEM = "title string, link string, pubDate string, guid struct<_VALUE: string>, description string, source struct<_VALUE: string, _url: string>"


def entities(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def read_feed(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(keys, ok, position, title, link, published, guid, description, source, source_url): a row an item.

    A body that is no feed gives one row with ok false and nulls; a feed without items one with ok true.
    """
    ok = F.coalesce(F.col(body).rlike(r"(?i)<(rss|feed|rdf:RDF)\b"), F.lit(False))
    items = F.when(ok, F.regexp_extract_all(body, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0)))
    rows = df.select(*keys, ok.alias("ok"), F.posexplode_outer(items).alias("position", "_x"))
    x = rows.withColumn("_i", F.from_xml("_x", RSS_ITEM, {"rowTag": "item"}))
    return x.select(*keys, "ok", (F.col("position") + 1).alias("position"), F.trim("_i.title").alias("title"), F.trim("_i.link").alias("link"), F.trim("_i.pubDate").alias("published"), F.trim("_i.guid._VALUE").alias("guid"), F.trim("_i.description").alias("description"), F.trim("_i.source._VALUE").alias("source"), F.col("_i.source._url").alias("source_url"))


def read_trending_feed(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(keys, position, title, traffic, news): items with their nested news as array<struct<title, url, source>>."""
    upto = lambda end: rf"[^<]*+(?:<(?!{end})[^<]*+)*+"  # noqa: E731  as .*? up to the end, without a try at every character
    close = lambda name: rf"/(?:\w+:)?{name}>"
    tag = lambda x, name: F.trim(entities(F.regexp_replace(F.regexp_extract(x, rf"<(?:\w+:)?{name}\b[^>]*>({upto(close(name))})<{close(name)}", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))
    rows = df.select(*keys, F.posexplode(F.regexp_extract_all(body, F.lit(rf"<item\b{upto('/item>')}</item>"), F.lit(0))).alias("position", "_x"))
    news = F.transform(F.regexp_extract_all("_x", F.lit(rf"<(?:\w+:)?news_item>{upto(close('news_item'))}<{close('news_item')}"), F.lit(0)), lambda n: F.struct(tag(n, "news_item_title").alias("title"), tag(n, "news_item_url").alias("url"), tag(n, "news_item_source").alias("source")))
    return rows.select(*keys, (F.col("position") + 1).alias("position"), tag(F.col("_x"), "title").alias("title"), tag(F.col("_x"), "approx_traffic").alias("traffic"), news.alias("news"))


def prefixed_json(body: Column) -> Column:
    """The VARIANT of a body whose first line may be a guard before the JSON; null for HTML, empty or broken ones."""
    t = F.trim(body)
    json = F.when(t.rlike(r"^[\[{]"), t).otherwise(F.regexp_replace(t, r"^[^\n]*\n", ""))
    return F.when(~t.rlike(r"^<") & (t != ""), F.try_parse_json(json))


def framed_call(df: DataFrame, body: str, call: str, keys: list[str]) -> DataFrame:
    """(keys, payload): the JSON text inside the frame of the call in a body of lines of JSON frames, as VARIANT."""
    line = df.select(*keys, F.explode(F.split(body, "\n")).alias("_l")).where(F.trim("_l").startswith("["))
    frame = line.select(*keys, F.variant_get(F.try_parse_json("_l"), "$", "array<variant>").alias("_f")).select(*keys, F.explode("_f").alias("_f"))
    named = frame.where(F.try_variant_get("_f", "$[1]", "string") == call)
    return named.select(*keys, F.try_parse_json(F.try_variant_get("_f", "$[2]", "string")).alias("payload"))


def embedded_json(html: Column, element_id: str = "__NEXT_DATA__") -> Column:
    """The VARIANT in the script element of the given id."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{element_id}"[^>]*>(.*?)</script>', 1), F.lit("")))


def keyed_blob(html: Column, key: str) -> Column:
    """The VARIANT of the data array in the callback that names ``key`` inside a page's scripts."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, rf"(?s)key:\s*'{key}'.*?data:\s*(\[.*?\])\s*,\s*sideChannel", 1), F.lit("")))


def file_type(content: Column, name: Column, content_type: Column) -> Column:
    """pdf, docx, pptx, xlsx, zip, doc, png, jpg, html, csv, md, text or unknown: first bytes, then type, then name.

    The office formats are told apart by the member names that a ZIP holds in the clear.
    """
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda h: F.startswith(head, F.lit(h))
    holds = lambda text: F.contains(content, F.lit(text.encode()))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    text = F.is_valid_utf8(content.cast("string")) & ~F.contains(head, F.lit("0000"))
    out = F.when(starts("25504446"), "pdf").when(starts("504B0304") & holds("word/document.xml"), "docx").when(starts("504B0304") & holds("ppt/presentation.xml"), "pptx").when(starts("504B0304") & holds("xl/workbook.xml"), "xlsx").when(starts("504B0304"), "zip").when(starts("D0CF11E0"), "doc").when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpg")
    for kind in ("html", "csv", "pdf"):
        out = out.when(F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(kind)), kind)
    out = out.when(ext.isin("html", "htm"), "html").when(ext.isin("csv", "tsv"), "csv").when(ext.isin("md", "markdown"), "md")
    out = out.when(text & F.ltrim(F.lower(content.cast("string"))).rlike(r"^(<!doctype html|<html)"), "html")
    return out.when(text, "text").otherwise("unknown")


def decode(df: DataFrame, content: str, content_type: str, out: str = "text") -> DataFrame:
    """df with ``out``: byte order mark, else strict UTF-8, else the charset named by the type or a meta tag, else windows-1252.

    Runs in Arrow batches, because the JVM function knows no windows-1252.
    """
    import re

    def text_of(raw: bytes | None, kind: str | None) -> str | None:
        if raw is None:
            return None
        for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if raw.startswith(mark):
                return raw.decode(name, "replace")
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            named = re.search(r"charset=[\"']?([\w-]+)", kind or "") or re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", raw[:4096].decode("latin-1"), re.I)
        try:
            return raw.decode(named.group(1) if named else "cp1252", "replace")
        except LookupError:
            return raw.decode("cp1252", "replace")

    @F.pandas_udf("string")
    def decoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raw, kind in batches:
            yield pd.Series([text_of(r, k) for r, k in zip(raw, kind)], dtype=object)

    return df.withColumn(out, decoded(F.col(content), F.col(content_type)))
