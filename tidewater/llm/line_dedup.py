"""Line dedup by site-relative frequency.

For each host the pages that hold a line are divided by all pages of the host; lines over a boilerplate
ratio go from every page of that host. A host has at most (mean lines a page / ratio) such lines, so its
list is small however many pages it has.

``drop_repeats`` adds what one ratio cannot catch at every size: the ratio falls with the words of the line,
a long passage counts after a few pages, and small hosts count too. What goes only by that stays on one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, broadcast_if, packed_rows, unpacked


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.2) -> DataFrame:
    """(host, h, n_pages, pages): hashes of the lines on over ``ratio`` of a host's pages; a line on one page is no repeat."""
    site = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    pages = docs.groupBy(site).agg(F.count("*").alias("pages"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _hash))
    lines = docs.select(site, F.explode(own).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_pages")).where("n_pages >= 2")
    return lines.join(pages, "host").where(F.col("n_pages") > F.col("pages") * ratio)


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.2) -> DataFrame:
    """docs with the boilerplate lines of their host cut from ``text``, plus _lines and _dropped (counts), the last two columns.

    Lines are compared without leading and trailing blanks; blank lines neither count nor go, nor does a line on a
    single page or on exactly ``ratio`` of the pages. A null host is a host of its own (with the empty one); a null
    text stays null, an empty one empty; repeated rows are pages of their own; every row stays, also when no line
    does. All other columns are kept as they are; where one has the name of an added column, that gets an underscore more.
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.cut(boilerplate(docs, host, text, ratio).groupBy(F.col("host").alias("_host")).agg(F.collect_set("h").alias("_known")))
    n = known.agg(F.sum(F.size("_known"))).first()[0] or 0
    out = packed_rows(docs).withColumn("_host", F.coalesce(F.col("_row")[host].cast("string"), F.lit("")))
    return _without_known(out.join(broadcast_if(known, n), "_host", "left"), docs.columns, text)


def _without_known(out: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The rows (_row, _known) with ``text`` without the lines whose hashes are in _known; adds _lines and _dropped."""
    old = F.col("_row")[text]
    out = out.withColumn("_all", _lines(old)).withColumn("_left", F.when(F.col("_known").isNotNull(), F.filter("_all", lambda x: (F.trim(x) == "") | ~F.array_contains("_known", _hash(x)))))
    dropped = F.coalesce(F.size("_all") - F.size("_left"), F.lit(0))
    new = F.when((dropped > 0) & old.isNotNull(), F.array_join("_left", "\n")).otherwise(old)
    row = F.struct(*[(new if c == text else F.col("_row")[c]).alias(c) for c in columns])
    return unpacked(out.select(row.alias("_row"), F.size("_all").alias("_n"), dropped.alias("_d")), columns, {"_lines": F.col("_n"), "_dropped": F.col("_d")})


def _text_key(text: Column) -> Column:
    """60 bits of a text's md5: rows of equal text are one page."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def repeats(lines: DataFrame, pages: DataFrame, ratio: float = 0.2, passage: int = 50) -> DataFrame:
    """(host, h, keep): hashes of the lines to cut, from lines (host, t, h, w) and pages (host, pages).

    Pages of a host are its different texts. A line of w words counts when 3 of them or more hold it and they are
    over ``ratio`` / w of the host's pages, or when it has ``passage`` words; or when 2 or more hold it that are
    over ``ratio`` of the pages. The text ``keep`` keeps it; that is null, so that the line goes from every page,
    where at least 3 pages and over ``ratio`` of them hold it.
    """
    n, share = F.col("n_pages"), F.col("pages") * ratio
    held = lines.distinct().groupBy("host", "h").agg(F.count("*").alias("n_pages"), F.max("w").alias("w"), F.min("t").alias("keep")).where("n_pages >= 2")
    held = held.join(pages, "host").where((n > share) | ((n >= 3) & ((n * F.col("w") > share) | (F.col("w") >= passage))))
    return held.select("host", "h", F.when(~((n >= 3) & (n > share)), F.col("keep")).alias("keep"))


def drop_repeats(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.2, passage: int = 50) -> DataFrame:
    """As drop_lines, by the rule of ``repeats``: no line is lost from a host but those on over ``ratio`` of its pages.

    Repeated rows are one page here, so copies of a document do not make its lines boilerplate.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    pages = own.select("host", _text_key(F.col("text")).alias("t")).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    words = lambda x: F.size(F.split(F.trim(x), "[ \\t\\r\\f]+"))
    each = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.struct(_hash(x).alias("h"), words(x).alias("w"))))
    lines = own.select("host", _text_key(F.col("text")).alias("t"), F.explode(each).alias("l")).select("host", "t", "l.h", "l.w")
    bad = scratch.cut(repeats(lines, pages, ratio, passage))
    cut = lines.join(broadcast_if(bad, bad.count()), ["host", "h"]).where("keep is null or keep <> t")
    known = scratch.cut(cut.groupBy(F.col("host").alias("_host"), F.col("t").alias("_t")).agg(F.collect_set("h").alias("_known")))
    n = known.agg(F.sum(F.size("_known"))).first()[0] or 0
    out = packed_rows(docs).withColumn("_host", F.coalesce(F.col("_row")[host].cast("string"), F.lit(""))).withColumn("_t", _text_key(F.col("_row")[text]))
    scratch.free(known)
    return _without_known(out.join(broadcast_if(known, n), ["_host", "_t"], "left"), docs.columns, text)
