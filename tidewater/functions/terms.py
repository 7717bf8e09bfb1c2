"""Search terms put together from the parts that were asked for, and their long rows for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.records import term_status
from tidewater.functions.values import round_half_up

#: Parts of a term and the fields of their entries.
TIMELINE = "array<struct<date:string,value:double,partial:boolean,has_data:boolean>>"
REGIONS = "array<struct<code:string,name:string,value:double,has_data:boolean>>"
RELATED = "array<struct<list:string,rank:int,name:string,value:double,breakout:boolean,link:string>>"
PARTS = {"timeline": TIMELINE, "regions": REGIONS, "queries": RELATED, "topics": RELATED}
ROW = "row_type string, list string, rank int, date string, code string, name string, value double, partial boolean, breakout boolean, link string"


def term_items(terms: DataFrame, keys: list[str], parts: dict[str, DataFrame]) -> DataFrame:
    """terms with an array column a requested part, and status, average, peak_date and top_region.

    ``parts`` holds for each requested part (timeline, regions, queries, topics) a table of the keys and the part's
    array, at most a row a key; a term without one has null there. The status is ok, partial or failed by the parts that
    came. Average and peak are of the points that have data and are whole; the top region is the first with data.
    """
    out = terms
    for name in PARTS:
        if name in parts:
            out = out.join(parts[name].select(*keys, F.col(name).cast(PARTS[name])), keys, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast(PARTS[name]))
    whole = F.filter("timeline", lambda p: p["value"].isNotNull() & ~F.coalesce(p["partial"], F.lit(False)) & F.coalesce(p["has_data"], F.lit(True)))
    total = F.aggregate(whole, F.lit(0.0), lambda a, p: a + p["value"])
    best = F.array_max(F.transform(whole, lambda p, i: F.struct(p["value"].alias("v"), (-i).alias("i"), p["date"].alias("date"))))
    top = F.get(F.filter("regions", lambda r: r["value"].isNotNull() & F.coalesce(r["has_data"], F.lit(True))), F.lit(0))
    status = term_status(**{n: F.col(n) for n in parts}) if parts else F.lit("ok")
    return out.select("*", status.alias("status"), F.when(F.size(whole) > 0, round_half_up(total / F.size(whole))).alias("average"), best["date"].alias("peak_date"), top["name"].alias("top_region"))


def long_rows(items: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, ROW): for each term one row ``term``, then its timeline, region, relatedQuery and relatedTopic rows.

    One pass: the rows of a term are made within it. Missing parts have no rows.
    """
    fields = [f.split() for f in ROW.split(", ")]

    def row(**given: Column) -> Column:
        return F.struct(*[given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in fields])

    none = F.array().cast(f"array<struct<{','.join(f'{n}:{kind}' for n, kind in fields)}>>")
    related = lambda kind: lambda q: row(row_type=F.lit(kind), list=q["list"], rank=q["rank"], name=q["name"], value=q["value"], breakout=F.coalesce(q["breakout"], F.lit(False)), link=q["link"])
    each = [
        F.array(row(row_type=F.lit("term"), date=F.col("peak_date"), name=F.col("top_region"), value=F.col("average"))),
        F.transform("timeline", lambda p: row(row_type=F.lit("timeline"), date=p["date"], value=p["value"], partial=p["partial"])),
        F.transform("regions", lambda r: row(row_type=F.lit("region"), code=r["code"], name=r["name"], value=r["value"])),
        F.transform("queries", related("relatedQuery")),
        F.transform("topics", related("relatedTopic")),
    ]
    return items.select(*keep, F.inline(F.concat(*[F.coalesce(x, none) for x in each])))
