"""Search-interest answers as rows: regions, trending searches, widgets and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import windows


def region_rows(df: DataFrame, keys: list[str], regions: str, index: int = 0, no_data: bool = False) -> DataFrame:
    """(keys, code, name, value, has_data, rank) of an array of regions (code, name, values, has_data): value ``index``, missing flags mean data.

    Rows without data go unless asked for. Ranked by value, missing ones as -1, then by name.
    """
    r = df.select(*keys, F.explode(regions).alias("r"))
    has = F.coalesce(F.try_element_at("r.has_data", F.lit(index + 1)), F.lit(True))
    rows = r.select(*keys, F.col("r.code").alias("code"), F.col("r.name").alias("name"), F.try_element_at("r.values", F.lit(index + 1)).alias("value"), has.alias("has_data"))
    return windows.ranked(rows if no_data else rows.where("has_data"), keys, by_value("value", "name"))


def by_value(value: str, name: str) -> list[Column]:
    """Order: the highest value first, null as -1, then by name."""
    return [F.coalesce(F.col(value), F.lit(-1)).desc(), F.col(name).asc()]


def volume_label(n: Column) -> Column:
    """1500 as 1.5K+, 2000000 as 2M+."""
    short = lambda d, unit: F.concat(F.regexp_replace(F.format_string("%.1f", n / d), r"\.0$", ""), F.lit(unit))
    return F.when(n >= 1_000_000, short(1e6, "M+")).when(n >= 1000, short(1e3, "K+")).otherwise(F.concat(n.cast("long").cast("string"), F.lit("+")))


def trending_rows(df: DataFrame, keys: list[str], payload: str, names: dict[int, str]) -> DataFrame:
    """(keys, rank, title, geo, volume, label, growth, started, ended, active, queries, categories) of a VARIANT of positional arrays.

    Places: 0 title, 2 geo, 3 and 4 start and end (seconds, in arrays), 6 volume, 8 growth, 9 queries, 10 category
    ids, told by ``names`` (a short fixed list); an unknown id reads "Category n". No end: active. Entries without a title go.
    """
    e = df.select(*keys, F.posexplode(F.try_variant_get(payload, "$", "array<variant>")).alias("_i", "_v"))
    at = lambda k, kind: F.try_variant_get("_v", f"$[{k}]", kind)
    rows = e.where(at(0, "string").isNotNull()).select(
        *keys, (F.col("_i") + 1).alias("rank"), at(0, "string").alias("title"), at(2, "string").alias("geo"), at(6, "double").alias("volume"), at(8, "double").alias("growth"),
        F.timestamp_seconds(F.try_variant_get("_v", "$[3][0]", "long")).alias("started"), F.timestamp_seconds(F.try_variant_get("_v", "$[4][0]", "long")).alias("ended"), F.coalesce(at(9, "array<string>"), F.array().cast("array<string>")).alias("queries"), at(10, "array<int>").alias("_ids"))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<int,string>")
    named = F.transform("_ids", lambda i: F.coalesce(F.try_element_at(known, i), F.concat(F.lit("Category "), i.cast("string"))))
    return rows.select("*", volume_label(F.col("volume")).alias("label"), F.col("ended").isNull().alias("active"), F.coalesce(named, F.array().cast("array<string>")).alias("categories")).drop("_ids")


def select_widgets(df: DataFrame, keys: list[str], order: str, widget: str, keyword: str, terms: Column) -> DataFrame:
    """(keys, kind, term, widget): of the widgets named KIND or KIND_n the first of each kind and term.

    The term is the asked one equal to the widget's keyword, case aside, else the n-th; a map of several terms without a
    number compares them and has no term, as has the time series. Widgets of other names or terms go.
    """
    pattern = r"^(TIMESERIES|GEO_MAP|RELATED_QUERIES|RELATED_TOPICS)(?:_(\d+))?$"
    kind, number = F.regexp_extract(widget, pattern, 1), F.regexp_extract(widget, pattern, 2).try_cast("int")
    asked = F.try_element_at(F.filter(terms, lambda t: F.lower(F.trim(t)) == F.lower(F.trim(keyword))), F.lit(1))
    nth = F.try_element_at(terms, F.coalesce(number, F.when(F.size(terms) == 1, F.lit(0))) + 1)
    shared = (kind == "TIMESERIES") | ((kind == "GEO_MAP") & number.isNull() & (F.size(terms) > 1))
    rows = df.select(*keys, order, F.col(widget).alias("widget"), kind.alias("kind"), F.when(~shared, F.coalesce(asked, nth)).alias("term"), shared.alias("_s"))
    rows = rows.where((F.col("kind") != "") & (F.col("_s") | F.col("term").isNotNull()))
    return windows.top_n(rows, [*keys, "kind", "term"], [order], 1, "_n").select(*keys, "kind", "term", "widget")


def explore_link(site: str, title: Column, hours: Column, geo: Column) -> Column:
    """The page of a trending search, for the shortest window that holds the hours."""
    window = F.when(hours <= 4, "now 4-H").when(hours <= 24, "now 1-d").otherwise("now 7-d")
    return F.concat(F.lit(f"{site}/trends/explore?q="), F.url_encode(title), F.lit("&date="), F.url_encode(window), F.lit("&geo="), F.url_encode(F.coalesce(geo, F.lit(""))))


def trending_item(df: DataFrame, site: str, hours: Column) -> DataFrame:
    """df (title, geo, news array of title, url, source) with the first news, how many there are and the explore link."""
    first = F.try_element_at("news", F.lit(1))
    return df.withColumns({"n_news": F.greatest(F.size("news"), F.lit(0)), "news_title": first["title"], "news_url": first["url"], "news_source": first["source"], "explore_url": explore_link(site, F.col("title"), hours, F.col("geo"))})
