"""Registered queries that match names and read numbers, dates and cells out of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import records as rc
from tidewater.functions import text as tx
from tidewater.functions import values as v
from tidewater.operators import match, monitor, windows
from tidewater.plans.records import _money, _t
from tidewater.plans.registry import registry
from tidewater.plans.snapshots import _SQL as _DIFF_SQL
from tidewater.plans.snapshots import _changes

QUERIES, ORACLE, query = registry()


@query("""with l as (select p_name as name, min(p_partkey) as pos, list_distinct(string_split(p_name, ' ')) as u from part group by 1),
w as (select distinct 'The ' || split_part(p_name, ' ', 1) || ' by ' || p_type as wanted from part),
t as (select wanted, list_filter(list_distinct(string_split(lower(wanted), ' ')), lambda x: length(x) > 1 and x not in ('hotel', 'the', 'and', 'by')) as t from w),
s as (select wanted, name, pos, len(list_intersect(t, u)) / len(t) as score from t, l where len(list_intersect(t, u)) / len(t) >= 0.5)
select w.wanted, b.match, round(b.score, 6) as score from w left join (select wanted, arg_min(name, (-score, pos)) as match, max(score) as score from s group by 1) b on w.wanted = b.wanted""")
def token_match(spark, d):
    part = _t(spark, d, "part")
    wanted = part.select(F.concat(F.lit("The "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" by "), F.col("p_type")).alias("wanted"))
    return match.token_match(wanted, "wanted", part, "p_name", "p_partkey").select("wanted", "match", F.round("score", 6).alias("score"))


@query("""with w as (select distinct split_part(p_name, ' ', 1) as wanted from part union select distinct p_name from part union select distinct p_type from part),
j as (select wanted, p_name, p_name <> lower(wanted) as far, p_size, p_partkey from w join part on starts_with(p_name, lower(wanted)))
select w.wanted, b.match, b.how from w left join (select wanted, arg_min(p_name, (far, -p_size, p_partkey)) as match, case when min(far::int) = 1 then 'prefix' else 'exact' end as how from j group by 1) b on w.wanted = b.wanted""")
def exact_then_prefix_pick(spark, d):
    part = _t(spark, d, "part")
    wanted = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("wanted")).union(part.select("p_name")).union(part.select("p_type"))
    return match.exact_then_prefix(wanted, "wanted", part, "p_name", "p_size", "p_partkey")


@query("""with k as (select distinct p_brand || '-' || p_type as value from part), w as (select p_brand as wanted from part union select p_brand || '-' || lower(p_type) from part union select p_type from part),
e as (select wanted, value from w join k on lower(value) = lower(wanted)), f as (select wanted, value from w join k on starts_with(lower(value), lower(wanted) || '-') where wanted not in (select wanted from e))
select * from e union all select * from f union all select wanted, wanted from w where wanted not in (select wanted from e) and wanted not in (select wanted from f)""")
def family_expand(spark, d):
    part = _t(spark, d, "part")
    name = F.concat_ws("-", "p_brand", "p_type")
    wanted = part.select(F.col("p_brand").alias("wanted")).union(part.select(F.concat_ws("-", "p_brand", F.lower("p_type")))).union(part.select("p_type"))
    return match.family_expand(wanted, "wanted", part.select(name.alias("known")), "known")


@query("""with m as (select p_partkey, lower(p_name || ' ' || p_type) as h from part)
select p_partkey, case when regexp_matches(h, '(^|[ /-])(cold)') then '' else concat_ws(',', case when regexp_matches(h, '(^|[ /-])(ring|bolt)') then 'fastener' end, case when regexp_matches(h, '(^|[ /-])(eco|promo)') then 'cheap' end) end as matched from m""")
def matched_keywords(spark, d):
    found = match.matched_keywords(F.concat_ws(" ", "p_name", "p_type"), {"fastener": ["ring", "bolt"], "cheap": ["eco", "promo"]}, ["cold"])
    return _t(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("matched"))


@query("select l_orderkey, l_linenumber, case when l_linenumber % 4 = 2 then -round(l_extendedprice, 2) else round(l_extendedprice, 2) end as value, case l_linenumber % 4 when 1 then 'EUR' when 2 then 'USD' when 3 then 'EUR' end as currency from lineitem")
def parse_number(spark, d):
    """Prices printed in four styles and read back."""
    us = F.format_number("l_extendedprice", 2)
    eu, spaced = F.translate(us, ",.", ".,"), F.translate(us, ",.", " ,")
    style = F.col("l_linenumber") % 4
    printed = F.when(style == 0, us).when(style == 1, F.concat(eu, F.lit(" EUR"))).when(style == 2, F.concat(F.lit("($"), us, F.lit(")"))).otherwise(F.concat(F.lit("€ "), spaced))
    rows = _t(spark, d, "lineitem").withColumn("printed", printed)
    return rows.select("l_orderkey", "l_linenumber", v.parse_number(F.col("printed"), style == 1).alias("value"), v.currency_of(F.col("printed")).alias("currency"))


@query("select o_orderkey, o_orderdate::date::varchar as parsed from orders")
def parse_date(spark, d):
    """Dates printed in four styles and read back."""
    day, style = F.col("o_orderdate"), F.col("o_orderkey") % 4
    printed = F.when(style == 0, F.date_format(day, "yyyy-MM-dd")).when(style == 1, F.date_format(day, "dd.MM.yyyy")).when(style == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.concat(F.lit("due "), F.date_format(day, "d MMM yyyy")))
    return _t(spark, d, "orders").select("o_orderkey", v.parse_date(printed).cast("string").alias("parsed"))


@query("select p_partkey, case when p_partkey % 3 = 1 then p_size::double when p_partkey % 3 = 2 then -p_size::double end as number from part")
def typed_cells(spark, d):
    size, style = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    cell = F.when(style == 0, F.concat(F.lit("0"), size)).when(style == 1, size).otherwise(F.concat(F.lit("("), size, F.lit(")")))
    return _t(spark, d, "part").select("p_partkey", v.typed_cell(cell).alias("number"))


@query("""with d as (select distinct o_orderdate::date as day from orders), a as (select day, unnest(generate_series(day - interval 13 days, day + interval 14 days, interval 1 day))::date as x from d),
r as (select day, x, row_number() over (partition by day, x > day order by case when x > day then x - day else day - x end) as n from a where dayofweek(x) in (3, 6))
select day::varchar as day, string_agg(x::varchar, ',' order by x) as drops from r where n <= 2 group by 1""")
def drop_days(spark, d):
    day = _t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return day.select(F.col("day").cast("string").alias("day"), F.array_join(v.drop_days(F.col("day")), ",").alias("drops"))


@query("select doc_id, (len(list_filter(regexp_extract_all(text, '[0-9.,]+'), lambda x: regexp_full_match(x, '[0-9]+,[0-9]{1,2}'))) + 2 * len(regexp_extract_all(text, '[0-9]\\.[0-9]{3},[0-9]')))::int as comma, (len(list_filter(regexp_extract_all(text, '[0-9.,]+'), lambda x: regexp_full_match(x, '[0-9]+\\.[0-9]{1,2}'))) + 2 * len(regexp_extract_all(text, '[0-9],[0-9]{3}\\.[0-9]')) + len(list_filter(regexp_extract_all(text, '[0-9.,]+'), lambda x: regexp_full_match(x, '[0-9]{1,3}(,[0-9]{3})+'))))::int as dot from documents")
def decimal_comma_vote(spark, d):
    comma, dot = v.decimal_comma_votes(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", comma.cast("int").alias("comma"), dot.cast("int").alias("dot"))


@query(r"select page_id, case when ends_with(t, ' - ' || s) then left(t, length(t) - length(s) - 3) when ends_with(t, ' | ' || s) then left(t, length(t) - length(s) - 3) else t end as title from (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as s, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || case page_id % 3 when 0 then ' - ' || regexp_extract(url, '://([^/?#]*)', 1) when 1 then ' | ' || regexp_extract(url, '://([^/?#]*)', 1) else '' end as t from pages)")
def title_suffix_strip(spark, d):
    site = F.regexp_extract("url", "://([^/?#]*)", 1)
    tail = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" - "), site)).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" | "), site)).otherwise("")
    title = F.concat(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), tail)
    return _t(spark, d, "pages").select("page_id", tx.strip_suffix(title, site).alias("title"))


@query("select l_orderkey, arg_min(l_linenumber, (case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end, l_linenumber)) as picked, arg_min(l_returnflag, (case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end, l_linenumber)) as status from lineitem group by 1")
def status_priority_pick(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("status"))))
    picked = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(rc.by_status(rows, ("A", "N", "R")).alias("p"))
    return picked.select("l_orderkey", F.col("p.l_linenumber").alias("picked"), "p.status")


@query("select l_orderkey, l_linenumber, l_extendedprice / l_quantity as per_night, round(round(l_extendedprice, 2)::decimal(18,2) * (1 + l_tax::decimal(4,2)), 2)::double as total from lineitem")
def per_night_split(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("per_night"), F.round(_money("l_extendedprice") * (1 + F.col("l_tax").cast("decimal(4,2)")), 2).cast("double").alias("total"))


_MIX = ", r as (select key, change_type, row_number() over (partition by change_type order by key) as n from j where change_type <> 'unchanged'), m as (select key, change_type, row_number() over (order by n, change_type)::int as position from r qualify position <= 20)"


def _preview(spark, d):
    changes = _changes(spark, d, []).where("change_type <> 'unchanged'")
    return monitor.interleaved(changes, "change_type", "key", 20)


@query(_DIFF_SQL + _MIX + " select key, change_type, position from m")
def interleaved_preview(spark, d):
    return _preview(spark, d).select("key", "change_type", "position")


@query(_DIFF_SQL + _MIX + """ select (select count_if(change_type = 'new') || ' new, ' || count_if(change_type = 'changed') || ' changed, ' || count_if(change_type = 'removed') || ' removed' from j) || chr(10) || (select string_agg('- ' || change_type || ': ' || key, chr(10) order by position) from m)
 || case when (select count(*) from r) > 20 then chr(10) || '…and ' || ((select count(*) from r) - 20) || ' more' else '' end as body""")
def alert_digest(spark, d):
    return monitor.digest(_changes(spark, d, []), "change_type", "key", 20)


@query("""with o as (select o_orderkey, row_number() over (order by o_orderkey) as n from orders where o_orderkey % 7 <> 0), c as (select o_orderkey from o where n <= 1000), p as (select o_orderkey from orders where o_orderkey % 10 <> 0)
select coalesce(p.o_orderkey, c.o_orderkey) as o_orderkey, case when p.o_orderkey is null then 'new' when c.o_orderkey is null then 'carried' else 'known' end as kind from p full join c on p.o_orderkey = c.o_orderkey""")
def truncated_diff(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return monitor.truncated(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 7 <> 0"), "o_orderkey", 1000)


@query("with t as (select term, row_number() over (order by term) - 2 as n from (select distinct p_name as term from part)) select (n // 4)::int as grp, term from t where n >= 0 union all select distinct (n // 4)::int, (select min(p_name) from part) from t where n >= 0")
def anchor_groups(spark, d):
    """Terms in their order, the first of all as the anchor of each group of four."""
    return windows.anchor_groups(_t(spark, d, "part").select(F.col("p_name").alias("term")).distinct(), "term", 4).select(F.col("grp").cast("int").alias("grp"), "term")
