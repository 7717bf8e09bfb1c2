"""Registered queries over orders, line items, parts, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import criteria
from tidewater.functions import text as tx
from tidewater.operators import invoice, keys, listing, merge, monitor, series, windows
from tidewater.plans.registry import registry

QUERIES, ORACLE, query = registry()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over all cores, for work that is heavy a row: a small file is few tasks, whatever its rows cost."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _money(c: str):
    return F.round(c, 2).cast("decimal(18,2)")


@query("""select o_orderkey, o_custkey, substr(translate(base64(unhex(sha1('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'))), '+/', '-_'), 1, 16) as fingerprint from orders""")
def row_fingerprint(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey", keys.fingerprint(["o_orderkey", "o_orderstatus", "o_orderpriority"]).alias("fingerprint"))


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def first_per_key(spark, d):
    return windows.top_n(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 1).select("user_id", "event_id", "event_type")


@query("with l as (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select user_id, event_id, event_type from l where value >= 50")
def latest_revision_filter(spark, d):
    return windows.latest_revision(_t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("value") >= 50).select("user_id", "event_id", "event_type")


@query("select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id)::int as rank from events")
def feed_rank(spark, d):
    """Each feed's events, newest first, dealt by ranges, so that a hot feed is no single task."""
    e = _t(spark, d, "events").select("event_type", "event_id", "ts")
    return windows.numbered(e, [F.desc("ts"), "event_id"], "rank", ["event_type"]).select("event_type", "event_id", F.col("rank").cast("int").alias("rank"))


@query("select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber)::int as rank from lineitem qualify rank <= 3")
def top_n_per_group(spark, d):
    return windows.top_n(_t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("select o_orderkey, o_custkey from orders order by o_orderdate desc nulls last, o_orderkey limit 100")
def newest_capped(spark, d):
    return _t(spark, d, "orders").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey")


_BY_PRICE = "select p_partkey, p_name, row_number() over (order by p_retailprice, p_partkey)::int as position from part"


@query("select p_partkey, p_name, row_number() over (order by p_name desc, p_partkey)::int as position from part")
def sorted_listing(spark, d):
    """Every part in an order that the caller chose: names downwards."""
    p = _t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return windows.numbered(p, listing.chosen_order("name_desc", "p_name", "p_retailprice", "p_partkey")).select("p_partkey", "p_name", F.col("position").cast("int").alias("position"))


@query(_BY_PRICE)
def whole_listing(spark, d):
    """Every part in its order by price."""
    p = _t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return windows.numbered(p, ["p_retailprice", "p_partkey"]).select("p_partkey", "p_name", F.col("position").cast("int").alias("position"))


@query("select event_id, user_id from events where event_id not in (select event_id from events where event_id % 3 = 0)")
def unseen_only(spark, d):
    e = _t(spark, d, "events")
    return monitor.unseen(e, e.where("event_id % 3 = 0"), "event_id").select("event_id", "user_id")


@query("select o_orderkey, coalesce(case when o_orderkey % 4 <> 0 then o_orderpriority end, c_mktsegment) as label, c_name as name from orders left join customer on o_custkey = c_custkey")
def fill_from_detail(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("label"), F.lit("").alias("name"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"))
    return merge.fill_from(o, c, ["k"], ["label", "name"]).drop("k")


@query("with w as (select distinct l_partkey * 2 as p_partkey from lineitem) select w.p_partkey, p_name, p_name is not null as found from w left join part p on w.p_partkey = p.p_partkey")
def requested_vs_found(spark, d):
    w = _t(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("p_partkey")).distinct()
    return merge.requested_vs_found(w, _t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")


@query("select l_partkey, l_suppkey, min(round(l_extendedprice, 2)::decimal(18,2)) as price, arg_min(l_shipdate::date::varchar, (l_extendedprice, l_orderkey * 10 + l_linenumber)) as shipped, bool_or(l_returnflag = 'R') as official from lineitem group by 1, 2")
def offer_merge(spark, d):
    li = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("p"), _money("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_shipdate").cast("date").cast("string").alias("shipped"), (F.col("l_returnflag") == "R").alias("official"))
    return merge.merge_by_lowest(li, ["l_partkey", "l_suppkey"], "price", "seq", ["shipped"], ["official"])


@query("select l_partkey, count(*) as n_offers, arg_min(l_suppkey, (round(l_extendedprice, 2)::decimal(18,2), l_suppkey)) as cheapest, min(round(l_extendedprice, 2)::decimal(18,2)) as lowest, min(round(l_extendedprice, 2)::decimal(18,2)) filter (l_linestatus = 'O') as official_price from lineitem group by 1")
def price_parity(spark, d):
    li = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", _money("l_extendedprice").alias("price"), (F.col("l_linestatus") == "O").alias("official"))
    return merge.offers_summary(li, ["l_partkey"], "l_suppkey", "price", "official")


_SERIES = "with p as (select event_type, ts::date as day, count(*) as value, ts::date >= date '2024-01-29' as partial from events group by 1, 2, 4)"


def _points(spark, d):
    day = F.col("ts").cast("date")
    return _t(spark, d, "events").groupBy("event_type", day.alias("day")).agg(F.count("*").alias("value")).withColumn("partial", F.col("day") >= F.lit("2024-01-29").cast("date"))


@query(_SERIES + " select event_type, round(coalesce(avg(value) filter (not partial), avg(value)), 6) as average, max(value) as peak, arg_min(day, (-value, day))::varchar as peak_at, arg_max(value, day) as latest, max(day)::varchar as latest_at from p group by 1")
def series_stats(spark, d):
    s = series.series_stats(_points(spark, d), ["event_type"], "day", "value", "partial")
    return s.withColumn("average", F.round("average", 6)).withColumn("peak_at", F.col("peak_at").cast("string")).withColumn("latest_at", F.col("latest_at").cast("string"))


_ANCHOR = """with g as (select user_id % 3 as grp, case when event_type = 'click' then 'A' else event_type || (user_id % 3) end as term, ts::date as day, count(*)::double as value, ts::date >= date '2024-01-29' as partial from events group by 1, 2, 3, 5),
s as (select grp, sum(value) filter (not partial) as s, avg(value) filter (not partial) as a from g where term = 'A' group by 1 having s > 0), r as (select arg_min(s, grp) as ref from s), v as (select g.*, value * (ref / s) as v from g join s on g.grp = s.grp, r), m as (select max(v) as top from v)"""


def _grouped(spark, d):
    e = _t(spark, d, "events").withColumn("grp", F.col("user_id") % 3).withColumn("day", F.col("ts").cast("date"))
    term = F.when(F.col("event_type") == "click", "A").otherwise(F.concat("event_type", F.col("grp").cast("string")))
    return e.groupBy("grp", term.alias("term"), "day").agg(F.count("*").cast("double").alias("value")).withColumn("partial", F.col("day") >= F.lit("2024-01-29").cast("date"))


@query(_ANCHOR + " select grp, term, day::varchar as day, floor(v / top * 10000 + 0.5) / 100 as value from v, m")
def anchor_rescale(spark, d):
    return series.anchor_rescale(_grouped(spark, d), "A")[0].select("grp", "term", F.col("day").cast("string").alias("day"), "value")


@query(_ANCHOR + " select grp, round(a, 4) as anchor_average, round(ref / s, 4) as scale, a < 10 as weak from s, r")
def anchor_diagnostics(spark, d):
    return series.anchor_rescale(_grouped(spark, d), "A")[1]


@query("select l_suppkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges from (select l_suppkey, min(n) as a, max(n) as b from (select l_suppkey, n, n - row_number() over (partition by l_suppkey order by n) as g from (select distinct l_suppkey, l_partkey as n from lineitem)) group by l_suppkey, g) group by 1")
def compact_ranges(spark, d):
    return windows.compact_ranges(_t(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")


@query("select o_orderkey, round(o_totalprice, 2)::decimal(18,2) as total, s as line_sum, abs(s - round(o_totalprice, 2)::decimal(18,2)) <= greatest(0.02, round(o_totalprice, 2) * 0.001) as ok from orders join (select l_orderkey, sum(round(l_extendedprice, 2)::decimal(18,2)) as s from lineitem group by 1) on o_orderkey = l_orderkey")
def invoice_totals_check(spark, d):
    s = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(_money("l_extendedprice")).alias("line_sum"))
    j = _t(spark, d, "orders").select("o_orderkey", _money("o_totalprice").alias("total")).join(s, "o_orderkey")
    return j.withColumn("ok", F.abs(F.col("line_sum") - F.col("total")).cast("double") <= F.greatest(F.lit(0.02), F.col("total").cast("double") * 0.001))


@query("select l_orderkey, case when count(distinct l_tax) = 1 then max(l_tax) end as tax from lineitem group by 1")
def single_value_consensus(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.countDistinct("l_tax") == 1, F.max("l_tax")).alias("tax"))


@query("with r as (select source, count(*) as n_read, count_if(n_chars >= 1000) as n_matched, count_if(n_chars >= 1000 and lang = 'en') as n_output, count_if(n_chars < 200) as n_failed from documents group by 1) select *, case when n_failed = n_read then 'failed' when n_failed > 0 then 'partial' else 'ok' end as status from r")
def source_report(spark, d):
    size = F.col("n_chars")
    return monitor.run_report(_t(spark, d, "documents"), "source", size >= 1000, (size >= 1000) & (F.col("lang") == "en"), size < 200)


@query("select o_orderkey, abs(s - case when o_orderkey % 2 = 0 then s else s + 5 end) <= greatest(0.02, case when o_orderkey % 2 = 0 then s else s + 5 end * 0.001) as lines_ok, case when o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 then 'true' else 'unknown' end as total_ok, case when o_orderkey % 3 <> 0 or o_orderkey % 2 <> 0 then (case when o_orderkey % 2 = 0 then s + 1 else s + 5 end)::double else round(s + 1.0, 2)::double end as total from orders join (select l_orderkey, sum(floor(l_quantity))::double as s from lineitem group by 1) on o_orderkey = l_orderkey")
def totals_check(spark, d):
    """Orders with a subtotal and tax, with a total only, and with no total."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.floor("l_quantity")).cast("double").alias("s"))
    even, third = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0
    check = invoice.totals_check(F.col("s"), F.when(even, F.col("s")), F.when(even, F.lit(1.0)), F.when(~even, F.col("s") + 5).when(~third, F.col("s") + 1))
    return _t(spark, d, "orders").join(li, "o_orderkey").select("o_orderkey", check.alias("c")).select("o_orderkey", "c.lines_ok", F.coalesce(F.col("c.total_ok").cast("string"), F.lit("unknown")).alias("total_ok"), "c.total")


@query("select user_id, count(*) as n from events group by 1 having count(*) >= 70")
def capped_groups(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 70")


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus in ('O', 'F') and starts_with(o_orderpriority, '1') and o_totalprice between 50000 and 200000 and o_orderdate >= timestamp '1995-01-01'")
def multi_criteria_search(spark, d):
    chosen = criteria.every(criteria.one_of(F.col("o_orderstatus"), ["O", "F"]), criteria.exact_or_prefix(F.col("o_orderpriority"), ["1"]), criteria.bounds(F.col("o_totalprice"), 50000, 200000), criteria.in_window(F.col("o_orderdate"), "1995-01-01"), criteria.holds_all(F.col("o_orderpriority"), []))
    c = _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation is a fixed dimension
    return _t(spark, d, "orders").where(chosen).join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("select p_partkey, case when regexp_matches(lower(p_type), '(^|[ /-])(promo|econ)') then 'cheap' when regexp_matches(lower(p_type), '(^|[ /-])(brass|steel|copper)') then 'metal' else 'other' end as category from part")
def keyword_category(spark, d):
    return _t(spark, d, "part").select("p_partkey", tx.category(F.col("p_type"), {"cheap": ["promo", "econ"], "metal": ["brass", "steel", "copper"]}).alias("category"))


@query("select event_id from events where ts is null or (ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12')")
def time_window_filter(spark, d):
    return _t(spark, d, "events").where(criteria.in_window(F.col("ts"), "2024-01-10", "2024-01-12")).select("event_id")


@query("with c as (select ts from events order by ts desc, event_id limit 1 offset 500) select event_id from events, c where events.ts >= c.ts and not (events.ts = c.ts and event_id % 2 = 0)")
def cursor_increment(spark, d):
    e = _t(spark, d, "events")
    cursor = F.lit(e.select("ts").orderBy(F.desc("ts"), "event_id").offset(500).first()["ts"]).cast("timestamp_ntz")
    return monitor.increment(e, "ts", "event_id", cursor, e.where((F.col("ts") == cursor) & (F.col("event_id") % 2 == 0))).select("event_id")


@query("select user_id from (select user_id, min(ts) as t from events group by 1) where t >= timestamp '2024-01-16' - interval 15 days")
def seen_retention(spark, d):
    first = _t(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("t"))
    return monitor.retain(first, "t", F.lit("2024-01-16").cast("timestamp_ntz"), 15).select("user_id")


@query("select event_id from events order by ts desc, event_id desc limit 200")
def seen_cap(spark, d):
    return monitor.newest(_t(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 200).select("event_id")


@query("select event_id from events where event_id % 5 <> 0 and event_type = 'purchase' order by ts, event_id limit 50")
def partial_delivery(spark, d):
    e = _t(spark, d, "events")
    return monitor.deliver(e.where("event_type = 'purchase'"), e.where("event_id % 5 = 0"), "event_id", [F.col("ts"), F.col("event_id")], 50)[0].select("event_id")


@query("select 'customer' as kind, c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select 'supplier', s_suppkey, s_name, s_acctbal, null from supplier")
def unified_union(spark, d):
    c = _t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("select min(p_partkey) as first_key, lower(p_type) as folded, arg_min(p_type, p_partkey) as spelling from part group by lower(p_type)")
def distinct_ci(spark, d):
    return _t(spark, d, "part").groupBy(F.lower("p_type").alias("folded")).agg(F.min("p_partkey").alias("first_key"), F.min_by("p_type", "p_partkey").alias("spelling"))


@query("select p_partkey, regexp_replace(regexp_replace(replace(lower(p_name), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from part")
def slugify(spark, d):
    return _t(spark, d, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@query("select p_partkey, case when length(p_partkey::varchar) < 8 then lpad(p_partkey::varchar, 8, '0') else p_partkey::varchar end as padded from part")
def pad_ids(spark, d):
    return _t(spark, d, "part").select("p_partkey", tx.pad_id(F.col("p_partkey"), 8).alias("padded"))


@query("select c_custkey, 'CERT-' || lpad(row_number() over (order by c_custkey)::varchar, 6, '0') as serial from customer")
def sequence_ids(spark, d):
    """Numbers by the order of keys."""
    c = _t(spark, d, "customer").select("c_custkey")
    return windows.numbered(c, ["c_custkey"]).select("c_custkey", F.concat(F.lit("CERT-"), F.lpad(F.col("position").cast("string"), 6, "0")).alias("serial"))


@query("select p_partkey, p_type || case when n > 1 then '_' || n else '' end as unique_name from (select p_partkey, p_type, row_number() over (partition by p_type order by p_partkey) as n from part)")
def unique_names(spark, d):
    return windows.unique_names(_t(spark, d, "part"), "p_type", ["p_partkey"]).select("p_partkey", "unique_name")


@query("select c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment as body from customer")
def text_merge(spark, d):
    body = tx.fill_template("Dear {{name}} of {{ segment }}", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})
    return _t(spark, d, "customer").select("c_custkey", body.alias("body"))


@query("select o_orderkey, case when o_totalprice >= 1000000 then floor(o_totalprice / 1000000)::bigint || 'M+' when o_totalprice >= 1000 then floor(o_totalprice / 1000)::bigint || 'K+' else floor(o_totalprice)::bigint || '+' end as label from orders")
def traffic_label(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", tx.traffic_label(F.col("o_totalprice")).alias("label"))


@query("select doc_id, pos::int as chunk_no, substr(text, (pos * 450 + 1)::bigint, 500) as chunk from (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 50) / 450.0))::bigint)) as pos from documents where length(text) > 0)")
def fixed_windows(spark, d):
    t = _t(spark, d, "documents").where(F.length("text") > 0)
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 50) / 450.0)).cast("int")
    return t.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no")).select("doc_id", "chunk_no", F.substring("text", F.col("chunk_no") * 450 + 1, F.lit(500)).alias("chunk"))


@query("select doc_id, greatest(1, ceil(length(text) / 3000.0))::bigint as pages from documents")
def page_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.greatest(F.lit(1), F.ceil(F.length("text") / 3000.0)).cast("long").alias("pages"))


@query("select source, count(*) as documents, sum(greatest(1, ceil(length(text) / 3000.0)))::bigint as pages, sum(length(text))::bigint as characters from documents group by 1")
def document_summary(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.greatest(F.lit(1), F.ceil(F.length("text") / 3000.0))).cast("long").alias("pages"), F.sum(F.length("text")).cast("long").alias("characters"))


@query(r"select page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '[^A-Za-z0-9]+', '-', 'g') || '-' || left(sha1(url), 10) as key from pages")
def record_key(spark, d):
    return _t(spark, d, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "[^A-Za-z0-9]+", "-"), F.lit("-"), F.left(F.sha1("url"), F.lit(10))).alias("key"))
