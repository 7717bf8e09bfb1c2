"""Registered queries over feeds, JSON, HTML, auctions and products that are derived from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import auctions, criteria, markdown, pages, products, terms, trends
from tidewater.functions import records as rc
from tidewater.functions import text as tx
from tidewater.functions import values as v
from tidewater.operators import documents as dc
from tidewater.operators import invoice, listing, windows
from tidewater.plans.records import _dealt, _money, _t
from tidewater.plans.registry import registry
from tidewater.sources import bodies, items, links
from tidewater.streaming import feeds

QUERIES, ORACLE, query = registry()


#: The order of an order's lines, as fields that arrays sort by: a struct inside the sorted ones is compared many times slower.
_ORDER = ("l_linenumber", "l_partkey", "l_extendedprice")


def _by(order: str) -> list:
    return [F.col(f"o.{f}").alias(f"_{f}") for f in _ORDER] if order == "o" else [F.col(order).alias("_o")]


def _list(order: str, *fields, name: str = "rows"):
    """An array of structs in the order of a column."""
    return F.sort_array(F.collect_list(F.struct(*_by(order), *fields))).alias(name)


@query("select doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[’ʼ`]', '''', 'g'), '\\s+', ' ', 'g')) as folded from documents")
def text_fold(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query("select user_id, row_number() over (partition by user_id order by event_id)::int as position, event_type || ' & ' || event_id as title, 'https://n.example/' || event_id as link, 'g' || event_id as guid, 'S' || user_id as source, 'https://s.example/' || user_id as source_url from events where user_id % 7 <> 0 union all select distinct user_id, 0, null, null, null, null, null from events where user_id % 7 = 0")
def feed_items(spark, d):
    """A feed of each user's events, read back; every seventh body is no feed."""
    e = _t(spark, d, "events")
    i = F.concat(F.lit("<item><title>"), "event_type", F.lit(" &amp; "), F.col("event_id").cast("string"), F.lit("</title><link>https://n.example/"), F.col("event_id").cast("string"), F.lit("</link><guid isPermaLink=\"false\">g"), F.col("event_id").cast("string"), F.lit("</guid><source url=\"https://s.example/"), F.col("user_id").cast("string"), F.lit("\">S"), F.col("user_id").cast("string"), F.lit("</source></item>"))
    b = e.groupBy("user_id").agg(_list("event_id", i.alias("x")))
    body = F.when(F.col("user_id") % 7 == 0, F.lit("<html>no feed</html>")).otherwise(F.concat(F.lit("<rss version=\"2.0\"><channel><title>t</title>"), F.array_join(F.transform("rows", lambda x: x["x"]), ""), F.lit("</channel></rss>")))
    return bodies.read_feed(b.withColumn("body", body), "body", ["user_id"]).select("user_id", F.coalesce("position", F.lit(0)).alias("position"), "title", "link", "guid", "source", "source_url")


@query("select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice)::int as position, 'part <' || l_partkey || '>' as title, floor(l_quantity)::bigint || 'K+' as traffic, floor(l_quantity)::bigint * 1000 as visits, 'news ' || l_suppkey as news, 'https://n.example/?a=1&b=' || l_suppkey as news_url from lineitem")
def trending_feed(spark, d):
    """A trending feed of each order's lines with nested news, CDATA and entities, read back."""
    s = lambda c: F.col(c).cast("string")
    q = F.floor("l_quantity").cast("string")
    i = F.concat(F.lit("<item><title><![CDATA[part &lt;"), s("l_partkey"), F.lit("&gt;]]></title><ht:approx_traffic>"), q, F.lit("K+</ht:approx_traffic><ht:news_item><ht:news_item_title>news "), s("l_suppkey"), F.lit("</ht:news_item_title><ht:news_item_url>https://n.example/?a=1&amp;b="), s("l_suppkey"), F.lit("</ht:news_item_url></ht:news_item></item>"))
    order = F.struct(*_ORDER)
    b = _t(spark, d, "lineitem").withColumn("o", order).groupBy(F.col("l_orderkey").alias("k")).agg(_list("o", i.alias("x")))
    rows = bodies.read_trending_feed(b.withColumn("body", F.array_join(F.transform("rows", lambda x: x["x"]), "\n")), "body", ["k"])
    return rows.select("k", "position", "title", "traffic", v.traffic_number(F.col("traffic")).alias("visits"), F.col("news")[0]["title"].alias("news"), F.col("news")[0]["url"].alias("news_url"))


@query("select o_orderkey, case when o_orderkey % 5 < 3 then o_orderstatus end as status, case when o_orderkey % 5 < 3 then o_custkey::varchar end as customer from orders")
def guarded_json(spark, d):
    """JSON bodies with and without a guard line, HTML and broken ones."""
    o = _t(spark, d, "orders")
    j = F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c")))
    k = F.col("o_orderkey") % 5
    body = F.when(k == 0, j).when(k < 3, F.concat(F.lit(")]}'\n"), j)).when(k == 3, F.concat(F.lit("<html>"), j)).otherwise(F.lit("{broken"))
    x = bodies.prefixed_json(body)
    return o.select("o_orderkey", F.try_variant_get(x, "$.s", "string").alias("status"), F.try_variant_get(x, "$.c", "string").alias("customer"))


@query("select o_orderkey, o_custkey as customer from orders where o_orderkey % 3 <> 0")
def framed_payload(spark, d):
    """The payload of one call among the frames of a body; every third body lacks it."""
    o = _t(spark, d, "orders")
    inner = F.to_json(F.struct(F.col("o_custkey").alias("c")))
    frame = lambda name: F.concat(F.lit(f'["w","{name}",'), F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("]"))
    body = F.concat(F.lit(")]}'\n\n12\n["), frame("other"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(","), frame("wanted"))).otherwise(""), F.lit("]\n25\n[[\"e\",4]]"))
    got = bodies.framed_call(o.select("o_orderkey", body.alias("body")), "body", "wanted", ["o_orderkey"])
    return got.select("o_orderkey", F.try_variant_get("payload", "$.c", "long").alias("customer"))


@query("select page_id, url as address, page_id as blob from pages")
def script_json(spark, d):
    p = _t(spark, d, "pages")
    data = F.to_json(F.struct(F.struct("url").alias("props")))
    html = F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script><script>call({key: 'ds:0', hash: '1', data:["), F.col("page_id").cast("string"), F.lit(",[]], sideChannel: {}});</script>"))
    return p.select("page_id", F.try_variant_get(bodies.embedded_json(html), "$.props.url", "string").alias("address"), F.try_variant_get(bodies.keyed_blob(html, "ds:0"), "$[0]", "long").alias("blob"))


@query("select page_id, case page_id % 8 when 0 then 'pdf' when 1 then 'docx' when 2 then 'zip' when 3 then 'png' when 4 then 'csv' when 5 then 'md' when 6 then 'html' else 'text' end as kind from pages")
def file_kinds(spark, d):
    k = F.col("page_id") % 8
    raw = lambda s: F.encode(F.lit(s), "UTF-8")
    content = F.when(k == 0, raw("%PDF-1.7 x")).when(k == 1, F.concat(F.unhex(F.lit("504B0304")), raw("..word/document.xml.."))).when(k == 2, F.unhex(F.lit("504B030400"))).when(k == 3, F.unhex(F.lit("89504E470D0A"))).when(k == 6, F.encode("html", "UTF-8")).otherwise(F.encode("url", "UTF-8"))
    name = F.when(k == 5, "https://x.example/a.md?x=1").otherwise("a")
    return _t(spark, d, "pages").select("page_id", bodies.file_type(content, name, F.when(k == 4, "text/csv; charset=utf-8")).alias("kind"))


@query("select page_id, 'café ' || url as text from pages")
def charset_text(spark, d):
    """Bytes in UTF-8 (with and without a mark), UTF-16 and windows-1252, decoded."""
    k, t = F.col("page_id") % 4, F.concat(F.lit("café "), "url")
    content = F.when(k == 0, F.encode(t, "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))).when(k == 2, F.encode(t, "UTF-16")).otherwise(F.encode(t, "ISO-8859-1"))
    rows = _t(spark, d, "pages").select("page_id", content.alias("content"), F.lit(None).cast("string").alias("type"))
    return bodies.decode(rows, "content", "type").select("page_id", "text")


@query("""select page_id, case page_id % 7 when 0 then 'https://drive.usercontent.google.com/download?id=f' || page_id || '&export=download&confirm=t' when 1 then 'https://docs.google.com/spreadsheets/d/s' || page_id || '/export?format=xlsx' when 2 then 'https://www.dropbox.com/scl/fi/' || page_id || '/a.pdf?rlkey=k1&dl=1'
 when 3 then 'https://t.sharepoint.com/:b:/g/' || page_id || '?e=tok&download=1' when 4 then 'https://raw.githubusercontent.com/o/r/main/' || page_id || '.csv' when 5 then 'https://api.onedrive.com/v1.0/shares/u!' || replace(replace(rtrim(base64(encode('https://1drv.ms/b/s!' || page_id)), '='), '/', '_'), '+', '-') || '/root/content' else url end as link from pages""")
def share_links(spark, d):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 7
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    shared = F.when(k == 0, c("https://drive.google.com/file/d/f", n, "/view?usp=sharing")).when(k == 1, c("https://docs.google.com/spreadsheets/d/s", n, "/edit#gid=0")).when(k == 2, c("https://www.dropbox.com/scl/fi/", n, "/a.pdf?rlkey=k1&dl=0")).when(k == 3, c("https://t.sharepoint.com/:b:/g/", n, "?e=tok")).when(k == 4, c("https://github.com/o/r/blob/main/", n, ".csv")).when(k == 5, c("https://1drv.ms/b/s!", n)).otherwise(F.col("url"))
    return _t(spark, d, "pages").select("page_id", links.direct_link(shared).alias("link"))


@query("select c_custkey::varchar as number, c_name as holder, case when c_custkey % 2 = 0 then c_mktsegment else 'seg ' || c_mktsegment end as kind from customer where c_custkey % 5 <> 0")
def header_map(spark, d):
    """Columns of a file found by what their headers are called; rows without a number go."""
    c = _t(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    raw = c.select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("string")).otherwise("").alias("Record No."), F.col("c_name").alias("Owner:"), F.when(even, F.col("c_mktsegment")).alias("Type"), F.concat(F.lit("seg "), "c_mktsegment").alias("Record Type"), F.lit("x").alias("Other"))
    return items.with_header_map(raw, {"number": "record (no|number)", "holder": "owner", "kind": "type|record type"}, "number")


@query("select l_orderkey, l_linenumber, l_partkey, l_returnflag as flag, l_quantity::bigint::varchar as quantity from lineitem")
def cells_from_right(spark, d):
    li = _t(spark, d, "lineitem")
    cells = F.array(F.col("l_returnflag"), F.col("l_quantity").cast("long").cast("string"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.array(F.lit("more")), cells)).otherwise(cells).alias("cells"))
    return items.cells_by_header(rows, "cells", ["flag", "quantity"]).drop("cells")


_LINES = "with x as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as n from lineitem)"


def _lined(spark, d):
    return _t(spark, d, "lineitem").withColumn("o", F.struct(*_ORDER))


@query(_LINES + """, a as (select l_orderkey, arg_min(round(l_extendedprice, 2), (case l_returnflag when 'A' then 1 when 'N' then 3 else 9 end, n)) filter (l_returnflag in ('A', 'N')) as award, arg_min(round(l_extendedprice, 2) + 1, n) filter (l_linestatus = 'F' and l_linenumber = 1) as contract, max(l_quantity) as bid, count(*)::int as n_items,
 arg_min(case when l_linenumber % 2 = 0 then 'r' || l_suppkey % 5 end, n) filter (l_linenumber % 2 = 0) as region, string_agg(distinct 'c' || (l_partkey % 3), ',' order by 'c' || (l_partkey % 3)) as codes from x group by 1)
select o_orderkey as auction_id, case when o_orderkey % 3 = 0 then 'lease' else 'sale' end as procedure_type, case when o_orderkey % 3 = 0 then 'english-fast' end as auction_type, coalesce(region, 'n' || c_nationkey) as region, codes, n_items, case o_orderstatus when 'F' then 'sold' when 'O' then 'winner_pending' else 'in_progress' end as outcome,
 coalesce(contract, award) as final_price, bid as top_bid, floor((coalesce(contract, award) - round(o_totalprice, 2)) / round(o_totalprice, 2) * 100 * 100 + 0.5) / 100 as increase_pct, case when o_orderkey % 4 = 0 then '[redacted]' when o_orderkey % 4 = 1 then null else c_name end as title
from a join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey""")
def procedure_records(spark, d):
    """Orders as auctions: items, awards by status, contracts, bids and the seller, flattened to one record each."""
    text = lambda c: F.create_map(F.lit("uk"), c)
    price = F.round("l_extendedprice", 2)
    award = F.when(F.col("l_returnflag") == "A", "active").when(F.col("l_returnflag") == "N", "pending").otherwise("unsuccessful")
    lines = _lined(spark, d).groupBy("l_orderkey").agg(
        _list("o", F.col("l_partkey").alias("id"), F.concat(F.lit("c"), (F.col("l_partkey") % 3).cast("string")).alias("code"), F.lit("s").alias("scheme"), F.col("l_quantity").alias("quantity"), F.lit("u").alias("unit"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("r"), (F.col("l_suppkey") % 5).cast("string"))).alias("region"), F.lit("").alias("city"), award.alias("status"), price.alias("amount"), (price + 1).alias("more"), F.col("l_linestatus").alias("ls"), F.col("l_linenumber").alias("ln")))
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    k = F.col("o_orderkey") % 4
    rows = F.transform("rows", lambda r: r.withField("description", text(F.lit("x"))))
    seller = F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("region"), F.lit("city").alias("city"))
    period = F.struct(F.col("o_orderdate").alias("start"), F.col("o_orderdate").alias("end"))
    p = F.struct(
        F.col("o_orderkey").alias("id"), text(F.when(k == 0, " ** ").when(k == 1, " - ").otherwise(F.col("c_name"))).alias("title"), F.when(F.col("o_orderkey") % 3 == 0, "lease-english-fast").otherwise("sale").alias("method"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "qualification").otherwise("active").alias("status"),
        F.round("o_totalprice", 2).alias("start_price"), F.lit(None).cast(o.select(period.alias("x")).schema["x"].dataType).alias("tender_period"), period.alias("enquiry_period"), rows.alias("items"), F.when(F.col("o_orderkey") % 2 == 0, seller).alias("seller"), seller.alias("related_seller"),
        F.transform(rows, lambda r: F.struct(r["status"].alias("status"), r["amount"].alias("amount"))).alias("awards"), F.transform(F.filter(rows, lambda r: (r["ls"] == "F") & (r["ln"] == 1)), lambda r: F.struct(F.lit("signed").alias("status"), r["more"].alias("amount"))).alias("contracts"), F.transform(rows, lambda r: F.struct(r["quantity"].alias("amount"))).alias("bids"))
    made = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).select(p.alias("p")).select(auctions.procedure(F.col("p")).alias("r"))
    return made.select("r.auction_id", "r.procedure_type", "r.auction_type", "r.region", F.array_join(F.array_sort("r.codes"), ",").alias("codes"), "r.n_items", "r.result.outcome", "r.result.final_price", "r.result.top_bid", "r.result.increase_pct", "r.title")


@query("""select c_custkey as record_number, case when c_custkey % 2 = 0 then 'Roofing (new)' else 'Fence, plumbing' end as record_type, case when c_custkey % 2 = 0 then 'roof' else 'plumbing' end as category, (100 + c_custkey % 900) || case when c_custkey % 3 = 0 then ' MAIN ST' else ' OAK AVE' end as address, 'San Mateo' as city, 'CA' as state, lpad((90000 + c_custkey % 999)::varchar, 5, '0') as zip,
 case when c_custkey % 2 = 0 then c_name || ' INC' else c_name end as contractor, case when c_custkey % 2 = 0 then c_name end as contractor_person, case when c_custkey % 2 = 0 then 'Roof Area' end as labels, c_custkey % 2 = 0 as details_fetched from customer""")
def permit_records(spark, d):
    """Customers as permits: a grid row, for every second one a detail page, addresses with and without a comma."""
    c, k, n = _t(spark, d, "customer"), F.col("c_custkey"), F.col("c_custkey").cast("string")
    address = F.concat((100 + k % 900).cast("string"), F.when(k % 3 == 0, " MAIN ST, SAN MATEO CA ").otherwise(" OAK AVE SAN MATEO CA "), F.lpad((90000 + k % 999).cast("string"), 5, "0"))
    row = F.struct(n.alias("record_number"), F.when(k % 2 == 0, "").otherwise("Fence, plumbing").alias("record_type"), address.alias("address"), F.lit("open").alias("status"), F.lit("").alias("description"), F.col("c_name").alias("contractor_name"))
    more = F.create_map(F.lit("Roof Area"), F.lit("1"), F.lit("Owner Phone"), F.lit("2"))
    detail = F.when(k % 2 == 0, F.struct(n.alias("record_number"), F.lit("Roofing (new)").alias("record_type"), F.lit("").alias("address"), F.lit("").alias("status"), F.lit("").alias("description"), F.concat("c_name", F.lit(" INC")).alias("contractor_company"), F.col("c_name").alias("contractor_name"), F.lit("A").alias("applicant"), more.alias("more")))
    made = c.select(k.alias("n"), row.alias("row"), detail.alias("detail")).select("n", auctions.permit(F.col("row"), F.col("detail"), ("CA", "OR"), rules={"roof": ["roof"], "plumbing": ["plumb"]}).alias("r"))
    return made.select(F.col("n").alias("record_number"), "r.record_type", "r.category", "r.address", "r.city", "r.state", "r.zip", "r.contractor", "r.contractor_person", F.array_join(F.map_keys("r.more"), ",").alias("labels"), "r.details_fetched")


@query("""select p_partkey, 'coles' as store, p_brand || ' ' || p_name as name, case when p_size > 25 then round(p_retailprice, 2) + 1 end as was_price, case when p_size > 25 then 1.0 end as savings, p_size > 25 or p_size % 5 = 0 as on_special, case when p_size % 5 = 0 then 'Two for one · ' || p_type else p_type end as promo_text, p_type || ' > ' || p_brand as category from part
union all select p_partkey, 'woolworths', p_name, case when p_size > 25 then round(p_retailprice, 2) + 1 end, case when p_size > 25 then 1.0 end, p_size > 25 or p_size % 4 = 0, nullif(concat_ws(' · ', case when p_size % 4 = 0 then 'Half price' end, case when p_size > 25 then 'Save $1.00' end), ''), case when p_size % 2 = 0 then p_type || ' > ' || p_brand else 'S ' || p_type end from part
union all select p_partkey, 'aldi', p_name, case when p_size > 25 then round(p_retailprice, 2) + 1 end, case when p_size > 25 then 1.0 end, p_size > 25 or p_size % 3 = 1, nullif(concat_ws(' · ', case when p_size % 3 = 1 then 'Super Saver' end, case when p_size > 25 then 'Was $' || printf('%.2f', round(p_retailprice, 2) + 1) end), ''), p_type from part""")
def product_records(spark, d):
    """Parts as products of three stores, mapped to one record."""
    p, s = _t(spark, d, "part"), lambda *x: F.struct(*[c.alias(n) for c, n in x])
    price, big, no = F.round("p_retailprice", 2), F.col("p_size") > 25, F.lit(None)
    n, brand, kind, size = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")
    text, nothing = F.lit(" "), F.lit("none")
    was = F.when(big, price + 1).otherwise(0.0)
    one = s((F.col("p_partkey"), "id"), (n, "name"), (nothing, "description"), (brand, "brand"), (text, "size"), (s((price, "now"), (was, "was"), (F.lit("X"), "promotion_type"), (F.lit(False), "online_special"), (F.when(size % 5 == 0, "Two for one"), "multi_buy"), (F.lit(0.0), "save_amount"), (price, "unit_price"), (text, "comparable"), (kind, "offer"), (kind, "save_statement"), (text, "price_description")), "pricing"), (F.array(s((kind, "sub_category"), (brand, "category"), (nothing, "aisle"))), "online_heirs"), (F.array(F.lit("/i.png")), "image_uris"), (F.lit(True), "availability"), (no.cast("string"), "ad_id"))
    lists = lambda c: F.when(size % 2 == 0, F.to_json(F.array(c))).otherwise("[broken")
    two = s((F.col("p_partkey"), "stockcode"), (n, "display_name"), (n, "name"), (brand, "brand"), (text, "size"), (price, "price"), (F.when(big, price + 1).otherwise(price), "was_price"), (size % 4 == 0, "half_price"), (F.lit(False), "on_special"), (text, "tag"), (lists(kind), "pies_department"), (lists(brand), "pies_category"), (no.cast("string"), "pies_subcategory"), (F.concat(F.lit("S "), kind), "sap_department"), (text, "sap_category"), (text, "sap_subcategory"), (no.cast("boolean"), "in_stock"), (F.lit(True), "available"), (no.cast("boolean"), "sponsored"), (text, "barcode"), (text, "large_image"), (text, "medium_image"), (text, "small_image"), (text, "slug"))
    asset = F.array(s((F.lit("FR01"), "kind"), (F.lit("u/{width}"), "url")))
    three = s((F.col("p_partkey"), "sku"), (text, "brand"), (n, "name"), (text, "size"), (F.round(price * 100).cast("long"), "cents_relevant"), (F.lit(1), "cents"), (F.when(big, F.concat(F.lit("AUD "), F.format_number(price + 1, 2))), "was_text"), (F.when(size % 3 == 1, F.array(F.lit("Super Saver"), F.lit("Super  Saver"))), "badges"), (text, "savings_text"), (text, "sale_from"), (F.array(kind, text), "categories"), (asset, "assets"), (F.lit(False), "discontinued"), (text, "slug"))
    out = None
    for made in (products.coles(one), products.woolworths(two), products.aldi(three, F.lit(None).cast("string"))):
        rows = p.select("p_partkey", made.alias("r")).select("p_partkey", "r.store", "r.name", "r.was_price", "r.savings", "r.on_special", "r.promo_text", "r.category")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * 100 + 0.5)::bigint / 100.0 as value, floor(l_extendedprice)::double as whole from lineitem")
def money_texts(spark, d):
    """Displayed prices of four kinds and back."""
    k, cents = F.col("l_linenumber") % 4, F.floor(F.col("l_extendedprice") * 100 + 0.5)
    two = F.lpad((cents % 100).cast("string"), 2, "0")
    units = F.floor(cents / 100).cast("string")
    shown = F.when(k == 0, F.concat(F.lit("$"), F.format_number(F.floor(cents / 100), 0), F.lit("."), two)).when(k == 1, F.concat(units, F.lit(","), two, F.lit(" €"))).when(k == 2, F.concat(F.lit("from AUD "), units, F.lit("."), two, F.lit(" each"))).otherwise(F.concat(units, F.lit("."), two))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", products.money(shown).alias("value"), v.price_text(F.concat(F.lit("€ "), F.format_number(F.floor("l_extendedprice"), 0))).alias("whole"))


@query(_LINES + " select l_orderkey, row_number() over (partition by l_orderkey order by case when l_quantity > 10 then l_quantity else -1 end desc, 'n' || l_partkey, n)::int as rank, 'n' || l_partkey as name, case when l_quantity > 10 then l_quantity end as value from x where l_returnflag <> 'R'")
def region_rows(spark, d):
    """Regions with values ranked, those without data left out, missing values last."""
    r = F.struct(F.col("o").alias("_k"), F.col("l_partkey").cast("string").alias("code"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name"), F.array(F.when(F.col("l_quantity") > 10, F.col("l_quantity"))).alias("values"), F.array(F.col("l_returnflag") != "R").alias("has_data"))
    g = _lined(spark, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(r)).alias("regions"))
    return trends.region_rows(g, ["l_orderkey"], "regions").select("l_orderkey", "rank", "name", "value")


@query(_LINES + " select l_orderkey, n::int as rank, 'p' || l_partkey as title, case when l_quantity >= 10 then floor(l_quantity)::bigint || 'K+' else floor(l_quantity * 100)::bigint || '+' end as label, l_linestatus = 'O' as active, case when l_linenumber % 3 = 0 then 'Sports' else 'Category ' || (l_linenumber % 3) end as categories from x")
def trending_rows(spark, d):
    """Positional arrays of trending searches, read back with category names."""
    q = F.when(F.col("l_quantity") >= 10, F.floor(F.col("l_quantity")) * 1000).otherwise(F.floor(F.col("l_quantity") * 100))
    end = F.when(F.col("l_linestatus") == "O", F.lit("null")).otherwise(F.lit("[1700000000]"))
    row = F.concat(F.lit('["p'), F.col("l_partkey").cast("string"), F.lit('",null,"US",[1699990000],'), end, F.lit(",null,"), q.cast("string"), F.lit(',null,50,["a"],['), (F.col("l_linenumber") % 3).cast("string"), F.lit("]]"))
    g = _lined(spark, d).groupBy("l_orderkey").agg(_list("o", row.alias("x")))
    body = F.try_parse_json(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["x"]), ","), F.lit("]")))
    out = trends.trending_rows(g.select("l_orderkey", body.alias("body")), ["l_orderkey"], "body", {0: "Sports"})
    return out.select("l_orderkey", "rank", "title", "label", "active", F.array_join("categories", ",").alias("categories"))


@query(_LINES + " select l_orderkey, 'T1' as term, strftime(l_shipdate, '%Y-%m-%d') as at, case when l_returnflag <> 'R' then l_quantity end as value, l_linestatus = 'O' as partial from x union all select l_orderkey, 'T0', strftime(l_shipdate, '%Y-%m-%d'), l_discount, l_linestatus = 'O' from x")
def timeline_points(spark, d):
    """Points of two terms as rows, values without data null."""
    li = _lined(spark, d)
    point = F.struct(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("string").alias("time"), F.array("l_quantity", "l_discount").alias("values"), F.array(F.col("l_returnflag") != "R").alias("has_data"), (F.col("l_linestatus") == "O").alias("partial"))
    g = li.groupBy("l_orderkey").agg(F.collect_list(point).alias("points"))
    return rc.timeline_rows(g, ["l_orderkey"], "points", F.array(F.lit("T1"), F.lit("T0")), F.lit("DAY")).select("l_orderkey", "term", "at", "value", "partial")


@query(_LINES + " select l_orderkey, case l_returnflag when 'A' then 'top' else 'rising' end as kind, row_number() over (partition by l_orderkey, case l_returnflag when 'A' then 'top' else 'rising' end order by n)::int as rank, 'q' || l_partkey as query, case when l_returnflag = 'R' then null else l_quantity::bigint::varchar end as value, l_returnflag = 'R' as breakout, 'https://t.example/x?q=' || l_partkey as link from x")
def related_queries(spark, d):
    s = lambda c: F.col(c).cast("string")
    entry = F.struct(F.col("o").alias("_o"), F.concat(F.lit("q"), s("l_partkey")).alias("query"), F.when(F.col("l_returnflag") == "R", "Breakout").when(F.col("l_returnflag") == "N", F.concat(F.lit("+"), F.col("l_quantity").cast("long").cast("string"), F.lit("%"))).otherwise(F.col("l_quantity").cast("long").cast("string")).alias("value"), F.concat(F.lit("/x?q="), s("l_partkey")).alias("link"))
    g = _lined(spark, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "A", entry))).alias("top"), F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "A", entry))).alias("rising"))
    return rc.related_rows(g, ["l_orderkey"], ("top", "rising"), "https://t.example").withColumn("value", F.col("value").cast("string"))


@query(_LINES + ", k as (select *, case l_linenumber % 4 when 0 then 'TIMESERIES' when 1 then 'GEO_MAP' when 2 then 'RELATED_QUERIES' else 'RELATED_TOPICS' end as kind, case l_linenumber % 4 when 0 then null else case l_partkey % 3 when 0 then 'Aa' when 1 then 'Bb' when 2 then case when l_linenumber % 2 = 0 then 'Aa' else 'Bb' end end end as term from x) select l_orderkey, kind, term, arg_min(kind || case l_linenumber % 4 when 0 then '' else case l_linenumber % 2 when 0 then '_0' else '_1' end end, n) as widget from k group by 1, 2, 3")
def widget_choice(spark, d):
    """The first widget of each kind and term, by keyword or else by number."""
    k, n = F.col("l_linenumber") % 4, F.when(F.col("l_linenumber") % 2 == 0, "_0").otherwise("_1")
    name = F.when(k == 0, "TIMESERIES").when(k == 1, F.concat(F.lit("GEO_MAP"), n)).when(k == 2, F.concat(F.lit("RELATED_QUERIES"), n)).otherwise(F.concat(F.lit("RELATED_TOPICS"), n))
    rows = _lined(spark, d).withColumn("w", name).withColumn("kw", F.when(F.col("l_partkey") % 3 == 0, " aa ").when(F.col("l_partkey") % 3 == 1, "BB"))
    return trends.select_widgets(rows, ["l_orderkey"], "o", "w", "kw", F.array(F.lit("Aa"), F.lit("Bb")))


@query("select page_id, case when page_id % 6 in (0, 1) then 'captcha' when page_id % 6 = 2 then 'consent' when page_id % 6 = 3 then 'rate-limited' when page_id % 6 = 4 then 'blocked' else 'ok' end as kind from pages")
def block_pages(spark, d):
    """Pages with the marks of each kind after their whole text, and plain ones that only name them."""
    k = F.col("page_id") % 6
    tail = F.when(k == 0, '<form id="captcha-form"></form>').when(k == 1, 'Our systems have detected unusual traffic<form action="https://consent.x.com/save">').when(k == 2, '<title> Before you continue</title><form method="post" action="https://x.com/save">').when(k == 3, "Error 429: too many requests").otherwise("a captcha and consent are words")
    return _t(spark, d, "pages").select("page_id", pages.block_kind(F.col("url"), F.when(k == 4, 403).otherwise(200), F.concat("html", tail)).alias("kind"))


@query("select page_id, 't' || page_id as token, page_id as total, url as place from pages")
def page_tokens(spark, d):
    n = F.col("page_id").cast("string")
    tree = F.concat(F.lit('[{"a":[{"p":["t'), n, F.lit('",0,'), n, F.lit(']}]},{"p":["later",0,1],"s":[5,0,'), F.to_json(F.array("url")), F.lit("]}]"))
    tree = F.replace(F.replace(tree, F.lit('["http'), F.lit('"http')), F.lit('"]]}]'), F.lit('"]}]'))
    return _t(spark, d, "pages").select("page_id", pages.page_info(tree, "p", "s").alias("i")).select("page_id", "i.token", "i.total", "i.place")


@query("select page_id, 2::int as n_hits, url as first from pages")
def tree_objects(spark, d):
    tree = F.to_json(F.struct(F.array(F.struct(F.col("url").alias("hit"))).alias("a"), F.struct(F.struct(F.lit("x").alias("hit"), F.struct(F.lit(1).alias("hit")).alias("in")).alias("b")).alias("c")))
    found = rc.objects_with(tree, "hit")
    return _t(spark, d, "pages").select("page_id", found.alias("f")).select("page_id", F.size("f").alias("n_hits"), F.get_json_object(F.col("f")[0], "$.hit").alias("first"))


@query("select page_id, 'd' || page_id as description, case when page_id % 2 = 0 then 'i' || page_id end as image, case when page_id % 3 <> 0 then 'A' || page_id end as author, url as canonical, regexp_extract(html, '(?i)<html[^>]*lang=\"([^\"]*)\"', 1) as lang from pages")
def page_meta_fields(spark, d):
    """Head fields under their first and later names, attributes in either order; an author that is a url is none."""
    n = F.col("page_id").cast("string")
    even, third = F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0
    head = F.concat(F.when(even, F.lit('<meta name="description" content="d')).otherwise(F.lit('<meta property="og:description" content="d')), n, F.lit('">'), F.when(even, F.concat(F.lit('<meta content="i'), n, F.lit('" property="og:image">'))).otherwise(""), F.lit('<meta name="author" content="'), F.when(third, "https://a.example").otherwise(F.concat(F.lit("A"), n)), F.lit('"><link rel="canonical" href="'), F.col("url"), F.lit('">'))
    return _t(spark, d, "pages").select("page_id", rc.head_meta(F.concat("html", head)).alias("m")).select("page_id", "m.description", "m.image", "m.author", "m.canonical", "m.lang")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'Dear ' || c_name || ' of ,' else 'Dear ' || c_name || ' of ' || c_mktsegment || ',' end as body from customer")
def template_fill(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", tx.fill_template("Dear {{ Name }} of {{segment}}{{no such}},", {"name": F.col("c_name"), "segment": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))}).alias("body"))


@query("select distinct lower(p_brand) || '/' || p_type || '/' || replace(p_name, ' ', '-') as path, (first_value(p_partkey) over (partition by p_brand, p_type, p_name order by p_partkey))::varchar as id from part union all select distinct p_brand || '/none', null from part")
def tree_resolve(spark, d):
    """Slug paths of three levels in a tree of brands, types and names."""
    p = _t(spark, d, "part")
    top = p.select(F.lit(None).cast("string").alias("parent"), F.col("p_brand").alias("slug"), F.col("p_brand").alias("id"))
    mid = p.select(F.col("p_brand").alias("parent"), F.col("p_type").alias("slug"), F.concat_ws("|", "p_brand", "p_type").alias("id"))
    low = p.select(F.concat_ws("|", "p_brand", "p_type").alias("parent"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("id"))
    wanted = p.select(F.concat_ws("/", F.lower("p_brand"), "p_type", F.replace("p_name", F.lit(" "), F.lit("-"))).alias("path")).union(p.select(F.concat("p_brand", F.lit("/none"))))
    return listing.resolve_paths(top.union(mid).union(low).distinct(), wanted, "path", 3).select("path", F.col("id").cast("long").cast("string").alias("id"))


@query("""with q as (select event_id as o, case when event_id % 2 = 0 then upper('q' || user_id) else 'q' || user_id end as query, event_type <> 'click' as rising, event_type = 'error' as breakout, value from events), s as (select *, lower(query) as key, case when rising then case when breakout then 100000.0 else value end else value / 10 end as score from q where lower(query) <> 'q1'),
b as (select key, arg_max(query, (score, -o)) as query, max(score) as score, arg_max(o, (score, -o)) as o from s group by 1), f as (select * from b order by score desc, o limit 30), l as (select * from f where not regexp_matches(key, '^q[0-9]*5$') order by score desc, o limit 10) select key, query, score, row_number() over (order by score desc, o)::int as position from l""")
def idea_scores(spark, d):
    e = _t(spark, d, "events")
    name = F.concat(F.lit("q"), F.col("user_id").cast("string"))
    q = e.select(F.col("event_id").alias("order"), F.when(F.col("event_id") % 2 == 0, F.upper(name)).otherwise(name).alias("query"), (F.col("event_type") != "click").alias("rising"), (F.col("event_type") == "error").alias("breakout"), "value")
    seeds = spark.createDataFrame([("Q1",)], "query string")  # what the caller asks for
    return listing.idea_scores(q, seeds, e.where("user_id % 10 = 5").select(name.alias("query")), 10)


@query("select p_partkey, case when q.label is not null then q.label end as label from part left join (select lower(p_name) as t, arg_max('l' || p_partkey, p_partkey) as label from part where p_partkey % 2 = 0 group by 1) q on lower(p_name) = q.t")
def enrich_by_title(spark, d):
    p = _t(spark, d, "part")
    extra = p.where("p_partkey % 2 = 0").select(F.upper("p_name").alias("title"), "p_partkey", F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("label"))
    return listing.enrich_by_title(p.select("p_partkey", F.col("p_name").alias("title")), extra, "title", "p_partkey", ["label"]).select("p_partkey", "label")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_custkey % 3 <> 0")
def restored_columns(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("c_name"))
    return listing.restore_columns(_t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), c, "k", ["c_name"], ["c_name"]).select("o_orderkey", "c_name")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id) as n from events where event_type <> 'click') where n = 1 and value >= 50")
def fresh_products(spark, d):
    e = _t(spark, d, "events").withColumn("ad", F.col("event_type") == "click").withColumn("special", F.col("value") >= 50)
    return listing.fresh_products(e, "user_id", "event_id", "ad", "special", only_specials=True).select("user_id", "event_id", "value")


@query("select count(*) as n_rows, count_if(c_custkey % 4 = 0) as n_skipped from customer")
def named_row_counts(spark, d):
    c = _t(spark, d, "customer").withColumn("n", F.when(F.col("c_custkey") % 4 == 0, F.when(F.col("c_custkey") % 8 == 0, " ")).otherwise(F.col("c_name")))
    return listing.named_rows(c, "n")[1]


@query("select lower(event_type) as event_type, count(*) as n from events where lower(event_type) not in ('click', 'view') group by 1")
def unknown_values(spark, d):
    return listing.unknown_values(_t(spark, d, "events"), "event_type", ["click", "view"])


@query("with s as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, case when l_linenumber % 3 <> 0 then l_extendedprice end as p, l_returnflag from lineitem) select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by p asc nulls last, l_orderkey, l_linenumber, l_partkey, l_extendedprice)::int as by_price, row_number() over (partition by l_suppkey order by case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end, l_orderkey, l_linenumber, l_partkey, l_extendedprice)::int as by_status from s")
def listing_orders(spark, d):
    """Lines of a supplier by price, unpriced last, and by the place of their status."""
    then = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    li = _t(spark, d, "lineitem").withColumn("p", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")))
    out = windows.ranked(li, ["l_suppkey"], listing.by_price("p", *then), "by_price")
    return windows.ranked(out, ["l_suppkey"], listing.by_rank("l_returnflag", ["R", "A"], *then), "by_status").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "by_price", "by_status")


@query("select page_id, case when regexp_matches(url, '(?i)^https?://') then 'url' end as kind, 'id' as id_kind, 'domain' as host_kind from pages")
def query_kinds(spark, d):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return _t(spark, d, "pages").select("page_id", criteria.query_kind(F.col("url")).alias("kind"), criteria.query_kind(F.concat(F.lit("AR"), F.lpad(F.col("page_id").cast("string"), 12, "0"))).alias("id_kind"), criteria.query_kind(host).alias("host_kind"))


@query("select p_partkey, lower(split_part(p_name, ' ', 1)) = 'cold' or split_part(p_name, ' ', 2) = 'widget' as shared from part")
def shares_word(spark, d):
    return _t(spark, d, "part").select("p_partkey", criteria.shares_word(F.col("p_name"), F.lit("Cold widgets")).alias("shared"))


@query("select o_orderkey, o_orderdate + interval 5 millisecond as at, case when length('note ' || o_orderpriority) > 8 then left('note ' || o_orderpriority, 8) || '…' else 'note ' || o_orderpriority end as short from orders")
def instants_and_previews(spark, d):
    at = v.epoch_instant(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.lit(5_000_000))
    return _t(spark, d, "orders").select("o_orderkey", at.cast("timestamp_ntz").alias("at"), v.preview(F.concat(F.lit("note "), "o_orderpriority"), 8).alias("short"))


@query(_LINES + " select l_orderkey, arg_min('r' || l_partkey, (l_extendedprice, n)) as best, count(*)::int as n_rooms from x group by 1")
def best_rates(spark, d):
    g = _lined(spark, d).groupBy("l_orderkey").agg(_list("o", F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_extendedprice").alias("price")))
    return g.select("l_orderkey", rc.best_rate(F.col("rows"))["name"].alias("best"), F.size("rows").alias("n_rooms"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 2 = 0 then round(l_extendedprice, 2) else floor(l_extendedprice * l_quantity * 100 + 0.5) / 100 end as total, case when l_linenumber % 2 = 0 then floor(round(l_extendedprice, 2) / l_quantity * 100 + 0.5) / 100 else l_extendedprice end as per_night from lineitem")
def stay_prices(spark, d):
    even, p = F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")
    s = rc.stay_price(F.when(even, F.round(p, 2)), F.when(~even, p), F.col("l_quantity"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s["total"].alias("total"), s["per_night"].alias("per_night"))


@query(_LINES + ", c as (select l_orderkey, case l_suppkey % 3 when 0 then 'EUR' when 1 then 'USD' else 'RON' end as currency, count(*) as k, min(n) as f from x group by 1, 2) select l_orderkey, arg_min(currency, (-k, f)) as currency from c group by 1")
def invoice_currency(spark, d):
    """The currency that most lines of an order name, by sign or code."""
    n = F.col("l_suppkey") % 3
    line = F.concat(F.lit("item "), F.when(n == 0, "€ ").when(n == 1, "$").otherwise("RON "), F.format_number("l_extendedprice", 2))
    return invoice.document_currency(_lined(spark, d).withColumn("line", line), ["l_orderkey"], "o", "line")


@query("select o_orderkey, 'INV-' || o_orderkey as number, o_orderdate::date::varchar as date, case when o_orderkey % 2 = 0 then 'credit_note' else 'invoice' end as kind, round(o_totalprice, 2)::double as total from orders")
def invoice_fields(spark, d):
    """Orders printed as invoices: number, date, type and total read from their lines."""
    o = _dealt(_t(spark, d, "orders"), "o_orderkey")
    title = F.when(F.col("o_orderkey") % 2 == 0, "Credit note").otherwise("Invoice")
    lines = F.array(title, F.concat(F.lit("Invoice No: INV-"), F.col("o_orderkey").cast("string")), F.concat(F.lit("Invoice date: "), F.date_format("o_orderdate", "d MMMM yyyy")), F.lit("Subtotal: 1.00"), F.lit("Tax 10%: 2.00"), F.concat(F.lit("Grand total: $"), F.format_number(F.round("o_totalprice", 2), 2)))
    rows = o.select("o_orderkey", F.posexplode(lines).alias("n", "line"))
    got = invoice.labelled_fields(rows, ["o_orderkey"], "n", "line").select("o_orderkey", "number", F.col("date").cast("string").alias("date"))
    kinds = o.select("o_orderkey", invoice.document_type(title).alias("kind"))
    return got.join(invoice.totals(rows, ["o_orderkey"], "n", "line").select("o_orderkey", "total"), "o_orderkey").join(kinds, "o_orderkey")


@query("select page_id, 2::int as row_no, 'u ' || page_id || '|' || url as cells from pages union all select page_id, 1, 'Name|Link' from pages")
def table_cells(spark, d):
    html = F.concat("html", F.lit("<table class=x><tr><th>Name</th><th> Link </th></tr><tr><td><b>u</b> "), F.col("page_id").cast("string"), F.lit("</td><td>"), "url", F.lit("</td></tr></table>"))
    return markdown.html_tables(_t(spark, d, "pages").select("page_id", html.alias("html")), "html", ["page_id"]).select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


@query(_LINES + " select l_orderkey, min(l_quantity) as small, arg_max(l_quantity, (c, l_quantity)) as body_size from (select l_orderkey, l_quantity, sum(4)::bigint as c from x group by 1, 2) group by 1")
def body_sizes(spark, d):
    li = _t(spark, d, "lineitem")
    sizes = dc.body_size(li.select("l_orderkey", F.col("l_quantity").alias("size"), F.lit("word").alias("text")), ["l_orderkey"])
    return sizes.join(li.groupBy("l_orderkey").agg(F.min("l_quantity").alias("small")), "l_orderkey").select("l_orderkey", "small", "body_size")


@query("select event_type, min(ts) as scanned_from, max(ts) as scanned_to, count(*) as n, min(ts) <= timestamp '2024-01-02' as reached, case when min(ts) > timestamp '2024-01-02' then case when max(event_id % 1000) = 7 then 'truncated' else 'end of feed' end end as reason from events group by 1")
def feed_coverage(spark, d):
    """What each feed covered, in one pass."""
    return feeds.coverage(_t(spark, d, "events"), "ts", "2024-01-02", ["event_type"], F.col("event_id") % 1000 == 7)


@query("select doc_id as text_id, source as heading, text from documents where doc_id % 3 <> 0 and text <> ''")
def vector_rows(spark, d):
    t = _t(spark, d, "documents")
    chunks = t.select(F.when(F.col("doc_id") % 3 == 0, "failed").alias("status"), "text", F.lit("").alias("file_name"), F.col("doc_id").cast("string").alias("source_url"), F.lit(None).cast("int").alias("page_start"), F.col("source").alias("heading_path"))
    return pages.vector_rows(chunks).select(F.col("source").cast("long").alias("text_id"), "heading", "text")


@query("select page_id, case when page_id % 2 = 0 then 'detail ' || page_id else 'feed' end as snippet, case when page_id % 2 = 0 then url end as image from pages")
def article_rows(spark, d):
    p = _t(spark, d, "pages")
    feed = p.select("page_id", F.lit("feed").alias("snippet"), F.col("url").alias("article_url"))
    details = p.where("page_id % 2 = 0").select("page_id", F.concat(F.lit("detail "), F.col("page_id").cast("string")).alias("snippet"), F.col("url").alias("image"), F.lit("a").alias("author"))
    return pages.article_rows(feed, details, "page_id").select("page_id", "snippet", "image")


@query("select l_orderkey, count(*)::int as n_news, arg_min('t' || l_partkey, (l_linenumber, l_partkey, l_extendedprice)) as news_title, 'https://t.example/trends/explore?q=o+' || l_orderkey || '&date=now+1-d&geo=US' as explore_url from lineitem group by 1")
def trending_items(spark, d):
    s = F.concat(F.lit("t"), F.col("l_partkey").cast("string"))
    g = _lined(spark, d).groupBy("l_orderkey").agg(_list("o", s.alias("title"), s.alias("url"), s.alias("source"), name="news"))
    rows = g.select("l_orderkey", F.concat(F.lit("o "), F.col("l_orderkey").cast("string")).alias("title"), F.lit("US").alias("geo"), "news")
    return trends.trending_item(rows, "https://t.example", F.lit(24)).select("l_orderkey", F.col("n_news").cast("int").alias("n_news"), "news_title", "explore_url")


@query("select l_orderkey, l_linenumber, l_partkey, case when l_quantity = l_linenumber then l_quantity::bigint::varchar when l_returnflag = 'R' then l_linenumber || '+' else l_linenumber || '-' || l_quantity::bigint end as shown, case when l_linenumber % 3 = 0 then 'failed' when l_linenumber % 3 = 1 then 'partial' else 'ok' end as status from lineitem")
def ranges_and_status(spark, d):
    li, k = _t(spark, d, "lineitem"), F.col("l_linenumber") % 3
    most = F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int"))
    most = F.when(F.col("l_quantity") == F.col("l_linenumber"), F.col("l_linenumber")).otherwise(most)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", rc.count_range(F.col("l_linenumber"), most).alias("shown"), rc.term_status(a=F.when(k > 0, 1), b=F.when(k > 1, 1)).alias("status"))


@query(_LINES + ", g as (select *, sum(case when l_linenumber % 3 <> 2 or n = 1 then 1 else 0 end) over (partition by l_orderkey order by n) as item_no from x) select l_orderkey, item_no::bigint as item_no, string_agg('d' || l_partkey, ' ' order by n) as text from g group by 1, 2")
def description_lines(spark, d):
    """Rows without numbers continue the item above."""
    n = F.row_number().over(windows.Window.partitionBy("l_orderkey").orderBy("o"))
    rows = _lined(spark, d).withColumn("n", n).withColumn("text", F.concat(F.lit("d"), F.col("l_partkey").cast("string")))
    return dc.join_descriptions(rows, ["l_orderkey"], "n", (F.col("l_linenumber") % 3 != 2) | (F.col("n") == 1), "text")


@query("""select c_custkey, 'customer' as party, c_name as name from customer union all select c_custkey, 'supplier', 'Seller & Co ' || c_nationkey from customer where c_custkey % 4 <> 3""")
def party_names(spark, d):
    """Pages of words that name both parties: behind the label, right of it, under it, or not at all."""
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    word = lambda x0, x1, y, text: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(float(y)).alias("y"), F.lit(10.0).alias("size"), text.alias("text"))
    say = F.lit
    seller = lambda x, y: [word(x, x + 40, y, say("Seller")), word(x + 43, x + 50, y, say("&")), word(x + 53, x + 65, y, say("Co")), word(x + 68, x + 80, y, n)]
    total = [word(0, 30, 100, say("Total")), word(200, 240, 100, say("5.00"))]
    behind = F.array(word(0, 60, 10, say("Customer:")), word(63, 160, 10, F.col("c_name")), word(0, 40, 30, say("From:")), *seller(43, 30), *total)
    right = F.array(word(0, 30, 10, say("Bill")), word(33, 45, 10, say("to:")), word(100, 190, 10, F.col("c_name")), word(0, 50, 30, say("SUPPLIER")), *seller(100, 30), *total)
    under = F.array(word(0, 40, 10, say("Vendor")), word(200, 240, 10, say("Client:")), *seller(0, 24), word(200, 290, 24, F.col("c_name")), *total)
    ended = F.array(word(0, 40, 10, say("Vendor:")), word(200, 240, 10, say("Buyer")), word(0, 40, 24, say("Date:")), word(200, 290, 24, F.col("c_name")), word(0, 60, 38, say("Nobody")), *total)
    pages_ = _t(spark, d, "customer").select("c_custkey", F.explode(F.when(k == 0, behind).when(k == 1, right).when(k == 2, under).otherwise(ended)).alias("w"))
    return invoice.party_names(pages_.select("c_custkey", "w.*"), ["c_custkey"])


@query(_LINES + """, t as (select l_orderkey as term, case when l_orderkey % 4 = 0 or l_orderkey % 3 = 0 then 'partial' else 'ok' end as status from x group by 1),
 g as (select l_orderkey, avg(l_quantity) filter (l_linestatus = 'F') as a from x group by 1), r as (select *, case when l_returnflag = 'A' then 'top' else 'rising' end as l from x)
 select term, status, 'term' as row_type, null as list, null as rank, null as name, floor(a * 100 + 0.5) / 100 as value from t join g on g.l_orderkey = term
 union all select l_orderkey, status, 'timeline', null, null, null, l_quantity from x join t on term = l_orderkey
 union all select l_orderkey, status, 'region', null, null, 'S' || l_suppkey, 2 * l_quantity from x join t on term = l_orderkey where l_orderkey % 4 <> 0
 union all select l_orderkey, status, 'relatedQuery', l, row_number() over (partition by l_orderkey, l order by n)::int, 'q' || l_partkey, case when l_returnflag <> 'R' then l_quantity end from r join t on term = l_orderkey
 union all select l_orderkey, status, 'relatedTopic', 'top', n::int, 't' || l_partkey, l_quantity from x join t on term = l_orderkey where l_orderkey % 3 <> 0""")
def term_long_rows(spark, d):
    """Orders as terms put together from four parts, two of which some lack, as rows of five types."""
    li, k = _lined(spark, d), F.col("l_orderkey")
    s = lambda c: F.col(c).cast("string")
    part = lambda df, name, *fields: df.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct(*_by("o"), F.struct(*fields).alias("e")))), lambda x: x["e"]).alias(name))
    timeline = part(li, "timeline", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_quantity").alias("value"), (F.col("l_linestatus") != "F").alias("partial"), F.lit(None).cast("boolean").alias("has_data"))
    regions = part(li.where(k % 4 != 0), "regions", s("l_suppkey").alias("code"), F.concat(F.lit("S"), s("l_suppkey")).alias("name"), (F.col("l_quantity") * 2).alias("value"), F.lit(True).alias("has_data"))
    kind = F.when(F.col("l_returnflag") == "A", "top").otherwise("rising")
    place = F.row_number().over(Window.partitionBy("l_orderkey", "list").orderBy("o"))
    related = lambda df, letter: [F.col("list"), F.col("rank"), F.concat(F.lit(letter), s("l_partkey")).alias("name"), F.when((F.col("l_returnflag") != "R") | F.lit(letter == "t"), F.col("l_quantity")).alias("value"), (F.col("l_returnflag") == "R").alias("breakout"), F.lit(None).cast("string").alias("link")]
    queries = part(li.withColumn("list", kind).withColumn("rank", place), "queries", *related(li, "q"))
    topics = part(li.where(k % 3 != 0).withColumn("list", F.lit("top")).withColumn("rank", place), "topics", *related(li, "t"))
    items = terms.term_items(li.select("l_orderkey").distinct(), ["l_orderkey"], {"timeline": timeline, "regions": regions, "queries": queries, "topics": topics})
    rows = terms.long_rows(items, ["l_orderkey", "status"])
    name = F.when(F.col("row_type") != "term", F.col("name"))
    return rows.select(k.alias("term"), "status", "row_type", "list", "rank", name.alias("name"), "value")
