"""Registered queries over mappings of records: parties, products in groups, images, links, contacts, roles and lines of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import auctions, criteria
from tidewater.functions import records as rc
from tidewater.operators import documents as dc
from tidewater.operators import invoice
from tidewater.plans.records import _dealt, _t
from tidewater.plans.registry import registry
from tidewater.sources import links

QUERIES, ORACLE, query = registry()


def _s(c):
    return F.col(c).cast("string")


@query("""with l as (select l_orderkey, count(*)::int as n, min(case when l_returnflag = 'A' then l_linenumber end) as won, string_agg(case when l_linenumber % 2 = 0 then 'award:a' || l_linenumber end, ',' order by l_linenumber) as docs from lineitem group by 1)
select l_orderkey as auction_id, case when won is not null then 'S' || won end as winner, case when won is not null and won % 2 = 0 then 'm' || won || '@x.y' end as winner_email, n as n_bids, concat_ws(',', case when l_orderkey % 3 <> 0 then 'procedure:p' || l_orderkey end, docs) as documents, case when l_orderkey % 5 <> 0 then 'O' || l_orderkey end as organiser from l""")
def procedure_parties(spark, d):
    """Lineitems as bids and awards of auctions: the winner with an e-mail unless masked, bids, documents by origin, the organiser."""
    n = _s("l_linenumber")
    award = F.struct(F.col("l_linenumber").alias("o"), F.when(F.col("l_returnflag") == "A", "active").otherwise("cancelled").alias("status"), F.struct(F.concat(F.lit("S"), n).alias("name"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("m"), n, F.when(F.col("l_linenumber") % 2 == 0, "@x.y").otherwise("***")).alias("email"), F.lit("").alias("phone")).alias("supplier"), F.array(F.when(F.col("l_linenumber") % 2 == 0, F.struct(F.concat(F.lit("a"), n).alias("id"), F.lit("t").alias("title"), F.lit("u").alias("url")))).alias("documents"))
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(award)).alias("awards"))
    k = F.col("l_orderkey")
    own = F.when(k % 3 != 0, F.array(F.struct(F.concat(F.lit("p"), _s("l_orderkey")).alias("id"), F.lit("t").alias("title"), F.lit("u").alias("url"))))
    nobody = F.lit(None).cast("string")
    organiser = F.struct(F.when(k % 5 != 0, F.concat(F.lit("O"), _s("l_orderkey"))).alias("name"), nobody.alias("id"), F.lit("").alias("email"), F.lit("+3***").alias("phone"))
    p = F.struct(F.col("awards").alias("awards"), F.col("awards").alias("bids"), own.alias("documents"), organiser.alias("organiser"))
    made = rows.select("l_orderkey", auctions.participants(p).alias("r"))
    return made.select(k.alias("auction_id"), F.col("r.winner.name").alias("winner"), F.col("r.winner.email").alias("winner_email"), "r.n_bids", F.array_join(F.transform("r.documents", lambda x: F.concat(x["origin"], F.lit(":"), x["id"])), ",").alias("documents"), F.col("r.organiser.name").alias("organiser"))


@query("select p_partkey as id, p_name as name from part where p_size % 7 <> 0")
def unwrapped_products(spark, d):
    """Products inside groups by brand, ad tiles left out."""
    product = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 7 == 0, True).alias("is_ad"))
    pages = _t(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("page"), "p_brand").agg(F.collect_list(product).alias("products")).groupBy("page").agg(F.collect_list(F.struct("products")).alias("groups"))
    return rc.unwrap_groups(pages, "groups").select("id", "name")


@query("""select p_partkey, case p_size % 3 when 0 then 'https://i.example/front/' || p_partkey || '?w=640' when 1 then 'https://i.example/side/' || p_partkey || '?w=640' end as image,
 case when p_size % 2 = 0 then lpad(p_partkey::varchar, 11, 'v') end as video from part""")
def images_and_videos(spark, d):
    """The first kind of asset present, at a width; the id of a video link anywhere in a record."""
    k = _s("p_partkey")
    asset = lambda kind: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"https://i.example/{kind}/"), k, F.lit("?w={width}")).alias("url"))
    z = F.col("p_size") % 3
    assets = F.when(z == 0, F.array(asset("side"), asset("front"))).when(z == 1, F.array(asset("logo"), asset("side"))).otherwise(F.array(asset("logo")))
    link = F.concat(F.when(F.col("p_size") % 4 == 0, "https://youtu.be/").otherwise("https://www.youtube.com/embed/"), F.lpad(k, 11, "v"))
    record = F.struct(F.lit("x").alias("a"), F.array(F.struct(F.when(F.col("p_size") % 2 == 0, link).otherwise("https://v.example/1").alias("url"))).alias("media"))
    return _t(spark, d, "part").select("p_partkey", rc.image_of(assets, ("front", "side"), 640).alias("image"), rc.video_id(record).alias("video"))


@query("select page_id, generate_subscripts(t, 1)::int as n, unnest(t) as title from (select page_id, ['More of ' || page_id, 'Last'] as t from pages)")
def related_links(spark, d):
    """The links of a list below the article's own."""
    n = _s("page_id")
    html = F.concat(F.lit('<ol><li><a href="/own">Own</a></li><li><a href="/m">More of '), n, F.lit('</a>&nbsp;<font>Paper</font></li><li><a href="/l">Last</a></li></ol>'))
    return _t(spark, d, "pages").select("page_id", F.posexplode(rc.related_coverage(html)).alias("n", "e")).select("page_id", (F.col("n") + 1).alias("n"), F.col("e.title").alias("title"))


@query("""select p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' one two' as said, p_retailprice between 1000 and 1500 as within, p_size >= 10 as large from part""")
def texts_and_bounds(spark, d):
    """What is searched in: strings and arrays of them; bounds on one or both sides."""
    words = F.array(F.lit("one"), F.lit(None).cast("string"), F.lit("two"))
    return _t(spark, d, "part").select("p_partkey", criteria.search_text(F.col("p_name"), F.lit(None).cast("string"), F.array("p_brand", "p_type"), words).alias("said"), criteria.bounds(F.col("p_retailprice"), 1000, 1500).alias("within"), criteria.bounds(F.col("p_size"), least=10).alias("large"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'Ann Lee' end as name, case when c_custkey % 3 = 0 then 'Best Roofing Inc' end as company, '(555) ' || lpad((c_custkey % 1000)::varchar, 3, '0') || '-1234' as phone, 'a' || c_custkey || '@x.org' as email,
 case when c_custkey % 5 <> 0 then 'C' || c_custkey end as license, (c_custkey % 90 + 10) || ' Oak St, Tampa, FL 33602' as address from customer""")
def contacts(spark, d):
    """Blocks of contact lines in changing completeness."""
    k, n = F.col("c_custkey"), _s("c_custkey")
    lines = F.array_compact(F.array(F.when(k % 2 == 0, "Ann Lee"), F.when(k % 3 == 0, "Best Roofing Inc"), F.concat((k % 90 + 10).cast("string"), F.lit(" Oak St")), F.lit("Tampa, FL 33602"), F.concat(F.lit("Phone: (555) "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-1234")), F.concat(F.lit("E-mail: a"), n, F.lit("@x.org")), F.when(k % 5 != 0, F.concat(F.lit("License #: C"), n))))
    return _t(spark, d, "customer").select("c_custkey", rc.contact(lines).alias("c")).select("c_custkey", "c.*")


@query("""select p_partkey, role, pos as position from part, (select unnest([['description', '1'], ['quantity', '2'], ['unit_price', '3'], ['tax', '4']]) as r), (select 1), lateral (select r[1] as role, r[2]::int as pos)
 union all select p_partkey, 'line_total', case when p_size % 2 = 0 then 6 else 5 end from part""")
def column_roles(spark, d):
    """Headers in four languages: one column a role, the right-most for line totals."""
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % 4 + 1).cast("int"))
    heads = [pick("Item", "Bezeichnung", "Désignation", "Descripción"), pick("Qty", "Menge", "Quantité", "Cantidad"), pick("Unit price", "Einzelpreis", "Prix unitaire", "Precio"), pick("VAT", "MwSt", "TVA", "IVA"), pick("Amount", "Betrag", "Montant", "Importe"), F.when(F.col("p_size") % 2 == 0, "Total")]
    cells = _dealt(_t(spark, d, "part"), "p_partkey").select("p_partkey", F.posexplode(F.array(*heads)).alias("i", "head")).where("head is not null").select("p_partkey", (F.col("i") + 1).alias("position"), "head")
    return invoice.header_roles(cells, ["p_partkey"], "position", "head")


@query("""select p_partkey, word, line_no::bigint as line_no, segment_no::bigint as segment_no from part, (select unnest([['a', '1', '1'], ['b', '1', '1'], ['c', '1', '2'], ['d', '2', '1'], ['e', '3', '1'], ['f', '3', '2']]) as w), lateral (select w[1] as word, w[2] as line_no, w[3] as segment_no)""")
def words_to_lines(spark, d):
    """Words of pages of three lines, raised a little and far apart here and there."""
    y = F.col("p_size").cast("double")
    word = lambda text, x0, x1, dy: F.struct(F.lit(text).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), (y + dy).alias("y"), F.lit(10.0).alias("size"))
    words = F.array(word("c", 80, 90, 1.0), word("a", 0, 20, 0.0), word("b", 24, 40, 2.0), word("d", 0, 20, 14.0), word("f", 60, 70, 29.0), word("e", 0, 30, 28.0))
    pages = _t(spark, d, "part").select("p_partkey", F.explode(words).alias("w")).select("p_partkey", "w.*")
    return dc.word_lines(pages, ["p_partkey"]).select("p_partkey", F.col("text").alias("word"), "line_no", "segment_no")


@query(r"""with r as (select page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages),
k as (select page_id, url, left(regexp_replace(regexp_replace(regexp_replace(host || case when path = '/' then '' else path end, '[^a-zA-Z0-9!_.''()-]+', '-', 'g'), '-+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 180) as name from r)
select page_id, case when name = '' then 'page' else name end || '-' || left(sha1(url), 10) as key from k""")
def readable_keys(spark, d):
    """Keys of urls that people can read, bounded, with a hash that tells urls apart."""
    return _t(spark, d, "pages").select("page_id", links.readable_key(F.col("url")).alias("key"))


@query("""select page_id, case page_id % 4 when 0 then 'url' when 1 then 'id' when 2 then 'domain' else 'name' end as kind from pages""")
def input_kinds(spark, d):
    """What people type: urls, ids, domains and names."""
    k = F.col("page_id") % 4
    typed = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("AR"), F.lpad(_s("page_id"), 12, "0"))).when(k == 2, F.concat(F.lit(" Shop"), _s("page_id"), F.lit(".example.org "))).otherwise(F.concat(F.lit("Shop No "), _s("page_id")))
    return _t(spark, d, "pages").select("page_id", criteria.query_kind(typed).alias("kind"))
