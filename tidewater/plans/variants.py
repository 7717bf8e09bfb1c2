"""Registered queries over records without a schema, derived from orders, lineitems and pages with keys in changing order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import tables
from tidewater.functions import variants as va
from tidewater.operators import diff
from tidewater.plans.records import _t
from tidewater.plans.registry import registry

QUERIES, ORACLE, query = registry()

_HASH = "substr(translate(base64(unhex(sha1({}))), '+/', '-_'), 1, 16)"


def _json(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _items(spark, d):
    """Orders as JSON texts, their keys in either order at every level; a third hold a field that others lack."""
    k, p, s, u = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey")
    more = F.when(k % 3 == 0, _json(',"note":{"by":"c', u, '","n":[1,{"y":2,"x":"', s, '"}]}')).otherwise("")
    up = _json('{"id":', k, ',"price":{"amount":', u, ',"terms":{"kind":"', s, '","days":30}},"price.amount":"', p, '"', more, "}")
    down = _json("{", F.when(k % 3 == 0, _json('"note":{"n":[1,{"x":"', s, '","y":2}],"by":"c', u, '"},')).otherwise(""), '"price.amount":"', p, '","price":{"terms":{"days":30,"kind":"', s, '"},"amount":', u, '},"id":', k, "}")
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.parse_json(F.when(k % 2 == 0, up).otherwise(down)).alias("item"))


_NOTE = """case when o_orderkey % 3 = 0 then '"note":{"by":"c' || o_custkey || '","n":[1,{"x":"' || o_orderstatus || '","y":2}]},' else '' end"""
_PRICE = """'"price":{"amount":' || o_custkey || ',"terms":{"days":30,"kind":"' || o_orderstatus || '"}}'"""
_WHOLE = f"""'{{"id":' || o_orderkey || ',' || {_NOTE} || {_PRICE} || ',"price.amount":"' || o_orderpriority || '"}}'"""


@query(f"select o_orderkey, {_HASH.format(_WHOLE)} as fingerprint, {_WHOLE} as canonical from orders")
def row_fingerprint_nested(spark, d):
    """Nested records whose keys come in either order."""
    return _items(spark, d).select("o_orderkey", va.item_fingerprint(F.col("item")).alias("fingerprint"), va.canonical(F.col("item")).alias("canonical"))


_LESS = f"""'{{"id":' || o_orderkey || ',' || case when o_orderkey % 3 = 0 then '"note":{{"n":[1,{{"x":"' || o_orderstatus || '","y":2}}]}},' else '' end || '"price":{{"amount":' || o_custkey || ',"terms":{{"kind":"' || o_orderstatus || '"}}}}}}'"""


@query(f"""select o_orderkey, '{{' || case when o_orderkey % 3 = 0 then '"note.by":"c' || o_custkey || '",' else '' end || '"price.amount":"' || o_orderpriority || '","price.terms.kind":"' || o_orderstatus || '"}}' as compared, {_LESS} as rest from orders""")
def projected_fields(spark, d):
    """Dotted paths with a literal key first, on either side: only these fields, and all but these."""
    i = F.col("item")
    return _items(spark, d).select("o_orderkey", va.projection(i, ["price.terms.kind", "price.amount", "note.by", "none.such"]).alias("compared"), va.projection(i, [], ["price.amount", "price.terms.days", "note.by", "none"]).alias("rest"))


def _two(spark, d):
    """Two crawls of the orders: what changes follows from the key; the second has its keys the other way round."""
    k = F.col("o_orderkey")
    row = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    first = _json('{"id":', k, ',"a":{"b":{"c":{"d":{"e":1,"f":2}}}},"price":{"amount":', F.col("o_custkey"), ',"currency":"USD"},"tags":["x","', F.col("o_orderstatus"), '"],"gone":null}')
    amount = F.when(k % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    deep = F.when(k % 11 == 0, "3").otherwise("2")
    extra = F.when(k % 4 == 0, F.lit(',"seller":{"name":"s"}')).otherwise("")
    tags = F.when(k % 9 == 0, _json('["', F.col("o_orderstatus"), '"]')).otherwise(_json('["x","', F.col("o_orderstatus"), '"]'))
    currency = F.when(k % 13 == 0, '{"code":"EUR"}').otherwise('"USD"')
    second = _json('{"tags":', tags, ',"price":{"currency":', currency, ',"amount":', amount, '},"a":{"b":{"c":{"d":{"f":', deep, ',"e":1}}}}', extra, ',"id":', k, "}")
    make = lambda text, where: row.where(where).select("o_orderkey", F.parse_json(text).alias("item"))
    return make(first, k % 10 != 0), make(second, k % 7 != 0)


_TWO = """with o as (select o_orderkey as k, o_custkey as u, o_orderstatus as s from orders),
e as (select k, 'price.amount' as field, u::varchar as before, (u + 1)::varchar as after from o where k % 5 = 0
  union all select k, 'a.b.c.d', '{"e":1,"f":2}', '{"e":1,"f":3}' from o where k % 11 = 0 union all select k, 'seller', null, '{"name":"s"}' from o where k % 4 = 0
  union all select k, 'tags', '["x","' || s || '"]', '["' || s || '"]' from o where k % 9 = 0 union all select k, 'price.currency', 'USD', '{"code":"EUR"}' from o where k % 13 = 0),
c as (select * from e where k % 10 <> 0 and k % 7 <> 0) """


@query(_TWO + "select k::varchar as key, field, before, after, count(*) over (partition by k)::int as total from c qualify row_number() over (partition by k order by field) <= 3")
def nested_changes(spark, d):
    """Changed items field by field, four levels deep, at most three fields each."""
    c = diff.item_diff(*_two(spark, d), "item", ["id"], ["o_orderkey"]).where("change_type = 'changed'")
    c = c.select("key", va.nested_changes(F.col("before"), F.col("after"), most=3).alias("c"))
    return c.select("key", "c.total", F.explode("c.changes").alias("f")).select("key", "f.field", "f.before", "f.after", "total")


@query(_TWO + "select k::varchar as key, field, before, after, count(*) over (partition by k)::int as total from c qualify row_number() over (partition by k order by field) <= 3")
def lateral_changes(spark, d):
    """The same through the SQL table function, called laterally."""
    tables.register(spark)
    changed = diff.item_diff(*_two(spark, d), "item", ["id"], ["o_orderkey"]).where("change_type = 'changed'")
    changed.select("key", F.to_json("before").alias("b"), F.to_json("after").alias("a")).createOrReplaceTempView("tidewater_changed")
    return spark.sql("select c.key, f.field, f.before, f.after, f.total from tidewater_changed c, lateral flatten_changes(c.b, c.a, 3) f")


@query(_TWO + """select k::varchar as key, case when k % 10 = 0 then 'new' when k % 7 = 0 then 'removed' when k % 9 = 0 or k % 5 = 0 then 'changed' else 'unchanged' end as change_type from o where not (k % 10 = 0 and k % 7 = 0)""")
def projected_diff(spark, d):
    """Items compared by two of their fields only, one a dotted path."""
    return diff.item_diff(*_two(spark, d), "item", ["id"], ["o_orderkey"], ["price.amount", "tags"]).select("key", "change_type")


@query(_TWO + """select k::varchar as key, case when k % 10 = 0 then 'new' when k % 7 = 0 then 'removed' when k % 9 = 0 or k % 13 = 0 then 'changed' else 'unchanged' end as change_type from o where not (k % 10 = 0 and k % 7 = 0)""")
def ignoring_diff(spark, d):
    """Items compared by all but some fields, nested ones among them."""
    return diff.item_diff(*_two(spark, d), "item", ["id"], ["o_orderkey"], [], ["price.amount", "a.b.c", "seller", "gone"]).select("key", "change_type")
