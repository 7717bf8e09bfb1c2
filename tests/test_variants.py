"""Records without a schema: order of keys, projection, nested changes and tree search."""

import json

from pyspark.sql import functions as F

from tidewater.functions import pages
from tidewater.functions import records as rc
from tidewater.functions import variants as va
from tidewater.operators import diff, keys


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def item(value):
    return F.parse_json(F.lit(value if isinstance(value, str) else json.dumps(value)))


def test_order_of_keys_never_changes_a_hash(spark):
    a, b = '{"x":{"b":1,"a":[{"q":1,"p":null}]},"c":1.50}', '{"c":1.5,"x":{"a":[{"p":null,"q":1}],"b":1}}'
    r = one(spark, a=va.item_fingerprint(item(a)), b=va.item_fingerprint(item(b)), t=va.canonical(item(a)), n=va.item_fingerprint(item('{"c":1.5,"x":{"a":[{"q":1}],"b":1}}')), s=va.canonical(F.lit(None).cast("variant")))
    assert r["a"] == r["b"] != r["n"] and r["t"] == '{"c":1.5,"x":{"a":[{"p":null,"q":1}],"b":1}}' and r["s"] == "null"
    df = spark.createDataFrame([(1, (1, "x"), {"k": 1, "j": 2})], "id int, s struct<b:int,a:string>, m map<string,int>")
    turned = df.select("id", F.struct(F.col("s.a"), F.col("s.b")).alias("s"), F.map_from_arrays(F.array(F.lit("j"), F.lit("k")), F.array(F.lit(2), F.lit(1))).alias("m"))
    first, second = (keys.with_key_and_hash(x, ["id"]).first() for x in (df, turned))
    assert first["_hash"] == second["_hash"] and first["_key"] == "1"
    assert keys.with_key_and_hash(df, ["id"], compare=["s.a"]).first()["_hash"] != keys.with_key_and_hash(df, ["id"], compare=["s.b"]).first()["_hash"]
    named = spark.createDataFrame([(1, 5, (6,))], "id int, `s.b` int, s struct<b:int>")
    assert keys.with_key_and_hash(named, ["id"], compare=["s.b"]).first()["_hash"] == keys.with_key_and_hash(named.withColumn("s", F.struct(F.lit(7).alias("b"))), ["id"], compare=["s.b"]).first()["_hash"]  # the literal name wins


def test_projection(spark):
    v = {"a": {"b": {"c": 1, "d": 2}, "e": 3}, "a.b": "literal", "z": None, 'q"': [1]}
    r = one(
        spark,
        literal=va.projection(item(v), ["a.b"]),
        nested=va.projection(item(v), ["a.b.d", "a.e", "z", "none", "a.none"]),
        less=va.projection(item(v), [], ["a.b", 'q"', "a.e"]),
        deep=va.projection(item({"a": {"b": {"c": 1, "d": 2}}}), [], ["a.b.c", "a.x.y", "k"]),
        plain=va.projection(item("[1,2]"), [], ["a"]),
        key=va.item_key(item({"a": {"b": " x "}, "n": 5}), ["a.b", "n", "no"], F.lit("h")),
        none=va.item_key(item({"a": "", "b": None}), ["a", "b", "c"], F.lit("h")),
        hashed=va.item_key(item(v), [], F.lit("h")),
    )
    assert r["literal"] == '{"a.b":"literal"}' and r["nested"] == '{"a.b.d":2,"a.e":3,"z":null}'
    assert r["less"] == '{"a":{"b":{"c":1,"d":2}},"z":null}' and r["deep"] == '{"a":{"b":{"d":2}}}' and r["plain"] == "[1,2]"
    assert r["key"] == "x | 5 | null" and r["none"] is None and r["hashed"] == "#h"


def test_nested_changes(spark):
    before = {"a": {"b": {"c": {"d": {"x": 1}}}}, "n": {"p": 1}, "t": [1], "same": {"k": [1, {"z": 1}]}, "long": "w" * 1200, "null": None}
    after = {"same": {"k": [1, {"z": 1}]}, "a": {"b": {"c": {"d": {"x": 2}}}}, "n": 5, "t": [1, 2], "new": {"r": 1}, "long": "w" * 1201}
    c = one(spark, c=va.nested_changes(item(before), item(after), most=4), whole=va.nested_changes(item("[1]"), item({"a": 1})), none=va.nested_changes(item(before), item(before)))
    assert c["c"]["total"] == 5 and [(x["field"], x["before"], x["after"]) for x in c["c"]["changes"]][:1] == [("a.b.c.d", '{"x":1}', '{"x":2}')]
    assert [x["field"] for x in c["c"]["changes"]] == ["a.b.c.d", "long", "n", "new"] and c["c"]["changes"][2]["before"] == '{"p":1}' and c["c"]["changes"][3]["before"] is None
    assert '"hash"' in c["c"]["changes"][1]["after"] and len(c["c"]["changes"][1]["after"]) < 300
    assert [(x["field"], x["before"], x["after"]) for x in c["whole"]["changes"]] == [("(item)", "[1]", '{"a":1}')] and c["none"]["total"] == 0


def test_item_diff(spark):
    rows = lambda *x: spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(x)], "n int, j string").select("n", F.parse_json("j").alias("item"))
    previous = rows({"id": 1, "p": {"a": 1, "b": 2}}, {"id": 2, "p": 1}, {"id": 1, "p": 9}, {"p": 3})
    current = rows({"p": {"b": 2, "a": 1}, "id": "1 "}, {"id": 3})
    got = {r["key"]: r["change_type"] for r in diff.item_diff(previous, current, "item", ["id"], ["n"], ignore=["id"]).collect()}
    assert got == {"1": "unchanged", "2": "removed", "3": "new"}


def test_item_diff_parses_once(spark):
    side = lambda: spark.range(3).select("id", F.parse_json(F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit("}"))).alias("item"))
    got = diff.item_diff(side(), side(), "item", ["id"], ["id"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2
    assert sorted((r["key"], r["change_type"]) for r in got.select("key", "change_type").collect()) == [(k, "unchanged") for k in "012"]


def test_nested_changes_by_kind(spark):
    before, after = '{"a":1,"b":{"c":1.50,"d":null},"e":{},"f":[1]}', '{"a":"1","b":{"c":1.5,"x":null},"e":{"y":null},"f":["1"]}'
    c = one(spark, c=va.nested_changes(F.parse_json(F.lit(before)), F.parse_json(F.lit(after))))["c"]
    assert [(x["field"], x["before"], x["after"]) for x in c["changes"]] == [("a", "1", "1"), ("f", "[1]", '["1"]')] and c["total"] == 2


def test_tree_search(spark):
    deep = '{"z":' * 58 + '{"hit":7}' + "}" * 58
    beyond = '{"z":' * 70 + '{"hit":7}' + "}" * 70
    order = '{"b":[{"hit":1,"in":{"hit":2}},"text",[[{"hit":3}]]],"a":{"c":{"hit":"{\\"hit\\":9}"},"s":"{\\"hit\\":8}"}}'
    r = one(spark, deep=va.tree_nodes(F.lit(deep), va.has_field("hit")), beyond=va.tree_nodes(F.lit(beyond), va.has_field("hit")), order=va.tree_nodes(F.lit(order), va.has_field("hit")), into=va.tree_nodes(F.lit(order), va.has_field("hit"), into_hits=True), bad=va.tree_nodes(F.lit("{oops"), va.has_field("hit")), none=va.tree_nodes(F.lit(None).cast("string"), va.has_field("hit")))
    hits = lambda c: [json.loads(x)["hit"] for x in c]
    assert hits(r["deep"]) == [7] and r["beyond"] == [] and hits(r["order"]) == [1, 3, '{"hit":9}'] and hits(r["into"]) == [1, 2, 3, '{"hit":9}'] and not r["bad"] and not r["none"]
    info = one(spark, i=pages.page_info(F.lit('[{"s":[null,0,7]},{"k":{"p":["",0,3]}},{"p":["t",0,9],"s":[5,0,"town"]}]'), "p", "s"), o=rc.objects_with(F.lit('{"a": [{"h": 1, "b": {"h": 2}}, [{"h": 3}]]}'), "h"))
    assert tuple(info["i"]) == ("t", 3, "town") and [json.loads(x)["h"] for x in info["o"]] == [1, 3]
    plan = spark.range(1).select(rc.objects_with(F.col("id").cast("string"), "h"), pages.page_info(F.col("id").cast("string"), "p", "s"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
