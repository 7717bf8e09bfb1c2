"""Records without a schema, as VARIANT: canonical text, projection, fingerprints, nested changes and tree search.

A record may hold other fields than the next one, in any order and to any depth. Each step takes one more level apart
within the row, by expressions: nothing is exploded, regrouped or sent to Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.operators.keys import abridged, short_hash

Path = tuple[str, ...]


def members(v: Column) -> Column:
    """An object's fields as a map; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """An array's values; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def canonical(v: Column) -> Column:
    """JSON with the keys of every level sorted; an absent value is null.

    Numbers are printed by their value: 1.50 as 1.5; one written with an exponent stays apart from one without.
    """
    return F.coalesce(F.to_json(v), F.lit("null"))


def shown(v: Column) -> Column:
    """A value for people: texts as they are, anything else as canonical JSON; long ones by hash and beginning."""
    return abridged(F.coalesce(F.try_variant_get(v, "$", "string"), F.nullif(F.to_json(v), F.lit("null"))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once a row."""
    return F.transform(F.array(value), use)[0]


def _sorted(names: Sequence[str]) -> list[str]:
    return sorted(set(names), key=lambda n: n.encode("utf-16-be"))


def field(v: Column, *names: str) -> Column:
    """The value at a field of objects in objects; null if one is missing or no object. Only the way to it is read, no map is made."""
    if any("'" in n and '"' in n for n in names):  # no path can spell it
        return reduce(lambda x, n: F.try_element_at(members(x), F.lit(n)), names, v)
    return F.try_variant_get(v, "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names), "variant")


def at_path(v: Column, path: str) -> tuple[Column, Column]:
    """(whether it is there, the value) at ``a.b.c``; a field whose very name is the whole path wins."""
    value = field(v, path)
    if "." in path:
        value = F.coalesce(value, field(v, *path.split(".")))
    return value.isNotNull(), value


def _object(keys: Column, text: Callable[[Column], Column]) -> Column:
    """The JSON of an object from its keys and the text of each."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(keys), lambda k: F.concat(F.to_json(k.cast("variant")), F.lit(":"), text(k))), ","), F.lit("}"))


def _without(v: Column, gone: list[tuple[Path, Column]]) -> Column:
    """Canonical text of v without the fields at the paths whose condition holds."""
    here = [(p[0], c) for p, c in gone if len(p) == 1]
    deeper: dict[str, list[tuple[Path, Column]]] = {}
    for p, c in gone:
        if len(p) > 1:
            deeper.setdefault(p[0], []).append((p[1:], c))
    stays = lambda k: reduce(lambda a, x: a & ~((k == x[0]) & x[1]), here, F.lit(True))

    def text(fields: Column, k: Column) -> Column:
        value = F.element_at(fields, k)
        return reduce(lambda out, x: F.when(k == x[0], _without(value, x[1])).otherwise(out), deeper.items(), canonical(value))

    return F.coalesce(_bound(members(v), lambda fields: _object(F.filter(F.map_keys(fields), stays), lambda k: text(fields, k))), canonical(v))


def projection(v: Column, compare: Sequence[str] = (), ignore: Sequence[str] = ()) -> Column:
    """Canonical text of what is compared: the ``compare`` fields that are there, else all but the ``ignore`` fields.

    Fields are names or dotted paths; a field whose very name is the path wins over the nested one.
    """
    if compare:
        parts = []
        for f in _sorted(compare):
            there, value = at_path(v, f)
            parts.append(F.when(there, F.concat(F.lit(json.dumps(f, ensure_ascii=False) + ":"), canonical(value))))
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))
    if not ignore:
        return canonical(v)
    literal = lambda f: field(v, f).isNotNull()
    gone = [((f,), F.lit(True)) for f in ignore] + [(tuple(f.split(".")), ~literal(f)) for f in ignore if "." in f]
    return _without(v, gone)


def item_fingerprint(v: Column, compare: Sequence[str] = (), ignore: Sequence[str] = ()) -> Column:
    """16 characters of the base64url sha1 of the projection: the order of keys never matters."""
    return short_hash(projection(v, compare, ignore))


def item_key(v: Column, id_fields: Sequence[str], fallback: Column) -> Column:
    """The texts at the id fields, trimmed, joined by `` | ``; null if all are empty; without id fields ``#`` and the fallback."""
    if not id_fields:
        return F.concat(F.lit("#"), fallback)
    values = [at_path(v, f)[1] for f in id_fields]
    texts = [F.coalesce(F.try_variant_get(x, "$", "string"), canonical(x)) for x in values]
    empty = reduce(lambda a, b: a & b, [x.isin("", "null") for x in texts])
    return F.when(~empty, F.concat_ws(" | ", *[F.trim(x) for x in texts]))


def nested_changes(before: Column, after: Column, most: int = 20, depth: int = 4) -> Column:
    """struct<total, changes array<struct<field, before, after>>>: what differs, by field, at most ``most`` listed.

    Objects on both sides are compared field by field (``a.b``) down to ``depth`` levels; arrays, deeper objects and an
    object against anything else are one change. Absent and null are equal. A change of the whole is ``(item)``.
    """
    pair = lambda path, b, a: F.struct(path.alias("path"), b.alias("b"), a.alias("a"))
    pairs = F.array(pair(F.lit(""), before, after))

    def fields(p: Column) -> Column:
        name = lambda k: F.when(p["path"] == "", k).otherwise(F.concat(p["path"], F.lit("."), k))
        each = lambda x: F.transform(F.array_sort(F.array_union(F.map_keys(x["m"]), F.map_keys(x["o"]))), lambda k: pair(name(k), F.try_element_at(x["m"], k), F.try_element_at(x["o"], k)))
        both = F.struct(members(p["b"]).alias("m"), members(p["a"]).alias("o"))
        return _bound(both, lambda x: F.when(x["m"].isNotNull() & x["o"].isNotNull(), each(x)).otherwise(F.array(p)))

    for level in range(depth):  # items to compare mostly differ, so the first look is at their fields
        pairs = F.flatten(F.transform(F.filter(pairs, lambda p: ~_alike(p["b"], p["a"])) if level else pairs, fields))
    differs = lambda p: ~_alike(p["b"], p["a"]) & (canonical(p["b"]) != canonical(p["a"]))
    return _bound(F.filter(pairs, differs), lambda found: _listed(found, most))


def _alike(b: Column, a: Column) -> Column:
    """Whether both are of one kind and text, and so of one canonical text; that of scalars is slow to print and not needed for it."""
    same = lambda f: f(b).eqNullSafe(f(a))
    return same(lambda v: F.try_variant_get(v, "$", "string")) & same(F.schema_of_variant)


def _listed(pairs: Column, most: int) -> Column:
    listed = F.transform(F.slice(pairs, 1, most), lambda p: F.struct(F.when(p["path"] == "", "(item)").otherwise(p["path"]).alias("field"), shown(p["b"]).alias("before"), shown(p["a"]).alias("after")))
    return F.struct(F.size(pairs).alias("total"), listed.alias("changes"))


NODE = "struct<at:array<int>,text:string>"


def _below(p: Column) -> Column:
    """The nodes (at, text) one level below a node of JSON text; ``at`` grows in document order."""
    node = lambda x, i: F.struct(F.concat(p["at"], F.array(i)).alias("at"), x.alias("text"))
    # members as they stand in the text, not by name; texts and numbers below are no nodes
    is_tree = lambda x: F.coalesce(F.left(F.to_json(x), F.lit(1)).isin("{", "["), F.lit(False))
    v = F.try_parse_json(p["text"])
    parts = F.struct(members(v).alias("m"), elements(v).alias("e"), F.from_json(p["text"], "map<string,string>").alias("t"))

    def nodes(x: Column) -> Column:
        inner = F.filter(F.map_keys(x["t"]), lambda k: is_tree(F.try_element_at(x["m"], k)))
        of_object = F.transform(inner, lambda k, i: node(F.element_at(x["t"], k), i))
        of_array = F.transform(F.filter(x["e"], is_tree), lambda y, i: node(F.to_json(y), i))
        return F.coalesce(F.when(x["m"].isNotNull(), of_object), of_array, F.array().cast(f"array<{NODE}>"))

    return _bound(parts, nodes)


def tree_nodes(tree: Column, hit: Callable[[Column], Column], depth: int = 60, into_hits: bool = False) -> Column:
    """The objects and arrays of a JSON text that ``hit`` (of a VARIANT) accepts, as JSON texts in document order.

    The tree is searched level by level to the given depth; what lies below a hit is searched only with ``into_hits``.
    Null and malformed texts, and objects that name a field twice, have no nodes.
    """
    none = F.array().cast(f"array<{NODE}>")
    root = F.filter(F.array(F.struct(F.array().cast("array<int>").alias("at"), tree.alias("text"))), lambda p: F.try_parse_json(p["text"]).isNotNull())
    found = lambda p: F.coalesce(hit(F.try_parse_json(p["text"])), F.lit(False))
    state = f"struct<hits:array<{NODE}>,open:array<{NODE}>>"

    def level(s: Column, _: Column) -> Column:
        goes_on = s["open"] if into_hits else F.filter(s["open"], lambda p: ~found(p))
        return F.struct(F.concat(s["hits"], F.filter(s["open"], found)).alias("hits"), F.flatten(F.transform(goes_on, _below)).alias("open")).cast(state)

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(depth)), F.struct(none.alias("hits"), root.cast(f"array<{NODE}>").alias("open")).cast(state), level)
    return F.transform(F.array_sort(walked["hits"]), lambda p: p["text"])


def has_field(key: str) -> Callable[[Column], Column]:
    return lambda v: F.map_contains_key(members(v), key)
