"""Snapshot differences: new, changed, removed and unchanged rows, with field-level changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewater.functions.variants import item_fingerprint, item_key, projection
from tidewater.operators.keys import abridged, with_key_and_hash


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def prepared(df: DataFrame, id_fields: list[str], order: list[str], compare: list[str] | None = None, ignore: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(_key, _hash, kept columns): one row a key, the first in ``order``; rows without a key go."""
    keep = df.columns if keep is None else keep
    return first_per_key(with_key_and_hash(df, id_fields, compare, ignore).where("_key is not null"), ["_key"], order).select("_key", "_hash", *[F.col(f"`{c}`") for c in keep])


def diff_prepared(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(key, change_type, before_<c>, after_<c>) of two ``prepared`` sides: one full outer equi-join on the key.

    A side that is stored by buckets of the key, as ``SnapshotTable`` does, is neither sorted nor shuffled again.
    """
    side = lambda df, p: df.select("_key", *[F.col(f"`{c}`").alias(f"{p}{c}" if c == "_hash" else f"{p}_{c}") for c in df.columns if c != "_key"])
    joined = side(previous, "before").join(side(current, "after"), "_key", "full_outer")
    kind = F.when(F.col("before_hash").isNull(), "new").when(F.col("after_hash").isNull(), "removed").when(F.col("before_hash") != F.col("after_hash"), "changed").otherwise("unchanged")
    return joined.withColumn("change_type", kind).withColumnRenamed("_key", "key").drop("before_hash", "after_hash")


def snapshot_diff(previous: DataFrame, current: DataFrame, id_fields: list[str], order: list[str], compare: list[str] | None = None, ignore: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(key, change_type, before_<c>, after_<c>): one full outer equi-join on the key.

    Rows without a key take no part; of rows with equal keys the first in ``order`` counts. Fields are
    carried only for the columns in ``keep`` (all by default).
    """
    keep = current.columns if keep is None else keep
    return diff_prepared(*(prepared(df, id_fields, order, compare, ignore, keep) for df in (previous, current)))


def summarize_changes(changes: DataFrame) -> DataFrame:
    """One row: counts of each change type and of the items on either side."""
    n = lambda k: F.count_if(F.col("change_type") == k)
    return changes.agg(n("new").alias("n_new"), n("changed").alias("n_changed"), n("removed").alias("n_removed"), n("unchanged").alias("n_unchanged"), F.count_if(F.col("change_type") != "new").alias("previous_items"), F.count_if(F.col("change_type") != "removed").alias("current_items"))


def _leaves(kind: T.DataType, path: tuple[str, ...], depth: int) -> list[tuple[str, ...]]:
    """Paths of a column's fields down to ``depth`` levels; arrays and what lies deeper stay whole."""
    if isinstance(kind, T.StructType) and len(path) < depth:
        return [p for f in kind.fields for p in _leaves(f.dataType, (*path, f.name), depth)]
    return [path]


def field_changes(changes: DataFrame, fields: list[str], most: int = 20, depth: int = 4) -> DataFrame:
    """(key, field, before, after, total): one row a changed field, by name, at most ``most`` a key.

    Structs are compared field by field (``a.b``) down to ``depth`` levels, arrays and deeper structs as one JSON
    text. Values are compared as text, null equal to null; long ones are shown by hash and beginning; ``total`` counts
    all changed fields.
    """
    def text(side: str, path: tuple[str, ...]) -> Column:
        c, kind = F.col(f"{side}_{path[0]}"), changes.schema[f"{side}_{path[0]}"].dataType
        for name in path[1:]:
            c, kind = c[name], kind[name].dataType
        return F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")

    paths = sorted(p for f in fields for p in _leaves(changes.schema[f"before_{f}"].dataType, (f,), depth))
    entries = [F.struct(F.lit(".".join(p)).alias("field"), text("before", p).alias("before"), text("after", p).alias("after")) for p in paths]
    differs = F.filter(F.array(*entries), lambda e: ~e["before"].eqNullSafe(e["after"]))
    rows = changes.where("change_type = 'changed'").select("key", differs.alias("c"))
    out = rows.select("key", F.explode(F.slice("c", 1, most)).alias("e"), F.size("c").alias("total"))
    return out.select("key", "e.field", abridged(F.col("e.before")).alias("before"), abridged(F.col("e.after")).alias("after"), "total")


def item_diff(previous: DataFrame, current: DataFrame, item: str, id_fields: Sequence[str], order: list[Column | str], compare: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """(key, change_type, before, after): items (a VARIANT column) matched by key, compared by their projection.

    Items without a key take no part; of items with one key the first in ``order`` counts. One full outer equi-join.
    """

    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))  # noqa: E731  a filter on it is not pushed below, where it would parse and print the items again

    def side(df: DataFrame, name: str) -> DataFrame:
        h = None if id_fields else item_fingerprint(F.col(item), compare, ignore)
        keyed = df.select("*", once(item_key(F.col(item), id_fields, h), "_key")).where("_key is not null")
        return first_per_key(keyed, ["_key"], order).select(F.col("_key").alias("key"), F.col("_key").alias(f"_{name}"), F.col(item).alias(name))

    differ = projection(F.col("before"), compare, ignore) != projection(F.col("after"), compare, ignore)
    kind = F.when(F.col("_before").isNull(), "new").when(F.col("_after").isNull(), "removed").when(differ, "changed").otherwise("unchanged")
    joined = side(previous, "before").join(side(current, "after"), "key", "full_outer")
    return joined.select("key", "before", "after", once(kind, "change_type")).select("key", "change_type", "before", "after")
