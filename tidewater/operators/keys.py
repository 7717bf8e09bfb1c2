"""Keys, fingerprints and comparison projections of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_of(c: Column | str) -> Column:
    """A scalar as trimmed text; numbers lose a trailing ``.0`` as JSON does."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0$", "$1"))


LONG = 1000  # characters of a text from which only its hash is compared


def short_hash(c: Column) -> Column:
    """16 characters of the base64url sha1 of a text."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha1(c))), "+/", "-_"), 1, 16)


def abridged(c: Column) -> Column:
    """A text of over LONG characters as its hash and first 200 characters; others as they are."""
    return F.when(F.length(c) > LONG, F.to_json(F.struct(short_hash(c).alias("hash"), F.left(c, F.lit(200)).alias("preview")))).otherwise(c)


def fingerprint(columns: list[str], texts: tuple[str, ...] = ()) -> Column:
    """16 characters of the base64url sha1 of the canonical JSON (sorted keys, nulls kept); long values of the ``texts`` count by their hash."""
    return short_hash(F.to_json(F.struct(*[(abridged(F.col(f"`{c}`")) if c in texts else F.col(f"`{c}`")).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def key_of(id_fields: list[str], fallback: Column | None = None) -> Column:
    """Trimmed parts joined by `` | ``; null if all are empty; without id fields ``#`` and the fallback."""
    if not id_fields:
        return F.concat(F.lit("#"), fallback)
    parts = [F.coalesce(text_of(c), F.lit("null")) for c in id_fields]
    empty = [F.coalesce(text_of(c), F.lit("")) == "" for c in id_fields]
    all_empty = empty[0]
    for e in empty[1:]:
        all_empty = all_empty & e
    return F.when(~all_empty, F.concat_ws(" | ", *parts))


def _field(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """A column by its very name, else the field at a dotted path."""
    if name in df.columns:
        return F.col(f"`{name}`"), df.schema[name].dataType
    head, *rest = name.split(".")
    c, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for part in rest:
        c, kind = c[part], kind[part].dataType
    return c, kind


def with_key_and_hash(df: DataFrame, id_fields: list[str], compare: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """df with ``_key`` and ``_hash``; compared fields win, else all but the ignored and the key.

    A compared field is a column or a dotted path into structs; a column of that very name wins. Nested values count by
    their canonical JSON: neither the order of a struct's fields nor that of a map's keys changes the hash.
    """
    used = compare or [c for c in df.columns if c not in (ignore or [])]
    found = {c: _field(df, c) for c in used}
    if any(isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType)) for _, kind in found.values()):
        record = F.struct(*[found[c][0].alias(c) for c in sorted(used)])
        h = short_hash(F.to_json(F.to_variant_object(record)))
    else:
        texts = tuple(c for c in used if found[c][1] == T.StringType())
        values = [(abridged(found[c][0]) if c in texts else found[c][0]).alias(c) for c in sorted(used)]
        h = short_hash(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}))
    return df.withColumn("_hash", h).withColumn("_key", key_of(id_fields, h))
