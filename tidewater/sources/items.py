"""Files of records: JSON arrays, JSON Lines, envelopes and CSV, told apart by their first characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

BOM = "﻿"


def sniff(spark: SparkSession, path: str) -> str:
    """json (array or envelope), lines or csv; a ValueError for HTML and empty input. Reads the first lines only."""
    head = [r["value"].lstrip(BOM).strip() for r in spark.read.text(path).where(F.trim("value") != "").limit(2).collect()]
    head = [h for h in head if h]
    if not head:
        raise ValueError(f"{path} is empty")
    if head[0].startswith("<"):
        raise ValueError(f"{path} holds HTML, not records")
    if head[0].startswith("["):
        return "json"
    if head[0].startswith("{"):
        whole = head[0].endswith("}") or head[0].endswith("},")
        return "lines" if whole and (len(head) > 1 and head[1].startswith("{")) else "json"
    return "csv"


def _unwrapped(df: DataFrame) -> DataFrame:
    """The items of {items}, {data: {items}} or {data} envelopes; df itself if it is none."""
    kind = {f.name: f.dataType for f in df.schema.fields}
    path = None
    if isinstance(kind.get("items"), ArrayType):
        path = "items"
    elif isinstance(kind.get("data"), ArrayType):
        path = "data"
    elif isinstance(kind.get("data"), StructType) and any(f.name == "items" and isinstance(f.dataType, ArrayType) for f in kind["data"].fields):
        path = "data.items"
    if path is None:
        return df
    rows = df.select(F.explode(path).alias("_item"))
    return rows.select("_item.*") if isinstance(rows.schema["_item"].dataType, StructType) else rows.withColumnRenamed("_item", "value")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file or folder, one row each. JSON Lines and CSV split; an array is read whole a file.

    A byte order mark is skipped, CSV headers are trimmed, empty CSV lines are passed over, quoted fields may
    hold line ends. CSV values stay text.
    """
    kind = sniff(spark, path)
    if kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        names = [c.lstrip(BOM).strip() for c in df.columns]
        df = df.toDF(*names)
        filled = F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", True) for c in names])
        return df.where(filled)
    return _unwrapped(spark.read.json(path, multiLine=kind == "json"))


def with_header_map(df: DataFrame, synonyms: dict[str, str], required: str | None = None) -> DataFrame:
    """df with canonical column names: of the columns whose header fits a key's pattern the first non-empty value.

    Rows without ``required`` are dropped; columns that fit no key go.
    """
    import re

    plain = {c: re.sub(r"\s+", " ", re.sub(r"[:.]", "", c.lower())).strip() for c in df.columns}
    out = {}
    for key, pattern in synonyms.items():
        fits = [c for c in df.columns if re.fullmatch(pattern, plain[c])]
        if fits:
            out[key] = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in fits])
    rows = df.select(*[c.alias(k) for k, c in out.items()])
    return rows.where(F.col(required).isNotNull()) if required else rows


def cells_by_header(df: DataFrame, cells: str, headers: list[str]) -> DataFrame:
    """df with a column for each header, taken from the array ``cells`` counted from its right end."""
    n = len(headers)
    return df.withColumns({h: F.try_element_at(cells, F.lit(i - n)) for i, h in enumerate(headers)})
