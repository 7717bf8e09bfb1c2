"""Helpers shared by the training-data operators: reading, cutting lineage, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewater.scratch import Scratch, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_rows(df: DataFrame, name: str = "_row") -> DataFrame:
    """df as one struct column, so that helper columns cannot clash with its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column], name: str = "_row") -> DataFrame:
    """The columns of the struct, then the added ones; an added name that is taken gets underscores at its end."""
    taken, out = {c.lower() for c in columns}, []
    for n, c in added.items():
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(c.alias(n))
    return df.select(*[F.col(name)[c].alias(c) for c in columns], *out)


def need_whole_numbers(df: DataFrame, column: str) -> None:
    """Says at once that ids of another type are not for this operator, instead of failing in a task."""
    if not isinstance(df.schema[column].dataType, IntegralType):
        raise ValueError(f"{column} must be a column of whole numbers")


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def broadcast_if(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A hint only below a counted number of narrow rows; beyond it Spark shuffles (and splits skew)."""
    return F.broadcast(df) if rows <= most else df
