"""Merging records: filling from details, offers per provider, parity, requested against found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_from(listing: DataFrame, detail: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """listing with only its null or empty fields filled from detail (one row a key)."""
    d = detail.select(*keys, *[F.col(f).alias(f"_d_{f}") for f in fields])
    j = listing.join(d, keys, "left")
    for f in fields:
        j = j.withColumn(f, F.coalesce(F.when(F.col(f).cast("string") != "", F.col(f)), F.col(f"_d_{f}")))
    return j.drop(*[f"_d_{f}" for f in fields])


def merge_by_lowest(df: DataFrame, keys: list[str], price: str, order: str, fill: list[str], flags: list[str]) -> DataFrame:
    """One row a key: the lowest price (then order) is the base, its nulls filled by the next; flags are ORed."""
    rank = F.struct(F.col(price).isNull().alias("x"), F.col(price), F.col(order))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c)
    return df.groupBy(*keys).agg(F.min(price).alias(price), *[first(c) for c in fill], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags])


def offers_summary(df: DataFrame, keys: list[str], provider: str, price: str, official: str, headline: str | None = None) -> DataFrame:
    """(keys, n_offers, cheapest, lowest, official_price); the lowest price is that of the offers or of the ``headline``."""
    rank = F.when(F.col(price).isNotNull(), F.struct(price, provider))
    lowest = F.min(price) if headline is None else F.least(F.min(price), F.min(headline))
    return df.groupBy(*keys).agg(F.count("*").alias("n_offers"), F.min_by(provider, rank).alias("cheapest"), lowest.alias("lowest"), F.min(F.when(F.col(official), F.col(price))).alias("official_price"))


def requested_vs_found(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every wanted key with ``found`` and the found row's columns (null where there is none)."""
    return wanted.join(found.withColumn("_hit", F.lit(True)), key, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")
