"""Time series: statistics over complete points and rescaling of groups through a shared anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series_stats(points: DataFrame, keys: list[str], ts: str, value: str, partial: str) -> DataFrame:
    """Average over complete points (all, if none is complete), the first peak, and the latest value."""
    complete = F.avg(F.when(~F.col(partial), F.col(value)))
    return points.groupBy(*keys).agg(F.coalesce(complete, F.avg(value)).alias("average"), F.max(value).alias("peak"), F.min_by(ts, F.struct(-F.col(value), F.col(ts))).alias("peak_at"), F.max_by(value, ts).alias("latest"), F.max(ts).alias("latest_at"))


def anchor_rescale(points: DataFrame, anchor: str, group: str = "grp", term: str = "term", value: str = "value", partial: str = "partial") -> tuple[DataFrame, DataFrame]:
    """(values, diagnostics): groups brought to the scale of the first group in which the anchor has a signal.

    The anchor's sum over complete points of a group sets its factor; groups without signal are dropped;
    the largest value becomes 100, values are rounded to 2 decimals and factors to 4.
    """
    own = points.where(F.col(term) == anchor)
    sums = own.groupBy(group).agg(F.sum(F.when(~F.col(partial), F.col(value))).alias("s"), F.avg(F.when(~F.col(partial), F.col(value))).alias("anchor_average")).where("s > 0")
    ref = sums.agg(F.min_by("s", group).alias("ref"))
    scale = sums.join(F.broadcast(ref)).withColumn("scale", F.col("ref") / F.col("s"))  # one row
    scaled = points.join(scale.select(group, "scale"), group).withColumn("v", F.col(value) * F.col("scale"))
    top = scaled.agg(F.max("v").alias("top"))  # one row
    values = scaled.join(F.broadcast(top)).withColumn("value", F.floor(F.col("v") / F.col("top") * 10000 + 0.5) / 100).drop("v", "top", "scale")
    return values, scale.select(group, F.round("anchor_average", 4).alias("anchor_average"), F.round("scale", 4).alias("scale"), (F.col("anchor_average") < 10).alias("weak"))
