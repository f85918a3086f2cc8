"""Versions of content: changes between captures, carried values and matched refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(rows: DataFrame, key: list[str], order: list[str], value: str, stamp: str) -> DataFrame:
    """Intervals (changed_after, changed_by] between consecutive known values that differ."""
    w = Window.partitionBy(*key).orderBy(*order)
    known = rows.filter(F.col(value).isNotNull()).withColumn("__v", F.lag(value).over(w)).withColumn("changed_after", F.lag(stamp).over(w))
    return known.filter(F.col("__v") != F.col(value)).select(*key, "changed_after", F.col(stamp).alias("changed_by"), F.col("__v").alias("old"), F.col(value).alias("new"))


def carried(rows: DataFrame, key: list[str], order: list[str], value: str, stamp: str) -> DataFrame:
    """The latest known value of each key and the first time that it was seen."""
    last = rows.filter(F.col(value).isNotNull()).withColumn("__last", F.last(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return last.filter(F.col(value) == F.col("__last")).groupBy(*key, F.col("__last").alias(value)).agg(F.min(stamp).alias("first_carried_at"))


def refreshes(stamps: DataFrame, found: DataFrame, key: list[str], tolerance_days: int = 3, days: int = 30) -> DataFrame:
    """For each key, the latest stated update (stated_at) within the tolerance of an observed change, with the earliest change that detects it.

    Changes stand in every stretch of so many days that they and their tolerance touch, so a stamp meets those of its stretch only.
    """
    slack, width = F.expr(f"interval {int(tolerance_days)} days"), days * 86_400_000_000
    low, high = F.col("changed_after") - slack, F.col("changed_by") + slack
    stretch = lambda c: F.floor(F.unix_micros(c) / F.lit(width))
    held = found.select(*key, low.alias("__low"), high.alias("__high"), "changed_by", F.explode(F.sequence(stretch(low), stretch(high))).alias("__s"))
    rows = stamps.select(*key, "stated_at").distinct().withColumn("__s", stretch("stated_at")).join(held, [*key, "__s"]).filter(F.col("stated_at").between(F.col("__low"), F.col("__high")))
    per = rows.groupBy(*key, "stated_at").agg(F.min("changed_by").alias("detected_by"))
    return per.groupBy(*key).agg(F.max("stated_at").alias("refreshed_at"), F.max_by("detected_by", "stated_at").alias("detected_by"))


def version_counts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("rows"), F.countDistinct(value).alias("versions"))
