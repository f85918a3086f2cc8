"""Runs of the snapshot job as intervals: containment, and pushing moments out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.running import running


def merged_windows(windows: DataFrame, key: list[str] | None = None, days: float = 30.0) -> DataFrame:
    """Touching and overlapping windows as one (gaps and islands). Windows are read in stretches of so many days, so that even without a key no task reads all."""
    key = key or []
    rows = windows.select(*key, "started_at", "finished_at", F.monotonically_increasing_id().alias("__id"))
    order, stretch = [F.col("started_at"), F.col("finished_at"), F.col("__id")], F.floor(F.unix_micros("started_at") / F.lit(int(days * 86_400_000_000)))
    rows = running(rows, key, order, stretch, {"reach": ("max", "finished_at")}, inclusive=False)
    rows = rows.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("started_at") > F.col("reach")), 1).otherwise(0))
    rows = running(rows, key, order, stretch, {"island": ("sum", "opens")})
    return rows.groupBy(*key, "island").agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at")).drop("island")


def latest_before(moments: DataFrame, windows: DataFrame, key: list[str], moment: str) -> DataFrame:
    """Each moment with the last window that starts at it or before (started_at, finished_at, or nulls): one sorted pass, no range join."""
    left = moments.withColumn("__at", F.col(moment)).withColumn("__m", F.lit(1))
    right = windows.select(*key, F.col("started_at").alias("__at"), F.struct("started_at", "finished_at").alias("__w")).withColumn("__m", F.lit(0))
    w = Window.partitionBy(*key).orderBy("__at", "__m").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("__last", F.last("__w", ignorenulls=True).over(w)).filter("__m = 1")
    return rows.select(*moments.columns, F.col("__last.started_at").alias("started_at"), F.col("__last.finished_at").alias("finished_at"))


def shifted(moments: DataFrame, windows: DataFrame, key: list[str], moment: str) -> DataFrame:
    """Moments inside a window move to its end; windows that touch count as one, so no further round is needed."""
    rows = latest_before(moments, merged_windows(windows, key), key, moment)
    inside = F.col(moment) < F.col("finished_at")
    return rows.withColumn("shifted_at", F.when(inside, F.col("finished_at")).otherwise(F.col(moment))).drop("started_at", "finished_at")
