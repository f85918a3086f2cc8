"""Interval-censored lifecycles of listed jobs.

Presence may be read from any capture, absence only from a complete one. A job's first absence is the first complete capture
after its first sighting that lacks it; its closure is the same after its last sighting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import days_between

FACTS = ("title", "team", "location", "description_hash", "url")


def is_complete(status: str = "coverage_status") -> Column:
    return F.col(status) == "complete"


def ordered(captures: DataFrame) -> DataFrame:
    """Captures with i (their number within the company, by time and id) and c (complete captures so far)."""
    w = Window.partitionBy("company_id").orderBy("captured_at", "snapshot_id")
    return captures.withColumn("i", F.row_number().over(w)).withColumn("c", F.sum(is_complete().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def intervals(captures: DataFrame, listings: DataFrame) -> DataFrame:
    """One row per (company_id, job_id) ever listed.

    Jobs are never multiplied by captures: complete captures are numbered within the company, a job's own numbers
    form islands, and the first number behind its first island is its first absence. One shuffle by job besides the join.
    """
    order = ordered(captures)
    job = Window.partitionBy("company_id", "job_id").orderBy("i")
    full = Window.partitionBy("company_id", "job_id")
    rows = listings.join(order, "snapshot_id").withColumn("complete", is_complete().cast("int"))
    rows = rows.withColumn("n", F.sum("complete").over(job.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("base", F.first("c").over(job)).withColumn("own", F.first("complete").over(job))
    # complete sightings without a gap since the first sighting
    unbroken = (F.col("complete") == 1) & (F.col("c") - F.col("n") == F.col("base") - F.col("own"))
    rows = rows.withColumn("absent_c", F.coalesce(F.max(F.when(unbroken, F.col("c"))).over(full), F.col("base")) + 1)
    facts = F.max_by(F.struct(*FACTS), "i").alias("facts")
    out = rows.groupBy("company_id", "job_id").agg(
        F.min("captured_at").alias("first_observed"),
        F.max("captured_at").alias("last_seen_open"),
        F.min(F.when(F.col("c") >= F.col("absent_c"), F.col("captured_at"))).alias("reappeared_at"),
        F.max("absent_c").alias("absent_c"),
        (F.max("c") + 1).alias("closure_c"),
        facts,
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.count("*").alias("capture_count"),
        F.sort_array(F.collect_list("snapshot_id")).alias("present_snapshot_ids"),
    )
    complete = order.filter(is_complete()).select("company_id", F.col("c"), "captured_at")
    absent = complete.select("company_id", F.col("c").alias("absent_c"), F.col("captured_at").alias("first_seen_absent"))
    closed = complete.select("company_id", F.col("c").alias("closure_c"), F.col("captured_at").alias("closure_absent_at"))
    out = out.join(absent, ["company_id", "absent_c"], "left").join(closed, ["company_id", "closure_c"], "left")
    censoring = F.when(F.col("closure_absent_at").isNull(), "right").otherwise("interval")
    return out.select(
        "company_id", "job_id", "first_observed", "last_seen_open", "first_seen_absent", "reappeared_at", "closure_absent_at", *[F.col(f"facts.{f}").alias(f) for f in FACTS],
        censoring.alias("censoring"), days_between("closure_absent_at", "last_seen_open").alias("gap_days"), "sources", "capture_count", "present_snapshot_ids",
    )


def archive_only(sources: str = "sources") -> Column:
    return ~F.array_contains(sources, "own")


def companies_with_captures(captures: DataFrame) -> DataFrame:
    return captures.select("company_id").distinct()


def merged(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Tighten stored lifecycles with derived ones: earlier first sightings, later last ones, earlier absences. Derived rows without a stored one are new."""
    s, d = stored.alias("s"), derived.alias("d")
    rows = s.join(d, ["company_id", "job_id"], "full")
    pick = {"first_observed": F.least, "last_seen_open": F.greatest, "first_seen_absent": F.least, "reappeared_at": F.least}
    cols = [f(F.col(f"s.{c}"), F.col(f"d.{c}")).alias(c) for c, f in pick.items()]
    kind = F.when(F.col("s.first_observed").isNull(), "new").when(F.col("d.first_observed").isNull(), "kept").otherwise("merged")
    return rows.select("company_id", "job_id", *cols, kind.alias("change"))


def daily_transition(open_jobs: DataFrame, today: DataFrame, now: Column) -> DataFrame:
    """What one day's complete listing does to each job: new, seen, reappeared or absent."""
    s, t = open_jobs.alias("s"), today.select("company_id", "job_id", F.lit(True).alias("listed")).distinct().alias("t")
    rows = s.join(t, ["company_id", "job_id"], "full")
    known, listed, away = F.col("first_observed").isNotNull(), F.coalesce("listed", F.lit(False)), F.col("first_seen_absent").isNotNull()
    change = F.when(~known, "new").when(listed & away & F.col("reappeared_at").isNull(), "reappeared").when(listed, "seen").when(~away, "absent").otherwise("still_absent")
    return rows.select(
        "company_id", "job_id", F.coalesce("first_observed", now).alias("first_observed"), F.when(listed, now).otherwise(F.col("last_seen_open")).alias("last_seen_open"),
        F.when(change == "absent", now).otherwise(F.col("first_seen_absent")).alias("first_seen_absent"), F.when(change == "reappeared", now).otherwise(F.col("reappeared_at")).alias("reappeared_at"), change.alias("change"),
    )
