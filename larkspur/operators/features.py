"""Coverage, trends and history features of companies, teams and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import days_between, ratio, team_key
from larkspur.operators.lifecycle import is_complete


def capture_gaps(captures: DataFrame) -> DataFrame:
    """Per company: number of captures, first, last, median and longest gap in days."""
    w = Window.partitionBy("company_id").orderBy("captured_at", "snapshot_id")
    rows = captures.withColumn("gap", days_between("captured_at", F.lag("captured_at").over(w)))
    return rows.groupBy("company_id").agg(F.count("*").alias("captures"), F.min("captured_at").alias("first_capture_at"), F.max("captured_at").alias("last_capture_at"), F.median("gap").alias("median_gap_days"), F.max("gap").alias("longest_gap_days"))


def coverage_window(captures: DataFrame, attempts: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Per company: how much of its history is covered. attempts (company_id, attempted_at) are days on which a capture was tried."""
    rows = captures if as_of is None else captures.filter(F.col("captured_at") <= as_of)
    span = rows.groupBy("company_id").agg(F.min("captured_at").alias("first_capture_at"), F.max("captured_at").alias("last_capture_at"))
    days = rows.select("company_id", F.to_date("captured_at").alias("day"), is_complete().cast("int").alias("complete"))
    if attempts is not None:
        tried = attempts.join(span, "company_id").filter(F.col("attempted_at").between(F.col("first_capture_at"), F.col("last_capture_at")))
        days = days.unionByName(tried.select("company_id", F.to_date("attempted_at").alias("day"), F.lit(0).alias("complete")))
    days = days.groupBy("company_id", "day").agg(F.max("complete").alias("complete"))
    found = days.groupBy("company_id").agg(F.count("*").alias("attempted_days"), F.sum("complete").alias("complete_capture_days"))
    calendar = F.datediff("last_capture_at", "first_capture_at") + 1
    return found.join(span, "company_id").select(
        "company_id", "first_capture_at", "last_capture_at", days_between("last_capture_at", "first_capture_at").alias("history_days"), calendar.cast("long").alias("calendar_days"), "attempted_days", "complete_capture_days",
        ratio("complete_capture_days", "attempted_days").alias("history_coverage"), ratio("complete_capture_days", calendar).alias("calendar_coverage"), (calendar - F.col("attempted_days")).cast("long").alias("never_attempted_days"),
    )


def open_trend(captures: DataFrame, listings: DataFrame) -> DataFrame:
    """Per company: the least-squares slope of open jobs over days, from complete captures. flat if it makes less than one job over the span; null slopes are unknown, not flat."""
    counts = listings.groupBy("snapshot_id").agg(F.countDistinct("job_id").alias("open"))
    rows = captures.filter(is_complete()).join(counts, "snapshot_id", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    w = Window.partitionBy("company_id")
    rows = rows.withColumn("x", days_between("captured_at", F.min("captured_at").over(w)))
    order = F.struct("captured_at", "snapshot_id")
    out = rows.groupBy("company_id").agg(F.count("*").alias("points"), F.min_by("open", order).alias("open_first"), F.max_by("open", order).alias("open_last"), F.regr_slope(F.col("open").cast("double"), F.col("x")).alias("slope_per_day"), F.max("x").alias("span"))
    direction = F.when(F.abs(F.col("slope_per_day") * F.col("span")) < 1.0, "flat").when(F.col("slope_per_day") > 0, "up").when(F.col("slope_per_day") <= 0, "down")
    return out.withColumn("direction", direction).drop("span")


def company_features(intervals: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """Per company: closures in 30 and 90 days, the range of the median lifetime, and how many closed jobs were reposted. links: company_id, old_job_id."""
    linked = links.select("company_id", F.col("old_job_id").alias("job_id"), F.lit(1).alias("linked")).distinct()
    rows = intervals.join(linked, ["company_id", "job_id"], "left").withColumn("age", days_between(now, "first_seen_absent"))
    closed = F.col("first_seen_absent").isNotNull()
    return rows.groupBy("company_id").agg(
        F.count_if(closed).alias("closed_count"),
        F.count_if(~closed).alias("right_censored_count"),
        F.count_if(closed & F.col("age").between(0, 30)).alias("closures_last_30_days"),
        F.count_if(closed & F.col("age").between(0, 90)).alias("closures_last_90_days"),
        F.median(F.when(closed, days_between("last_seen_open", "first_observed"))).alias("median_lifetime_low"),
        F.median(F.when(closed, days_between("first_seen_absent", "first_observed"))).alias("median_lifetime_high"),
        F.count_if(closed & (F.col("linked") == 1)).alias("reposted_count"),
    ).withColumn("repost_rate", ratio("reposted_count", "closed_count"))


def in_days(when: str, now: Column, days: int) -> Column:
    """Whether a time lies in the days up to now, both ends included."""
    return F.coalesce(F.col(when).between(now - F.expr(f"interval {int(days)} days"), now), F.lit(False))


def scoped(intervals: DataFrame, now: Column, whole: bool) -> DataFrame:
    """The jobs seen by now with their team_key: those with a team, or (whole) all jobs of a company, which a question without a team asks for (team_key is null)."""
    rows = intervals.filter(F.col("first_observed") <= now)
    return rows.withColumn("team_key", F.lit(None).cast("string")) if whole else rows.withColumn("team_key", team_key("team")).filter("team_key is not null")


def team_activity(intervals: DataFrame, now: Column, new_days: int = 30, closure_days: int = 60, whole: bool = False) -> DataFrame:
    """Per company and team (or whole company), as of now: open, new and closed jobs, and how many are known from archives only."""
    end = F.col("first_seen_absent")
    return scoped(intervals, now, whole).groupBy("company_id", "team_key").agg(
        F.count("*").alias("jobs"),
        F.count_if(end.isNull() | (end > now)).alias("open_jobs"),
        F.count_if(in_days("first_observed", now, new_days)).alias("new_jobs"),
        F.count_if(in_days("first_seen_absent", now, closure_days)).alias("closed_jobs"),
        F.count_if(~F.array_contains("sources", "own")).alias("archive_only_jobs"),
        F.max("first_observed").alias("latest_new_at"),
    )


def team_events(intervals: DataFrame, now: Column, new_days: int = 30, closure_days: int = 60, whole: bool = False, most: int = 20) -> DataFrame:
    """The newest `most` new and closed jobs per company and team, newest first and then by job: company_id, team_key, kind, place, job_id, title, at, archive_only, and total, how many of the kind there are in all."""
    rows = scoped(intervals, now, whole)
    kinds = []
    for kind, when, days in (("new", "first_observed", new_days), ("closed", "first_seen_absent", closure_days)):
        kinds.append(rows.filter(in_days(when, now, days)).select("company_id", "team_key", F.lit(kind).alias("kind"), "job_id", "title", F.col(when).alias("at"), (~F.array_contains("sources", "own")).alias("archive_only")))
    w = Window.partitionBy("company_id", "team_key", "kind").orderBy(F.desc("at"), "job_id")
    rows = kinds[0].unionByName(kinds[1])
    totals = rows.groupBy(F.col("company_id").alias("__c"), F.col("team_key").alias("__t"), F.col("kind").alias("__k")).agg(F.count(F.lit(1)).alias("total"))
    rows = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    same = (F.col("company_id") == F.col("__c")) & F.col("team_key").eqNullSafe(F.col("__t")) & (F.col("kind") == F.col("__k"))
    return rows.join(totals, same).drop("__c", "__t", "__k")


def team_verdict(minimum_new: int = 1, minimum_closed: int = 1, bar: float = 0.5, min_history_days: float = 30.0) -> Column:
    """Whether a team is active, over new_jobs, closed_jobs, history_days and history_coverage: new or closed jobs say true, whatever is covered; none of either says false only where history and coverage suffice to have seen them; else null (unknown)."""
    new, closed = F.coalesce("new_jobs", F.lit(0)), F.coalesce("closed_jobs", F.lit(0))
    seen = (F.coalesce("history_days", F.lit(0.0)) >= min_history_days) & (F.coalesce("history_coverage", F.lit(0.0)) >= bar)
    return F.when((new >= minimum_new) | (closed >= minimum_closed), True).when((new == 0) & (closed == 0) & seen, False)


def repost_pattern(rows: DataFrame, min_history_days: float = 30.0, title_min: float = 0.85, description_min: float = 0.80) -> DataFrame:
    """rows (history_days, first_seen_absent, linked, title_score, description_score) with repost_pattern: unknown on thin history or without hashes, never none."""
    same = (F.col("description_score") >= description_min) & (F.coalesce("title_score", F.lit(0.0)) >= title_min)
    pattern = (
        F.when(F.coalesce("history_days", F.lit(0.0)) < min_history_days, "unknown")
        .when(F.col("first_seen_absent").isNull(), "none")
        .when(~F.coalesce("linked", F.lit(False)), "none")
        .when(F.col("description_score").isNull(), "unknown")
        .when(same, "repeated_unchanged")
        .otherwise("changed")
    )
    return rows.withColumn("repost_pattern", pattern)


def posting_features(intervals: DataFrame, published: DataFrame, archived: DataFrame, now: Column, long_lived_days: int = 180) -> DataFrame:
    """Age from the earliest of its three origins (stated publication, earliest archive capture, sighting), whether it is long-lived, and its censoring: interval if it was seen absent and never again, right if it was ever seen open, else null.

    published: company_id, job_id, published_at. archived: company_id, job_id, captured_at of archive captures that list the job.
    """
    first = published.groupBy("company_id", "job_id").agg(F.min("published_at").alias("published_at"))
    early = archived.groupBy("company_id", "job_id").agg(F.min("captured_at").alias("archived_at"))
    rows = intervals.join(first, ["company_id", "job_id"], "left").join(early, ["company_id", "job_id"], "left")
    rows = rows.withColumn("origin", F.least("published_at", "archived_at", "first_observed")).withColumn("age_days", days_between(now, "origin"))
    censoring = F.when(F.col("first_seen_absent").isNotNull() & F.col("reappeared_at").isNull(), "interval").when(F.col("last_seen_open").isNotNull(), "right")
    return rows.select("company_id", "job_id", "origin", "age_days", (F.col("age_days") >= long_lived_days).alias("long_lived"), censoring.alias("censoring"))


def dominant_title(rows: DataFrame, key: list[str], title: Column, limit: float = 0.60, least: int = 3) -> DataFrame:
    """Per key: the share of the commonest title, and whether the page is degenerate."""
    counts = rows.withColumn("t", title).groupBy(*key, "t").agg(F.count("*").alias("n"))
    out = counts.groupBy(*key).agg(F.sum("n").alias("jobs"), F.max("n").alias("most"))
    share = ratio("most", "jobs")
    return out.withColumn("dominant_fraction", share).withColumn("degenerate", (share > limit) & (F.col("jobs") >= least)).drop("most")


def mode_by(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The commonest value per key; of equally common ones the smallest."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))
