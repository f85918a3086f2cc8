"""Summaries of runs, datasets and the corpus: a few rows each, from aggregates that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import days_between, ratio
from larkspur.operators.running import quantile
from larkspur.session import written


def earliest_own(captures: DataFrame) -> DataFrame:
    """One row: the first own capture of any company."""
    return captures.filter("source = 'own'").agg(F.min("captured_at").alias("earliest_own_at"))


def batches(captures: DataFrame) -> DataFrame:
    """Own captures of one stamp are one batch: captured_at, companies."""
    return captures.filter("source = 'own'").groupBy("captured_at").agg(F.countDistinct("company_id").alias("companies"))


def uncovered_batches(captures: DataFrame, windows: DataFrame) -> DataFrame:
    """Batches that lie in no recorded window (started_at, finished_at), both ends included. Windows stand on the days that they touch, so nothing is broadcast."""
    day = F.lit(86_400_000_000)
    days = F.explode(F.sequence(F.floor(F.unix_micros("started_at") / day), F.floor(F.unix_micros("finished_at") / day)))
    held = windows.filter("finished_at >= started_at").select("started_at", "finished_at", days.alias("__day"))
    own = batches(captures).withColumn("__day", F.floor(F.unix_micros("captured_at") / day))
    inside = own.join(held, "__day").filter(F.col("captured_at").between(F.col("started_at"), F.col("finished_at"))).select("captured_at")
    return own.join(inside, "captured_at", "left_anti").drop("__day")


def fallback_windows(captures: DataFrame, windows: DataFrame, before: Column | None = None, most_hours: int = 24) -> DataFrame:
    """Windows for the uncovered batches before a cut-off: started_at, finished_at. Each runs from its batch to the next own batch of any company, as the run can't have lasted beyond that, and most_hours at most."""
    rows = uncovered_batches(captures, windows)
    rows = rows if before is None else rows.filter(F.col("captured_at") < before)
    hours, day = F.expr(f"interval {int(most_hours)} hours"), F.lit(86_400_000_000)
    span = lambda c: F.floor(F.unix_micros(c) / day)
    # the next batch lies in one of the days that the longest window touches, so no task sorts all batches
    starts = rows.select(F.col("captured_at").alias("started_at"), (F.col("captured_at") + hours).alias("__end"))
    near = starts.withColumn("__day", F.explode(F.sequence(span("started_at"), span("__end"))))
    later = batches(captures).select("captured_at", span("captured_at").alias("__day"))
    following = near.join(later, "__day").filter((F.col("captured_at") > F.col("started_at")) & (F.col("captured_at") < F.col("__end"))).groupBy("started_at").agg(F.min("captured_at").alias("__next"))
    return starts.join(following, "started_at", "left").select("started_at", F.coalesce("__next", "__end").alias("finished_at"))


def run_summary(runs: DataFrame) -> DataFrame:
    """system, status, action, runs and their share of the system's runs."""
    total = runs.groupBy("system").agg(F.count("*").alias("__n"))
    out = runs.groupBy("system", "status", F.when(F.col("status") == "completed", F.col("action")).alias("action")).agg(F.count("*").alias("runs"))
    return out.join(total, "system").withColumn("share", ratio("runs", "__n")).drop("__n")


def completed(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'completed'").select("run_id", "system").distinct()


def sample_sizes(cases: DataFrame) -> DataFrame:
    """Per split: cases, postings and companies. cases: posting_id, company_id, replay_at, split; cases without one are unassigned."""
    return cases.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count("*").alias("cases"), F.countDistinct("posting_id").alias("postings"), F.countDistinct("company_id").alias("companies"))


def scored_sample(pairs: DataFrame, systems: list[str]) -> DataFrame:
    """One row: how many cases, postings and companies are scored, that is have an action of every system."""
    rows = pairs
    for s in systems:
        rows = rows.filter(F.col(s).isNotNull())
    return rows.agg(F.count("*").alias("cases"), F.countDistinct("posting_id").alias("postings"), F.countDistinct("company_id").alias("companies"))


def event_coverage(companies: DataFrame, events: DataFrame) -> DataFrame:
    """One row: companies, those with an event, and events."""
    found = events.groupBy("company_id").agg(F.count("*").alias("n"))
    return companies.select("company_id").distinct().join(found, "company_id", "left").agg(F.count("*").alias("companies"), F.count("n").alias("with_events"), F.sum(F.coalesce("n", F.lit(0))).alias("events"))


def spread(rows: DataFrame, value: str, step: float = 0.001) -> DataFrame:
    """One row: companies with a value, and its least, median, greatest and mean. The median is taken from counts by value, in stretches of step."""
    v = F.col(value)
    rows = written(rows.select(value))
    middle = quantile(rows, value, 0.5, F.floor(F.col("value") / F.lit(step)))
    return rows.agg(F.count(v).alias("known"), F.min(v).alias("least"), F.lit(middle).cast("double").alias("median"), F.max(v).alias("most"), F.avg(v).alias("mean"))


def repost_summary(intervals: DataFrame, links: DataFrame) -> DataFrame:
    """Per company: jobs that closed, those linked to a later one, the share, and the median days between them. links: company_id, old_job_id, gap_days."""
    linked = links.select("company_id", F.col("old_job_id").alias("job_id"), "gap_days")
    rows = intervals.filter("first_seen_absent is not null").select("company_id", "job_id").join(linked, ["company_id", "job_id"], "left")
    return rows.groupBy("company_id").agg(F.count("*").alias("closed"), F.count("gap_days").alias("reposted"), F.median("gap_days").alias("median_gap_days")).withColumn("repost_rate", ratio("reposted", "closed"))


def visible_links(links: DataFrame, intervals: DataFrame, moment: Column) -> DataFrame:
    """The links that could be seen at a moment: the old job had been seen absent and the new one listed by then. The best of each old job is its winner: the highest score, then the smaller new job."""
    old = intervals.filter(F.col("first_seen_absent") <= moment).select("company_id", F.col("job_id").alias("old_job_id"))
    new = intervals.filter(F.col("first_observed") <= moment).select("company_id", F.col("job_id").alias("new_job_id"))
    seen = links.join(old, ["company_id", "old_job_id"], "left_semi").join(new, ["company_id", "new_job_id"], "left_semi")
    best = seen.groupBy("company_id", "old_job_id").agg(F.min(F.struct((-F.col("combined")).alias("s"), F.col("new_job_id").alias("w"))).alias("__b"))
    return seen.join(best, ["company_id", "old_job_id"]).withColumn("winner", F.col("new_job_id") == F.col("__b.w")).drop("__b")


def as_seen(intervals: DataFrame, moment: Column) -> DataFrame:
    """Lifecycles with what had not happened by a moment taken back, without reading captures again; jobs that weren't seen yet go."""
    by = lambda c: F.when(F.col(c) <= moment, F.col(c)).alias(c)
    known = ("first_seen_absent", "reappeared_at", "closure_absent_at")
    rows = intervals.filter(F.col("first_observed") <= moment)
    return rows.select(*[by(c) if c in known else F.least(F.col(c), moment).alias(c) if c == "last_seen_open" else F.col(c) for c in rows.columns])


def latest_share(rows: DataFrame, stamp: str, share: float) -> DataFrame:
    """rows with is_test: whether they belong to the latest share of all by time, cut at a quantile of the whole; equal times stay together, rows without a time have none."""
    rows = written(rows)
    cut = quantile(rows.select(F.unix_micros(stamp).alias("t")), "t", 1 - share, F.floor(F.col("value") / F.lit(86_400_000_000)))
    return rows.withColumn("is_test", F.unix_micros(stamp) > F.lit(cut).cast("double"))


def age_at(intervals: DataFrame, moment: Column) -> DataFrame:
    """company_id, job_id and age in days at a moment of the jobs seen by then; a first sighting after it is none."""
    first = F.when(F.col("first_observed") <= moment, F.col("first_observed"))
    return intervals.select("company_id", "job_id", days_between(moment, first).alias("age_days"))
