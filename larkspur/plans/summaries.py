"""Queries over the summaries and claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import features, summaries
from larkspur.plans.evaluation import DUCK as RUN_DUCK
from larkspur.plans.evaluation import PAIRS, pairs_of, part
from larkspur.plans.fixtures import INTERVALS_SQL, capture_ctes, captures
from larkspur.plans.history import NOW_SQL, jobs_of, now, r6

DUCK = capture_ctes("duck")


def earliest_own(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.earliest_own(captures(spark, sf))


def capture_batches(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.batches(captures(spark, sf))


def windows_of(spark: SparkSession, sf: str) -> DataFrame:
    return captures(spark, sf).filter("snapshot_id % 5 = 0").select(F.col("captured_at").alias("started_at"), F.expr("captured_at + make_dt_interval(cast(snapshot_id % 2 as int), 5)").alias("finished_at")).distinct()


def uncovered_batches(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.uncovered_batches(captures(spark, sf), windows_of(spark, sf))


def fallback_windows(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.fallback_windows(captures(spark, sf), windows_of(spark, sf), F.lit("2024-01-20").cast("timestamp"), 30)


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.run_summary(part(spark, sf, "run")).select("system", "status", "action", "runs", r6("share"))


def completed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.completed(part(spark, sf, "run")).groupBy("system").agg(F.count("*").alias("runs"))


def sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = part(spark, sf, "run").select((F.col("case_id") % 700).alias("posting_id"), "company_id", "replay_at", F.expr("CASE company_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' WHEN 2 THEN 'dev' END").alias("split"))
    return summaries.sample_sizes(rows)


def scored_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs_of(spark, sf).withColumn("posting_id", F.col("case_id") % 700).withColumn("company_id", F.col("case_id") % 31)
    return summaries.scored_sample(rows, ["A", "B", "R"])


def event_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.event_coverage(part(spark, sf, "run").select("company_id"), part(spark, sf, "event").filter("event_type in ('layoff', 'hiring_freeze') and company_id % 3 <> 0"))


def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = summaries.spread(features.coverage_window(captures(spark, sf)), "history_coverage")
    return out.select("known", *[r6(c) for c in ("least", "median", "most", "mean")])


def links_of(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs linked to those with the next numbers: what a matcher would have stored."""
    rows = jobs_of(spark, sf)
    ends = rows.filter("first_seen_absent is not null").select("company_id", F.col("job_id").alias("old_job_id"), F.explode(F.array(F.col("job_id") + 10, F.col("job_id") + 20)).alias("new_job_id"))
    there = rows.select("company_id", F.col("job_id").alias("new_job_id"))
    return ends.join(there, ["company_id", "new_job_id"]).withColumn("combined", (F.col("new_job_id") % 7) / 10.0).withColumn("gap_days", (F.col("new_job_id") % 11).cast("double"))


LINKS_SQL = f"{INTERVALS_SQL}, lk AS (SELECT o.company_id, o.job_id AS old_job_id, n.job_id AS new_job_id, (n.job_id % 7) / 10.0 AS combined, CAST(n.job_id % 11 AS DOUBLE) AS gap_days, o.first_seen_absent AS gone_at, n.first_observed AS new_at FROM intervals o JOIN intervals n ON n.company_id = o.company_id AND n.job_id IN (o.job_id + 10, o.job_id + 20) WHERE o.first_seen_absent IS NOT NULL)"


def repost_summary(spark: SparkSession, sf: str) -> DataFrame:
    links = links_of(spark, sf).filter("new_job_id = old_job_id + 10")
    return summaries.repost_summary(jobs_of(spark, sf), links).select("company_id", "closed", "reposted", r6("median_gap_days"), r6("repost_rate"))


def visible_links(spark: SparkSession, sf: str) -> DataFrame:
    moment = F.lit("2024-01-20").cast("timestamp")
    return summaries.visible_links(links_of(spark, sf), jobs_of(spark, sf), moment).select("company_id", "old_job_id", "new_job_id", "winner")


def lifecycles_as_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = summaries.as_seen(jobs_of(spark, sf), F.lit("2024-01-16").cast("timestamp"))
    return rows.select("company_id", "job_id", "first_observed", "last_seen_open", "first_seen_absent", "reappeared_at")


def latest_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = summaries.latest_share(part(spark, sf, "run").select("run_id", "started_at"), "started_at", 0.2)
    return rows.select("run_id", "is_test")


QUERIES = {
    f.__name__: f
    for f in (
        earliest_own, capture_batches, uncovered_batches, fallback_windows, run_summary, completed_runs, sample_sizes, scored_sample, event_coverage, coverage_summary, repost_summary, visible_links, lifecycles_as_seen, latest_share,
    )
}

WIN = "w AS (SELECT captured_at AS a, captured_at + to_days(CAST(snapshot_id % 2 AS INT)) + INTERVAL 5 HOUR AS b FROM snap WHERE snapshot_id % 5 = 0), ba AS (SELECT captured_at, count(DISTINCT company_id) AS companies FROM snap WHERE source = 'own' GROUP BY ALL), un AS (SELECT * FROM ba WHERE NOT EXISTS (SELECT 1 FROM w WHERE captured_at BETWEEN a AND b))"
ORACLE_SQL = {
    "earliest_own": f"WITH {DUCK} SELECT min(captured_at) AS earliest_own_at FROM snap WHERE source = 'own'",
    "capture_batches": f"WITH {DUCK} SELECT captured_at, count(DISTINCT company_id) AS companies FROM snap WHERE source = 'own' GROUP BY ALL",
    "uncovered_batches": f"WITH {DUCK}, {WIN} SELECT * FROM un",
    "fallback_windows": f"WITH {DUCK}, {WIN}, nx AS (SELECT captured_at, lead(captured_at) OVER (ORDER BY captured_at) AS n FROM ba) SELECT captured_at AS started_at, least(coalesce(n, captured_at + INTERVAL 30 HOUR), captured_at + INTERVAL 30 HOUR) AS finished_at FROM un JOIN nx USING (captured_at) WHERE captured_at < TIMESTAMP '2024-01-20'",
    "run_summary": f"WITH {RUN_DUCK}, g AS (SELECT system, status, CASE WHEN status = 'completed' THEN action END AS action, count(*) AS runs FROM run GROUP BY ALL) SELECT *, round(runs / sum(runs) OVER (PARTITION BY system), 6) AS share FROM g",
    "completed_runs": f"WITH {RUN_DUCK} SELECT system, count(*) AS runs FROM run WHERE status = 'completed' GROUP BY ALL",
    "sample_sizes": f"WITH {RUN_DUCK} SELECT CASE company_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' WHEN 2 THEN 'dev' ELSE 'unassigned' END AS split, count(*) AS cases, count(DISTINCT case_id % 700) AS postings, count(DISTINCT company_id) AS companies FROM run GROUP BY ALL",
    "scored_sample": f'WITH {PAIRS} SELECT count(*) AS cases, count(DISTINCT case_id % 700) AS postings, count(DISTINCT case_id % 31) AS companies FROM par WHERE "A" IS NOT NULL AND "B" IS NOT NULL AND "R" IS NOT NULL',
    "event_coverage": f"WITH {RUN_DUCK}, c AS (SELECT DISTINCT company_id FROM run), e AS (SELECT company_id, count(*) AS n FROM event WHERE event_type IN ('layoff', 'hiring_freeze') AND company_id % 3 <> 0 GROUP BY ALL) SELECT count(*) AS companies, count(n) AS with_events, CAST(coalesce(sum(n), 0) AS BIGINT) AS events FROM c LEFT JOIN e USING (company_id)",
    "coverage_summary": f"WITH {DUCK}, c AS (SELECT count(DISTINCT d) FILTER (coverage_status = 'complete') / count(DISTINCT d) AS v FROM snap GROUP BY company_id) SELECT count(v) AS known, round(min(v), 6) AS least, round(median(v), 6) AS median, round(max(v), 6) AS most, round(avg(v), 6) AS mean FROM c",
    "repost_summary": f"WITH {LINKS_SQL} SELECT i.company_id, count(*) AS closed, count(lk.gap_days) AS reposted, round(median(lk.gap_days), 6) AS median_gap_days, round(count(lk.gap_days) / count(*), 6) AS repost_rate FROM intervals i LEFT JOIN lk ON lk.company_id = i.company_id AND lk.old_job_id = i.job_id AND lk.new_job_id = lk.old_job_id + 10 WHERE i.first_seen_absent IS NOT NULL GROUP BY i.company_id",
    "visible_links": f"WITH {LINKS_SQL}, s AS (SELECT * FROM lk WHERE gone_at <= TIMESTAMP '2024-01-20' AND new_at <= TIMESTAMP '2024-01-20') SELECT company_id, old_job_id, new_job_id, row_number() OVER (PARTITION BY company_id, old_job_id ORDER BY combined DESC, new_job_id) = 1 AS winner FROM s",
    "lifecycles_as_seen": f"WITH {INTERVALS_SQL} SELECT company_id, job_id, first_observed, least(last_seen_open, TIMESTAMP '2024-01-16') AS last_seen_open, CASE WHEN first_seen_absent <= TIMESTAMP '2024-01-16' THEN first_seen_absent END AS first_seen_absent, CASE WHEN reappeared_at <= TIMESTAMP '2024-01-16' THEN reappeared_at END AS reappeared_at FROM intervals WHERE first_observed <= TIMESTAMP '2024-01-16'",
    "latest_share": f"WITH {RUN_DUCK} SELECT run_id, epoch_us(started_at) > (SELECT quantile_cont(epoch_us(started_at), 0.8) FROM run) AS is_test FROM run",
}
