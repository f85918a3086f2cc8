"""Queries over captures and listings: lifecycles, coverage, features, repost links, changes and survival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalars import days_between, normalized_text
from larkspur.operators import asof, changes, corpus, features, intervals_join, lifecycle, matching, metrics, splits, survival
from larkspur.plans.fixtures import INTERVALS_SQL, capture_ctes, captures, listings

def now():
    return F.lit("2024-02-01").cast("timestamp")


NOW_SQL = "TIMESTAMP '2024-02-01'"
DUCK = capture_ctes("duck")


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def jobs_of(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.intervals(captures(spark, sf), listings(spark, sf))


def lifecycle_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs_of(spark, sf)
    return rows.select("company_id", "job_id", "first_observed", "last_seen_open", "first_seen_absent", "reappeared_at", "closure_absent_at", "title", "team", "location", "censoring", r6("gap_days"), F.array_join("sources", ",").alias("sources"), F.col("capture_count").cast("long").alias("capture_count"), F.array_join(F.transform("present_snapshot_ids", lambda x: x.cast("string")), ",").alias("snapshots"))


def lifecycle_companies(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.companies_with_captures(captures(spark, sf))


def lifecycle_archive_only(spark: SparkSession, sf: str) -> DataFrame:
    return jobs_of(spark, sf).groupBy("company_id").agg(F.count_if(lifecycle.archive_only()).alias("archive_only"), F.count("*").alias("jobs"))


def lifecycle_merge(spark: SparkSession, sf: str) -> DataFrame:
    stored = lifecycle.intervals(captures(spark, sf).filter("source = 'own'"), listings(spark, sf))
    rows = lifecycle.merged(stored, jobs_of(spark, sf))
    return rows.groupBy("change").agg(F.count("*").alias("n"), F.min("first_observed").alias("first"), F.max("last_seen_open").alias("last"), F.count("first_seen_absent").alias("absent"), F.count("reappeared_at").alias("reappeared"))


DAY = "TIMESTAMP '2024-01-15'"


def lifecycle_daily(spark: SparkSession, sf: str) -> DataFrame:
    snap = captures(spark, sf)
    day = F.lit("2024-01-15").cast("timestamp")
    known = lifecycle.intervals(asof.as_of(snap, "captured_at", day - F.expr("interval 1 day")), listings(spark, sf))
    today = snap.filter((F.col("captured_at") == day) & lifecycle.is_complete())
    covered = today.select("company_id").distinct()
    listed = today.join(listings(spark, sf), "snapshot_id")
    rows = lifecycle.daily_transition(known.join(covered, "company_id", "left_semi").select("company_id", "job_id", "first_observed", "last_seen_open", "first_seen_absent", "reappeared_at"), listed, day)
    return rows.select("company_id", "job_id", "change", "first_seen_absent", "reappeared_at")


def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return features.capture_gaps(captures(spark, sf)).select("company_id", F.col("captures").alias("captures"), "first_capture_at", "last_capture_at", r6("median_gap_days"), r6("longest_gap_days"))


def coverage_window(spark: SparkSession, sf: str) -> DataFrame:
    snap = captures(spark, sf)
    tried = snap.filter("coverage_status = 'gap'").select("company_id", (F.col("captured_at") + F.expr("interval 1 day")).alias("attempted_at"))
    return features.coverage_window(snap.filter("coverage_status <> 'gap'"), tried).select("company_id", "first_capture_at", "last_capture_at", r6("history_days"), "calendar_days", "attempted_days", "complete_capture_days", r6("history_coverage"), r6("calendar_coverage"), "never_attempted_days")


def open_trend(spark: SparkSession, sf: str) -> DataFrame:
    return features.open_trend(captures(spark, sf), listings(spark, sf)).select("company_id", "points", "open_first", "open_last", r6("slope_per_day"), "direction")


def team_activity(spark: SparkSession, sf: str) -> DataFrame:
    return features.team_activity(jobs_of(spark, sf), now())


def company_activity(spark: SparkSession, sf: str) -> DataFrame:
    """What a question without a team asks for: all jobs of a company."""
    return features.team_activity(jobs_of(spark, sf), now(), whole=True).drop("team_key", "latest_new_at")


def team_events(spark: SparkSession, sf: str) -> DataFrame:
    return features.team_events(jobs_of(spark, sf), now(), most=3).select("company_id", "team_key", "kind", "place", "job_id", "at", "archive_only")


def team_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each team is active, where every third company is hardly covered. New and closed jobs count within few days, so that there are teams without."""
    covered = features.coverage_window(captures(spark, sf)).select("company_id", "history_days", F.when(F.col("company_id") % 3 == 0, 0.4).otherwise(F.col("history_coverage")).alias("history_coverage"))
    rows = features.team_activity(jobs_of(spark, sf), now(), 15, 4).join(covered, "company_id")
    return rows.select("company_id", "team_key", features.team_verdict(min_history_days=20.0).alias("verdict"))


def title_mode(spark: SparkSession, sf: str) -> DataFrame:
    return features.mode_by(jobs_of(spark, sf), ["company_id"], "title")


def degenerate_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.dominant_title(listings(spark, sf), ["snapshot_id"], normalized_text("title"), limit=0.2)
    return rows.select("snapshot_id", "jobs", r6("dominant_fraction"), "degenerate")


def gated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return matching.gated_pairs(jobs_of(spark, sf)).select("company_id", "old_job_id", "new_job_id", r6("gap_days"))


def equal_title_links(spark: SparkSession, sf: str) -> DataFrame:
    """Scores where each text either equals the other or isn't known: what SQL can express of the scoring."""
    rows = matching.gated_pairs(jobs_of(spark, sf))
    for c in ("title", "team", "location"):
        rows = rows.withColumn(f"{c}_score", F.when(F.col(f"old_{c}").isNotNull() & F.col(f"new_{c}").isNotNull(), (F.col(f"old_{c}") == F.col(f"new_{c}")).cast("double")))
    rows = rows.withColumn("description_score", F.when(F.col("old_job_id") % 4 != 0, (F.col("old_description_hash") == F.col("new_description_hash")).cast("double")))
    return matching.combined(rows).select("company_id", "old_job_id", "new_job_id", r6("combined"), "title_only", "corroborated", "passes")


def top_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The best 200 of all pairs, passing or not, from what each company retains."""
    return matching.ranked(matching.retained(equal_title_links(spark, sf), 200), 200).select("company_id", "old_job_id", "new_job_id", "combined", "passes")


def page_date_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The newest postings that the last captures of their companies listed and whose pages are still to be read."""
    last = captures(spark, sf).groupBy("company_id").agg(F.max("captured_at").alias("captured_at"))
    rows = jobs_of(spark, sf).select(F.col("job_id").alias("posting_id"), "company_id", F.expr("CASE WHEN job_id % 3 <> 0 THEN 'lever' ELSE 'ashby' END AS ats"), F.expr("CASE WHEN job_id % 8 = 5 THEN replace(url, 'https', 'http') ELSE url END AS url"), "first_observed", "last_seen_open")
    tried = rows.filter("posting_id % 4 <> 2").selectExpr("posting_id", "CASE WHEN posting_id % 4 = 0 THEN 'ok' ELSE 'failed' END AS status", "cast(posting_id % 5 as int) AS attempts")
    # every company's last capture is its listing's last day at the latest: that of the last listed day counts too
    seen = rows.groupBy("company_id").agg(F.max("last_seen_open").alias("captured_at"))
    return corpus.page_date_candidates(rows, last.unionByName(seen), tried, 100)


def repost_links(spark: SparkSession, sf: str) -> DataFrame:
    return matching.repost_links(jobs_of(spark, sf)).select("company_id", "old_job_id", "new_job_id", r6("combined"), r6("gap_days"), r6("title_score"))


def links_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with an equal title, assigned one to one by a score that makes ties: exercises the assignment."""
    rows = matching.gated_pairs(jobs_of(spark, sf)).filter("old_title = new_title")
    return matching.assigned(rows.select("company_id", "old_job_id", "new_job_id", (F.lit(1.0) / (1 + F.floor(F.abs("gap_days") / 5))).alias("score")), ["company_id"], "old_job_id", "new_job_id", "score").select("company_id", "old_job_id", "new_job_id", r6("score"))


def company_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs_of(spark, sf)
    links = rows.filter("job_id % 4 = 1").select("company_id", F.col("job_id").alias("old_job_id"))
    out = features.company_features(rows, links, now())
    return out.select("company_id", "closed_count", "right_censored_count", "closures_last_30_days", "closures_last_90_days", r6("median_lifetime_low"), r6("median_lifetime_high"), "reposted_count", r6("repost_rate"))


def posting_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs_of(spark, sf)
    published = rows.select("company_id", "job_id", F.expr("first_observed - make_dt_interval(cast(job_id % 300 as int))").alias("published_at")).filter("job_id % 2 = 0")
    archived = captures(spark, sf).filter("source = 'archive'").join(listings(spark, sf), "snapshot_id").select("company_id", "job_id", F.expr("captured_at - make_dt_interval(cast(job_id % 3 * 90 as int))").alias("captured_at"))
    return features.posting_features(rows, published, archived, now()).select("company_id", "job_id", "origin", r6("age_days"), "long_lived", "censoring")


def repost_patterns(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs_of(spark, sf).withColumn("history_days", F.when(F.col("company_id") == 3, 10.0).otherwise(40.0)).withColumn("linked", F.col("job_id") % 3 == 0)
    rows = rows.withColumn("title_score", F.when(F.col("job_id") % 2 == 0, 0.9).otherwise(0.5)).withColumn("description_score", F.when(F.col("job_id") % 5 != 0, (F.col("job_id") % 7 != 0).cast("double")))
    return features.repost_pattern(rows).groupBy("company_id", "repost_pattern").agg(F.count("*").alias("n"))


def hash_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = versions(spark, sf)
    return changes.changes(rows, ["job_id"], ["captured_at", "snapshot_id"], "value", "captured_at").select("job_id", "changed_after", "changed_by", "old", "new")


def versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).join(captures(spark, sf), "snapshot_id")
    return rows.select("job_id", "company_id", "snapshot_id", "captured_at", F.when(F.col("snapshot_id") % 4 != 1, F.floor((F.col("snapshot_id") % 100000) / (F.col("job_id") % 5 + 3))).alias("value"))


VERSIONS_SQL = f"{DUCK}, vers AS (SELECT j.job_id, s.company_id, s.snapshot_id, s.captured_at, CASE WHEN s.snapshot_id % 4 <> 1 THEN CAST(floor((s.snapshot_id % 100000) / (j.job_id % 5 + 3)) AS BIGINT) END AS value FROM job j JOIN snap s USING (snapshot_id))"


def carried_values(spark: SparkSession, sf: str) -> DataFrame:
    return changes.carried(versions(spark, sf), ["job_id"], ["captured_at", "snapshot_id"], "value", "captured_at")


def matched_refreshes(spark: SparkSession, sf: str) -> DataFrame:
    rows = versions(spark, sf)
    found = changes.changes(rows, ["job_id"], ["captured_at", "snapshot_id"], "value", "captured_at")
    stamps = rows.filter("snapshot_id % 5 = 0").select("job_id", F.expr("captured_at + interval 36 hours").alias("stated_at"))
    return changes.refreshes(stamps, found, ["job_id"], 1)


def survival_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = survival.kaplan_meier(survival.durations(jobs_of(spark, sf)))
    return curve.select(r6("time"), "at_risk", "events", r6("survival"), r6("ci_low"), r6("ci_high"))


def survival_horizons(spark: SparkSession, sf: str) -> DataFrame:
    out = survival.behaviour(survival.durations(jobs_of(spark, sf)), [7, 14, 30, 60, 90])
    return out.select(r6("median_days"), *[r6(f"s{h}") for h in (7, 14, 30, 60, 90)])


def survival_turnbull(spark: SparkSession, sf: str) -> DataFrame:
    left, right, mass = survival.turnbull(survival.durations(jobs_of(spark, sf)))
    rows = [(float(a), None if b == float("inf") else float(b), round(float(m), 6)) for a, b, m in zip(left, right, mass, strict=True)]
    return spark.createDataFrame(rows, "low double, high double, mass double")


def survival_sample(spark: SparkSession, sf: str) -> DataFrame:
    return survival.durations(jobs_of(spark, sf)).groupBy("dropped", "event").agg(F.count("*").alias("n"))


def windows_of(spark: SparkSession, sf: str) -> DataFrame:
    return captures(spark, sf).filter("snapshot_id % 3 <> 0").select("company_id", F.col("captured_at").alias("started_at"), F.expr("captured_at + make_dt_interval(0, cast(snapshot_id % 7 * 6 as int))").alias("finished_at"))


WINDOWS_SQL = f"{DUCK}, win AS (SELECT company_id, captured_at AS started_at, captured_at + to_hours(CAST(snapshot_id % 7 * 6 AS INT)) AS finished_at FROM snap WHERE snapshot_id % 3 <> 0)"


def windows_merged(spark: SparkSession, sf: str) -> DataFrame:
    return intervals_join.merged_windows(windows_of(spark, sf), ["company_id"])


def moments_shifted(spark: SparkSession, sf: str) -> DataFrame:
    moments = captures(spark, sf).select("company_id", "snapshot_id", F.expr("captured_at + interval 9 hours").alias("moment"))
    return intervals_join.shifted(moments, windows_of(spark, sf), ["company_id"], "moment").select("company_id", "snapshot_id", "moment", "shifted_at")


def latest_capture(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join: at noon of every fifth day, each company's latest complete capture."""
    snap = captures(spark, sf)
    cases = snap.select("company_id").distinct().withColumn("replay_at", F.explode(F.expr("sequence(timestamp '2024-01-03 12:00:00', timestamp '2024-01-28 12:00:00', interval 5 days)")))
    return asof.latest_at_each(cases, snap.filter(lifecycle.is_complete()), ["company_id"], "captured_at", ["snapshot_id"])


def visible_captures(spark: SparkSession, sf: str) -> DataFrame:
    moment = F.lit("2024-01-12").cast("timestamp")
    return asof.as_of(captures(spark, sf), "captured_at", moment).groupBy("company_id", "coverage_status").agg(F.count("*").alias("n"))


def intervals_as_of(spark: SparkSession, sf: str) -> DataFrame:
    moment = F.lit("2024-01-16").cast("timestamp")
    rows = lifecycle.intervals(asof.as_of(captures(spark, sf), "captured_at", moment), listings(spark, sf))
    return rows.select("company_id", "job_id", "last_seen_open", "first_seen_absent", "censoring")


def case_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = asof.cases(jobs_of(spark, sf), now(), 7)
    return rows.groupBy("company_id", "job_id").agg(F.count("*").alias("cases"), F.min("replay_at").alias("first_case"), F.max("replay_at").alias("last_case"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = asof.round_robin(jobs_of(spark, sf), "company_id", "job_id", 20260607)
    return rows.select("company_id", "job_id", "company_size", F.col("turn").cast("long").alias("turn"))


def company_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs_of(spark, sf)
    return rows.select("company_id", "job_id", asof.stable_split(20260607, "job_id").alias("stable"), asof.temporal_split("first_observed", F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-05").cast("timestamp")).alias("temporal"))


def stable_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Companies and their jobs by the stable hash and by time."""
    rows = jobs_of(spark, sf).select(F.concat_ws("/", "company_id", "job_id").alias("posting_id"), F.col("company_id").cast("string").alias("company_id"), "first_observed")
    return splits.assigned_splits(rows, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-05").cast("timestamp"), 7, method="hash").select("posting_id", "company_split", "temporal_split")


def dataset_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every second job has a frozen split, and some runs have another job than their case."""
    rows = jobs_of(spark, sf).select(F.col("job_id").alias("posting_id"), "company_id", "first_observed", F.col("url").alias("canonical_url"))
    base = rows.filter("posting_id % 5 <> 0").select("posting_id", F.lit("dev").alias("split"))
    cases = rows.filter("posting_id % 2 = 0").select("posting_id", "canonical_url", F.col("first_observed").alias("replay_at"), F.when(F.col("posting_id") % 4 == 0, "test").alias("split"))
    runs = cases.select((F.col("posting_id") + 1).alias("posting_id"), F.col("canonical_url").alias("input_url"), "replay_at").filter("posting_id % 3 = 0")
    rebuilt = rows.filter("posting_id % 7 = 0").select("posting_id", F.lit("validation").alias("split"))
    return splits.dataset_splits(base, cases, runs, rebuilt)


def greedy_splits(spark: SparkSession, sf: str) -> DataFrame:
    return asof.greedy_split(jobs_of(spark, sf).groupBy("company_id").agg(F.count("*").alias("n")), "company_id", "n")


def eras(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs by whether they were first seen before their company's first own capture."""
    first = captures(spark, sf).filter("source = 'own'").groupBy("company_id").agg(F.min("captured_at").alias("boundary"))
    rows = jobs_of(spark, sf).join(first, "company_id", "left").withColumn("era", metrics.era("first_observed", "boundary"))
    return rows.groupBy("company_id", "era").agg(F.count("*").alias("n"), F.round(F.avg(days_between("last_seen_open", "first_observed")), 6).alias("mean_days"))


QUERIES = {
    f.__name__: f
    for f in (
        lifecycle_intervals, lifecycle_companies, lifecycle_archive_only, lifecycle_merge, lifecycle_daily, coverage_gaps, coverage_window, open_trend, team_activity, company_activity, team_events, team_verdicts, title_mode, degenerate_pages, gated_pairs, equal_title_links, repost_links,
        links_in_order, company_features, posting_features, repost_patterns, hash_changes, carried_values, matched_refreshes, survival_curve, survival_horizons, survival_turnbull, survival_sample, windows_merged, moments_shifted, latest_capture, top_candidates, page_date_candidates,
        visible_captures, intervals_as_of, case_grid, turns, company_splits, stable_splits, dataset_splits, greedy_splits, eras,
    )
}

GATED = f"""{INTERVALS_SQL},
pres AS (SELECT company_id, job_id, list(snapshot_id) FILTER (present) AS ids FROM dense GROUP BY ALL),
side AS (SELECT i.*, p.ids FROM intervals i JOIN pres p USING (company_id, job_id) WHERE length(trim(i.title)) >= 3),
gated AS (SELECT o.company_id, o.job_id AS old_job_id, n.job_id AS new_job_id, o.title AS old_title, n.title AS new_title, o.team AS old_team, n.team AS new_team, o.location AS old_location, n.location AS new_location, o.description_hash AS old_hash, n.description_hash AS new_hash,
  (epoch_us(n.first_observed) - epoch_us(o.first_seen_absent)) / 86400e6 AS gap_days
  FROM side o JOIN side n ON o.company_id = n.company_id AND o.job_id <> n.job_id AND n.first_observed > o.last_seen_open
  WHERE o.first_seen_absent IS NOT NULL AND (epoch_us(n.first_observed) - epoch_us(o.first_seen_absent)) / 86400e6 > -7 AND (epoch_us(n.first_observed) - epoch_us(o.first_seen_absent)) / 86400e6 <= 120 AND NOT list_has_any(o.ids, n.ids))"""
LIFE = "(epoch_us({b}) - epoch_us({a})) / 86400e6"
KM = f"""{INTERVALS_SQL},
dur AS (SELECT (epoch_us(last_seen_open) - epoch_us(first_observed)) / 86400e6 AS low, (epoch_us(closure_absent_at) - epoch_us(first_observed)) / 86400e6 AS high FROM intervals),
smp AS (SELECT coalesce(high, low) AS t, high IS NOT NULL AS ev FROM dur WHERE NOT (high IS NULL AND low <= 0)),
cnt AS (SELECT t, count(*) FILTER (ev) AS d, count(*) AS l FROM smp GROUP BY t),
risk AS (SELECT t, d, (SELECT sum(l) FROM cnt c2 WHERE c2.t >= c1.t) AS n FROM cnt c1),
curve AS (SELECT t, d, n, (SELECT product(1 - r2.d / r2.n) FROM risk r2 WHERE r2.t <= r1.t) AS s, (SELECT sum(r2.d / (r2.n * (r2.n - r2.d))) FROM risk r2 WHERE r2.t <= r1.t AND r2.d < r2.n) AS v FROM risk r1)"""

#: The same over captures up to a moment.
AS_OF = INTERVALS_SQL.replace("AS i FROM snap),", "AS i FROM snap WHERE d <= DATE '2024-01-16'),", 1)

BEFORE = AS_OF.replace("2024-01-16", "2024-01-14")

ORACLE_SQL = {
    "lifecycle_daily": f"""WITH {BEFORE}, today AS (SELECT company_id, snapshot_id FROM snap WHERE d = DATE '2024-01-15' AND coverage_status = 'complete'), seen AS (SELECT DISTINCT t.company_id, j.job_id FROM today t JOIN job j USING (snapshot_id)), known AS (SELECT i.* FROM intervals i WHERE company_id IN (SELECT company_id FROM today)),
 b AS (SELECT coalesce(k.company_id, s.company_id) AS company_id, coalesce(k.job_id, s.job_id) AS job_id, k.first_observed AS f, k.first_seen_absent AS a, k.reappeared_at AS r, s.job_id IS NOT NULL AS listed FROM known k FULL JOIN seen s ON s.company_id = k.company_id AND s.job_id = k.job_id),
 c AS (SELECT *, CASE WHEN f IS NULL THEN 'new' WHEN listed AND a IS NOT NULL AND r IS NULL THEN 'reappeared' WHEN listed THEN 'seen' WHEN a IS NULL THEN 'absent' ELSE 'still_absent' END AS change FROM b) SELECT company_id, job_id, change, CASE WHEN change = 'absent' THEN TIMESTAMP '2024-01-15' ELSE a END AS first_seen_absent, CASE WHEN change = 'reappeared' THEN TIMESTAMP '2024-01-15' ELSE r END AS reappeared_at FROM c""",
    "lifecycle_intervals": f"WITH {INTERVALS_SQL}, snaps AS (SELECT company_id, job_id, string_agg(CAST(snapshot_id AS VARCHAR), ',' ORDER BY snapshot_id) AS snapshots FROM dense WHERE present GROUP BY ALL) SELECT company_id, job_id, first_observed, last_seen_open, first_seen_absent, reappeared_at, closure_absent_at, title, team, location, CASE WHEN closure_absent_at IS NULL THEN 'right' ELSE 'interval' END AS censoring, round((epoch_us(closure_absent_at) - epoch_us(last_seen_open)) / 86400e6, 6) AS gap_days, array_to_string(sources, ',') AS sources, capture_count, snapshots FROM intervals JOIN snaps USING (company_id, job_id)",
    "lifecycle_companies": f"WITH {DUCK} SELECT DISTINCT company_id FROM snap",
    "lifecycle_archive_only": f"WITH {INTERVALS_SQL} SELECT company_id, count(*) FILTER (NOT list_contains(sources, 'own')) AS archive_only, count(*) AS jobs FROM intervals GROUP BY company_id",
    "coverage_gaps": f"WITH {DUCK}, g AS (SELECT *, (epoch_us(captured_at) - epoch_us(lag(captured_at) OVER (PARTITION BY company_id ORDER BY captured_at))) / 86400e6 AS gap FROM snap) SELECT company_id, count(*) AS captures, min(captured_at) AS first_capture_at, max(captured_at) AS last_capture_at, round(median(gap), 6) AS median_gap_days, round(max(gap), 6) AS longest_gap_days FROM g GROUP BY company_id",
    "coverage_window": f"""WITH {DUCK}, own AS (SELECT * FROM snap WHERE coverage_status <> 'gap'), span AS (SELECT company_id, min(captured_at) AS a, max(captured_at) AS b FROM own GROUP BY company_id),
 tried AS (SELECT s.company_id, s.captured_at + INTERVAL 1 DAY AS t FROM snap s WHERE coverage_status = 'gap'),
 days AS (SELECT company_id, CAST(captured_at AS DATE) AS day, coverage_status = 'complete' AS full_ FROM own UNION ALL SELECT t.company_id, CAST(t.t AS DATE), false FROM tried t JOIN span USING (company_id) WHERE t.t BETWEEN a AND b),
 per AS (SELECT company_id, count(DISTINCT day) AS attempted_days, count(DISTINCT day) FILTER (full_) AS complete_capture_days FROM days GROUP BY company_id)
 SELECT company_id, a AS first_capture_at, b AS last_capture_at, round((epoch_us(b) - epoch_us(a)) / 86400e6, 6) AS history_days, date_diff('day', a, b) + 1 AS calendar_days, attempted_days, complete_capture_days, round(complete_capture_days / attempted_days, 6) AS history_coverage, round(complete_capture_days / (date_diff('day', a, b) + 1), 6) AS calendar_coverage, date_diff('day', a, b) + 1 - attempted_days AS never_attempted_days FROM per JOIN span USING (company_id)""",
    "open_trend": f"""WITH {DUCK}, o AS (SELECT s.company_id, s.captured_at, count(DISTINCT j.job_id) AS n FROM snap s LEFT JOIN job j USING (snapshot_id) WHERE coverage_status = 'complete' GROUP BY ALL), x AS (SELECT *, (epoch_us(captured_at) - epoch_us(min(captured_at) OVER (PARTITION BY company_id))) / 86400e6 AS x FROM o),
 a AS (SELECT company_id, count(*) AS points, arg_min(n, captured_at) AS open_first, arg_max(n, captured_at) AS open_last, CASE WHEN count(*) > 1 THEN regr_slope(n, x) END AS slope, max(x) AS span FROM x GROUP BY company_id) SELECT company_id, points, open_first, open_last, round(slope, 6) AS slope_per_day, CASE WHEN slope IS NULL THEN NULL WHEN abs(slope * span) < 1 THEN 'flat' WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction FROM a""",
    "team_activity": f"""WITH {INTERVALS_SQL} SELECT company_id, lower(trim(team)) AS team_key, count(*) AS jobs, count(*) FILTER (first_seen_absent IS NULL OR first_seen_absent > {NOW_SQL}) AS open_jobs, count(*) FILTER (first_observed >= {NOW_SQL} - INTERVAL 30 DAY) AS new_jobs, count(*) FILTER (first_seen_absent BETWEEN {NOW_SQL} - INTERVAL 60 DAY AND {NOW_SQL}) AS closed_jobs, count(*) FILTER (NOT list_contains(sources, 'own')) AS archive_only_jobs, max(first_observed) AS latest_new_at
 FROM intervals WHERE first_observed <= {NOW_SQL} AND trim(team) <> '' GROUP BY ALL""",
    "company_activity": f"""WITH {INTERVALS_SQL} SELECT company_id, count(*) AS jobs, count(*) FILTER (first_seen_absent IS NULL OR first_seen_absent > {NOW_SQL}) AS open_jobs, count(*) FILTER (first_observed >= {NOW_SQL} - INTERVAL 30 DAY) AS new_jobs, count(*) FILTER (first_seen_absent BETWEEN {NOW_SQL} - INTERVAL 60 DAY AND {NOW_SQL}) AS closed_jobs, count(*) FILTER (NOT list_contains(sources, 'own')) AS archive_only_jobs FROM intervals WHERE first_observed <= {NOW_SQL} GROUP BY ALL""",
    "team_events": f"""WITH {INTERVALS_SQL}, e AS (SELECT *, 'new' AS kind, first_observed AS "at" FROM intervals WHERE first_observed BETWEEN {NOW_SQL} - INTERVAL 30 DAY AND {NOW_SQL} UNION ALL SELECT *, 'closed', first_seen_absent FROM intervals WHERE first_seen_absent BETWEEN {NOW_SQL} - INTERVAL 60 DAY AND {NOW_SQL} AND first_observed <= {NOW_SQL}),
 n AS (SELECT company_id, lower(trim(team)) AS team_key, kind, row_number() OVER (PARTITION BY company_id, lower(trim(team)), kind ORDER BY "at" DESC, job_id) AS place, job_id, "at", NOT list_contains(sources, 'own') AS archive_only FROM e WHERE trim(team) <> '') SELECT * FROM n WHERE place <= 3""",
    "team_verdicts": f"""WITH {INTERVALS_SQL}, cov AS (SELECT company_id, (epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 86400e6 AS h, CASE WHEN company_id % 3 = 0 THEN 0.4 ELSE count(DISTINCT d) FILTER (coverage_status = 'complete') / count(DISTINCT d) END AS c FROM snap GROUP BY company_id),
 t AS (SELECT company_id, lower(trim(team)) AS team_key, count(*) FILTER (first_observed >= {NOW_SQL} - INTERVAL 15 DAY) + count(*) FILTER (first_seen_absent BETWEEN {NOW_SQL} - INTERVAL 4 DAY AND {NOW_SQL}) AS n FROM intervals WHERE first_observed <= {NOW_SQL} AND trim(team) <> '' GROUP BY ALL) SELECT company_id, team_key, CASE WHEN n > 0 THEN true WHEN h >= 20 AND c >= 0.5 THEN false END AS verdict FROM t JOIN cov USING (company_id)""",
    "title_mode": f"WITH {INTERVALS_SQL}, c AS (SELECT company_id, title, count(*) AS n FROM intervals GROUP BY ALL) SELECT company_id, title, n FROM c QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY n DESC, title) = 1",
    "degenerate_pages": f"WITH {DUCK}, c AS (SELECT snapshot_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, count(*) AS n FROM job GROUP BY ALL), a AS (SELECT snapshot_id, CAST(sum(n) AS BIGINT) AS jobs, max(n) AS most FROM c GROUP BY snapshot_id) SELECT snapshot_id, jobs, round(most / jobs, 6) AS dominant_fraction, (most / jobs > 0.2 AND jobs >= 3) AS degenerate FROM a",
    "gated_pairs": f"WITH {GATED} SELECT company_id, old_job_id, new_job_id, round(gap_days, 6) AS gap_days FROM gated",
    "equal_title_links": f"""WITH {GATED}, sc AS (SELECT *, CAST(old_title = new_title AS INT) AS ti, CAST(old_team = new_team AS INT) AS te, CAST(old_location = new_location AS INT) AS lo, CASE WHEN old_job_id % 4 <> 0 THEN CAST(old_hash = new_hash AS INT) END AS de FROM gated),
 co AS (SELECT *, (coalesce(0.45 * ti, 0) + coalesce(0.25 * de, 0) + coalesce(0.15 * te, 0) + coalesce(0.15 * lo, 0)) / (CASE WHEN ti IS NULL THEN 0 ELSE 0.45 END + CASE WHEN de IS NULL THEN 0 ELSE 0.25 END + CASE WHEN te IS NULL THEN 0 ELSE 0.15 END + CASE WHEN lo IS NULL THEN 0 ELSE 0.15 END) AS v FROM sc)
 SELECT company_id, old_job_id, new_job_id, round(CAST(v AS DOUBLE), 6) AS combined, (te IS NULL AND lo IS NULL AND de IS NULL) AS title_only, (coalesce(te, 0) + coalesce(lo, 0) + coalesce(de, 0) > 0) AS corroborated, coalesce(ti = 1 AND v >= 0.7 AND ((te IS NULL AND lo IS NULL AND de IS NULL) OR coalesce(te, 0) + coalesce(lo, 0) + coalesce(de, 0) > 0), false) AS passes FROM co""",
    "company_features": f"""WITH {INTERVALS_SQL} SELECT company_id, count(first_seen_absent) AS closed_count, count(*) - count(first_seen_absent) AS right_censored_count, count(*) FILTER (first_seen_absent BETWEEN {NOW_SQL} - INTERVAL 30 DAY AND {NOW_SQL}) AS closures_last_30_days, count(*) FILTER (first_seen_absent BETWEEN {NOW_SQL} - INTERVAL 90 DAY AND {NOW_SQL}) AS closures_last_90_days,
 round(median((epoch_us(last_seen_open) - epoch_us(first_observed)) / 86400e6) FILTER (first_seen_absent IS NOT NULL), 6) AS median_lifetime_low, round(median((epoch_us(first_seen_absent) - epoch_us(first_observed)) / 86400e6) FILTER (first_seen_absent IS NOT NULL), 6) AS median_lifetime_high, count(*) FILTER (first_seen_absent IS NOT NULL AND job_id % 4 = 1) AS reposted_count,
 round(count(*) FILTER (first_seen_absent IS NOT NULL AND job_id % 4 = 1) / nullif(count(first_seen_absent), 0), 6) AS repost_rate FROM intervals GROUP BY company_id""",
    "posting_features": f"WITH {INTERVALS_SQL}, ar AS (SELECT company_id, job_id, min(captured_at) - to_days(CAST(any_value(job_id) % 3 * 90 AS INT)) AS t FROM dense WHERE present AND source = 'archive' GROUP BY ALL), o AS (SELECT i.*, least(CASE WHEN job_id % 2 = 0 THEN first_observed - to_days(CAST(job_id % 300 AS INT)) ELSE first_observed END, ar.t) AS origin FROM intervals i LEFT JOIN ar USING (company_id, job_id)) SELECT company_id, job_id, origin, round((epoch_us({NOW_SQL}) - epoch_us(origin)) / 86400e6, 6) AS age_days, (epoch_us({NOW_SQL}) - epoch_us(origin)) / 86400e6 >= 180 AS long_lived, CASE WHEN first_seen_absent IS NOT NULL AND reappeared_at IS NULL THEN 'interval' ELSE 'right' END AS censoring FROM o",
    "repost_patterns": f"WITH {INTERVALS_SQL}, p AS (SELECT company_id, CASE WHEN company_id = 3 THEN 'unknown' WHEN first_seen_absent IS NULL OR job_id % 3 <> 0 THEN 'none' WHEN job_id % 5 = 0 THEN 'unknown' WHEN job_id % 7 <> 0 AND job_id % 2 = 0 THEN 'repeated_unchanged' ELSE 'changed' END AS repost_pattern FROM intervals) SELECT company_id, repost_pattern, count(*) AS n FROM p GROUP BY ALL",
    "hash_changes": f"WITH {VERSIONS_SQL}, k AS (SELECT *, lag(value) OVER w AS old, lag(captured_at) OVER w AS changed_after FROM vers WHERE value IS NOT NULL WINDOW w AS (PARTITION BY job_id ORDER BY captured_at, snapshot_id)) SELECT job_id, changed_after, captured_at AS changed_by, old, value AS new FROM k WHERE old <> value",
    "carried_values": f"WITH {VERSIONS_SQL}, l AS (SELECT job_id, arg_max(value, captured_at) AS value FROM vers WHERE value IS NOT NULL GROUP BY job_id) SELECT job_id, l.value, min(captured_at) AS first_carried_at FROM l JOIN vers v USING (job_id) WHERE v.value = l.value GROUP BY ALL",
    "matched_refreshes": f"""WITH {VERSIONS_SQL}, k AS (SELECT *, lag(value) OVER w AS old, lag(captured_at) OVER w AS changed_after FROM vers WHERE value IS NOT NULL WINDOW w AS (PARTITION BY job_id ORDER BY captured_at, snapshot_id)), c AS (SELECT job_id, changed_after, captured_at AS changed_by FROM k WHERE old <> value),
 m AS (SELECT v.job_id, v.captured_at + INTERVAL 36 HOUR AS stated_at, c.changed_by FROM vers v JOIN c USING (job_id) WHERE v.snapshot_id % 5 = 0 AND v.captured_at + INTERVAL 36 HOUR BETWEEN c.changed_after - INTERVAL 1 DAY AND c.changed_by + INTERVAL 1 DAY) SELECT job_id, stated_at AS refreshed_at, min(changed_by) AS detected_by FROM m GROUP BY job_id, stated_at QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY stated_at DESC) = 1""",
    "survival_sample": f"WITH {INTERVALS_SQL}, s AS (SELECT CASE WHEN closure_absent_at IS NULL AND last_seen_open <= first_observed THEN 'zero_follow_up' END AS dropped, closure_absent_at IS NOT NULL AS event FROM intervals) SELECT dropped, event, count(*) AS n FROM s GROUP BY ALL",
    "survival_curve": f"WITH {KM} SELECT round(t, 6) AS time, CAST(n AS BIGINT) AS at_risk, d AS events, round(s, 6) AS survival, CASE WHEN s > 0 AND s < 1 THEN round(exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(coalesce(v, 0)) / ln(s))), 6) END AS ci_low, CASE WHEN s > 0 AND s < 1 THEN round(exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(coalesce(v, 0)) / ln(s))), 6) END AS ci_high FROM curve",
    "survival_horizons": f"WITH {KM} SELECT round(min(t) FILTER (s <= 0.5), 6) AS median_days, " + ", ".join(f"CASE WHEN max(t) >= {h} THEN round(coalesce(arg_max(s, t) FILTER (t <= {h}), 1), 6) END AS s{h}" for h in (7, 14, 30, 60, 90)) + " FROM curve",
    "windows_merged": f"""WITH {WINDOWS_SQL}, r AS (SELECT *, max(finished_at) OVER (PARTITION BY company_id ORDER BY started_at, finished_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM win), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR started_at > reach THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY started_at, finished_at) AS island FROM r) SELECT company_id, min(started_at) AS started_at, max(finished_at) AS finished_at FROM i GROUP BY company_id, island""",
    "moments_shifted": f"""WITH RECURSIVE {WINDOWS_SQL}, mo AS (SELECT company_id, snapshot_id, captured_at + INTERVAL 9 HOUR AS moment FROM snap), push AS (SELECT company_id, snapshot_id, moment, moment AS at_ FROM mo UNION SELECT p.company_id, p.snapshot_id, p.moment, w.finished_at FROM push p JOIN win w ON w.company_id = p.company_id AND p.at_ >= w.started_at AND p.at_ < w.finished_at) SELECT company_id, snapshot_id, moment, max(at_) AS shifted_at FROM push GROUP BY ALL""",
    "latest_capture": f"""WITH {DUCK}, co AS (SELECT DISTINCT company_id FROM snap), ca AS (SELECT company_id, unnest(range(TIMESTAMP '2024-01-03 12:00:00', TIMESTAMP '2024-01-28 12:00:01', INTERVAL 5 DAY)) AS replay_at FROM co) SELECT ca.company_id, ca.replay_at, s.captured_at AS captured_at_at, s.snapshot_id FROM ca ASOF LEFT JOIN (SELECT * FROM snap WHERE coverage_status = 'complete') s ON ca.company_id = s.company_id AND ca.replay_at >= s.captured_at""",
    "visible_captures": f"WITH {DUCK} SELECT company_id, coverage_status, count(*) AS n FROM snap WHERE captured_at <= TIMESTAMP '2024-01-12' GROUP BY ALL",
    "intervals_as_of": f"WITH {AS_OF} SELECT company_id, job_id, last_seen_open, first_seen_absent, CASE WHEN closure_absent_at IS NULL THEN 'right' ELSE 'interval' END AS censoring FROM intervals",
    "case_grid": f"WITH {INTERVALS_SQL}, e AS (SELECT company_id, job_id, first_observed AS a, least({NOW_SQL}, coalesce(first_seen_absent, {NOW_SQL})) AS b FROM intervals), g AS (SELECT company_id, job_id, unnest(generate_series(a, b, INTERVAL 7 DAY)) AS t FROM e WHERE a <= b UNION SELECT company_id, job_id, b FROM e WHERE a <= b) SELECT company_id, job_id, count(*) AS cases, min(t) AS first_case, max(t) AS last_case FROM g GROUP BY ALL",
    "turns": f"WITH {INTERVALS_SQL} SELECT company_id, job_id, count(*) OVER (PARTITION BY company_id) AS company_size, row_number() OVER (PARTITION BY company_id ORDER BY substr(sha256('20260607|' || job_id), 1, 13), job_id) AS turn FROM intervals",
    "company_splits": f"WITH {INTERVALS_SQL}, h AS (SELECT company_id, job_id, first_observed, CAST(('0x' || substr(sha256('20260607|' || job_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS x FROM intervals) SELECT company_id, job_id, CASE WHEN x < 0.6 THEN 'dev' WHEN x < 0.8 THEN 'validation' ELSE 'test' END AS stable, CASE WHEN first_observed >= TIMESTAMP '2024-01-10' THEN 'test' WHEN first_observed >= TIMESTAMP '2024-01-05' THEN 'validation' ELSE 'dev' END AS temporal FROM h",
    "dataset_splits": f"""WITH {DUCK}, j AS (SELECT DISTINCT job_n AS p FROM jobs WHERE job_n IN (SELECT job_id FROM job)), m AS (SELECT p, coalesce(CASE WHEN p % 4 = 0 THEN 'test' END, CASE WHEN p % 7 = 0 THEN 'validation' END, CASE WHEN p % 5 <> 0 THEN 'dev' END) AS split FROM j), al AS (SELECT p + 1 AS p, split AS a FROM m WHERE p % 2 = 0 AND (p + 1) % 3 = 0 AND split IS NOT NULL)
 SELECT coalesce(m.p, al.p) AS posting_id, coalesce(a, split) AS split FROM (SELECT * FROM m WHERE split IS NOT NULL) m FULL JOIN al ON m.p = al.p""",
    "eras": f"WITH {INTERVALS_SQL}, b AS (SELECT company_id, min(captured_at) AS boundary FROM snap WHERE source = 'own' GROUP BY company_id), e AS (SELECT i.*, CASE WHEN boundary IS NULL THEN 'unknown' WHEN first_observed < boundary THEN 'archive' ELSE 'live' END AS era FROM intervals i LEFT JOIN b USING (company_id)) SELECT company_id, era, count(*) AS n, round(avg((epoch_us(last_seen_open) - epoch_us(first_observed)) / 86400e6), 6) AS mean_days FROM e GROUP BY ALL",
    "lifecycle_merge": f"""WITH {INTERVALS_SQL}, ord2 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY captured_at) AS i FROM snap WHERE source = 'own'), den2 AS (SELECT u.company_id, u.job_id, o.captured_at, o.i, o.coverage_status, j.job_id IS NOT NULL AS present FROM (SELECT DISTINCT o.company_id, j.job_id FROM job j JOIN ord2 o USING (snapshot_id)) u JOIN ord2 o USING (company_id) LEFT JOIN job j ON j.snapshot_id = o.snapshot_id AND j.job_id = u.job_id),
 f2 AS (SELECT company_id, job_id, min(i) FILTER (present) AS fi, min(captured_at) FILTER (present) AS first_observed, max(captured_at) FILTER (present) AS last_seen_open FROM den2 GROUP BY ALL), a2 AS (SELECT d.company_id, d.job_id, min(i) FILTER (coverage_status = 'complete' AND NOT present AND i > fi) AS ai FROM den2 d JOIN f2 USING (company_id, job_id) GROUP BY ALL),
 s2 AS (SELECT f2.company_id, f2.job_id, f2.first_observed, f2.last_seen_open, min(d.captured_at) FILTER (d.i = ai) AS first_seen_absent, min(d.captured_at) FILTER (d.present AND d.i > ai) AS reappeared_at FROM f2 JOIN a2 USING (company_id, job_id) JOIN den2 d USING (company_id, job_id) GROUP BY ALL),
 m AS (SELECT CASE WHEN s.first_observed IS NULL THEN 'new' WHEN d.first_observed IS NULL THEN 'kept' ELSE 'merged' END AS change, least(s.first_observed, d.first_observed) AS f, greatest(s.last_seen_open, d.last_seen_open) AS l, least(s.first_seen_absent, d.first_seen_absent) AS a, least(s.reappeared_at, d.reappeared_at) AS r FROM s2 s FULL JOIN intervals d USING (company_id, job_id))
 SELECT change, count(*) AS n, min(f) AS first, max(l) AS last, count(a) AS absent, count(r) AS reappeared FROM m GROUP BY change""",
}
ORACLE_SQL |= {
    "top_candidates": f"WITH e AS ({ORACLE_SQL['equal_title_links']}) SELECT company_id, old_job_id, new_job_id, combined, passes FROM e ORDER BY combined DESC, old_job_id, new_job_id, company_id LIMIT 200",
    "page_date_candidates": f"""WITH {INTERVALS_SQL}, p AS (SELECT *, CASE WHEN job_id % 8 = 5 THEN replace(url, 'https', 'http') ELSE url END AS u, max(last_seen_open) OVER (PARTITION BY company_id) AS listed FROM intervals)
 SELECT job_id AS posting_id, u AS url FROM p WHERE job_id % 3 <> 0 AND u LIKE 'https://%' AND (last_seen_open = listed OR last_seen_open IN (SELECT max(captured_at) FROM snap WHERE snap.company_id = p.company_id)) AND (job_id % 4 = 2 OR (job_id % 4 <> 0 AND job_id % 5 < 3)) ORDER BY first_observed DESC, job_id LIMIT 100""",
}
