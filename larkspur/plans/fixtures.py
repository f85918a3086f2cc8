"""Projections of the driver's tables onto the engine's schemas, as Spark SQL and, for oracles, as DuckDB SQL.

Users of events stand for jobs, ten companies for each 150 of them, and calendar days for captures of a company's listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import table

DAYS = {"spark": "datediff(d, date '2024-01-01')", "duck": "date_diff('day', date '2024-01-01', d)"}
START = {"spark": "CAST(d AS TIMESTAMP)", "duck": "CAST(d AS TIMESTAMP)"}


def capture_ctes(dialect: str) -> str:
    """ev, snap (captures) and job (their listings)."""
    # in Spark, the parts that some job may name are picked before the join: all others would be sent to every executor or land in seven tasks
    events, part = ("{events}", "(SELECT p_partkey, p_name, p_brand, p_type FROM {part} WHERE p_partkey BETWEEN -5 AND 7)") if dialect == "spark" else ("events", "part")
    mid = "sha2(CAST(j.job_n % 9 AS STRING), 256)" if dialect == "spark" else "sha256(CAST(j.job_n % 9 AS VARCHAR))"
    text = "STRING" if dialect == "spark" else "VARCHAR"
    return f"""
ev AS (SELECT user_id AS job_n, CAST(user_id % 10 + 10 * floor(user_id / 150.0) AS BIGINT) AS company_n, CAST(date_trunc('day', ts) AS DATE) AS d FROM {events}),
cap AS (SELECT DISTINCT company_n, d, {DAYS[dialect]} AS e FROM ev),
snap AS (SELECT company_n AS company_id, company_n * 100000 + e AS snapshot_id, {START[dialect]} AS captured_at, d, e,
  CASE WHEN (e + company_n) % 7 = 3 THEN 'partial' WHEN (e + company_n) % 11 = 5 THEN 'gap' ELSE 'complete' END AS coverage_status,
  CASE WHEN e < 6 THEN 'archive' ELSE 'own' END AS source FROM cap),
jobs AS (SELECT DISTINCT job_n, company_n, (job_n * 5) % 12 AS s0, (job_n * 5) % 12 + 5 + (job_n * 7) % 20 AS e0 FROM ev),
job AS (SELECT sn.snapshot_id, j.job_n AS job_id, p.p_name AS title, p.p_brand AS team, p.p_type AS location, {mid} AS description_hash,
  'https://jobs.example.com/' || CAST(j.company_n AS {text}) || '/' || CAST(j.job_n AS {text}) AS url
  FROM jobs j JOIN snap sn ON sn.company_id = j.company_n AND sn.e BETWEEN j.s0 AND j.e0 AND NOT (j.job_n % 3 = 0 AND (j.job_n + sn.e) % 5 = 0)
  LEFT JOIN {part} p ON p.p_partkey = j.job_n % 7 + 1)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, snapshot_id, captured_at, coverage_status, source."""
    return spark.sql(f"WITH {capture_ctes('spark')} SELECT company_id, snapshot_id, captured_at, coverage_status, source FROM snap", events=table(spark, sf_dir, "events"), part=table(spark, sf_dir, "part"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_id, job_id, title, team, location, description_hash, url."""
    return spark.sql(f"WITH {capture_ctes('spark')} SELECT * FROM job", events=table(spark, sf_dir, "events"), part=table(spark, sf_dir, "part"))


#: The lifecycle of every job the plain way: jobs times captures. Oracles build on it.
INTERVALS_SQL = f"""{capture_ctes("duck")},
ord AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY captured_at, snapshot_id) AS i FROM snap),
universe AS (SELECT DISTINCT o.company_id, j.job_id FROM job j JOIN ord o USING (snapshot_id)),
dense AS (SELECT u.company_id, u.job_id, o.snapshot_id, o.captured_at, o.i, o.coverage_status, o.source, (j.job_id IS NOT NULL) AS present, j.title, j.team, j.location, j.description_hash, j.url
  FROM universe u JOIN ord o USING (company_id) LEFT JOIN job j ON j.snapshot_id = o.snapshot_id AND j.job_id = u.job_id),
ends AS (SELECT company_id, job_id, min(i) FILTER (present) AS first_i, max(i) FILTER (present) AS last_i FROM dense GROUP BY ALL),
gone AS (SELECT d.company_id, d.job_id, min(i) FILTER (coverage_status = 'complete' AND NOT present AND i > first_i) AS absent_i, min(i) FILTER (coverage_status = 'complete' AND NOT present AND i > last_i) AS closure_i FROM dense d JOIN ends USING (company_id, job_id) GROUP BY ALL),
intervals AS (SELECT d.company_id, d.job_id, min(captured_at) FILTER (i = first_i) AS first_observed, min(captured_at) FILTER (i = last_i) AS last_seen_open,
  min(captured_at) FILTER (i = absent_i) AS first_seen_absent, min(captured_at) FILTER (present AND i > absent_i) AS reappeared_at, min(captured_at) FILTER (i = closure_i) AS closure_absent_at,
  min(title) FILTER (i = last_i) AS title, min(team) FILTER (i = last_i) AS team, min(location) FILTER (i = last_i) AS location, min(description_hash) FILTER (i = last_i) AS description_hash, min(url) FILTER (i = last_i) AS url,
  count(*) FILTER (present) AS capture_count, list_sort(list(DISTINCT source) FILTER (present)) AS sources
  FROM dense d JOIN ends USING (company_id, job_id) JOIN gone USING (company_id, job_id) GROUP BY ALL)"""
