"""Queries of the corpus' housekeeping: status, caches, samples, reasons, sets and the relevance table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import corpus as C
from larkspur.operators import lifecycle
from larkspur.plans.evaluation import DUCK as RUN_DUCK
from larkspur.plans.evaluation import part
from larkspur.plans.fixtures import capture_ctes, captures, listings
from larkspur.session import table
from larkspur.sources import landed, sinks

DUCK = capture_ctes("duck")


def snapshot_status(spark: SparkSession, sf: str) -> DataFrame:
    snap = captures(spark, sf)
    return C.snapshot_status(snap.select("company_id").distinct(), snap.filter("company_id <> 4"))


def coverage_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return captures(spark, sf).groupBy("company_id", "source").pivot("coverage_status", ["complete", "partial", "gap"]).agg(F.count(F.lit(1)))


def cached_responses(spark: SparkSession, sf: str) -> DataFrame:
    """The response a cache would have served at each piece of evidence's moment. Responses live for 1 to 7 days, so an older one may outlive the latest."""
    e = part(spark, sf, "evidence")
    cache = e.select("probe", (F.col("run_id") % 20).alias("args_hash"), "fetched_at", F.expr("fetched_at + make_dt_interval(cast(1 + evidence_id % 4 * 2 as int))").alias("expires_at"), F.col("evidence_id").alias("response"))
    asks = e.select("evidence_id", "probe", (F.col("run_id") % 20).alias("args_hash"), F.col("available_at").alias("asked_at"))
    return C.cached(asks, cache, ["probe", "args_hash"], "asked_at").select("evidence_id", "response", "fetched_at")


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A proportional sample of documents by language, in hash order: the report is a sample by definition."""
    return C.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 60).select("doc_id", "lang")


def reason_families(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("concat(CASE doc_id % 5 WHEN 0 THEN 'The job is no longer listed. ' WHEN 1 THEN 'Published 3 days ago; a Layoff followed. ' WHEN 2 THEN 'Valid through May. ' WHEN 3 THEN 'Relisted with unchanged text. ' ELSE '' END, 'qqq')")
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.reason_families(text), ",").alias("families"))


def rebuilt_companies(spark: SparkSession, sf: str) -> DataFrame:
    snap = captures(spark, sf)
    linked = snap.select(F.col("company_id") + 5).toDF("company_id").distinct()
    return snap.select("company_id").union(linked).distinct()


def known_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation keys with the lowest posting id and how many share them."""
    rows = part(spark, sf, "run").select((F.col("case_id") % 500).alias("company_id"), F.col("action").alias("ats_job_id"), F.col("run_id").alias("posting_id"))
    return C.by_correlation_key(rows, ["company_id", "ats_job_id"], "posting_id")


def identity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Pages resolved by exact URL, else by host if the host is one page's only."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    asks = pages.select("page_id", F.expr("CASE WHEN page_id % 2 = 0 THEN url ELSE concat(url, 'x') END").alias("asked"))
    return C.resolved(asks, pages, "asked", "url", "page_id").select("page_id", "found_by", "found")


def collapsed_captures(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).join(captures(spark, sf), "snapshot_id").select("url", F.col("captured_at").alias("stamp"), F.floor((F.col("snapshot_id") % 100000) / 4).alias("digest"))
    return landed.collapsed(rows).select("url", "stamp", "digest")


def numbered_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = part(spark, sf, "evidence").select("run_id", F.col("evidence_id").alias("place"), "claim_type")
    return sinks.evidence_ids(rows, 5).select("run_id", "place", "evidence_id")


def upserted_companies(spark: SparkSession, sf: str) -> DataFrame:
    snap = captures(spark, sf)
    old = snap.filter("company_id < 6").groupBy("company_id").agg(F.min("captured_at").alias("created_at"), F.lit("old").alias("name"))
    new = snap.filter("company_id > 3").groupBy("company_id").agg(F.max("captured_at").alias("created_at"), F.lit("new").alias("name"))
    return sinks.upserted(old, new, ["company_id"], ["created_at"])


def dataset_status(spark: SparkSession, sf: str) -> DataFrame:
    runs = part(spark, sf, "run")
    return C.dataset_status(runs.select("case_id").distinct(), runs.filter("status = 'completed'"), ["case_id"], ["A", "B", "R"])


def grid_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = part(spark, sf, "run").filter("replay_at is not null")
    return rows.groupBy("replay_at").agg(F.countDistinct("case_id").alias("cases"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if((F.col("system") == "A") & (F.col("action") == "apply_now")).alias("a_apply_now"))


def relevant_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Which unknown inputs could still change the action, from the decision table laid out once."""
    from larkspur.plans.evaluation import inputs

    return C.could_change(inputs(spark, sf)).select("case_id", F.array_join("could_change", ",").alias("could_change"))


def board_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Each job as present or absent in its company's latest complete capture."""
    snap = captures(spark, sf).filter(lifecycle.is_complete())
    latest = snap.groupBy("company_id").agg(F.max_by("snapshot_id", F.struct("captured_at", "snapshot_id")).alias("snapshot_id"))
    ever = listings(spark, sf).join(captures(spark, sf), "snapshot_id").select("company_id", "job_id").distinct()
    there = latest.join(listings(spark, sf), "snapshot_id").select("company_id", "job_id", F.lit("board_present").alias("claim"))
    return ever.join(there, ["company_id", "job_id"], "left").withColumn("claim", F.coalesce("claim", F.lit("board_absent")))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_status, coverage_by_source, cached_responses, stratified_sample, reason_families, rebuilt_companies, known_postings, identity_resolution, collapsed_captures, numbered_evidence, upserted_companies, dataset_status, grid_distribution,
        relevant_inputs, board_presence,
    )
}

ORACLE_SQL = {
    "snapshot_status": f"WITH {DUCK}, own AS (SELECT * FROM snap WHERE company_id <> 4), la AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC, snapshot_id DESC) = 1), gp AS (SELECT company_id, count(*) FILTER (coverage_status = 'gap') AS gaps FROM own GROUP BY company_id) SELECT c.company_id, captured_at AS last_captured_at, coverage_status AS last_coverage, coalesce(gaps, 0) AS gaps FROM (SELECT DISTINCT company_id FROM snap) c LEFT JOIN la USING (company_id) LEFT JOIN gp USING (company_id)",
    "coverage_by_source": f"WITH {DUCK} SELECT company_id, source, nullif(count(*) FILTER (coverage_status = 'complete'), 0) AS complete, nullif(count(*) FILTER (coverage_status = 'partial'), 0) AS partial, nullif(count(*) FILTER (coverage_status = 'gap'), 0) AS gap FROM snap GROUP BY ALL",
    "cached_responses": f"""WITH {RUN_DUCK}, cache AS (SELECT probe, run_id % 20 AS args_hash, fetched_at, fetched_at + to_days(CAST(1 + evidence_id % 4 * 2 AS INT)) AS expires_at, evidence_id AS response FROM evidence), asks AS (SELECT evidence_id, probe, run_id % 20 AS args_hash, available_at AS asked_at FROM evidence),
 hit AS (SELECT a.evidence_id, c.response, c.fetched_at FROM asks a JOIN cache c ON a.probe = c.probe AND a.args_hash = c.args_hash AND c.fetched_at <= asked_at AND asked_at < c.expires_at QUALIFY row_number() OVER (PARTITION BY a.evidence_id ORDER BY c.fetched_at DESC, c.expires_at DESC, c.response DESC) = 1) SELECT a.evidence_id, response, fetched_at FROM asks a LEFT JOIN hit USING (evidence_id)""",
    "reason_families": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'posting_state' WHEN 1 THEN 'publish,company_event' WHEN 2 THEN 'expiry' WHEN 3 THEN 'posting_state,repost,requirements' ELSE '' END AS families FROM documents",
    "rebuilt_companies": f"WITH {DUCK} SELECT company_id FROM snap UNION SELECT company_id + 5 FROM snap",
    "known_postings": f"WITH {RUN_DUCK} SELECT case_id % 500 AS company_id, action AS ats_job_id, min(run_id) AS posting_id, count(*) AS matches FROM run GROUP BY ALL",
    "identity_resolution": r"""WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages), e AS (SELECT url, min(page_id) AS m FROM h GROUP BY url), u AS (SELECT host, min(page_id) AS m FROM h GROUP BY host HAVING count(DISTINCT page_id) = 1), a AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || 'x' END AS asked FROM pages)
 SELECT a.page_id, CASE WHEN e.m IS NOT NULL THEN 'exact' WHEN u.m IS NOT NULL THEN 'host' END AS found_by, coalesce(e.m, u.m) AS found FROM a LEFT JOIN e ON e.url = a.asked LEFT JOIN u ON u.host = regexp_replace(lower(regexp_extract(a.asked, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')""",
    "collapsed_captures": f"WITH {DUCK}, r AS (SELECT j.url, s.captured_at AS stamp, CAST(floor((s.snapshot_id % 100000) / 4) AS BIGINT) AS digest FROM job j JOIN snap s USING (snapshot_id)) SELECT url, stamp, digest FROM r QUALIFY lag(digest) OVER (PARTITION BY url ORDER BY stamp) IS DISTINCT FROM digest",
    "numbered_evidence": f"WITH {RUN_DUCK} SELECT run_id, evidence_id AS place, 'e' || (row_number() OVER (PARTITION BY run_id ORDER BY evidence_id) + 4) AS evidence_id FROM evidence",
    "upserted_companies": f"WITH {DUCK}, b AS (SELECT company_id, min(captured_at) AS lo, max(captured_at) AS hi FROM snap GROUP BY company_id) SELECT company_id, CASE WHEN company_id < 6 THEN lo ELSE hi END AS created_at, CASE WHEN company_id > 3 THEN 'new' ELSE 'old' END AS name FROM b",
    "dataset_status": f"WITH {RUN_DUCK}, c AS (SELECT DISTINCT case_id FROM run), s AS (SELECT unnest(['A', 'B', 'R']) AS system), d AS (SELECT DISTINCT system, case_id FROM run WHERE status = 'completed') SELECT s.system, count(d.case_id) AS completed, count(*) - count(d.case_id) AS remaining FROM c CROSS JOIN s LEFT JOIN d ON d.system = s.system AND d.case_id = c.case_id GROUP BY s.system",
    "grid_distribution": f"WITH {RUN_DUCK} SELECT replay_at, count(DISTINCT case_id) AS cases, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (system = 'A' AND action = 'apply_now') AS a_apply_now FROM run WHERE replay_at IS NOT NULL GROUP BY replay_at",
    "board_presence": f"WITH {DUCK}, la AS (SELECT company_id, arg_max(snapshot_id, captured_at) AS snapshot_id FROM snap WHERE coverage_status = 'complete' GROUP BY company_id), ever AS (SELECT DISTINCT s.company_id, j.job_id FROM job j JOIN snap s USING (snapshot_id)) SELECT e.company_id, e.job_id, CASE WHEN j.job_id IS NULL THEN 'board_absent' ELSE 'board_present' END AS claim FROM ever e LEFT JOIN la USING (company_id) LEFT JOIN job j ON j.snapshot_id = la.snapshot_id AND j.job_id = e.job_id",
}
