"""Queries over stored records and structured pages: tagged JSON, the fetches behind records, and nested JSON-LD."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import domains
from larkspur.operators import tagged as G
from larkspur.plans.evaluation import DUCK, part
from larkspur.plans.fixtures import capture_ctes, captures, listings
from larkspur.session import table
from larkspur.sources import json_ld, run_log, templates

ATS = "CASE case_id % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'lever' WHEN 3 THEN 'other' END"


def records_of(spark: SparkSession, sf: str) -> DataFrame:
    """A record of every case of the board and resolver probes, as tagged JSON, with its claims in order."""
    claim = part(spark, sf, "claim")
    item = G.tagged(G.CLAIM, G.members(claim_type=G.plain(F.col("claim_type")), value=G.plain(F.col("value")), source_event_at=G.time(F.col("source_event_at")), source_quality=G.plain(F.col("source_quality"))))
    said = claim.filter("case_id % 4 <> 1").groupBy("case_id").agg(F.max("available_at").alias("observed_at"), F.sort_array(F.collect_list(F.struct("evidence_id", item.alias("j")))).alias("items"))
    asked = part(spark, sf, "asked").join(said, "case_id", "left").withColumn("ats", F.expr(ATS))
    tenant, job = F.expr("CASE WHEN case_id % 6 <> 0 THEN concat('t', cast(case_id % 9 as string)) END"), F.expr("CASE WHEN case_id % 4 <> 0 THEN cast(case_id as string) END")
    address = F.expr("CASE WHEN case_id % 3 = 0 THEN concat('https://jobs.example.com/', cast(case_id as string)) WHEN case_id % 3 = 1 THEN 'mailto:x' END")
    data = G.members(
        ats=G.plain(F.col("ats")), tenant=G.plain(tenant), job_id=G.plain(job), canonical_url=G.plain(address), observed_at=G.time(F.col("observed_at")), resolver_ok=G.or_unknown(F.expr("case_id % 7 <> 0"), G.plain(F.expr("CASE WHEN case_id % 7 <> 1 THEN resolver_ok END"))),
        evidence=G.listed(F.transform(F.coalesce("items", F.array()), lambda x: x["j"])),
    )
    return asked.select(F.col("case_id").alias("record_id"), F.when(F.col("case_id") % 2 == 0, G.RESOLVER).otherwise(G.BOARD).alias("probe_name"), data.alias("data"))


def decoded_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records read back: texts, times, what is unknown, and the number of claims."""
    v = F.parse_json("data")
    return records_of(spark, sf).select(
        "record_id", G.value(v, "$.ats", "string").alias("ats"), G.value(v, "$.observed_at", "timestamp").alias("observed_at"), G.is_unknown(v, "$.resolver_ok").alias("unknown"), G.value(v, "$.resolver_ok", "boolean").alias("resolver_ok"),
        F.size(F.try_variant_get(v, "$.evidence", "array<variant>")).cast("long").alias("claims"), F.size(G.foreign_tags(F.col("data"))).cast("long").alias("foreign_tags"),
    )


def stored_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The claims of all records, in their order, from JSON alone."""
    c = F.col("claim")
    rows = G.claims_of(records_of(spark, sf), "data")
    return rows.select("record_id", F.col("place").cast("long").alias("place"), G.value(c, "$.claim_type", "string").alias("claim_type"), G.value(c, "$.value", "string").alias("value"), G.value(c, "$.source_event_at", "timestamp").alias("source_event_at"), G.value(c, "$.source_quality", "string").alias("source_quality"))


def record_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """The cache keys of the fetches behind every record."""
    return G.fetch_keys(records_of(spark, sf))


def ld(dialect: str) -> str:
    """The JSON-LD of a page: a posting under page_id % 5 levels of graphs and arrays, with others after it; some pages hold a broken block, none or only other nodes."""
    text = "STRING" if dialect == "spark" else "VARCHAR"
    n = f"CAST(page_id AS {text})"
    inner = f"""'{{"@type":"JobPosting","title":"t' || {n} || '","datePosted":"2024-01-0' || CAST(1 + page_id % 7 AS {text}) || '","hiringOrganization":{{"url":"https://www.org' || CAST(page_id % 4 AS {text}) || '.com/x"}}}}'"""
    levels = [inner]
    for k in range(4):
        levels.append(f"""'{{"@graph":[{{"@type":"Other"}},' || {levels[-1]} || '],"@type":"Page"}}'""" if k % 2 == 0 else f"""'[' || {levels[-1]} || ',{{"@type":["Thing","JobPosting"],"title":"late"}}]'""")
    cases = " ".join(f"WHEN {k} THEN {j}" for k, j in enumerate(levels))
    return f"""CASE WHEN page_id % 11 = 0 THEN '{{broken' WHEN page_id % 13 = 0 THEN '{{"@type":"Page","@graph":{{"@type":"JobPosting"}}}}' ELSE CASE page_id % 5 {cases} END END"""


def ld_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The first job posting of every page, however deep it lies."""
    pages = table(spark, sf, "pages").filter("html is not null")
    block = F.concat(F.lit('<script type="application/ld+json">'), F.expr(ld("spark")), F.lit("</script>"))
    rows = pages.select("page_id", F.concat("html", F.when(F.col("page_id") % 17 != 0, block).otherwise("")).alias("html"))
    return json_ld.job_postings(rows).select("page_id", "title", "date_posted_raw", "org_domain")


def links(dialect: str) -> str:
    """What stands behind a page's text: links to its own host, to one of five vendors (1 to 6 times), below a blocked one, to a public body and to a top level that doesn't exist."""
    text = "STRING" if dialect == "spark" else "VARCHAR"
    n = lambda k: f"CAST(page_id % {k} AS {text})"
    return f"""'<a href="' || url || '">own</a>' || repeat('<a class=x href="https://jobs.vendor' || {n(5)} || '.co.uk/apply">v</a>', CAST(1 + page_id % 6 AS INT)) || repeat('<a href="https://m' || {n(3)} || '.widgets.io:443/x">w</a>', CAST(page_id % 4 AS INT))
 || repeat('<a href="https://www.shop' || {n(7)} || '.if/">typo</a><a href="http://www.labor.gov/">law</a>', 7)"""


def mined_domains(spark: SparkSession, sf: str) -> DataFrame:
    """The owner's domain of every page, by name or by its share of the links."""
    pages = table(spark, sf, "pages").selectExpr("page_id", f"concat(html, {links('spark')}) AS html", "CASE WHEN page_id % 4 = 0 THEN concat('Vendor-', cast(page_id % 5 as string), ' Ltd.') END AS company_name", "CASE WHEN page_id % 3 = 0 THEN 'Example' ELSE '-' END AS tenant")
    blocked = spark.createDataFrame([("widgets.io",), ("vendor2.co.uk",), ("example.net",)], "domain string")
    return domains.mined(pages, blocked)


BOARD_KIND = "CASE company_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END"
#: A listing as the card of its board's kind. Some say little: junk below a heading, departments only, junk alone.
CARDS = """CASE company_id % 3
 WHEN 0 THEN concat('<tr class="job-post"><td><a href="https://job-boards.greenhouse.io/t', company_id, '/jobs/', job_id, '"><p class="body">', CASE WHEN job_id % 19 = 0 THEN 'Apply now' ELSE title END, '<span class="tag-container">New</span></p><p>', location, '</p></a></td></tr><tr><td><a href="https://job-boards.greenhouse.io/zz/jobs/', job_id + 1, '">Elsewhere</a></td></tr>')
 WHEN 1 THEN concat('<div class="postings-group">', CASE WHEN job_id % 3 = 0 THEN concat('<div class="large-category-header">dept ', job_id, '</div>') ELSE '' END, CASE WHEN job_id % 4 <> 0 THEN concat('<div class="posting-category-title">', team, '</div>') ELSE '' END, '<div class="posting" data-qa-posting-id="', uid, '"><div class="posting-apply"><a href="/t1/', uid, '">Apply</a></div><a class="posting-title" href="/t1/', uid, '"><h5 data-qa="posting-name">', title, '</h5><div class="posting-categories"><span class="sort-by-location">', location, '</span></div></a></div></div>')
 ELSE to_json(named_struct('id', uid, 'title', CASE WHEN job_id % 7 = 0 THEN 'Apply' ELSE title END, 'locationName', location, 'teamId', cast(job_id % 6 as string))) END"""
PAGE = """CASE company_id % 3
 WHEN 0 THEN concat('<div class="job-posts--table--department"><h3 class="section-header">Dept</h3><table>', body, '</table></div><script>{"jobPosts":{"count":1,"total":', n + snapshot_id % 2, '}}</script>')
 WHEN 1 THEN concat('<html><body>', body, '</body></html>')
 ELSE concat('<script>window.__appData = {"jobBoard":{"teams":[{"id":"1","name":"One"},{"id":"2","name":"x","externalName":"Two }"}],"jobPostings":[', body, ']}};var z = "}";</script>') END"""


def archived_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every capture's listings as the page of an archived board."""
    rows = listings(spark, sf).join(captures(spark, sf), "snapshot_id").withColumn("uid", F.expr("concat('00000000-0000-4000-8000-', lpad(cast(job_id as string), 12, '0'))")).withColumn("card", F.expr(CARDS))
    page = rows.groupBy("company_id", "snapshot_id").agg(F.sort_array(F.collect_list(F.struct("job_id", "card"))).alias("cards"), F.count(F.lit(1)).alias("n"))
    body = F.expr("array_join(transform(cards, c -> c.card), CASE WHEN company_id % 3 = 2 THEN ',' ELSE '' END)")
    return page.withColumn("body", body).select(F.col("snapshot_id").alias("page_id"), F.expr(BOARD_KIND).alias("kind"), F.concat(F.lit("t"), "company_id").alias("tenant"), F.expr(PAGE).alias("html"))


def archived_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs that archived pages keep."""
    return templates.read(archived_pages(spark, sf))[0]


def archived_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Why archived pages are partial."""
    rows = templates.read(archived_pages(spark, sf))[1]
    return rows.withColumn("reasons", F.array_join("reasons", "; "))


def endings_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Runs and steps after closing the runs that are open: every seventh was closed before, every eleventh hasn't ended, every fifth of the failed had an error."""
    run = part(spark, sf, "run").selectExpr("run_id", "started_at", "CASE WHEN run_id % 7 = 0 THEN started_at END AS finished_at", "CASE WHEN run_id % 7 = 0 THEN 'stopped' ELSE 'running' END AS status", "cast(null AS string) AS decision", "cast(null AS double) AS total_cost_usd", "cast(null AS long) AS total_latency_ms", "status AS ends", "action")
    steps = part(spark, sf, "step").selectExpr("run_id", "step_index AS place", "component", "decision_type", "CASE WHEN step_index % 3 <> 0 THEN cast(cost_usd AS double) END AS cost_usd", "cast(latency_s AS double) AS latency_s", "cast(null AS string) AS error", "cast(null AS timestamp) AS created_at")
    ends = run.filter("run_id % 11 <> 0").selectExpr("run_id", "ends AS status", "CASE WHEN ends = 'completed' THEN action END AS decision", "CASE WHEN ends = 'failed' THEN concat('error ', run_id) END AS error")
    return run_log.closed(run.drop("ends", "action"), run_log.numbered(steps).drop("place"), ends)


def closed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with their status, decision and totals."""
    rows = endings_of(spark, sf)[0]
    return rows.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


def failure_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The last steps that say why runs failed."""
    return endings_of(spark, sf)[1].filter(F.col("decision_type") == run_log.RUN_FAILED).select("run_id", "step_index", "component", "error", "created_at")


QUERIES = {f.__name__: f for f in (decoded_records, stored_claims, record_fetches, ld_postings, mined_domains, archived_jobs, archived_verdicts, closed_runs, failure_steps)}

ARCHIVED = f"""{capture_ctes("duck")}, r AS (SELECT s.snapshot_id, s.company_id, s.company_id % 3 AS k, job_id, CASE WHEN s.company_id % 3 = 0 AND job_id % 19 = 0 THEN 'Dept' WHEN NOT (s.company_id % 3 = 2 AND job_id % 7 = 0) THEN title END AS title, team, location, '00000000-0000-4000-8000-' || lpad(CAST(job_id AS VARCHAR), 12, '0') AS uid,
 last_value(CASE WHEN job_id % 3 = 0 THEN 'dept ' || job_id END IGNORE NULLS) OVER (PARTITION BY s.snapshot_id ORDER BY job_id) AS dept FROM job j JOIN snap s USING (snapshot_id)),
t AS (SELECT snapshot_id, title, count(*) AS n FROM r WHERE title IS NOT NULL GROUP BY ALL), m AS (SELECT snapshot_id, max(n) AS most, sum(n) AS named FROM t GROUP BY ALL),
v AS (SELECT r.snapshot_id, any_value(k) AS k, count(*) AS entries, coalesce(any_value(named), 0) AS named, coalesce(any_value(named) >= 3 AND any_value(most) > 0.6 * any_value(named), false) AS one FROM r LEFT JOIN m USING (snapshot_id) GROUP BY r.snapshot_id)"""

FETCH = "sha256('{{\"args\":{{\"params\":{{{0}}},\"url\":\"' || {1} || '\"}},\"probe\":\"' || {2} || '\"}}')"
RECORDS = f"""{DUCK}, rec AS (SELECT case_id AS record_id, CASE WHEN case_id % 2 = 0 THEN 'resolve_posting' ELSE 'board_snapshot' END AS p, {ATS} AS ats, CASE WHEN case_id % 6 <> 0 THEN 't' || (case_id % 9) END AS tenant, CASE WHEN case_id % 4 <> 0 THEN CAST(case_id AS VARCHAR) END AS job_id,
 CASE WHEN case_id % 3 = 0 THEN 'https://jobs.example.com/' || case_id END AS url, CASE WHEN case_id % 7 <> 1 AND case_id % 7 <> 0 THEN resolver_ok END AS ok, case_id % 7 = 0 AS unknown FROM asked)"""
ORACLE_SQL = {
    "decoded_records": f"WITH {RECORDS} SELECT record_id, ats, max(available_at) AS observed_at, any_value(unknown) AS unknown, any_value(ok) AS resolver_ok, count(c.case_id) AS claims, 0 AS foreign_tags FROM rec LEFT JOIN claim c ON c.case_id = record_id AND record_id % 4 <> 1 GROUP BY record_id, ats",
    "stored_claims": f"WITH {DUCK} SELECT case_id AS record_id, row_number() OVER (PARTITION BY case_id ORDER BY evidence_id) - 1 AS place, claim_type, value, source_event_at, source_quality FROM claim WHERE case_id % 4 <> 1 AND case_id IN (SELECT case_id FROM asked)",
    "record_fetches": f"""WITH {RECORDS} SELECT record_id, p AS probe, CASE ats WHEN 'greenhouse' THEN {FETCH.format('"content":"true"', "'https://boards-api.greenhouse.io/v1/boards/' || tenant || '/jobs' || CASE WHEN p = 'resolve_posting' AND job_id IS NOT NULL THEN '/' || job_id ELSE '' END", "p")}
 WHEN 'ashby' THEN {FETCH.format('"includeCompensation":"false"', "'https://api.ashbyhq.com/posting-api/job-board/' || tenant", "p")} ELSE {FETCH.format('"mode":"json"', "'https://api.lever.co/v0/postings/' || tenant", "p")} END AS args_hash FROM rec WHERE ats IN ('greenhouse', 'ashby', 'lever') AND tenant IS NOT NULL
 UNION ALL SELECT record_id, 'json_ld', {FETCH.format("", "url", "'json_ld'")} FROM rec WHERE p = 'resolve_posting' AND url IS NOT NULL""",
    "ld_postings": f"""WITH RECURSIVE src AS (SELECT page_id, TRY_CAST({ld("duck")} AS JSON) AS j FROM pages WHERE html IS NOT NULL AND page_id % 17 <> 0),
n AS (SELECT page_id, [0::BIGINT] AS path, j FROM src WHERE j IS NOT NULL
 UNION ALL SELECT page_id, list_append(path, i - 1), a[i] FROM (SELECT page_id, path, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, path, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j, '$."@graph"') = 'ARRAY' THEN json_extract(j, '$."@graph"[*]') END AS a FROM n) WHERE a IS NOT NULL)),
f AS (SELECT * FROM n WHERE json_type(j) = 'OBJECT' AND (json_extract_string(j, '$."@type"') = 'JobPosting' OR list_contains(json_extract_string(j, '$."@type"[*]'), 'JobPosting')) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY list_append(path, 2147483647)) = 1)
SELECT page_id, json_extract_string(j, '$.title') AS title, json_extract_string(j, '$.datePosted') AS date_posted_raw, CASE WHEN json_extract_string(j, '$.hiringOrganization.url') IS NOT NULL THEN 'org' || (page_id % 4) || '.com' END AS org_domain FROM f""",
    "mined_domains": rf"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html || {links("duck")}, 'href="https?://(?:www\.)?([^/":?#]+)', 1)) AS host, generate_subscripts(regexp_extract_all(html || {links("duck")}, 'href="https?://(?:www\.)?([^/":?#]+)', 1), 1) AS place FROM pages),
d AS (SELECT page_id, regexp_extract(host, CASE WHEN host LIKE '%.co.uk' THEN '[^.]+\.co\.uk$' ELSE '[^.]+\.[^.]+$' END) AS domain, count(*) AS n, min(place) AS place FROM h WHERE host NOT LIKE '%.if' AND host NOT LIKE '%.gov' GROUP BY ALL HAVING domain NOT IN ('widgets.io', 'vendor2.co.uk', 'example.net')),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, place) AS i, coalesce(lead(n) OVER (PARTITION BY page_id ORDER BY n DESC, place), 1) AS next, (domain LIKE 'example.%' AND page_id % 3 = 0) OR (page_id % 4 = 0 AND domain LIKE 'vendor%') AS named FROM d),
b AS (SELECT page_id, arg_min(domain, i) FILTER (named) AS named, arg_min(domain, i) FILTER (i = 1 AND n >= 4 AND n >= 2 * next) AS dominant FROM r GROUP BY page_id)
SELECT page_id, coalesce(named, dominant) AS domain, CASE WHEN named IS NOT NULL THEN 'name' WHEN dominant IS NOT NULL THEN 'dominant' END AS found_by FROM pages LEFT JOIN b USING (page_id)""",
    "archived_jobs": f"""WITH {ARCHIVED} SELECT r.snapshot_id AS page_id, CASE k WHEN 0 THEN CAST(job_id AS VARCHAR) ELSE uid END AS job_id, title, CASE k WHEN 0 THEN 'Dept' WHEN 1 THEN CASE WHEN job_id % 4 <> 0 THEN team ELSE dept END ELSE CASE job_id % 6 WHEN 1 THEN 'One' WHEN 2 THEN 'Two }}' END END AS team, location,
 CASE k WHEN 0 THEN 'https://job-boards.greenhouse.io/t' || company_id || '/jobs/' || job_id WHEN 1 THEN '/t1/' || uid ELSE 'https://jobs.ashbyhq.com/t' || company_id || '/' || uid END AS url FROM r JOIN v USING (snapshot_id, k) WHERE title IS NOT NULL AND NOT one""",
    "archived_verdicts": f"""WITH {ARCHIVED} SELECT snapshot_id AS page_id, entries, CASE WHEN one THEN 0 ELSE named END AS jobs, CASE k WHEN 0 THEN entries + snapshot_id % 2 WHEN 1 THEN entries END AS declared,
 concat_ws('; ', CASE WHEN entries > named THEN 'junk titles' END, CASE WHEN k = 0 AND snapshot_id % 2 = 1 THEN 'declares more jobs' END, CASE WHEN one THEN 'dominant title' END) AS reasons FROM v""",
    "closed_runs": f"""WITH {DUCK}, t AS (SELECT run_id, sum(CASE WHEN step_index % 3 <> 0 THEN CAST(cost_usd AS DOUBLE) END) AS cost, sum(CAST(latency_s AS DOUBLE)) AS latency FROM step GROUP BY run_id),
r AS (SELECT run_id, started_at, status AS ends, action, run_id % 7 <> 0 AND run_id % 11 <> 0 AS closes, run_id % 7 = 0 AS before FROM run)
SELECT r.run_id, started_at, CASE WHEN closes OR before THEN started_at END AS finished_at, CASE WHEN before THEN 'stopped' WHEN closes THEN ends ELSE 'running' END AS status, CASE WHEN closes AND ends = 'completed' THEN action END AS decision,
 CASE WHEN closes THEN round(coalesce(cost, 0), 6) END AS total_cost_usd, CASE WHEN closes THEN CAST(round_even(coalesce(latency, 0) * 1000, 0) AS BIGINT) END AS total_latency_ms FROM r LEFT JOIN t USING (run_id)""",
    "failure_steps": f"WITH {DUCK}, t AS (SELECT run_id, count(*) AS n FROM step GROUP BY run_id) SELECT r.run_id, coalesce(n, 0) + 1 AS step_index, 'controller' AS component, 'error ' || r.run_id AS error, started_at AS created_at FROM run r LEFT JOIN t USING (run_id) WHERE status = 'failed' AND r.run_id % 7 <> 0 AND r.run_id % 11 <> 0",
}
