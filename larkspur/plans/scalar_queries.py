"""Queries that hold the scalar functions against an independent engine, over pages, documents, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import matching, policy
from larkspur.session import table


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages")
    return rows.select("page_id", S.host("url").alias("host"), S.path("url").alias("path"), S.query_value("url", "page").alias("page"), S.watch_key("url").alias("watch_key"))


def board_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Boards from URLs that stand for each kind of host."""
    url = F.expr("CASE page_id % 5 WHEN 0 THEN concat('https://boards.greenhouse.io/Acme', page_id, '/jobs/', page_id) WHEN 1 THEN concat('HTTPS://jobs.ashbyhq.com/', page_id) WHEN 2 THEN concat('https://jobs.lever.co/x', page_id, '?lever=1') WHEN 3 THEN concat('https://www.example.com/careers?gh_jid=', page_id) ELSE 'https://example.org/a?gh_jid=abc' END")
    rows = table(spark, sf, "pages").select("page_id", url.alias("u"))
    return rows.select("page_id", S.board_kind("u").alias("kind"), S.board_tenant("u").alias("tenant"))


def normalized_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" -- ("), F.col("p_brand"), F.lit(")!"))
    return table(spark, sf, "part").select("p_partkey", S.normalized_text(title).alias("title"), S.team_key("p_brand").alias("team"), F.size(S.tokens(title)).cast("long").alias("tokens"))


def title_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    other = rows.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("b_name"), F.col("p_type").alias("b_type"))
    rows = rows.join(other, "p_partkey").withColumn("a", F.concat_ws(" ", "p_name", "p_type")).withColumn("b", F.concat_ws(" ", "b_name", "b_type"))
    return rows.select("p_partkey", F.round(S.token_jaccard("a", "b"), 6).alias("jaccard"), S.changed("a", "b").alias("changed"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.content_hash("text").alias("content_hash"))


def content_versions(spark: SparkSession, sf: str) -> DataFrame:
    from larkspur.operators.changes import version_counts

    return version_counts(table(spark, sf, "documents"), ["source"], "text")


def junk_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.expr("CASE p_partkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'ab' WHEN 2 THEN 'Apply now!' WHEN 3 THEN '2024' WHEN 4 THEN p_name WHEN 6 THEN 'View all our jobs' WHEN 7 THEN 'Apply as a ring' WHEN 8 THEN 'Check the many rings we sell' END")
    rows = table(spark, sf, "part").withColumn("reason", matching.junk_title(title))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def generic_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every part under one of the fixed titles, written in capitals and with signs, or under its own name."""
    titles = F.array(*map(F.lit, matching.GENERIC_TITLES))
    at = (F.col("p_partkey") % (len(matching.GENERIC_TITLES) + 1)).cast("int")
    title = F.when(at == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.upper(F.translate(F.element_at(titles, at), " ", "-")), F.lit("!")))
    return table(spark, sf, "part").select("p_partkey", matching.junk_title(title).alias("reason"))


def event_materiality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    kind = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'layoff' WHEN 1 THEN 'layoff' WHEN 2 THEN 'shutdown' ELSE 'funding' END")
    headline = F.expr("CASE o_custkey % 4 WHEN 0 THEN concat('cuts ', o_custkey % 20, '.5% of staff') WHEN 1 THEN concat('lets go 1,', lpad(o_custkey % 90, 3, '0'), ' employees') WHEN 2 THEN concat(o_custkey % 150, ' Jobs go') ELSE 'lays off people' END")
    return rows.select("o_orderkey", kind.alias("event_type"), S.materiality(kind, headline, F.lit(None).cast("string")).alias("materiality"))


def times(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    text = F.expr("CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE 'soon' END")
    return rows.select("event_id", S.utc_text("ts").alias("text"), S.flexible_time(text).alias("parsed"), S.wayback_time(F.date_format("ts", "yyyyMMddHHmmss")).alias("stamp"))


def recheck(spark: SparkSession, sf: str) -> DataFrame:
    expiry = F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_orderdate as timestamp) + make_dt_interval(cast(o_orderkey % 30 - 5 as int), 11) END")
    return table(spark, sf, "orders").select("o_orderkey", S.recheck_days(expiry, "o_orderdate").alias("days"), policy.publish_recency(expiry, F.expr("cast(o_orderdate as timestamp) + interval 20 days"), 14.0).alias("recency"))


def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("event_type").agg(F.count("p.k").alias("known"), F.sum("p.k").alias("total"), F.countDistinct("p.k").alias("distinct_values"))


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages")
    anchors = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return rows.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(anchors).cast("long").alias("anchors"), F.get(anchors, F.lit(0)).alias("first_anchor"))


def target_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Case-insensitive substring over three columns."""
    rows = table(spark, sf, "part")
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.contains(F.lower(c), F.lit("ring"))
    return rows.filter(hit).select("p_partkey", "p_name")


def packed_values(spark: SparkSession, sf: str) -> DataFrame:
    value = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE concat(o_orderstatus, ': ', o_orderpriority, ': x') END")
    head, rest = S.split_value(value)
    return table(spark, sf, "orders").select("o_orderkey", head.alias("head"), rest.alias("rest"))


QUERIES = {f.__name__: f for f in (url_parts, board_urls, normalized_titles, title_overlap, content_hashes, content_versions, junk_titles, generic_titles, event_materiality, times, recheck, json_paths, page_titles, target_filter, packed_values)}

ORACLE_SQL = {
    "url_parts": r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^[^/?#]*(/[^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, regexp_replace(lower(trim(url)), '/+$', '') AS watch_key FROM pages""",
    "board_urls": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'lever' WHEN 3 THEN 'greenhouse' ELSE 'other' END AS kind, CASE page_id % 5 WHEN 0 THEN 'acme' || page_id WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN 'x' || page_id END AS tenant FROM pages""",
    "normalized_titles": """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS title, lower(trim(p_brand)) AS team, len(list_distinct(string_split(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')), ' '))) AS tokens FROM part""",
    "title_overlap": """WITH t AS (SELECT p_partkey, list_distinct(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w, lower(p_name || ' ' || p_type) AS s FROM part) SELECT a.p_partkey, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard, a.s <> b.s AS changed FROM t a JOIN t b ON b.p_partkey + 1 = a.p_partkey""",
    "content_hashes": "SELECT doc_id, CASE WHEN text <> '' THEN sha256(text) END AS content_hash FROM documents",
    "content_versions": "SELECT source, count(*) AS rows, count(DISTINCT text) AS versions FROM documents GROUP BY source",
    "junk_titles": "SELECT CASE p_partkey % 9 WHEN 0 THEN 'blank' WHEN 1 THEN 'short' WHEN 2 THEN 'generic' WHEN 3 THEN 'digits' WHEN 5 THEN 'blank' WHEN 6 THEN 'link' WHEN 7 THEN 'apply link' END AS reason, count(*) AS n FROM part GROUP BY ALL",
    "generic_titles": f"SELECT p_partkey, CASE WHEN p_partkey % {len(matching.GENERIC_TITLES) + 1} <> 0 THEN CASE WHEN p_partkey % {len(matching.GENERIC_TITLES) + 1} IN ({', '.join(str(i + 1) for i, t in enumerate(matching.GENERIC_TITLES) if len(t) < 3)}) THEN 'short' ELSE 'generic' END END AS reason FROM part",
    "event_materiality": """WITH o AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'layoff' WHEN 1 THEN 'layoff' WHEN 2 THEN 'shutdown' ELSE 'funding' END AS event_type FROM orders)
 SELECT o_orderkey, event_type, CASE WHEN event_type = 'shutdown' THEN 'material' WHEN event_type = 'funding' THEN 'minor' WHEN o_custkey % 4 = 0 AND o_custkey % 20 + 0.5 < 10 THEN 'minor' WHEN o_custkey % 4 = 2 AND o_custkey % 150 < 100 THEN 'minor' ELSE 'material' END AS materiality FROM o""",
    "times": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || 'Z' AS text, CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts)::TIMESTAMP WHEN 1 THEN date_trunc('second', ts) END AS parsed, date_trunc('second', ts) AS stamp FROM events""",
    "recheck": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 14 ELSE greatest(0, least(14, o_orderkey % 30 - 5)) END AS days, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN 20 - (o_orderkey % 30 - 5 + 11 / 24.0) <= 14 THEN 'recent' ELSE 'not_recent' END END AS recency FROM orders""",
    "json_paths": "SELECT event_type, count(json_extract(props, '$.k')) AS known, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS distinct_values FROM events GROUP BY event_type",
    "page_titles": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS anchors, regexp_extract_all(html, '<a href="([^"]*)"', 1)[1] AS first_anchor FROM pages""",
    "target_filter": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'",
    "packed_values": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS head, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE o_orderpriority || ': x' END AS rest FROM orders",
}
