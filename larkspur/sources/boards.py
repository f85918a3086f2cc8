"""Jobs from the HTML of archived boards: anchors that look like jobs, declared totals and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import blank_to_null, normalized_text, ratio
from larkspur.operators.matching import junk_title

# The shapes of links to jobs.
NUMBERED = "/jobs/([0-9]+)"
UUID = "([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})/?(?:[?#].*)?$"


def declared_total(html: Column | str) -> Column:
    """How many jobs a page says it has, from its embedded state or its heading; null if it doesn't."""
    h = F.col(html) if isinstance(html, str) else html
    state = F.regexp_extract(h, '"jobPosts"\\s*:\\s*\\{[^{}]*?"total"\\s*:\\s*([0-9]+)', 1)
    head = F.regexp_replace(F.regexp_extract(h, '(?is)data-testid="job-count-header"[^>]*>\\s*([0-9][0-9,]*)\\s+jobs?\\b', 1), ",", "")
    return F.coalesce(F.when(state != "", state), F.when(head != "", head)).cast("int")


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, tenant, kind, place, href and text of every anchor."""
    found = F.transform(F.regexp_extract_all(html, F.lit("(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>.*?</a>"), 0), lambda a: F.struct(F.regexp_extract(a, "(?is)\\bhref\\s*=\\s*[\"']([^\"']*)[\"']", 1).alias("href"), blank_to_null(F.regexp_replace(F.regexp_replace(a, "(?s)<[^>]*>", " "), "&amp;", "&")).alias("text")))
    return pages.select("page_id", "tenant", "kind", F.posexplode(found).alias("place", "a")).select("page_id", "tenant", "kind", "place", "a.href", "a.text")


def listed_jobs(links: DataFrame) -> DataFrame:
    """One row per page and job: its url and its first text that names a job; jobs without such a text are dropped (their number is in junk)."""
    tenant = F.contains(F.lower("href"), F.lower("tenant"))
    number = F.when(F.col("kind") == "greenhouse", F.regexp_extract("href", NUMBERED, 1)).otherwise(F.regexp_extract("href", UUID, 1))
    rows = links.withColumn("job_id", number).filter((F.col("job_id") != "") & tenant)
    title = F.when(junk_title("text").isNull(), F.col("text"))
    return rows.groupBy("page_id", "job_id").agg(F.min_by("href", "place").alias("url"), F.min_by(title, F.when(title.isNotNull(), F.col("place"))).alias("title"), F.min("place").alias("place"))


def boards(pages: DataFrame, most_same: float = 0.60, least: int = 3) -> DataFrame:
    """Per page: jobs, why it is partial (junk titles, one dominant title, fewer jobs than declared), or null for a complete one. pages: page_id, tenant, kind, html."""
    jobs = listed_jobs(anchors(pages))
    named = jobs.filter("title is not null")
    counts = named.withColumn("t", normalized_text("title")).groupBy("page_id", "t").agg(F.count("*").alias("n"))
    same = counts.groupBy("page_id").agg(F.sum("n").alias("jobs"), F.max("n").alias("most"))
    junk = jobs.groupBy("page_id").agg(F.count_if(F.col("title").isNull()).alias("junk"))
    rows = pages.select("page_id", declared_total("html").alias("declared")).join(same, "page_id", "left").join(junk, "page_id", "left")
    rows = rows.select("page_id", "declared", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("junk", F.lit(0)).alias("junk"), "most")
    why = F.when((F.col("jobs") >= least) & (ratio("most", "jobs") > most_same), "dominant title").when(F.col("junk") > 0, "junk titles").when(F.col("declared") > F.col("jobs"), "declares more jobs")
    return rows.select("page_id", "jobs", "declared", why.alias("partial_reason"))


def first_usable(captures: DataFrame, key: list[str]) -> DataFrame:
    """Of several landed sources of a board (place: order of preference), the first that has jobs."""
    w = Window.partitionBy(*key).orderBy("place")
    return captures.filter("jobs > 0").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
