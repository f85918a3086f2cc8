"""Landed files as DataFrames with stated schemas: CSV targets, board JSON and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import flexible_time, host, materiality, utc_text

TARGETS = "company_name string, website_domain string, ats string, tenant string, open_job_count int, checked_at string"
EVENTS = "company_id string, event_type string, event_date string, available_at string, source_url string, headline string, raw_excerpt string, collected_at string"
STATUS = "company_id string, searched_at string, queries_run int, events_found int"
#: One job of each kind of board, as its API states it.
GREENHOUSE_JOB = "id bigint, title string, absolute_url string, updated_at string, first_published string, location struct<name:string>, departments array<struct<name:string>>, offices array<struct<name:string>>, content string"
ASHBY_JOB = "id string, title string, department string, team string, location string, jobUrl string, publishedAt string, descriptionPlain string"
LEVER_JOB = "id string, text string, hostedUrl string, createdAt string, categories struct<team:string,department:string,location:string>, descriptionPlain string"


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=TARGETS)
    return rows.select(F.trim("company_name").alias("company_name"), host("website_domain").alias("company_id"), F.lower(F.trim("ats")).alias("ats"), F.trim("tenant").alias("tenant"), "open_job_count", flexible_time("checked_at").alias("checked_at"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of companies with their materiality, which the text decides; dates are read as midnight."""
    rows = spark.read.csv(path, header=True, schema=EVENTS, multiLine=True, escape='"')
    date = F.to_date(flexible_time("event_date")).cast("timestamp")
    return rows.select("company_id", "event_type", date.alias("event_at"), flexible_time("available_at").alias("available_at"), "source_url", "headline", "raw_excerpt", materiality("event_type", "headline", "raw_excerpt").alias("materiality"), flexible_time("collected_at").alias("collected_at"))


#: What tells events apart, and what the others are packed into.
EVENT_KEY, PACKED = ("company_id", "event_type", "event_at", "source_url"), "headline string, raw_excerpt string, source_quality string, materiality string, collected_at string"


def packed_events(events: DataFrame, quality: str = "news") -> DataFrame:
    """Events as they are stored: EVENT_KEY, available_at and a JSON description of the rest, nulls kept."""
    rest = F.struct(F.col("headline"), F.col("raw_excerpt"), F.lit(quality).alias("source_quality"), F.col("materiality"), utc_text("collected_at").alias("collected_at"))
    return events.select(*EVENT_KEY, "available_at", F.to_json(rest, {"ignoreNullFields": "false"}).alias("description"))


def unpacked_events(stored: DataFrame) -> DataFrame:
    rest = F.from_json("description", PACKED)
    return stored.select(*EVENT_KEY, "available_at", *[rest[c].alias(c) for c in ("headline", "raw_excerpt", "source_quality", "materiality")], F.try_to_timestamp(rest["collected_at"]).alias("collected_at"))


def last_status(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """The last row of each company, in file order."""
    place = order if order is not None else F.monotonically_increasing_id()
    w = Window.partitionBy("company_id").orderBy(F.desc("__n"))
    return rows.withColumn("__n", place).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__n", "__r")


def parse_board(kind: str, payload: Column) -> Column:
    """The jobs of a board's payload as structs of job_id, title, team, location, url, published_at, description_hash; null for junk."""
    text = lambda c: F.sha2(F.when(c != "", c), 256)
    if kind == "greenhouse":
        jobs = F.from_json(payload, f"struct<jobs:array<struct<{_inner(GREENHOUSE_JOB)}>>>")["jobs"]
        return F.transform(jobs, lambda j: F.struct(j["id"].cast("string").alias("job_id"), j["title"].alias("title"), F.get(j["departments"], F.lit(0))["name"].alias("team"), F.coalesce(j["location"]["name"], F.get(j["offices"], F.lit(0))["name"]).alias("location"), j["absolute_url"].alias("url"), F.try_to_timestamp(j["first_published"]).alias("published_at"), text(j["content"]).alias("description_hash")))
    if kind == "ashby":
        jobs = F.from_json(payload, f"struct<jobs:array<struct<{_inner(ASHBY_JOB)}>>>")["jobs"]
        return F.transform(jobs, lambda j: F.struct(j["id"].alias("job_id"), j["title"].alias("title"), F.coalesce(j["team"], j["department"]).alias("team"), j["location"].alias("location"), j["jobUrl"].alias("url"), F.try_to_timestamp(j["publishedAt"]).alias("published_at"), text(j["descriptionPlain"]).alias("description_hash")))
    if kind == "lever":
        jobs = F.from_json(payload, f"array<struct<{_inner(LEVER_JOB)}>>")
        stamp = lambda j: F.timestamp_millis(F.when(j["createdAt"].rlike("^[0-9]+$"), j["createdAt"]).cast("long"))
        return F.transform(jobs, lambda j: F.struct(j["id"].alias("job_id"), j["text"].alias("title"), j["categories"]["team"].alias("team"), j["categories"]["location"].alias("location"), j["hostedUrl"].alias("url"), stamp(j).alias("published_at"), text(j["descriptionPlain"]).alias("description_hash")))
    raise ValueError(f"unknown kind of board: {kind}")


def _inner(ddl: str) -> str:
    """name type, ... as name:type,... for a nested struct."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def merge_entries(rows: DataFrame) -> DataFrame:
    """One row per (page_id, job_id): the first known url, and all title candidates in order, each once. rows: page_id, place, job_id, url, titles."""
    known = F.filter(F.sort_array(F.collect_list(F.struct("place", "url"))), lambda x: x["url"].isNotNull())
    return rows.groupBy("page_id", "job_id").agg(F.get(known, F.lit(0))["url"].alias("url"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "titles"))), lambda x: x["titles"]))).alias("titles"))


def run_windows(lines: DataFrame) -> DataFrame:
    """(started_at, finished_at) of finished runs. lines: place, line; a start line is followed by a stamped line of its end, or else the run was broken off."""
    stamp = F.try_to_timestamp(F.regexp_extract("line", "([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?)", 1))
    kind = F.when(F.col("line").rlike("(?i)snapshot start"), "start").when(F.col("line").rlike("(?i)snapshot (done|end)"), "end")
    rows = lines.select("file", "place", stamp.alias("at"), kind.alias("kind")).filter("kind is not null and at is not null")
    w = Window.partitionBy("file").orderBy("place")
    rows = rows.withColumn("next", F.lead("kind").over(w)).withColumn("finished_at", F.lead("at").over(w))
    return rows.filter("kind = 'start' and next = 'end'").select(F.col("at").alias("started_at"), "finished_at").distinct()


def collapsed(captures: DataFrame) -> DataFrame:
    """Archive captures without those whose digest is the same as the one before, by url. captures: url, stamp, digest."""
    w = Window.partitionBy("url").orderBy("stamp")
    return captures.withColumn("__d", F.lag("digest").over(w)).filter(~F.col("__d").eqNullSafe(F.col("digest"))).drop("__d")
