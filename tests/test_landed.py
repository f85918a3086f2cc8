"""Landed files, sinks and small operators on literals."""

import datetime as dt

from pyspark.sql import functions as F

from larkspur.operators import leakage, metrics, summaries, survival
from larkspur.sources import boards, landed, sinks
from larkspur.streaming import daily


def D(day, hour=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_targets_are_trimmed_and_keyed_by_their_domain(spark, tmp_path):
    (tmp_path / "t.csv").write_text("company_name,website_domain,ats,tenant,open_job_count,checked_at\n Acme ,https://www.Acme.com/x, Lever ,acme ,3,2026-01-02\nB,,ashby,b,,soon\n")
    a, b = landed.read_targets(spark, str(tmp_path / "t.csv")).orderBy("company_name").collect()
    assert (a.company_name, a.company_id, a.ats, a.tenant, a.open_job_count, a.checked_at) == ("Acme", "acme.com", "lever", "acme", 3, D(1))
    assert b.checked_at is None and b.open_job_count is None


def test_events_are_read_packed_and_upserted(spark, tmp_path):
    (tmp_path / "e.csv").write_text('company_id,event_type,event_date,available_at,source_url,headline,raw_excerpt,collected_at\na,layoff,2026-01-02,2026-01-03T10:00:00Z,u,"cuts 3% of ""staff""","two\nlines",2026-01-05\na,hiring_freeze,2026-01-02,2026-01-04,u,stops,,2026-01-05\n')
    read = landed.read_events(spark, str(tmp_path / "e.csv"))
    packed = landed.packed_events(read)
    back = {r.event_type: r for r in landed.unpacked_events(packed).collect()}
    cut = back["layoff"]
    assert (cut.event_at, cut.available_at, cut.headline, cut.raw_excerpt, cut.materiality, cut.collected_at, cut.source_quality) == (D(1), D(2, 10), 'cuts 3% of "staff"', "two\nlines", "minor", D(4), "news")
    assert (back["hiring_freeze"].materiality, back["hiring_freeze"].raw_excerpt) == ("material", None)
    later = packed.filter("event_type = 'layoff'").withColumn("available_at", F.lit(D(9)))
    got = {(r.event_type, r.available_at) for r in sinks.upserted(packed, later, list(landed.EVENT_KEY)).collect()}
    assert got == {("layoff", D(9)), ("hiring_freeze", D(3))}


def test_the_last_status_of_a_file_counts(spark, tmp_path):
    (tmp_path / "s.csv").write_text("company_id,searched_at,queries_run,events_found\na,2026-01-01,1,0\nb,2026-01-01,1,1\na,2026-01-03,2,5\n")
    rows = spark.read.csv(str(tmp_path / "s.csv"), header=True, schema=landed.STATUS)
    assert {r.company_id: r.events_found for r in landed.last_status(rows).collect()} == {"a": 5, "b": 1}


def test_entries_of_a_page_merge_in_order(spark):
    rows = [(1, 2, "j", "u2", ["B", "A"]), (1, 1, "j", None, ["A"]), (1, 3, "j", "u3", ["C"]), (1, 1, "k", None, [])]
    got = {r.job_id: (r.url, r.titles) for r in landed.merge_entries(spark.createDataFrame(rows, "page_id int, place int, job_id string, url string, titles array<string>")).collect()}
    assert got == {"j": ("u2", ["A", "B", "C"]), "k": (None, [])}


def test_the_first_source_with_jobs_is_used(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 4), ("a", 3, 9), ("b", 1, 0)], "company_id string, place int, jobs int")
    assert [tuple(r) for r in boards.first_usable(rows, ["company_id"]).collect()] == [("a", 2, 4)]


def test_only_failed_pages_are_tried_again(spark):
    kind = "posting_id int, status string, date_posted string, attempts int"
    stored = spark.createDataFrame([(1, "ok", "x", 1), (2, "failed", None, 1), (3, "failed", None, 2)], kind)
    new = spark.createDataFrame([(1, "failed", None, None), (2, "ok", "y", None), (4, "no_date", None, None)], kind)
    got = {r.posting_id: (r.status, r.date_posted, r.attempts) for r in sinks.recorded(stored, new).collect()}
    assert got == {1: ("ok", "x", 1), 2: ("ok", "y", 2), 3: ("failed", None, 2), 4: ("no_date", None, 1)}


def test_links_whose_sides_are_taken_are_not_written_again(spark):
    links = spark.createDataFrame([(1, 1, 2), (1, 3, 2), (1, 1, 5), (2, 1, 2), (1, 7, 8)], "company_id int, old_job_id int, new_job_id int")
    got = sorted(tuple(r) for r in sinks.new_links(links, links.limit(1)).collect())
    assert got == [(1, 7, 8), (2, 1, 2)]


def test_ages_and_eras(spark):
    rows = spark.createDataFrame([(1, 1, D(0), D(5)), (1, 2, D(9), D(5)), (1, 3, D(5), None)], "company_id int, job_id int, first_observed timestamp, boundary timestamp")
    assert {r.job_id: r.age_days for r in summaries.age_at(rows, F.lit(D(7))).collect()} == {1: 7.0, 2: None, 3: 2.0}
    assert {r.job_id: r.era for r in survival.era_split(rows, "first_observed", F.col("boundary")).collect()} == {1: "archive", 2: "live", 3: "unknown"}


def test_quality_coverage_and_reports(spark):
    runs = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "run_id int, system string")
    evidence = spark.createDataFrame([(1, "archive"), (1, "archive"), (2, "news"), (3, "news")], "run_id int, source_quality string")
    got = {(r.system, r.source_quality): (r.evidence, r.runs, r.share) for r in metrics.evidence_quality_coverage(evidence, runs).collect()}
    assert got == {("A", "archive"): (2, 1, 0.5), ("A", "news"): (1, 1, 0.5), ("B", "news"): (1, 1, 1.0)}
    rows = spark.createDataFrame([("b", 1, "x"), ("a", 2, "y"), ("a", 1, "z")], "kind string, run_id int, item string")
    assert [tuple(r) for r in leakage.itemized(rows, 2).collect()] == [("a", 1, "z"), ("a", 2, "y")]


def test_streamed_windows_close_behind_the_watermark(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "company_id int, captured_at timestamp"
    spark.createDataFrame([(1, D(0, 1)), (1, D(0, 5)), (2, D(0, 7)), (1, D(4))], schema).coalesce(1).write.parquet(source)
    counts = daily.window_counts(spark.readStream.schema(schema).parquet(source))
    for _ in range(2):
        counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.company_id, r.window.start, r.captures) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, D(0), 2), (2, D(0), 1)]
