"""Cases at their own moments, claims, datasets and the ranker, on literals and against brute force."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import claims, datasets, moments, ranker, summaries
from larkspur.operators.running import newest, quantile


def D(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


CAPTURES = "company_id int, snapshot_id int, captured_at timestamp, coverage_status string, source string"


def test_newest_values_come_over_stretches(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.randrange(100)) for k in (1, None) for n in range(40)]
    df = spark.createDataFrame(rows, "k int, n int, v int")
    got = {(r.k, r.n): r.newest for r in newest(df, ["k"], "n", F.floor(F.col("n") / 3), F.col("v"), 5).collect()}
    for k, n, _ in rows:
        assert got[k, n] == [v for a, m, v in sorted(rows, key=lambda r: -r[1]) if a == k and m <= n][:5]


def test_quantiles_from_counts_equal_those_of_all_values(spark):
    rng = random.Random(5)
    values = [rng.randrange(40) / 4 for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for share in (0.0, 0.25, 0.5, 0.8, 0.999, 1.0):
        assert quantile(df, "v", share, F.floor("value")) == pytest.approx(df.agg(F.percentile("v", share)).first()[0])
    assert quantile(df.filter("v is null"), "v", 0.5, F.floor("value")) is None and quantile(df.limit(1), "v", 0.5, F.floor("value")) == values[0]


def test_teams_at_their_moments_equal_brute_force(spark):
    rng = random.Random(2)
    jobs = [(rng.randrange(2), j, rng.choice(["Core ", "core", "", None, "Web"]), f"t{j}", D(rng.randrange(90)), D(rng.randrange(90, 200)) if j % 3 else None, ["own"] if j % 4 else ["archive"]) for j in range(150)]
    cases = [(i, rng.randrange(3), rng.choice(["core", "web", None]), D(rng.randrange(-5, 210))) for i in range(60)]
    got = {r.case_id: r for r in moments.team_at(spark.createDataFrame(cases, "case_id int, company_id int, team_key string, replay_at timestamp"), spark.createDataFrame(jobs, "company_id int, job_id int, team string, title string, first_observed timestamp, first_seen_absent timestamp, sources array<string>")).collect()}
    for i, company, team, t in cases:
        seen = [j for j in jobs if j[0] == company and (team is None or (j[2] or "").strip().lower() == team) and j[4] <= t]
        new = sorted((j for j in seen if j[4] >= t - dt.timedelta(30)), key=lambda j: (-j[4].timestamp(), j[1]))
        closed = sorted((j for j in seen if j[5] and t - dt.timedelta(60) <= j[5] <= t), key=lambda j: (-j[5].timestamp(), j[1]))
        r = got[i]
        assert (r.in_scope, r.archive_only, r.open_roles) == (len(seen), sum(j[6] == ["archive"] for j in seen), sum(not j[5] or j[5] > t for j in seen))
        for kind, want, at in (("new", new, 4), ("closed", closed, 5)):
            assert (r[f"{kind}_jobs"], r[f"{kind}_archive"], r[f"{kind}_at"]) == (len(want), sum(j[6] == ["archive"] for j in want), want[0][at] if want else None)
            assert [e.job_id for e in r[f"{kind}_events"] or []] == [j[1] for j in want[:5]]


def published(spark, first, raw, captures, lists, windows=(), t=40, ats="ashby", **more):
    cases = spark.createDataFrame([(1, 7, 1, ats, first, D(t))], "case_id int, company_id int, job_id int, ats string, first_observed timestamp, replay_at timestamp")
    caps = spark.createDataFrame([(7, i, *c) for i, c in enumerate(captures)], CAPTURES)
    stated = spark.createDataFrame([(i, 1, "u", raw) for i in lists], "snapshot_id int, job_id int, url string, last_published string")
    wins = spark.createDataFrame(list(windows), "started_at timestamp, finished_at timestamp")
    return [(r.raw, r.carried_at, r.absent_at) for r in moments.first_publications(cases, caps, stated, wins, **more).collect()]


def test_first_publications_need_a_bracket(spark):
    caps = [(D(1), "complete", "own"), (D(2), "partial", "own"), (D(5), "complete", "own"), (D(9), "complete", "own")]
    found = [("2024-01-05 12:00:00", D(5), D(1))]
    assert published(spark, D(5), "2024-01-05 12:00:00", caps, [2, 3]) == found
    assert published(spark, D(5), "2024-01-05 12:00:00", caps, [2, 3], ats="lever") == []
    assert published(spark, D(5), "2024-01-05 12:00:00", caps, [2, 3], t=4) == []  # not seen yet
    assert published(spark, D(5), "2024-01-03 12:00:00", caps, [2, 3]) == []  # too long before the sighting
    assert published(spark, D(5), "2024-01-03 12:00:00", caps, [2, 3], max_lag_days=3) == [("2024-01-03 12:00:00", D(5), D(1))]
    assert published(spark, D(5), "2024-01-06 12:00:00", caps, [2, 3]) == []  # behind the sighting
    assert published(spark, D(5), "2024-01-06 12:00:00", caps, [2, 3], windows=[(D(5), D(6))]) == [("2024-01-06 12:00:00", D(5), D(1))]  # but the run lasted until then
    assert published(spark, D(5), "2024-01-04 12:00:00", caps, [2, 3], windows=[(D(1), D(4))]) == []  # as late as the absence may have been taken
    assert published(spark, D(5), "not a date", caps, [2, 3]) == []
    assert published(spark, D(5), "2024-01-05 12:00:00", caps, [1, 2]) == []  # listed before its first sighting
    assert published(spark, D(1), "2023-12-31 12:00:00", caps, [0]) == []  # no capture before


def test_stated_dates_are_those_of_the_latest_capture_from_the_earliest_on(spark):
    caps = spark.createDataFrame([(7, i, D(i), "complete", "archive" if i == 5 else "own") for i in range(6)], CAPTURES)
    stated = spark.createDataFrame([(i, 1, "u", v) for i, v in enumerate(["a", "b", "a", None, "b", "c"])], "snapshot_id int, job_id int, url string, first_published string")
    cases = spark.createDataFrame([(t, 7, 1, D(t, 1)) for t in range(-1, 7)], "case_id int, company_id int, job_id int, replay_at timestamp")
    got = {r.case_id: (r.raw, r.carried_at, r.latest_at) for r in moments.stated_dates_at(cases, caps, stated, ("first_published",)).collect()}
    assert got == {0: ("a", D(0), D(0)), 1: ("b", D(1), D(1)), 2: ("a", D(0), D(2)), 3: ("a", D(0), D(2)), 4: ("b", D(1), D(4)), 5: ("b", D(1), D(4)), 6: ("b", D(1), D(4))}


def test_events_are_claimed_without_a_cut(spark):
    events = spark.createDataFrame([(1, "layoff" if i % 2 else "nonsense", D(i), D(i), "minor", f"h{i}") for i in range(200)], "company_id int, event_type string, event_at timestamp, available_at timestamp, materiality string, headline string")
    cases = spark.createDataFrame([(1, 1, D(150), D(140)), (2, 1, D(10), D(140)), (3, 2, D(10), None)], "case_id int, company_id int, replay_at timestamp, searched_at timestamp")
    got = claims.event_claims(cases, events).collect()
    assert [sum(r.case_id == i for r in got) for i in (1, 2, 3)] == [76, 5, 0]
    first = next(r for r in got if r.claim_type == "company_events_searched")
    assert (first.source_quality, first.source_event_at, first.value) == ("enrichment", D(140), "2024-05-20T00:00:00.000000Z") and {r.source_quality for r in got if r.claim_type == "layoff"} == {"news"}


def test_versions_without_hash_break_no_chain(spark):
    versions = spark.createDataFrame([(1, 1, i, D(i), s, h, None) for i, (s, h) in enumerate([("own", "a"), ("own", None), ("archive", "b"), (None, "b"), ("own", "a")])], "company_id int, job_id int, id int, captured_at timestamp, source string, content_hash string, capture_url string")
    cases = spark.createDataFrame([(1, 1, 1, D(3)), (2, 1, 1, D(9))], "case_id int, company_id int, job_id int, replay_at timestamp")
    got = sorted((r.case_id, r.value, r.source_quality) for r in claims.version_claims(cases, versions).collect())
    assert got == [(1, "a->b", "archive"), (2, "a->b", "archive"), (2, "b->a", "ats_native")]


def test_repost_claims_need_history_and_take_the_first_capture_of_an_instant(spark):
    caps = spark.createDataFrame([(1, 2, D(5), "complete", "own"), (1, 1, D(5), "complete", "archive"), (1, 3, D(8), "complete", "own")], CAPTURES)
    cases = spark.createDataFrame([(1, 1, 1, None, 40.0, D(4), D(5), D(8), D(9)), (2, 1, 1, None, 40.0, D(4), D(5), D(8), D(6)), (3, 1, 1, None, 20.0, D(4), D(5), D(8), D(9))], "case_id int, company_id int, job_id int, url string, history_days double, last_seen_open timestamp, first_seen_absent timestamp, reappeared_at timestamp, replay_at timestamp")
    got = sorted((r.case_id, r.claim_type, r.source_quality, r.source_url) for r in claims.repost_claims(cases, caps).collect())
    assert got == [(1, "disappeared_interval", "archive", "board-history:1/1"), (1, "reappeared", "ats_native", "board-history:1/1"), (2, "disappeared_interval", "archive", "board-history:1/1")]


def test_fallback_windows_end_with_the_next_batch(spark):
    caps = spark.createDataFrame([(i, i, at, "complete", s) for i, (at, s) in enumerate([(D(0), "own"), (D(0, 5), "own"), (D(0, 7), "archive"), (D(3), "own"), (D(4), "own"), (D(9), "own")])], CAPTURES)
    wins = spark.createDataFrame([(D(4), D(5))], "started_at timestamp, finished_at timestamp")
    got = sorted((r.started_at, r.finished_at) for r in summaries.fallback_windows(caps, wins, F.lit(D(9))).collect())
    assert got == [(D(0), D(0, 5)), (D(0, 5), D(1, 5)), (D(3), D(4))]


def test_planned_cases_take_turns_and_leave_runs(spark):
    posts = [(c, c * 100 + j, f"https://x/{j}", D(0), None) for c, n in ((1, 3), (2, 5), (3, 4)) for j in range(n)] + [(4, 400, "archive-only:x", D(0), None), (4, 401, None, D(0), None), (4, 402, "u", None, None)]
    posts = spark.createDataFrame(posts, "company_id int, job_id int, url string, first_observed timestamp, first_seen_absent timestamp")
    splits = posts.select("job_id", F.lit("dev").alias("split"))
    got = datasets.planned(posts, splits, "dev", F.lit(D(10)), 5, posts.filter("company_id = 3").select("company_id"), spark.createDataFrame([(D(5), D(6)), (D(6), D(7))], "started_at timestamp, finished_at timestamp"), limit=4).collect()
    assert {r.replay_at for r in got} == {D(0), D(7), D(10)} and len(got) == 12
    assert sorted({r.job_id // 100 for r in got if r.order.turn == 1}) == [1, 2] and len({r.job_id for r in got}) == 4
    assert [datasets.planned(posts, splits, "dev", F.lit(D(10)), 5, limit=1).first().company_id, datasets.planned(posts, splits, "test", F.lit(D(10))).count()] == [2, 0]


def test_records_have_the_keys_of_their_calls(spark):
    row = spark.range(1).select(datasets.args_hash("p", b=F.lit("x/1"), a=F.lit("2024")).alias("h")).first()
    assert row.h == hashlib.sha256(json.dumps({"probe": "p", "args": {"a": "2024", "b": "x/1"}}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_datasets_are_replaced_as_wholes(spark, tmp_path):
    def put(name, n):
        rows = spark.range(n).select(F.lit(name).alias("dataset_id"), F.col("id"))
        datasets.store(str(tmp_path), rows, rows, rows.limit(1))

    put("a", 5), put("b", 3), put("a", 2), put("a", 2)
    for table, want in (("cases", {"a": 2, "b": 3}), ("records", {"a": 2, "b": 3}), ("datasets", {"a": 1, "b": 1})):
        assert {r.dataset_id: r["count"] for r in spark.read.parquet(f"{tmp_path}/{table}").groupBy("dataset_id").count().collect()} == want


def test_ranker_learns_what_the_cost_does_not_say(spark):
    rng = random.Random(3)
    rows = [(i, D(i), "p", int((x := rng.random()) > 0.5), x, float(rng.choice([1, 3, 10]))) for i in range(400)]
    df = spark.createDataFrame(rows, "case_id int, replay_at timestamp, probe string, label int, n_evidence double, probe_cost_points double")
    r = ranker.evaluated(df).first()
    assert (r.status, r.train_rows, r.holdout_rows, r.keep) == ("trained", 300, 100, True) and r.learned_auc > 0.99 > 0.65 > r.deterministic_auc
    held = [(-x[5], x[3]) for x in rows[300:]]
    pairs = [(a, b) for a, p in held if p for b, q in held if not q]
    assert r.deterministic_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs))
    assert ranker.evaluated(df.limit(50)).first().status == "insufficient_data"
    assert ranker.evaluated(df.withColumn("label", F.lit(1))).first().status == "degenerate"
    assert {r.case_id for r in ranker.temporal_holdout(df.limit(3)).filter("holdout").collect()} == {2}


def test_evidence_derives_captures_once_and_broadcasts_no_growing_table(spark, tiny, monkeypatch):
    from larkspur.plans import moments as plans

    calls = []
    for name in ("captures", "listings"):
        plain = getattr(plans, name)
        monkeypatch.setattr(plans, name, lambda *a, name=name, plain=plain: calls.append(name) or plain(*a))
    monkeypatch.setattr(plans, "jobs_of", lambda *a: calls.append("jobs"))
    seen, evidence = plans.evidence_of(spark, tiny)
    assert sorted(calls) == ["captures", "listings"]
    both = evidence.select("case_id", "claim_type").join(seen.select("case_id", "replay_at"), "case_id")
    assert both.count() == evidence.count() > 0
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()


def test_records_count_claims_without_gathering_them(spark, tiny):
    from larkspur.plans import moments as plans

    plan = plans.dataset_records(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "row_number" not in plan


def test_dataset_records_hold_all_of_their_evidence(spark, tiny):
    from larkspur.plans import moments as plans

    seen, evidence = plans.evidence_of(spark, tiny)
    said = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if c.endswith("_at") else F.col(c) for c in claims.COLUMNS[2:]]
    want = evidence.join(seen.select("case_id", "company_id", "job_id", "replay_at"), "case_id").select(F.concat_ws("/", "company_id", "job_id"), "replay_at", "probe", "evidence_id", *said).collect()
    held = []
    for r in plans.dataset_records(spark, tiny).collect():
        data = json.loads(r.data)
        assert (data["posting_id"], data["observable"], len(data["evidence"])) == (r.posting_id, r.claims > 0, r.claims)
        held += [(r.posting_id, r.replay_at, r.probe_name, f"e{e['n']}", *map(e.get, claims.COLUMNS[2:])) for e in data["evidence"]]
    assert sorted(map(str, held)) == sorted(str(tuple(r)) for r in want) and {h[2] for h in held} == set(datasets.ORDER)


def test_records_keep_microseconds_and_number_ties_by_what_they_say(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    said = spark.createDataFrame([("c", datasets.ORDER[0], "first_published", "2024-01-02", u, "ats_native", at, at, at, x) for u, x in (("v", "b"), ("u", None), ("v", "a"))], "case_id string, probe string, claim_type string, value string, source_url string, source_quality string, source_event_at timestamp, available_at timestamp, fetched_at timestamp, excerpt string")
    cases = spark.createDataFrame([("c", 1, 2, at)], "case_id string, company_id int, job_id int, replay_at timestamp")
    got = {r.probe_name: json.loads(r.data) for r in datasets.records("d", cases, claims.numbered(said, datasets.ORDER), F.lit(at)).collect()}
    held = got[datasets.ORDER[0]]["evidence"]
    assert [(e["n"], e["source_url"], e.get("excerpt")) for e in held] == [(1, "u", None), (2, "v", "a"), (3, "v", "b")]
    assert {e[c] for e in held for c in ("source_event_at", "available_at", "fetched_at")} == {"2024-01-02T03:04:05.678901Z"}
    assert [got[p]["evidence"] for p in datasets.ORDER[1:]] == [[]] * 4 and not got[datasets.ORDER[1]]["observable"]


def test_event_counts_sum_up_the_claims_without_pairing(spark):
    rng = random.Random(7)
    events = spark.createDataFrame([(rng.randrange(3), rng.choice(["layoff", "funding", "nonsense"]), D(i % 90, 5), D(i % 90 + rng.randrange(9)), rng.choice(["minor", "material"]), f"h{i}") for i in range(300)], "company_id int, event_type string, event_at timestamp, available_at timestamp, materiality string, headline string")
    cases = spark.createDataFrame([(i, i % 4 if i % 9 else None, D(rng.randrange(100)), D(rng.randrange(100)) if i % 3 else None) for i in range(60)], "case_id int, company_id int, replay_at timestamp, searched_at timestamp")
    each = claims.event_claims(cases, events).groupBy("case_id", "claim_type", "source_quality")
    want = each.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value"), F.max("value").alias("last_value"), F.max("source_event_at").alias("latest"), F.max("available_at").alias("available_at"))
    got = claims.event_counts(cases, events)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 50
