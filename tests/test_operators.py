"""Small hand-made cases for what the tables don't exercise."""

import datetime as dt
import hashlib
import json
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import asof, controller, features, leakage, lifecycle, matching, metrics, policy, routing, survival
from larkspur.operators import tagged as G
from larkspur.sources import json_ld, landed, sinks

D = lambda n: dt.datetime(2026, 1, 1, 12) + dt.timedelta(days=n)
SNAP = "company_id string, snapshot_id long, captured_at timestamp, coverage_status string, source string"
JOB = "snapshot_id long, job_id string, title string, team string, location string, description_hash string, url string"


def jobs(spark, snaps, listed):
    """snaps: (company, day, coverage, source); listed: {job: positions of the captures that list it}."""
    a = spark.createDataFrame([(c, i, D(d), cov, src) for i, (c, d, cov, src) in enumerate(snaps)], SNAP)
    b = spark.createDataFrame([(i, j, f"title {j}", None, None, None, None) for j, at in listed.items() for i in at], JOB)
    return {r.job_id: r for r in lifecycle.intervals(a, b).collect()}


def test_absence_only_from_complete_captures(spark):
    snaps = [("acme", 0, "complete", "own"), ("acme", 1, "partial", "own"), ("acme", 2, "gap", "own"), ("acme", 3, "complete", "own"), ("acme", 4, "complete", "own")]
    r = jobs(spark, snaps, {"a": [0], "b": [0, 3, 4], "c": [1], "d": [0, 1, 4]})
    assert r["a"].first_seen_absent == D(3) and r["a"].closure_absent_at == D(3) and r["a"].gap_days == 3.0
    assert r["b"].first_seen_absent is None and r["b"].censoring == "right"
    assert r["c"].first_observed == D(1) and r["c"].first_seen_absent == D(3)  # presence in a partial capture counts
    assert r["d"].first_seen_absent == D(3) and r["d"].reappeared_at == D(4) and r["d"].closure_absent_at is None


def test_second_disappearance_and_empty_complete_capture(spark):
    snaps = [("acme", i, "complete", "archive" if i < 2 else "own") for i in range(6)]
    r = jobs(spark, snaps, {"a": [0, 2, 3], "z": [0, 1]})
    assert r["a"].first_seen_absent == D(1) and r["a"].reappeared_at == D(2) and r["a"].closure_absent_at == D(4)
    assert r["z"].sources == ["archive"] and r["z"].present_snapshot_ids == [0, 1]


def test_companies_share_job_ids(spark):
    a = spark.createDataFrame([("acme", 0, D(0), "complete", "own"), ("globex", 1, D(0), "complete", "own"), ("globex", 2, D(1), "complete", "own")], SNAP)
    b = spark.createDataFrame([(0, "j", "t", None, None, None, None), (1, "j", "t", None, None, None, None)], JOB)
    r = {x.company_id: x for x in lifecycle.intervals(a, b).collect()}
    assert r["acme"].censoring == "right" and r["globex"].first_seen_absent == D(1)


def test_assignment_allows_chains_and_is_greedy(spark):
    pairs = [("c", "A", "B", 0.9), ("c", "B", "C", 0.9), ("c", "A", "C", 0.95), ("c", "X", "B", 0.8), ("d", "A", "B", 0.1)]
    got = {(r.k, r.o, r.n) for r in matching.assigned(spark.createDataFrame(pairs, "k string, o string, n string, s double"), ["k"], "o", "n", "s").collect()}
    used, want = [set(), set()], set()
    for k, o, n, s in sorted(pairs, key=lambda x: (-x[3], x[1], x[2])):
        if (k, o) not in used[0] and (k, n) not in used[1]:
            used[0].add((k, o)), used[1].add((k, n)), want.add((k, o, n))
    assert got == want and ("c", "A", "C") in got


def test_similarity_and_renormalized_weights(spark):
    rows = spark.createDataFrame([("Senior Data-Engineer", "senior data engineer"), ("data engineer", "data analyst"), ("", "x")], "a string, b string")
    got = [r[0] for r in rows.select(matching.similarity("a", "b")).collect()]
    assert got[0] == 1.0 and got[2] is None and 0 < got[1] < 1
    scores = spark.createDataFrame([(1.0, None, None, None), (0.9, None, None, None), (1.0, 0.0, None, 1.0)], "title_score double, team_score double, location_score double, description_score double")
    out = matching.combined(scores).collect()
    assert out[0].combined == 1.0 and out[0].title_only and out[0].passes
    assert not out[1].passes  # a title alone has a higher bar
    assert math.isclose(out[2].combined, 0.70 / 0.85) and out[2].corroborated and out[2].passes


def test_event_window_and_unknown_signals(spark):
    cases = spark.createDataFrame([(1, "a", D(200), True), (2, "a", D(200), False), (3, "b", D(200), True)], "case_id long, company_id string, replay_at timestamp, searched boolean")
    events = spark.createDataFrame([("a", "layoff", D(20), D(200), "material"), ("a", "layoff", D(19), D(19), "material"), ("a", "hiring_pause", D(100), D(201), "minor")], "company_id string, event_type string, event_at timestamp, available_at timestamp, materiality string")
    r = {x.case_id: x for x in policy.event_signals(cases, events).collect()}
    assert r[1].material_negative_event is True and r[1].last_material_event_at == D(20) and r[1].freeze_or_pause is False
    assert r[2].material_negative_event is None and r[3].material_negative_event is False


def test_materiality_reads_magnitudes(spark):
    rows = [("layoff", "cuts 9.5% of staff", None), ("layoff", "cuts 10 %", None), ("layoff", "1,200 employees", None), ("layoff", "lays off people", None), ("funding", "20%", None), ("hiring_freeze", None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "e string, h string, x string").select(S.materiality("e", "h", "x")).collect()]
    assert got == ["minor", "material", "material", "material", "minor", "material"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.normalized_text(F.lit("  Ingénieur_Données -- (H/F) "))) == "ingénieur données h f"
    assert one(S.host(F.lit("HTTPS://user@WWW.Acme.COM:8080/x"))) == "acme.com" and one(S.host(F.lit("acme.com/jobs"))) == "acme.com" and one(S.host(F.lit(""))) is None
    assert one(S.flexible_time(F.lit("2026-01-02"))) == dt.datetime(2026, 1, 2) and one(S.flexible_time(F.lit("soon"))) is None
    assert one(S.ratio(F.lit(1), F.lit(0))) is None
    assert one(S.wayback_time(F.lit("2026010212000"))) is None
    assert [t.day for t in one(S.grid(F.lit(D(0)), F.lit(D(9)), 4))] == [1, 5, 9, 10]
    assert one(S.grid(F.lit(D(9)), F.lit(D(0)), 4)) == []


def test_quality_and_default_branch(spark):
    cols = "failures int, primary_publish boolean, posting_state string, contradiction boolean"
    rows = spark.createDataFrame([(1, True, "open", False), (0, None, "open", False), (0, True, None, False), (0, True, "open", True), (0, True, "open", None)], cols)
    assert [r[0].rule for r in rows.select(policy.evidence_quality()).collect()] == ["probe_failure", "no_primary_publish_evidence", "posting_state_unknown", "contradiction", "strong"]


def test_asof_join_is_inclusive_and_keeps_empty(spark):
    cases = spark.createDataFrame([("a", D(5)), ("a", D(1)), ("b", D(5))], "k string, replay_at timestamp")
    facts = spark.createDataFrame([("a", D(2), 1), ("a", D(5), 2), ("a", D(6), 3)], "k string, seen_at timestamp, v int")
    got = {(r.k, r.replay_at): r.v for r in asof.latest_at_each(cases, facts, ["k"], "seen_at", ["v"]).collect()}
    assert got == {("a", D(5)): 2, ("a", D(1)): None, ("b", D(5)): None}


def test_kaplan_meier_ends_at_zero_and_turnbull_sums_to_one(spark):
    rows = spark.createDataFrame([("c", 1, 1.0, 2.0, True, None), ("c", 2, 1.0, 3.0, True, None), ("c", 3, 2.0, None, False, None), ("c", 4, 3.0, 5.0, True, None)], "company_id string, job_id int, low double, high double, event boolean, dropped string")
    curve = survival.kaplan_meier(rows).orderBy("time").collect()
    # the censored one leaves at 2: of four at risk one fails at 2, of two one at 3, and the last at 5
    assert [(r.time, r.at_risk, r.events, round(r.survival, 6)) for r in curve] == [(2.0, 4, 1, 0.75), (3.0, 2, 1, 0.375), (5.0, 1, 1, 0.0)]
    left, right, mass = survival.turnbull(rows)
    assert math.isclose(mass.sum(), 1.0) and (left <= right).all()


def test_greedy_split_equals_the_walk_at_any_size(spark):
    rng = random.Random(4)
    fractions = {"dev": 0.6, "validation": 0.2, "test": 0.2}
    for n, most in ((1, 5), (40, 3), (3000, 40), (2000, 1)):
        sizes = [(f"c{i}", rng.randrange(1, most + 1)) for i in range(n)] + ([("huge", 5000)] if n == 3000 else [])
        order = sorted(sizes, key=lambda r: (-r[1], hashlib.blake2b(f"7:{r[0]}".encode(), digest_size=16).hexdigest()))
        total, held, want = sum(s for _, s in sizes), dict.fromkeys(fractions, 0), {}
        for c, s in order:
            want[c] = max(fractions, key=lambda x: fractions[x] * total - held[x])
            held[want[c]] += s
        got = {r.company_id: r.split for r in asof.greedy_split(spark.createDataFrame(sizes, "company_id string, n int"), "company_id", "n", seed=7).collect()}
        assert got == want
    deficits = {"a": Fraction(10**12), "b": Fraction(7)}
    assert asof.dealt(deficits, 3, 10**12 // 3) == [(0, ["a"]), (333333333331, ["a", "b"])] and deficits == {"a": 4, "b": 4}


def test_turnbull_on_executors_equals_that_on_the_driver(spark):
    rng = random.Random(6)
    rows = []
    for j in range(200):
        low = rng.randrange(0, 30) / 2
        rows.append(("c", j, low, None if rng.random() < 0.3 else low + rng.randrange(0, 12) / 2, True, None))
    sample = spark.createDataFrame(rows, "company_id string, job_id int, low double, high double, event boolean, dropped string")
    left, right, mass = survival.turnbull(sample, rounds=12, tolerance=0.0)
    got = sorted((r.left, r.right, r.mass) for r in survival.turnbull_rounds(sample, rounds=12, tolerance=0.0, width=4).collect())
    assert [(a, b) for a, b, _ in got] == list(zip(left.tolist(), right.tolist(), strict=True)) and np.allclose([m for *_, m in got], mass)
    # the plain way: a matrix of intervals by support
    low = np.array([r[2] for r in rows])
    high = np.array([np.inf if r[3] is None else r[3] for r in rows])
    inside, plain = (low[:, None] <= left) & (high[:, None] >= right), np.full(len(left), 1 / len(left))
    for _ in range(12):
        share = inside * plain
        plain = (share / share.sum(1, keepdims=True)).sum(0) / len(rows)
    assert np.allclose(plain, mass)
    with pytest.raises(ValueError):
        survival.turnbull(sample, most=3)


def test_citations_need_all_their_evidence(spark):
    reasons = spark.createDataFrame([(1, 0, ["e1"]), (1, 1, ["e1", "e9"]), (1, 2, [])], "run_id int, reason_index int, evidence_ids array<string>")
    evidence = spark.createDataFrame([(1, "e1"), (2, "e9")], "run_id int, evidence_id string")
    r = metrics.citation_support(reasons, evidence).first()
    assert (r.reasons, r.cited, r.supported) == (3, 2, 1)


def test_boards_parse_each_kind(spark):
    one = lambda kind, text: spark.createDataFrame([(text,)], "p string").select(landed.parse_board(kind, F.col("p"))).first()[0]
    g = one("greenhouse", '{"jobs": [{"id": 7, "title": "T", "departments": [{"name": "Eng"}], "offices": [{"name": "Paris"}], "content": ""}]}')[0]
    assert (g.job_id, g.team, g.location, g.description_hash) == ("7", "Eng", "Paris", None)
    v = one("lever", '[{"id": "x", "text": "T", "createdAt": "soon", "categories": {"team": "Ops"}}, {"id": "y", "createdAt": "1767225600000"}]')
    assert v[0].published_at is None and v[0].team == "Ops" and v[1].published_at.year == 2026
    assert one("ashby", '{"jobs": [{"id": "a", "department": "D"}]}')[0].team == "D"


def test_json_ld_finds_postings_at_any_depth_in_order(spark):
    def page(*blocks):
        return "".join(f"<script type='application/ld+json'>{b if isinstance(b, str) else json.dumps(b)}</script>" for b in blocks)

    def post(t, **more):
        return {"@type": "JobPosting", "title": t, **more}

    cases = {
        1: ([], None),
        2: (["{bad", {"@graph": [{"@type": "Thing"}, post(" Chef ", datePosted="2026-01-03", hiringOrganization={"sameAs": "", "url": "https://www.acme.com/x"})]}], " Chef "),
        3: ([[[[[post("deep")]]], post("late")]], "deep"),
        4: ([{"@type": ["X", "JobPosting"], "title": "outer", "@graph": [{"@graph": [[{"@graph": [post("inner")]}]]}]}], "inner"),
        5: ([{"@type": "JobPosting", "title": "kept", "@graph": {"@type": "JobPosting", "title": "no list"}}], "kept"),
        6: ([{"@type": "Thing"}, post("second block")], "second block"),
        7: ([post(5)], None),
    }
    pages = spark.createDataFrame([(i, page(*b)) for i, (b, _) in cases.items()] + [(8, None)], "page_id int, html string")
    got = {r.page_id: r for r in json_ld.job_postings(pages).collect()}
    assert {i: r.title for i, r in got.items()} == {i: t for i, (_, t) in cases.items() if i != 1}
    assert (got[2].org_domain, got[2].date_posted.day, got[2].valid_through) == ("acme.com", 3, None)
    assert json_ld.job_postings(pages.filter("page_id in (1, 8)")).count() == 0


def test_tagged_records_lose_nothing(spark):
    rows = [(1, None, None, True, 'a "quoted" \\ text\n', [1, 2]), (2, D(1), True, True, None, []), (3, D(2), None, False, "__type__", None), (4, None, False, True, "é", [None])]
    df = spark.createDataFrame(rows, "i int, t timestamp, flag boolean, known boolean, s string, xs array<int>")
    data = G.members(t=G.time(F.col("t")), flag=G.or_unknown(F.col("known"), G.plain(F.col("flag"))), s=G.plain(F.col("s")), xs=G.plain(F.col("xs")))
    out = df.withColumn("d", data).withColumn("v", F.parse_json("d"))
    out = out.select("i", "d", G.value(F.col("v"), "$.t", "timestamp").alias("t"), G.value(F.col("v"), "$.flag", "boolean").alias("flag"), (~G.is_unknown(F.col("v"), "$.flag")).alias("known"), G.value(F.col("v"), "$.s", "string").alias("s"), F.try_variant_get("v", "$.xs", "array<int>").alias("xs"), G.foreign_tags(F.col("d")).alias("odd"))
    got = {r.i: r for r in out.collect()}
    for i, t, flag, known, s, xs in rows:
        r = got[i]
        assert (r.t, r.flag if known else None, r.known, r.s, r.xs, r.odd) == (t, flag if known else None, known, s, xs, [])
        plain = json.loads(r.d)
        assert plain["s"] == s and plain["xs"] == xs and r.d == json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    odd = spark.createDataFrame([('{"a":{"__type__":"set"},"b":{"__type__":"datetime"},"c":"\\"__type__\\":\\"x\\""}',)], "d string")
    assert odd.select(G.foreign_tags(F.col("d")).alias("o")).first().o == ["set"]


def test_fetch_keys_are_rebuilt_from_records(spark):
    def key(probe, url, **params):
        return hashlib.sha256(json.dumps({"probe": probe, "args": {"url": url, "params": params}}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    green, api = "https://boards-api.greenhouse.io/v1/boards/acme/jobs", "https://api.lever.co/v0/postings/acme"
    rows = [
        (1, "resolve_posting", {"ats": "greenhouse", "tenant": "acme", "job_id": "7", "canonical_url": "https://x/y"}, [("resolve_posting", key("resolve_posting", green + "/7", content="true")), ("json_ld", key("json_ld", "https://x/y"))]),
        (2, "board_snapshot", {"ats": "greenhouse", "tenant": "acme", "job_id": "7"}, [("board_snapshot", key("board_snapshot", green, content="true"))]),
        (3, "resolve_posting", {"ats": "lever", "tenant": "acme", "job_id": 7, "canonical_url": "ftp://x"}, [("resolve_posting", key("resolve_posting", api, mode="json"))]),
        (4, "resolve_posting", {"ats": "other", "tenant": "acme"}, []), (5, "board_snapshot", {"ats": "ashby", "tenant": ""}, []), (6, "team_signal", {"ats": "lever", "tenant": "acme"}, []),
        (7, "requirements_drift", {"posting_id": "p"}, [("requirements_drift", key("requirements_drift", "https://api.ashbyhq.com/posting-api/job-board/t", includeCompensation="false"))]), (8, "requirements_drift", {"posting_id": "q"}, []),
    ]
    records = spark.createDataFrame([(i, p, json.dumps(d)) for i, p, d, _ in rows], "record_id int, probe_name string, data string")
    postings = spark.createDataFrame([("p", "ashby", "t", "1")], "posting_id string, ats string, tenant string, job_id string")
    got = sorted((r.record_id, r.probe, r.args_hash) for r in G.fetch_keys(records, postings).collect())
    assert got == sorted((i, *k) for i, _, _, keys in rows for k in keys)


def test_run_windows_drop_broken_runs(spark):
    lines = [("f", 0, "2026-01-01T10:00:00 snapshot start"), ("f", 1, "2026-01-01T11:00:00 snapshot start"), ("f", 2, "noise"), ("f", 3, "2026-01-01T11:30:00 snapshot done"), ("f", 4, "2026-01-02T11:00:00 snapshot start")]
    got = landed.run_windows(spark.createDataFrame(lines, "file string, place int, line string")).collect()
    assert [(r.started_at.hour, r.finished_at.minute) for r in got] == [(11, 30)]


def test_upserts_and_rebuilds(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", D(3)), (2, "b", D(1))], "id int, v string, created_at timestamp")
    new = spark.createDataFrame([(1, "c", D(5)), (3, "d", D(5))], "id int, v string, created_at timestamp")
    got = {r.id: (r.v, r.created_at) for r in sinks.upserted(old, new, ["id"], ["created_at"]).collect()}
    assert got == {1: ("c", D(3)), 2: ("b", D(1)), 3: ("d", D(5))}
    path = str(tmp_path / "t")
    sinks.rebuild(spark.createDataFrame([("a", 1), ("b", 2)], "company_id string, v int"), path)
    sinks.rebuild(spark.createDataFrame([("b", 3)], "company_id string, v int"), path)
    assert sorted((r.company_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_daily_stream_is_idempotent(spark, tmp_path):
    from larkspur.streaming.daily import run_available

    src, log, seen = str(tmp_path / "in"), str(tmp_path / "log"), []
    rows = spark.createDataFrame([("a", D(0)), ("a", D(0)), ("b", D(0)), ("a", D(1))], "company_id string, captured_at timestamp")
    rows.write.parquet(src)
    sink = lambda df, n: seen.append(df.count())
    run_available(spark, src, rows.schema, log, sink)
    run_available(spark, src, rows.schema, log, sink)
    assert sum(seen) == 3


def test_team_verdict_needs_coverage_for_a_no_only(spark):
    rows = [(0.4, 5, 0, 99.0), (0.6, 0, 1, 99.0), (None, 0, 1, None), (0.6, 0, 0, 99.0), (0.4, 0, 0, 99.0), (0.6, 0, 0, 29.0), (None, 0, 0, None)]
    df = spark.createDataFrame(rows, "history_coverage double, new_jobs int, closed_jobs int, history_days double")
    assert [r[0] for r in df.select(features.team_verdict()).collect()] == [True, True, True, False, None, None, None]
    assert df.select(features.team_verdict(minimum_new=9, minimum_closed=2)).first()[0] is None  # some activity, but too little: neither


def test_a_question_without_a_team_pools_the_company(spark):
    cols = "company_id string, job_id string, team string, title string, first_observed timestamp, first_seen_absent timestamp, sources array<string>"
    rows = [("a", "1", "Eng ", "x", D(0), None, ["own"]), ("a", "2", "", "y", D(95), D(99), ["archive"]), ("a", "3", None, "z", D(96), None, ["own"]), ("a", "4", "eng", "w", D(200), None, ["own"])]
    df, now = spark.createDataFrame(rows, cols), F.lit(D(100))
    own, whole = features.team_activity(df, now).collect(), features.team_activity(df, now, whole=True).collect()
    assert [(r.team_key, r.jobs, r.new_jobs) for r in own] == [("eng", 1, 0)]
    assert [(r.team_key, r.jobs, r.new_jobs, r.closed_jobs, r.open_jobs, r.archive_only_jobs) for r in whole] == [(None, 3, 2, 1, 2, 1)]
    assert [(r.kind, r.place, r.job_id) for r in features.team_events(df, now, whole=True).orderBy("kind", "place").collect()] == [("closed", 1, "2"), ("new", 1, "3"), ("new", 2, "2")]


def test_relevance_agrees_with_enumeration(spark):
    from larkspur.operators import corpus as C

    names = list(C.DOMAINS)
    kinds = "posting_state string, freeze_or_pause boolean, material_negative_event boolean, repost_pattern string, corroborating_hiring_signal boolean, publish_recency string"
    cases = [(1, None, False, False, "none", False, "recent"), (2, "open", None, None, None, None, None), (3, "closed", None, None, None, None, None), (4, "open", False, False, "none", False, None), (5, "open", False, False, "repeated_unchanged", None, "not_recent")]
    rest = "case_id int, " + kinds + ", quality string, long_lived boolean, declared_expiry timestamp, last_material_event_at timestamp, last_refreshed_at timestamp"
    df = spark.createDataFrame([(*c, "strong", True, None, D(1), None) for c in cases], rest)
    got = {r.case_id: set(r.could_change) for r in C.could_change(df).collect()}
    flat = [(c[0], i, *[f[n] for n in names], "strong", True, None, D(1), None) for c in cases for i, f in enumerate(C.fillings(dict(zip(names, c[1:], strict=True))))]
    decided = policy.decided(spark.createDataFrame(flat, rest.replace("case_id int,", "case_id int, i int,")).withColumn("replay_at", F.lit(D(2))))
    act = {(r.case_id, tuple(r[n] for n in names)): r.action for r in decided.collect()}
    for c in cases:
        known = dict(zip(names, c[1:], strict=True))
        want = set()
        for k, n in enumerate(names):
            if known[n] is None:
                for f in C.fillings(known):
                    alone = {act[(c[0], tuple({**f, n: v}[m] for m in names))] for v in (None, *C.DOMAINS[n])}
                    if len(alone) > 1:
                        want.add(n)
                        break
        assert got[c[0]] == want, c
    assert got[3] == set() and "posting_state" in got[1]


def test_junk_titles(spark):
    rows = spark.createDataFrame([(None,), (" -- ",), ("ab",), ("2024",), ("Open Roles",), ("Apply to be a chef",), ("View our jobs",), ("Show runner for a big new drama",), ("アカウント営業/リテール",)], "t string")
    assert [r[0] for r in rows.select(matching.junk_title("t")).collect()] == ["blank", "blank", "short", "digits", "generic", "apply link", "link", None, None]


def test_line_diff_and_field_drift(spark):
    from larkspur.operators import drift

    rows = spark.createDataFrame([("a\nb\n\n c", "a\nx\nc\nd"), (None, "a")], "old string, new string")
    got = [r[0] for r in rows.select(drift.line_diff("old", "new")).collect()]
    assert (got[0].added, got[0].removed, got[0].added_sample, got[0].removed_sample) == (2, 1, ["x", "d"], ["b"]) and got[1].added is None
    r = drift.field_drift(spark.createDataFrame([("Chef!", "chef", None, "Paris")], "live_title string, stored_title string, live_location string, stored_location string"), ["title", "location"]).first()
    assert r.title_changed is False and r.location_changed is None and r.drifted is False


def test_reasons_are_cited_or_dropped(spark):
    from larkspur.operators import drift

    cases = spark.createDataFrame([(1, "open"), (2, "open"), (3, "closed")], "case_id int, state string")
    evidence = spark.createDataFrame([(1, "e2", "posting_state"), (1, "e1", "posting_state"), (3, "e9", "event")], "case_id int, evidence_id string, claim_type string")
    out = drift.reasons(cases, evidence, {"state": (F.col("state") == "open", ["posting_state"]), "event": (F.lit(True), ["event", "posting_state"])})
    assert sorted((r.case_id, r.reason, r.evidence_ids) for r in out.collect()) == [(1, "event", ["e1", "e2"]), (1, "state", ["e1", "e2"]), (3, "event", ["e9"])]
    assert drift.dangling_citations(out, evidence).count() == 0 and drift.dangling_citations(out, evidence.filter("evidence_id <> 'e1'")).count() == 1


def test_board_pages_have_their_gates(spark):
    from larkspur.sources import boards

    link = lambda i, t: f'<li><a class="x" href="https://boards.greenhouse.io/acme/jobs/{i}?a=1"><b>{t}</b></a></li>'
    full = link(1, "Data &amp; ML Engineer") + link(2, "Cook") + link(1, "Apply now")
    pages = [(1, "acme", "greenhouse", full), (2, "acme", "greenhouse", full + '"jobPosts":{"count":2,"page":1,"total":146}'), (3, "acme", "greenhouse", link(1, "Chef") * 1 + link(2, "chef") + link(3, "CHEF!")), (4, "acme", "greenhouse", full + link(9, "Apply")), (5, "acme", "greenhouse", "<p>none</p>"), (6, "acme", "greenhouse", '<h2 data-testid="job-count-header"> 1,146 jobs</h2>')]
    df = spark.createDataFrame(pages, "page_id int, tenant string, kind string, html string")
    got = {r.page_id: (r.jobs, r.declared, r.partial_reason) for r in boards.boards(df).collect()}
    assert got == {1: (2, None, None), 2: (2, 146, "declares more jobs"), 3: (3, None, "dominant title"), 4: (2, None, "junk titles"), 5: (0, None, None), 6: (0, 1146, "declares more jobs")}
    jobs = {r.job_id: r.title for r in boards.listed_jobs(boards.anchors(df.filter("page_id = 1"))).collect()}
    assert jobs == {"1": "Data & ML Engineer", "2": "Cook"}


def test_fetched_after_meets_no_response_one_by_one(spark):
    rng = random.Random(5)
    at = lambda: D(0) + dt.timedelta(hours=rng.randrange(400))
    runs = [(i, None if i % 9 == 0 else at()) for i in range(60)]
    claims = [(rng.randrange(60), i, None if i % 31 == 0 else f"p{i % 3}", None if i % 37 == 0 else at()) for i in range(900)]
    held = [(f"p{i % 2}", f, None if i % 11 == 0 else f + dt.timedelta(hours=rng.choice([-7, 0, 1, 5, 60]))) for i, f in enumerate(at() for _ in range(40))]
    moment, day, want = dict(runs), dt.timedelta(hours=24), set()
    for run, i, probe, t in claims:
        near = [(f, e) for p, f, e in held if p == probe and t is not None and e is not None and f <= t + day and e > t]
        later = [f for f, _ in near if f > t]
        if not any(f <= t for f, _ in near) and later and moment[run] is not None and min(later) > moment[run]:
            want.add((run, str(i)))
    frames = (claims, "run_id long, evidence_id long, probe string, available_at timestamp"), (held, "probe string, fetched_at timestamp, expires_at timestamp"), (runs, "run_id long, replay_at timestamp")
    out = leakage.fetched_after(*(spark.createDataFrame(*f) for f in frames))
    got = [(r.run_id, r.item) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert not re.search(r"Join \[probe#\d+\], \[probe#\d+\]", out._jdf.queryExecution().executedPlan().toString())


def test_splits_are_those_of_the_seeded_hash(spark):
    import hashlib

    from larkspur.operators import splits

    rows = [(f"p{i}", f"c{i % 17}", D(i)) for i in range(60)] + [("q1", "c1", D(70)), ("q2", "c1", D(71))]
    df = spark.createDataFrame(rows, "posting_id string, company_id string, first_observed timestamp")
    got = {r.posting_id: r for r in splits.assigned_splits(df, F.lit(D(40)), F.lit(D(30)), 11, method="hash").collect()}
    for p, c, t in rows:
        x = int.from_bytes(hashlib.blake2b(f"11:{c}".encode(), digest_size=8).digest(), "big") / 2.0**64
        assert got[p].company_split == ("dev" if x < 0.6 else "validation" if x < 0.6 + 0.2 else "test")
        assert got[p].temporal_split == ("test" if t >= D(40) else "validation" if t >= D(30) else "dev")
    sizes, held, want = {}, dict.fromkeys(("dev", "validation", "test"), 0), {}
    for _, c, _ in rows:
        sizes[c] = sizes.get(c, 0) + 1
    share = {"dev": 0.6, "validation": 0.2, "test": 0.2}
    for c in sorted(sizes, key=lambda c: (-sizes[c], hashlib.blake2b(f"11:{c}".encode(), digest_size=16).hexdigest())):
        want[c] = max(held, key=lambda s: share[s] * len(rows) - held[s])
        held[want[c]] += sizes[c]
    assert {r.company_id: r.company_split for r in splits.assigned_splits(df, F.lit(D(40)), seed=11).collect()} == want
    tests = {r[0] for r in splits.stable_test_companies(df.select("company_id").limit(0), df, 11).collect()}
    assert tests == {c for p, c, _ in rows if got[p].company_split == "test"}
    with pytest.raises(ValueError):
        splits.stable_companies(df, 1, (0.5, 0.2, 0.2))


def test_datasets_retire_once_and_share_no_companies(spark):
    from larkspur.operators import splits

    sets = spark.createDataFrame([("a", None), ("b", D(1))], "dataset_id string, retired_at timestamp")
    gone = splits.retired(sets, F.lit(True), F.lit(D(5)))
    assert {r.dataset_id: r.retired_at for r in gone.collect()} == {"a": D(5), "b": D(1)}
    assert {r.retired_at for r in splits.unretired(gone, F.col("dataset_id") == "b").collect()} == {D(5), None}
    cases = spark.createDataFrame([("a", "x", "dev"), ("b", "y", None), ("b", "z", "test")], "dataset_id string, company_id string, split string")
    assert [r.company_id for r in splits.usable(cases, sets).collect()] == ["x"]
    assert {r.company_id for r in splits.excluded_companies(cases, "a").collect()} == {"y", "z"}
    assert [r.company_id for r in splits.permitted(cases).collect()] == ["x"] and splits.permitted(cases, ("test",)).count() == 1


def test_rounds_and_one_pass_assign_alike(spark, monkeypatch):
    rng = random.Random(3)
    pairs = sorted({("k%d" % rng.randrange(3), rng.randrange(9), rng.randrange(9)) for _ in range(150)})
    df = spark.createDataFrame([(*p, rng.choice([0.7, 0.8, 0.9])) for p in pairs], "k string, o int, n int, s double")
    one = {tuple(r) for r in matching.assigned(df, ["k"], "o", "n", "s").collect()}
    monkeypatch.setattr(matching, "FEW_CANDIDATES", 40)
    assert {tuple(r) for r in matching.assigned(df, ["k"], "o", "n", "s").collect()} == one
    assert {tuple(r) for r in matching.rounds(df, ["k"], "o", "n", "s").collect()} == one


def test_repost_links_against_brute_force(spark):
    """Every pair of jobs of a company, gated, scored and assigned the plain way."""
    from difflib import SequenceMatcher

    rng, rows = random.Random(8), []
    titles = ["Data Engineer", "Senior Data Engineer", "data-engineer", "Data Engineer II", "Line Cook", "Cook", "View all jobs", "Remote", "Account Executive"]
    for i in range(70):
        first = rng.randrange(150)
        last = first + rng.randrange(40)
        gone = last + rng.randrange(1, 9) if rng.random() < 0.8 else None
        rows.append((f"c{i % 3}", i, D(first), D(last), None if gone is None else D(gone), rng.choice(titles), rng.choice(["Eng", "eng ", "Ops", None]), rng.choice(["Paris", "Paris, FR", None]), rng.choice(["h1", "h2", None]), rng.choice([f"u{i}", "u0/", None]), [rng.randrange(400) for _ in range(3)]))
    cols = "company_id string, job_id int, first_observed timestamp, last_seen_open timestamp, first_seen_absent timestamp, title string, team string, location string, description_hash string, url string, present_snapshot_ids array<int>"
    got = {(r.company_id, r.old_job_id, r.new_job_id): round(r.combined, 9) for r in matching.repost_links(spark.createDataFrame(rows, cols)).collect()}

    def norm(x):
        return re.sub(r"[\W_]+", " ", (x or "").lower()).strip()

    def alike(a, b):
        a, b = norm(a), norm(b)
        if not a or not b:
            return None
        x, y = set(a.split()), set(b.split())
        return 1.0 if a == b else (len(x & y) / len(x | y) + SequenceMatcher(None, a, b).ratio()) / 2

    found, day = [], dt.timedelta(days=1)
    for o in rows:
        for n in rows:
            key = [(r[9] or "").strip().rstrip("/") or None for r in (o, n)]
            junk = any(norm(r[5]) in ("view all jobs", "remote") for r in (o, n))
            if junk or o[0] != n[0] or o[1] == n[1] or o[4] is None or key[0] is not None and key[0] == key[1] or n[2] <= o[3] or not -7 < (n[2] - o[4]) / day <= 120 or set(o[10]) & set(n[10]):
                continue
            parts = [alike(o[5], n[5]), None if not o[8] or not n[8] else float(o[8] == n[8]), alike(o[6], n[6]), alike(o[7], n[7])]
            known = [(p, w) for p, w in zip(parts, (0.45, 0.25, 0.15, 0.15), strict=True) if p is not None]
            score = sum(p * w for p, w in known) / sum(w for _, w in known)
            alone = all(p is None for p in parts[1:])
            backed = any(p is not None and p >= m for p, m in zip(parts[1:], (0.80, 0.80, 0.90), strict=True))
            if parts[0] >= (0.95 if alone else 0.85) and score >= 0.70 and (alone or backed):
                found.append((-score, o[1], n[1], o[0]))
    used, want = [set(), set()], {}
    for score, o, n, c in sorted(found):
        if o not in used[0] and n not in used[1]:
            used[0].add(o), used[1].add(n)
            want[(c, o, n)] = round(-score, 9)
    assert got == want and len(want) >= 5


def test_running_aggregates_against_brute_force(spark):
    from larkspur.operators.running import at_moments

    rng = random.Random(2)
    facts = [("a" if rng.random() < 0.8 else "b", D(rng.randrange(90)), rng.choice([1, 2, None])) for _ in range(200)] + [("a", None, 9), (None, D(3), 9)]
    cases = [(i, rng.choice(["a", "b", "c"]), D(rng.randrange(-5, 95))) for i in range(80)] + [(900, "a", None), (901, None, D(5))]
    out = at_moments(spark.createDataFrame(cases, "case_id int, k string, replay_at timestamp"), spark.createDataFrame(facts, "k string, at timestamp, v int"), ["k"], "at", {"n": ("sum", F.col("v")), "last": ("max", F.col("at")), "least": ("min", F.col("v"))}, days=7)
    got = {r.case_id: (r.n, r["last"], r.least) for r in out.collect()}
    for i, k, t in cases:
        seen = [(a, v) for x, a, v in facts if x is not None and x == k and a is not None and t is not None and a <= t]
        assert got[i] == (sum(v or 0 for _, v in seen), max((a for a, _ in seen), default=None), min((v for _, v in seen if v is not None), default=None)), i


def test_cached_responses_may_be_older_than_the_latest(spark):
    from larkspur.operators import corpus as C

    rng = random.Random(4)
    at = lambda: D(0) + dt.timedelta(hours=rng.randrange(300))
    cache = [(rng.choice("ab"), f, f + dt.timedelta(hours=rng.choice([-1, 0, 3, 30, 200])), i) for i, f in enumerate(at() for _ in range(60))]
    asks = [(i, rng.choice("abc"), at()) for i in range(150)]
    out = C.cached(spark.createDataFrame(asks, "i int, k string, asked timestamp"), spark.createDataFrame(cache, "k string, fetched_at timestamp, expires_at timestamp, response int"), ["k"], "asked")
    got = {r.i: (r.fetched_at, r.response) for r in out.collect()}
    for i, k, t in asks:
        hits = [(f, e, r) for x, f, e, r in cache if x == k and f <= t < e]
        want = max(hits, default=None)
        assert got[i] == ((None, None) if want is None else (want[0], want[2])), i


def test_refreshes_against_brute_force(spark):
    from larkspur.operators import changes

    rng = random.Random(6)
    found = [("k", D(a), D(a + rng.randrange(1, 70))) for a in (rng.randrange(100) for _ in range(25))]
    stamps = [("k", D(rng.randrange(-10, 190))) for _ in range(9)] + [("z", D(1))]
    got = changes.refreshes(spark.createDataFrame(stamps, "k string, stated_at timestamp"), spark.createDataFrame(found, "k string, changed_after timestamp, changed_by timestamp"), ["k"], 3).collect()
    three = dt.timedelta(days=3)
    hits = {t: min(b for _, a, b in found if a - three <= t <= b + three) for k, t in stamps if k == "k" and any(a - three <= t <= b + three for _, a, b in found)}
    assert [(r.refreshed_at, r.detected_by) for r in got] == [max(hits.items())]


def test_windows_merge_without_a_key(spark):
    from larkspur.operators.intervals_join import merged_windows

    rng, rows = random.Random(1), []
    for _ in range(80):
        a = rng.randrange(400)
        rows.append((D(a), D(a + rng.randrange(0, 6))))
    want = []
    for a, b in sorted(rows):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    got = merged_windows(spark.createDataFrame(rows, "started_at timestamp, finished_at timestamp")).orderBy("started_at").collect()
    assert [[r.started_at, r.finished_at] for r in got] == want


def test_refused_steps_cost_nothing(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([0.5, 0.6, 0.4, 0.2, 0.1])] + [(2, 0, None)], "run_id int, step_index int, usd double")
    got = {(r.run_id, r.step_index): (r.allowed, round(r.spent_usd, 6)) for r in policy.budget(rows, {"usd": 1.0}).collect()}
    assert got == {(1, 0): (True, 0.5), (1, 1): (False, 0.5), (1, 2): (True, 0.9), (1, 3): (False, 0.9), (1, 4): (True, 1.0), (2, 0): (True, 0.0)}
    assert [r.allowed for r in policy.budget(rows, {"usd": 9.0}, most=2).filter("run_id = 1").orderBy("step_index").collect()] == [True, True, False, False, False]


def test_a_long_run_is_budgeted_without_gathering_its_steps(spark):
    rows = spark.range(30_000).selectExpr("id % 3 as run_id", "cast(id as int) as step_index", "case when id % 7 = 0 then 50.0D else 0.25D end as usd", "concat('s', id) as note")
    got = policy.budget(rows, {"usd": 100.0}, most=300)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    for run in range(3):
        spent, n, want = 0.0, 0, []
        for i in range(run, 30_000, 3):
            cost = 50.0 if i % 7 == 0 else 0.25
            fits = n < 300 and spent + cost <= 100.0
            spent, n = (spent + cost, n + 1) if fits else (spent, n)
            want.append((i, f"s{i}", fits, spent))
        assert [tuple(r) for r in got.filter(F.col("run_id") == run).orderBy("step_index").select("step_index", "note", "allowed", "spent_usd").collect()] == want


def test_claims_are_read_by_the_rules(spark):
    from larkspur.operators import inputs as I

    cases = spark.createDataFrame([(1, D(100), True), (2, D(100), False), (3, D(100), True)], "case_id int, replay_at timestamp, resolver_ok boolean")
    cols = "case_id int, evidence_id string, probe string, claim_type string, value string, source_quality string, source_event_at timestamp, available_at timestamp, fetched_at timestamp"
    rows = [
        (1, "e1", "board_snapshot", "posting_state", "closed", None, None, D(99), D(99)), (1, "e2", "resolve_posting", "posting_state", " Open", None, None, D(50), D(50)),
        (1, "e3", "resolve_posting", "first_published", "x", "page_structured", D(10), D(50), D(50)), (1, "e4", "resolve_posting", "first_published", "x", "ats_native", D(20), D(50), D(50)), (1, "e5", "resolve_posting", "first_published", "x", "archive", D(1), D(50), D(50)),
        (1, "e6", "company_events", "company_events_searched", "x", None, None, D(50), D(50)), (1, "e7", "company_events", "layoff", "cuts: many", None, D(30), D(50), D(50)), (1, "e8", "other", "hiring_freeze", "material: x", None, D(30), D(50), D(50)),
        (2, "f1", "company_events", "layoff", "material: x", None, D(30), D(50), D(50)), (2, "f2", "team_signal", "corroborating_hiring_signal", " No", None, None, D(50), D(50)), (2, "f3", "resolve_posting", "posting_state", "open", None, None, D(5), D(5)),
    ]
    got = {r.case_id: r for r in I.policy_inputs(cases, spark.createDataFrame(rows, cols)).withColumn("open_", I.unresolved()).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.posting_state, a.first_published, a.publish_recency, a.material_negative_event, a.freeze_or_pause, a.last_material_event_at.date(), a.expiry_known) == ("open", D(20), "not_recent", True, False, D(30).date(), True)
    assert (b.posting_state, b.material_negative_event, b.corroborating_hiring_signal, b.expiry_known, b.last_material_event_at) == ("open", None, False, False, None)
    assert c.posting_state is None and set(c.open_) == set(I.NAMES) and "declared_expiry" not in a.open_
    late = spark.createDataFrame([("first_published", "2026-04-11", D(100) - dt.timedelta(hours=12)), ("first_published", "2026-04-12", D(100) + dt.timedelta(hours=12)), ("first_published", "t", D(100) + dt.timedelta(hours=1)), ("posting_state", "t", D(200))], "claim_type string, value string, source_event_at timestamp").withColumn("first_observed", F.lit(D(100)))
    assert [r.claim_type for r in I.guarded_publish(late).collect()] == ["first_published", "first_published", "publish_date_after_first_seen", "posting_state"]


def test_signatures_tell_nulls_apart_and_their_fillings_are_dealt_out(spark):
    from larkspur.operators import corpus as C

    cols = "case_id int, posting_state string, freeze_or_pause boolean, material_negative_event boolean, repost_pattern string, corroborating_hiring_signal boolean, publish_recency string, quality string, long_lived boolean, declared_expiry timestamp, last_material_event_at timestamp, last_refreshed_at timestamp"
    known = ("open", False, False, "none", False, "recent")
    rows = [(i, *(None if i >> k & 1 else v for k, v in enumerate(known)), q, None, None, None, None) for i, q in enumerate([*["strong"] * 32, *["", None] * 16])]
    df = spark.createDataFrame(rows, cols)
    out = C.could_change(df)
    alone = {r[0]: C.could_change(df.filter(F.col("case_id") == r[0])).first().could_change for r in rows[::13]}
    got = {r.case_id: r.could_change for r in out.collect()}
    assert len(got) == len(rows) and {i: got[i] for i in alone} == alone
    assert "hashpartitioning(__sig#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and f", {C.SIGNATURES}), REPARTITION_BY_NUM" in plan


def test_unknown_dates_are_questions_too(spark):
    from larkspur.operators import corpus as C

    cols = "case_id int, posting_state string, freeze_or_pause boolean, material_negative_event boolean, repost_pattern string, corroborating_hiring_signal boolean, publish_recency string, quality string, long_lived boolean, declared_expiry timestamp, last_material_event_at timestamp, last_refreshed_at timestamp, expiry_known boolean, events_searched boolean"
    rows = [(1, "reposted", False, False, "none", False, "recent", "strong", False, None, None, None, False, True), (2, "reposted", False, False, "none", False, "recent", "strong", False, None, None, None, True, True), (3, "open", False, True, "none", False, "recent", "strong", False, None, None, D(5), True, False), (4, "closed", None, None, None, None, None, "strong", None, None, None, None, False, False)]
    got = {r.case_id: set(r.could_change) for r in C.could_change(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: {"declared_expiry"}, 2: set(), 3: {"last_material_event_at"}, 4: set()}


def test_controller_runs_or_stops(spark):
    rows = spark.createDataFrame([(1, ["repost_pattern", "freeze_or_pause"], []), (2, [], []), (3, ["freeze_or_pause"], ["company_events"]), (4, ["freeze_or_pause", "material_negative_event", "repost_pattern"], [])], "case_id int, could_change array<string>, executed array<string>")
    out = routing.proposed(rows, {"repost_history": 1.0, "requirements_drift": 1.0, "company_events": 1.0, "team_signal": 1.0})
    got = {r.case_id: ([p.probe for p in r.proposed], r.s.verdict, r.s.probe, r.s.why) for r in out.withColumn("s", routing.next_step(F.lit(0.0), F.size("executed"), 4, 1.0)).collect()}
    assert got == {1: (["company_events", "repost_history"], "RUN", "company_events", None), 2: ([], "STOP", None, "no_unresolved_question"), 3: ([], "STOP", None, "no_eligible_candidate"), 4: (["company_events", "repost_history"], "RUN", "company_events", None)}
    assert out.select(routing.next_step(F.lit(0.5), F.lit(0), 4, 1.0)["why"]).first()[0] == "cost_cap"


def test_fitted_intervals_predict_within_their_support():
    import numpy as np

    left, right, mass = np.array([1.0, 4.0]), np.array([2.0, np.inf]), np.array([0.5, 0.5])
    assert [survival.interval_survival(left, right, mass, h) for h in (0.5, 1.5, 2.0, 9.0)] == [1.0, 0.75, 0.5, None]


def test_efficiency_counts_regret_and_recovery(spark):
    rows = [(["a", "b"], ["a"], "x", "y", "x"), (["a"], ["a", "c"], "x", "x", "y"), ([], [], "x", "y", "x")]
    df = spark.createDataFrame(rows, "A_probes array<string>, R_probes array<string>, A_action string, final string, settled string")
    r = metrics.efficiency(df, "A", "R", "settled", "final").first()
    assert (r.cases, r.reference_probes, r.probes, r.missed, r.extra, r.regret, r.recovered, r.spoiled) == (3, 3, 3, 1, 1, 1, 1, 2)


def test_small_operators_without_tables(spark):
    from larkspur.sources import boards

    links = spark.createDataFrame([("a", 1, 7, 0.8, 1.0, None), ("a", 1, 5, 0.9, 1.0, 1.0), ("a", 1, 4, 0.9, 0.9, None)], "company_id string, old_job_id int, new_job_id int, combined double, title_score double, description_score double")
    assert [(r.new_job_id, r.combined) for r in matching.best_link(links).collect()] == [(4, 0.9)]
    gate = metrics.product_gate(spark.createDataFrame([], "posting_id int, outcome_type string"), None, spark.createDataFrame([], "posting_id int, action string")).first()
    assert gate.status == "unproven" and gate.missing.startswith("no outcomes; no splits") and boards
    curve = spark.createDataFrame([(1.0, 0.9, 0.7, 1.0), (2.0, 0.5, 0.3, 0.8), (3.0, 0.4, 0.2, 0.5)], "time double, survival double, ci_low double, ci_high double")
    assert tuple(survival.median_interval(curve).first()) == (2.0, 2.0, 3.0)


def plain_controller(r, costs, waits, max_cost, max_wait, limit):
    """The rules one by one, as a person would apply them."""
    gives = routing.POPULATES
    done = {(e["probe"], e["args_hash"]) for e in r["executed"]}
    stop = lambda why, considered=(), rejected=(), ranking=(): ("stop", why, None, list(considered), list(rejected), list(ranking))
    if not r["could_change"]:
        return stop("no_unresolved_question")
    if r["steps_left"] <= 0:
        return stop("step_cap")
    if r["eligible"] is not None and all((p, r["hashes"].get(p)) in done for p in r["eligible"]):
        return stop("no_new_eligible_probe", sorted(r["eligible"]))
    if r["output"] is None:
        return stop("investigator_error", rejected=[("", "investigator_error")])
    if r["output"]["stop"]:
        return stop("investigator_stop")
    names = [(c["probe"], c["valid"]) for c in r["output"]["candidates"]]
    rejected, proposed, passed = [(n, "over_candidate_limit") for n, _ in names[limit:]], set(), []
    for n, valid in names[:limit]:
        if n not in gives:
            rejected.append((n, "unknown_probe"))
        elif r["eligible"] is None:
            rejected.append((n, "ineligible"))
        elif not valid:
            rejected.append((n, "invalid_args"))
        elif n not in r["eligible"]:
            rejected.append((n, "ineligible"))
        elif (n, r["hashes"].get(n)) in done or n in proposed:
            rejected.append((n, "duplicate"))
        elif not set(gives[n]) & set(r["could_change"]):
            rejected.append((n, "no_useful_input"))
        else:
            proposed.add(n)
            passed.append((len(set(gives[n]) & set(r["could_change"])) / costs[n], n))
    ranking = [(n, s) for s, n in sorted(passed, key=lambda x: (-x[0], x[1]))]
    considered = [n for n, _ in names[:limit]]
    if not ranking:
        return stop("no_eligible_candidate", considered, rejected)
    best = ranking[0][0]
    if r["spent_cost"] + costs[best] > max_cost:
        return stop("cost_cap", considered, [*rejected, (best, "budget_cost")], ranking)
    if r["spent_latency"] + waits[best] > max_wait:
        return stop("latency_cap", considered, [*rejected, (best, "budget_latency")], ranking)
    return ("run", "ranked_best", best, considered, rejected, ranking)


def test_controller_equals_its_rules_one_by_one(spark):
    rng = random.Random(8)
    probes, inputs = list(routing.POPULATES), sorted({x for v in routing.POPULATES.values() for x in v})
    rows = []
    for i in range(1500):
        hashes = {p: f"h{rng.randrange(3)}" for p in probes}
        executed = [{"probe": p, "args_hash": rng.choice([hashes[p], hashes[p], "old"])} for p in rng.sample(probes, rng.randrange(3))]
        eligible = None if rng.random() < 0.1 else rng.sample(probes, rng.choice([0, 1, 2, 3, 4, 4, 4]))
        output = None if rng.random() < 0.1 else {"stop": rng.random() < 0.1, "candidates": [{"probe": rng.choice([*probes, "nonsense"]), "valid": rng.random() < 0.8} for _ in range(rng.randrange(6))]}
        rows.append({"i": i, "could_change": rng.sample(inputs, rng.choice([0, 1, 2, 3, 4, 5])), "eligible": eligible, "executed": executed, "hashes": hashes, "steps_left": rng.choice([0, 1, 2, 3, 4]), "spent_cost": rng.choice([0.0, 0.0, 5.0]), "spent_latency": rng.choice([0.0, 0.0, 8.0]), "output": output})
    df = spark.createDataFrame(rows, "i int, could_change array<string>, eligible array<string>, executed array<struct<probe:string,args_hash:string>>, hashes map<string,string>, steps_left int, spent_cost double, spent_latency double, output struct<stop:boolean,candidates:array<struct<probe:string,valid:boolean>>>")
    costs, waits = {"repost_history": 1.0, "requirements_drift": 3.0, "company_events": 1.0, "team_signal": 3.0}, {"repost_history": 2.0, "requirements_drift": 5.0, "company_events": 2.0, "team_signal": 5.0}
    got = {r.i: r.d for r in df.select("i", controller.decision(costs, waits, 6.5, 9.5, 4).alias("d")).collect()}
    seen, refused = set(), set()
    for r in rows:
        d, want = got[r["i"]], plain_controller(r, costs, waits, 6.5, 9.5, 4)
        assert (d.decision, d.reason, d.probe, d.considered, [tuple(x) for x in d.rejected], [tuple(x) for x in d.ranking]) == want
        seen.add(d.reason)
        refused |= {x.reason for x in d.rejected}
    assert seen == {*controller.STOPS, "ranked_best"} and refused == {*controller.REFUSALS, "investigator_error"} - {"step_cap"}


def test_runs_of_other_shards_are_not_deleted(spark):
    runs = spark.createDataFrame([(1, "a", D(1)), (2, "a", None), (3, "b", D(1))], "run_id int, input_url string, replay_at timestamp")
    mine = spark.createDataFrame([("a", D(1)), ("a", None)], "input_url string, replay_at timestamp")
    doomed = sinks.deletable(runs, runs.filter("run_id < 3"), mine)
    assert sorted(r.run_id for r in doomed.collect()) == [1, 2] and [r.run_id for r in sinks.without(runs, doomed).collect()] == [3]
    with pytest.raises(ValueError):
        sinks.deletable(runs, runs.filter("run_id > 1"), mine)
    assert sinks.deletable(runs, runs).count() == 3


def test_marks_are_set_once(spark):
    steps = spark.createDataFrame([(1, 1, "x", 0.5), (1, 2, "y", 0.5), (2, 1, "held", None)], "run_id int, step_index int, decision_type string, cost double")
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id int")
    once = sinks.marked(steps, runs, "held")
    assert sorted((r.run_id, r.step_index, r.decision_type) for r in sinks.marked(once, runs, "held").collect()) == [(1, 1, "x"), (1, 2, "y"), (1, 3, "held"), (2, 1, "held"), (3, 1, "held")]


def test_rejected_candidates_are_limited_before_the_shuffle(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), i, rng.randrange(5), rng.randrange(20) / 20, rng.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "company_id int, old_job_id int, new_job_id int, combined double, passes boolean")
    got = matching.retained(df, 7)
    best = lambda xs, n: sorted(xs, key=lambda r: (-r[3], r[1], r[2]))[:n]
    want = [r for r in rows if r[4]] + [r for c in range(3) for r in best([x for x in rows if x[0] == c and not x[4]], 7)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and "WindowGroupLimit" in got._jdf.queryExecution().toString()
    assert [r.old_job_id for r in matching.ranked(got, 7).collect()] == [r[1] for r in best(rows, 7)]


def test_a_decision_computes_its_steps_once(spark):
    """What a decision is made of must not be repeated in the plan for each field that names it."""
    from larkspur.operators import controller

    c = spark.createDataFrame([], "could_change array<string>, eligible array<string>, executed array<struct<probe:string,args_hash:string>>, hashes map<string,string>, steps_left int, spent_cost double, spent_latency double, error string, output struct<stop:boolean,candidates:array<struct<probe:string,valid:boolean>>>")
    d = c.select(controller.decision({"company_events": 1.0}, {"company_events": 1.0}, 6.0, 9.0, 4).alias("d")).select("d.decision", "d.reason", "d.probe", "d.rejected", "d.ranking")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("invalid_args") == 1 and plan.count("array_intersect") <= 4


def test_fetch_keys_parse_a_record_once(spark):
    """All fetches of a record come from one parse of its text, in one scan of the records."""
    from larkspur.operators import tagged

    data = '{"ats":"greenhouse","tenant":"t","job_id":"7","canonical_url":"https://x/1"}'
    rows = spark.createDataFrame([(1, "resolve_posting", data), (2, "board_snapshot", data), (3, "resolve_posting", '{"ats":"lever", broken'), (4, "board_snapshot", '{"ats":5,"tenant":"t"}')], "record_id long, probe_name string, data string")
    keys = tagged.fetch_keys(rows)
    assert sorted((r.record_id, r.probe) for r in keys.collect()) == [(1, "json_ld"), (1, "resolve_posting"), (2, "board_snapshot")]
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1 and plan.count("LocalRelation") + plan.count("LogicalRDD") == 1


def test_leakage_audit_writes_no_tables(spark, tiny, monkeypatch):
    """The audit's parts read what they need: no copy of steps or evidence is written, and only the parts that need numbers sort by them."""
    from larkspur.plans import evaluation

    if hasattr(evaluation, "written"):
        monkeypatch.setattr(evaluation, "written", lambda df: pytest.fail("written"))
    plan = evaluation.leakage_audit(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") <= 4


def test_cached_joins_only_asks_whose_latest_response_expired(spark):
    """Asks that their latest response answers, or that none answers, aren't shuffled for the older ones."""
    from larkspur.operators import corpus

    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    cache = spark.createDataFrame([("p", day(1), day(9), "long"), ("p", day(2), day(3), "short"), ("p", day(12), day(14), "late")], "k string, fetched_at string, expires_at string, response string")
    asks = spark.createDataFrame([(1, "p", day(2)), (2, "p", day(5)), (3, "p", day(10)), (4, "p", day(13)), (5, "q", day(5)), (6, "p", None), (7, None, day(5))], "n int, k string, at string")
    stamps = lambda df, *cols: df.withColumns({c: F.col(c).cast("timestamp") for c in cols})
    found = corpus.cached(stamps(asks, "at"), stamps(cache, "fetched_at", "expires_at"), ["k"], "at")
    assert {r.n: r.response for r in found.collect()} == {1: "short", 2: "long", 3: None, 4: "late", 5: None, 6: None, 7: None}
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
