"""Datasets of cases at many moments: planning, the state of each case at its moment, the records it was built from, and their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import UTC_TEXT, days_between, grid, stable_key, utc_text
from larkspur.operators import changes, claims, features, moments, policy
from larkspur.operators import inputs as policy_inputs
from larkspur.operators.intervals_join import shifted
from larkspur.operators.running import running
from larkspur.session import merged, written
from larkspur.sources import sinks

# The probe of refresh matches, what it takes as an update, and placeholder addresses of jobs known from listings alone.
REFRESH_PROBE, UPDATES, NO_ADDRESS = "refresh_match", ("updated_at", "last_published"), "archive-only:"
#: The order in which the probes of a case run; its evidence is numbered so.
ORDER = [claims.BOARD_STATE_PROBE, REFRESH_PROBE, policy_inputs.EVENTS_PROBE, policy_inputs.TEAM_PROBE, claims.REPOST_PROBE]


def planned(postings: DataFrame, splits: DataFrame, split: str, now: Column, step_days: int = 30, excluded: DataFrame | None = None, windows: DataFrame | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """Cases of the postings (company_id, job_id, url, first_observed, first_seen_absent) of a split: case_id, company_id, job_id, url, replay_at, split, order.

    Postings without a first sighting or a fetchable address have no cases, nor have those of excluded companies (taken out before the limit, so they cost no
    place). Companies take turns: each one's postings in the seed's stable order, larger companies first within a turn; limit is one of postings.
    Moments run from the first sighting, every step_days, to the absence or now; moments inside a window of a run move to its end.
    """
    rows = postings.filter(F.col("first_observed").isNotNull() & F.col("url").isNotNull() & ~F.startswith("url", F.lit(NO_ADDRESS)))
    rows = rows.join(splits.filter(F.col("split") == split).select("job_id", "split"), "job_id")
    if excluded is not None:
        rows = rows.join(excluded.select("company_id").distinct(), "company_id", "left_anti")
    rows = rows.withColumn("__key", stable_key(seed, "job_id"))
    # a company's turns are counted in stretches of its stable order
    rows = running(rows.withColumn("__one", F.lit(1)), ["company_id"], [F.col("__key")], F.conv(F.substring("__key", 1, 2), 16, 10).cast("int"), {"turn": ("sum", "__one")})
    sizes = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("__size"))
    rows = rows.join(sizes, "company_id").withColumn("order", F.struct("turn", (-F.col("__size")).alias("size"), "company_id"))
    if limit is not None:
        rows = rows.orderBy("order").limit(limit)
    end = F.least(now, F.coalesce("first_seen_absent", now))
    out = rows.select("company_id", "job_id", "url", "split", "order", F.explode(grid("first_observed", end, step_days)).alias("replay_at"))
    if windows is not None:
        moved = out.select("replay_at").distinct().withColumn("__all", F.lit(0))
        moved = shifted(moved, windows.withColumn("__all", F.lit(0)), ["__all"], "replay_at").select("replay_at", "shifted_at")
        out = out.join(moved, "replay_at").drop("replay_at").withColumnRenamed("shifted_at", "replay_at").distinct()
    return out.withColumn("case_id", F.concat_ws("/", "company_id", "job_id", utc_text("replay_at")))


def refresh_claims(cases: DataFrame, stated: DataFrame, versions: DataFrame, tolerance_days: int = 3) -> DataFrame:
    """The latest stated update of each case that coincides with a change of content seen by its moment. stated: claims with a date of UPDATES. versions: company_id, job_id, id, captured_at, content_hash."""
    found = changes.changes(versions, ["company_id", "job_id"], ["captured_at", "id"], "content_hash", "captured_at")
    seen = cases.select("case_id", "company_id", "job_id", "replay_at").join(found, ["company_id", "job_id"]).filter(F.col("changed_by") <= F.col("replay_at"))
    dates = stated.filter(F.col("claim_type").isin(*UPDATES) & (F.col("source_quality") == claims.NATIVE) & F.col("source_event_at").isNotNull())
    match = changes.refreshes(dates.select("case_id", F.col("source_event_at").alias("stated_at")), seen.select("case_id", "changed_after", "changed_by"), ["case_id"], tolerance_days)
    first = dates.groupBy("case_id", F.col("source_event_at").alias("refreshed_at")).agg(F.min(F.struct("available_at", "source_url")).alias("__a"))
    rows = match.join(first, ["case_id", "refreshed_at"]).join(cases.select("case_id", "replay_at"), "case_id")
    at = F.greatest("__a.available_at", "detected_by")
    return rows.select(*claims.claim(F.col("case_id"), REFRESH_PROBE, F.lit(policy_inputs.REFRESHED), utc_text("refreshed_at"), F.lit(claims.NATIVE), F.col("refreshed_at"), at, F.lit(None), F.col("__a.source_url"), F.col("replay_at")))


def evidence_at(cases: DataFrame, captures: DataFrame, listings: DataFrame, intervals: DataFrame, stated: DataFrame, windows: DataFrame, events: DataFrame, versions: DataFrame, new_days: int = 30, closure_days: int = 60, min_history_days: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(cases with their lifecycles and coverage, evidence): all that the board, its dates, the team and the events say of each case at its moment.

    cases: case_id, company_id, job_id, team_key, ats, replay_at, searched_at. intervals are the lifecycles of captures and listings; these three are read by
    several steps, so hand them in as tables that are not computed again. No claim is kept that wasn't available at the moment; stated first publications behind
    the first sighting (as late as that may have been) are told apart. Evidence is numbered within each case.
    """
    cases = merged(written(cases))
    seen = merged(written(moments.coverage_at(moments.lifecycles_at(cases, captures, listings, intervals), captures)))
    dated = claims.stated_claims(moments.stated_dates_at(cases, captures, stated)).unionByName(claims.inferred_claims(moments.first_publications(seen, captures, stated, windows)))
    bound = moments.guard_bound(seen.select("case_id", F.col("first_observed").alias("__f")), "__f", windows, "first_observed").drop("__f")
    dated = merged(written(policy_inputs.guarded_publish(dated.join(bound, "case_id", "left")).select(*claims.COLUMNS)))
    team = moments.team_at(cases, intervals, new_days, closure_days).join(seen.select("case_id", "history_days", "history_coverage", "last_capture_at"), "case_id")
    team = team.withColumn("verdict", features.team_verdict(min_history_days=min_history_days))
    parts = (claims.board_claims(seen), dated, refresh_claims(cases, dated, versions), claims.team_claims(team), claims.event_claims(cases, events), claims.repost_claims(seen, captures, min_history_days))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    held = found.join(cases.select("case_id", F.col("replay_at").alias("__t")), "case_id").filter(F.col("available_at") <= F.col("__t")).drop("__t")
    return seen, claims.numbered(merged(written(held)), ORDER)


def case_states(seen: DataFrame, evidence: DataFrame, history: DataFrame | None = None, long_lived_days: int = 180) -> DataFrame:
    """seen with the policy's inputs, evidence quality, branch and action of each case, from its evidence alone. history: case_id, repost_pattern."""
    cases = seen.withColumn("resolver_ok", F.lit(False))
    rows = policy_inputs.policy_inputs(cases, evidence, history)
    odd = policy.contradictions(evidence.withColumnRenamed("case_id", "run_id")).select(F.col("run_id").alias("case_id"), (F.col("publish_date_conflict") | F.col("open_but_absent")).alias("contradiction"))
    rows = rows.join(odd, "case_id", "left").withColumn("failures", F.lit(0))
    rows = rows.withColumn("long_lived", days_between("replay_at", F.least("first_observed", "first_published")) >= long_lived_days)
    return policy.decided(rows.withColumn("quality", policy.evidence_quality()["quality"]))


def args_hash(probe: str, **args: Column) -> Column:
    """The key of a probe's call: SHA-256 of its canonical JSON (names sorted, no spaces). Arguments are ASCII texts."""
    names = sorted(args)
    inside = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":"'), args[n].cast("string"), F.lit('"')) for n in names])
    return F.sha2(F.concat(F.lit('{"args":{'), inside, F.lit(f'}},"probe":"{probe}"}}')), 256)


def records(dataset_id: str, cases: DataFrame, evidence: DataFrame, observed_at: Column) -> DataFrame:
    """What each probe of ORDER said of each case, one row a call, also where it said nothing: dataset_id, posting_id, replay_at, probe_name, args_hash, observed_at, ok, claims, data (JSON)."""
    each = cases.select("case_id", "company_id", "job_id", "replay_at", F.explode(F.array(*map(F.lit, ORDER))).alias("probe"))
    said = evidence.groupBy("case_id", "probe").agg(F.sort_array(F.collect_list(F.struct(F.substring("evidence_id", 2, 18).cast("long").alias("n"), *[c for c in claims.COLUMNS if c not in ("case_id", "probe")]))).alias("__c"), F.count(F.lit(1)).alias("__n"))
    rows = each.join(said, ["case_id", "probe"], "left")
    posting = F.concat_ws("/", "company_id", "job_id")
    call = F.coalesce(*[F.when(F.col("probe") == p, args_hash(p, posting_id=posting, replay_at=utc_text("replay_at"))) for p in ORDER])
    data = F.to_json(F.struct(posting.alias("posting_id"), utc_text("replay_at").alias("replay_at"), utc_text(observed_at).alias("observed_at"), F.col("__c").isNotNull().alias("observable"), F.coalesce("__c", F.array()).alias("evidence")), {"timestampFormat": UTC_TEXT})
    return rows.select(F.lit(dataset_id).alias("dataset_id"), posting.alias("posting_id"), "replay_at", F.col("probe").alias("probe_name"), call.alias("args_hash"), observed_at.alias("observed_at"), F.lit(True).alias("ok"), F.coalesce("__n", F.lit(0)).cast("int").alias("claims"), data.alias("data"))


def header(dataset_id: str, cases: DataFrame, found: DataFrame, evidence: DataFrame, created_at: Column, split_kind: str, split_name: str, step_days: int) -> DataFrame:
    """One row that says what a dataset holds: postings, companies, cases, records, cases with a board state and with a stated first publication. found: its records."""
    held = cases.agg(F.countDistinct("company_id", "job_id").alias("postings"), F.countDistinct("company_id").alias("companies"), F.count(F.lit(1)).alias("cases"))
    probes = found.agg(F.count(F.lit(1)).alias("probe_records"), F.count_if(F.col("probe_name") == claims.BOARD_STATE_PROBE).alias("board_state_records"))
    kinds = evidence.filter(F.col("probe") == claims.BOARD_STATE_PROBE)
    with_ = kinds.agg(F.countDistinct(F.when(F.col("claim_type") == policy_inputs.STATE, F.col("case_id"))).alias("cases_with_board_state"), F.countDistinct(F.when(F.col("claim_type") == policy_inputs.FIRST_PUBLISHED, F.col("case_id"))).alias("cases_with_publish_date"))
    # one row each
    held, probes, with_ = (x.withColumn("__one", F.lit(1)) for x in (held, probes, with_))
    rows = held.join(probes, "__one").join(with_, "__one").drop("__one")
    return rows.select(F.lit(dataset_id).alias("dataset_id"), created_at.alias("created_at"), F.lit(split_kind).alias("split_kind"), F.lit(split_name).alias("split_name"), F.lit(step_days).alias("grid_step_days"), *rows.columns)


def store(path: str, cases: DataFrame, found: DataFrame, head: DataFrame) -> None:
    """Write a dataset's cases, records and header under path; all have dataset_id. Building a dataset again replaces its partitions and leaves other datasets alone; the header comes last, so what has one is complete."""
    for name, rows in (("cases", cases), ("records", found), ("datasets", head)):
        sinks.rebuild(rows, f"{path}/{name}", "dataset_id")
