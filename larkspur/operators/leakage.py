"""The leakage audit: rows that let a run see past its moment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import prefix_argument
from larkspur.operators.inputs import EVENT_CLAIMS


def after_moment(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence that became available after its run's moment."""
    rows = evidence.join(runs.select("run_id", "replay_at"), "run_id").filter(F.col("available_at") > F.col("replay_at"))
    return rows.select(F.lit("evidence_after_t").alias("kind"), "run_id", F.col("evidence_id").cast("string").alias("item"))


def fetched_after(evidence: DataFrame, cache: DataFrame, runs: DataFrame, hours: int = 24) -> DataFrame:
    """Evidence whose value was first fetched after the run's moment: no cached response was valid when it claims to be available, and the first one within the hours after is later than the moment.

    cache: probe, fetched_at, expires_at. Claims and responses are merged in a sorted window of each probe and stretch of so many
    hours; what earlier and later stretches hold comes from one row a stretch, so no claim meets the responses one by one.
    """
    claims = evidence.join(runs.select("run_id", "replay_at"), "run_id").filter(F.col("available_at").isNotNull() & F.col("probe").isNotNull())
    claims = claims.select("probe", F.col("available_at").alias("at"), F.lit(1).alias("is_claim"), "run_id", "evidence_id", "replay_at")
    # a response stands where it is fetched, or where it expires if that is before
    held = cache.filter(F.col("fetched_at").isNotNull() & F.col("expires_at").isNotNull() & F.col("probe").isNotNull())
    held = held.select("probe", F.least("fetched_at", "expires_at").alias("at"), F.lit(0).alias("is_claim"), "fetched_at", "expires_at")
    both = claims.unionByName(held, allowMissingColumns=True).withColumn("stretch", F.floor(F.unix_micros("at") / F.lit(hours * 3_600_000_000)))
    # what follows is what precedes in falling order: a frame to the end would be read anew for every row
    past = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("probe", "stretch").agg(F.max("expires_at").alias("e"), F.min("fetched_at").alias("f"))
    ends = ends.select("probe", "stretch", F.max("e").over(past(["probe"], "stretch")).alias("before"), F.min("f").over(past(["probe"], F.desc("stretch"))).alias("after"))
    keys = ["probe", "stretch"]
    merged = both.withColumn("until", F.max("expires_at").over(past(keys, "at", "is_claim"))).withColumn("first", F.min("fetched_at").over(past(keys, F.desc("at"), F.desc("is_claim"))))
    merged = merged.filter("is_claim = 1").join(ends, keys)
    follows = F.least("first", "after")
    near = merged.select("run_id", "evidence_id", "replay_at", F.coalesce(F.greatest("until", "before") > F.col("at"), F.lit(False)).alias("valid"), F.when(follows <= F.col("at") + F.expr(f"interval {hours} hours"), follows).alias("next"))
    found = near.groupBy("run_id", "evidence_id", "replay_at").agg(F.bool_or("valid").alias("valid"), F.min("next").alias("next"))
    rows = found.filter(~F.col("valid") & (F.col("next") > F.col("replay_at")))
    return rows.select(F.lit("evidence_fetched_after_t").alias("kind"), "run_id", F.col("evidence_id").cast("string").alias("item"))


DAY = 86_400_000_000
# The inputs that a branch of the decision table proves decided, and the claims that may decide each.
EVENT_BACKING = ("company_events_searched", *EVENT_CLAIMS)
BACKING = {
    "posting_state": ("posting_state",), "freeze_or_pause": EVENT_BACKING, "declared_expiry": ("declared_expiry",), "material_negative_event": EVENT_BACKING,
    "corroborating_hiring_signal": ("corroborating_hiring_signal",), "publish_recency": ("first_published", "refreshed_at"), "last_material_event_at": EVENT_BACKING,
}
PROVES = {
    "P1_closed": ("posting_state",), "P3a_freeze_or_pause": ("posting_state", "freeze_or_pause"), "P3b_declared_expiry_unresolved": ("posting_state", "declared_expiry"), "P3c_material_event_unrefreshed": ("posting_state", "material_negative_event"),
    "P4_repeated_repost": ("posting_state", "corroborating_hiring_signal"), "P5_open_recent_strong": ("posting_state", "publish_recency"), "P5b_hiring_activity": ("posting_state", "corroborating_hiring_signal"), "P6_active_mixed_or_weak": ("posting_state",), "P7_default": ("posting_state",),
}
# What a probe's stored record may answer.
EXPOSES = {"team_signal": ("corroborating_hiring_signal",), "company_events": ("material_negative_event", "freeze_or_pause", "last_material_event_at")}


def days_of(a: str, b: str) -> Column:
    """The days that [a, b) touches."""
    return F.explode(F.sequence(F.floor(F.unix_micros(a) / F.lit(DAY)), F.floor((F.unix_micros(b) - 1) / F.lit(DAY))))


def capture_fetched_after(runs: DataFrame, captures: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs (run_id, company_id, replay_at) that read an own capture stamped with the start of a snapshot run that ended after their moment.

    windows: started_at, finished_at. Captures meet windows, and runs meet captures, on the days that these touch; nothing is broadcast.
    """
    day = lambda c: F.floor(F.unix_micros(c) / F.lit(DAY)).alias("__day")
    held = windows.filter("finished_at > started_at").select("started_at", "finished_at", days_of("started_at", "finished_at").alias("__day"))
    own = captures.filter("source = 'own'").select("company_id", "captured_at", day("captured_at"))
    stamped = own.join(held, "__day").filter((F.col("captured_at") >= F.col("started_at")) & (F.col("captured_at") < F.col("finished_at")))
    stamped = stamped.groupBy("company_id", "captured_at").agg(F.max("finished_at").alias("finished_at"))
    open_ = stamped.select("company_id", "captured_at", "finished_at", days_of("captured_at", "finished_at").alias("__day"))
    rows = runs.select("run_id", "company_id", "replay_at", day("replay_at")).join(open_, ["company_id", "__day"]).filter((F.col("captured_at") <= F.col("replay_at")) & (F.col("replay_at") < F.col("finished_at")))
    return rows.groupBy("run_id").agg(F.min("captured_at").alias("at")).select(F.lit("capture_fetched_after_t").alias("kind"), "run_id", F.col("at").cast("string").alias("item"))


def cache_misses(steps: DataFrame, model: bool = False) -> DataFrame:
    """Steps that reached the network. Misses of a model's cache are counted apart: they aren't violations."""
    own = F.col("component") == "model"
    rows = steps.filter((F.col("cache_status") == "miss") & (own if model else ~F.coalesce(own, F.lit(False))))
    return rows.select(F.lit("model_cache_miss" if model else "cache_miss").alias("kind"), "run_id", F.col("step_index").cast("string").alias("item"))


def violations(steps: DataFrame, kind: str) -> DataFrame:
    """Steps that recorded a violation of a kind: net_call or missing_probe_result."""
    return steps.filter(F.col("decision_type") == f"replay_violation:{kind}").select(F.lit(kind).alias("kind"), "run_id", F.col("step_index").cast("string").alias("item"))


def missing_moment(runs: DataFrame) -> DataFrame:
    return runs.filter("replay_at is null").select(F.lit("missing_replay_at").alias("kind"), "run_id", F.lit(None).cast("string").alias("item"))


def backed(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """run_id, claim_type of what evidence each run holds that was available at its moment."""
    rows = evidence.join(runs.select("run_id", "replay_at"), "run_id").filter(F.col("available_at") <= F.col("replay_at"))
    return rows.filter(F.col("claim_type").isin(*sorted({c for cs in BACKING.values() for c in cs}))).select("run_id", "claim_type").distinct()


def backing_of(input_: Column) -> Column:
    """The claims that may decide an input: a constant table of seven rows, folded into the plan."""
    out = F.array().cast("array<string>")
    for name, claims in BACKING.items():
        out = F.when(input_ == name, F.array(*map(F.lit, claims))).otherwise(out)
    return out


def without_backing(wanted: DataFrame, runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of wanted (run_id, input), each once, those that no available evidence of the run backs."""
    pairs = wanted.distinct()
    claims = pairs.withColumn("claim_type", F.explode(backing_of(F.col("input"))))
    found = claims.join(backed(runs, evidence), ["run_id", "claim_type"], "left_semi").select("run_id", "input").distinct()
    return pairs.join(found, ["run_id", "input"], "left_anti")


def unbacked_inputs(steps: DataFrame, runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Branches that the controller recorded (policy_decision:branch) and that prove an input decided without evidence that was available."""
    branch = F.get(F.split(prefix_argument("decision_type", "policy_decision"), ":"), F.lit(0))
    proved = F.array().cast("array<string>")
    for name, inputs in PROVES.items():
        proved = F.when(F.col("branch") == name, F.array(*map(F.lit, inputs))).otherwise(proved)
    known = runs.filter("replay_at is not null").select("run_id")
    rows = steps.filter("component = 'controller'").select("run_id", branch.alias("branch")).filter("branch is not null").distinct().join(known, "run_id", "left_semi")
    rows = without_backing(rows.select("run_id", F.explode(proved).alias("input")), runs, evidence)
    return rows.select(F.lit("input_without_evidence").alias("kind"), "run_id", F.col("input").alias("item"))


def is_decided(data: Column, key: str) -> Column:
    """Whether a JSON record answers a question: the key holds a scalar, neither null nor an object or list."""
    value = F.trim(F.get_json_object(data, f"$.{key}"))
    return F.coalesce((value != "null") & ~F.startswith(value, F.lit("{")) & ~F.startswith(value, F.lit("[")), F.lit(False))


def exposed_inputs(executed: DataFrame, records: DataFrame, runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """run_id, item: inputs that a stored record answers though no available evidence of the run does. Counted, not a violation: the policy doesn't read records.

    executed: run_id, posting_id, replay_at, probe_name, args_hash. records: posting_id, replay_at, probe_name, args_hash, ok, data (JSON).
    """
    keys = ["posting_id", "replay_at", "probe_name", "args_hash"]
    rows = executed.distinct().join(records.filter("ok").select(*keys, "data"), keys)
    answers = [F.when((F.col("probe_name") == p) & is_decided(F.col("data"), k), F.lit(k)) for p, ks in EXPOSES.items() for k in ks]
    wanted = rows.select("run_id", F.explode(F.filter(F.array(*answers), lambda x: x.isNotNull())).alias("input"))
    return without_backing(wanted, runs, evidence).select("run_id", F.col("input").alias("item"))


def itemized(rows: DataFrame, most: int = 50) -> DataFrame:
    """A report of at most `most` violations, in order; counts come from audit, which is complete."""
    return rows.orderBy("kind", "run_id", "item").limit(most)


def audit(parts: list[DataFrame]) -> DataFrame:
    """Violations by kind: how many, in how many runs."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("kind").agg(F.count("*").alias("violations"), F.countDistinct("run_id").alias("runs"))
