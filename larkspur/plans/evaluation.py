"""Queries over events, runs, steps, evidence and cases: policy, pairing, metrics, leakage, learning.

Orders stand for runs: three consecutive orders share a case, one for each of the systems A, B and R.
Line items stand for steps and evidence of their order's run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import asof, leakage, metrics, policy
from larkspur.operators import controller, corpus, routing
from larkspur.operators import inputs as I
from larkspur.operators import ranker as ranking
from larkspur.operators.running import at_moments
from larkspur.session import table

ACTIONS = "CASE o_totalprice_bucket % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'wait' WHEN 2 THEN 'apply_now' ELSE 'quick_apply' END"


def ctes(dialect: str) -> str:
    """runs, steps, evidence and company events, in either dialect."""
    spark = dialect == "spark"
    orders, lineitem = ("{orders}", "{lineitem}") if spark else ("orders", "lineitem")
    ts = lambda c: f"CAST({c} AS TIMESTAMP)"
    plus = lambda c, n: f"{ts(c)} + make_dt_interval(CAST({n} AS INT))" if spark else f"{ts(c)} + to_days(CAST({n} AS INT))"
    div = lambda a, b: f"CAST(floor({a} / {b}) AS BIGINT)"
    return f"""
run AS (SELECT o_orderkey AS run_id, {div("o_orderkey", "3.0")} AS case_id, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'R' END AS system,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {plus("TIMESTAMP '1998-01-01'", div("o_orderkey", "3.0") + " % 900")} END AS replay_at, {ts("o_orderdate")} AS started_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE {div("o_totalprice", "50000.0")} % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'wait' WHEN 2 THEN 'apply_now' ELSE 'quick_apply' END AS action, {div("o_custkey", "10.0")} AS company_id FROM {orders}),
step AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS step_index, CASE l_returnflag WHEN 'A' THEN 'probe' WHEN 'N' THEN 'controller' ELSE 'model' END AS component,
  'probe' || CAST(l_suppkey % 6 AS {"STRING" if spark else "VARCHAR"}) AS probe_name, l_partkey % 4 AS args_hash, CASE WHEN l_linestatus = 'O' THEN 'hit' ELSE 'miss' END AS cache_status, l_discount AS cost_usd, l_tax AS latency_s,
  CASE WHEN l_quantity > 47 THEN 'replay_violation:missing_probe_result' WHEN l_quantity > 45 THEN 'replay_violation:net_call' WHEN l_quantity > 20 THEN 'policy_decision:P' || CAST(l_linenumber AS {"STRING" if spark else "VARCHAR"}) ELSE 'model_call:tokens=' || CAST(l_partkey AS {"STRING" if spark else "VARCHAR"}) || '/12' END AS decision_type FROM {lineitem}),
evidence AS (SELECT l_orderkey AS run_id, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS evidence_id, 'probe' || CAST(l_suppkey % 7 AS {"STRING" if spark else "VARCHAR"}) AS probe,
  CASE l_linenumber % 4 WHEN 0 THEN 'first_published' WHEN 1 THEN 'posting_state' WHEN 2 THEN 'board_absent' ELSE 'event' END AS claim_type, CASE WHEN l_partkey % 3 = 0 THEN 'closed' ELSE ' Open ' END AS value,
  CASE l_suppkey % 3 WHEN 0 THEN 'ats_native' WHEN 1 THEN 'page_structured' ELSE 'archive' END AS source_quality, 'u' || CAST(l_suppkey % 5 AS {"STRING" if spark else "VARCHAR"}) AS source_url,
  {ts("l_shipdate")} AS available_at, {plus("l_shipdate", "l_linenumber")} AS fetched_at, CASE WHEN l_partkey % 6 <> 0 THEN {plus("l_shipdate", "l_partkey % 9 - 4")} END AS source_event_at FROM {lineitem}),
event AS (SELECT {div("o_custkey", "10.0")} AS company_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'layoff' WHEN '2-HIGH' THEN 'hiring_freeze' WHEN '3-MEDIUM' THEN 'funding' WHEN '4-NOT SPECIFIED' THEN 'expansion' ELSE 'other' END AS event_type,
  {ts("o_orderdate")} AS event_at, {plus("o_orderdate", "o_orderkey % 20")} AS available_at, CASE WHEN o_orderkey % 4 = 0 THEN 'minor' ELSE 'material' END AS materiality FROM {orders}),
claim AS (SELECT l_orderkey AS case_id, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS evidence_id,
  CASE (l_partkey + l_linenumber) % 8 WHEN 1 THEN 'board_snapshot' WHEN 3 THEN 'case' WHEN 5 THEN 'team_signal' WHEN 6 THEN 'company_events' WHEN 7 THEN 'company_events' ELSE 'resolve_posting' END AS probe,
  CASE (l_partkey + l_linenumber) % 8 WHEN 2 THEN 'first_published' WHEN 3 THEN 'refreshed_at' WHEN 4 THEN 'declared_expiry' WHEN 5 THEN 'corroborating_hiring_signal' WHEN 6 THEN 'company_events_searched'
   WHEN 7 THEN CASE l_suppkey % 4 WHEN 0 THEN 'layoff' WHEN 1 THEN 'hiring_freeze' WHEN 2 THEN 'funding' ELSE 'shutdown' END ELSE 'posting_state' END AS claim_type,
  CASE (l_partkey + l_linenumber) % 8 WHEN 5 THEN CASE l_suppkey % 3 WHEN 0 THEN 'True ' WHEN 1 THEN 'no' ELSE 'maybe' END WHEN 7 THEN CASE l_suppkey % 5 WHEN 0 THEN 'minor: a' WHEN 1 THEN 'Material : b' ELSE 'cuts: c' END
   ELSE CASE l_suppkey % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'Reposted ' WHEN 2 THEN 'bogus' ELSE ' Open' END END AS value,
  CASE l_suppkey % 3 WHEN 0 THEN 'ats_native' WHEN 1 THEN 'page_structured' ELSE 'archive' END AS source_quality, {ts("l_shipdate")} AS available_at, {plus("l_shipdate", "l_linenumber")} AS fetched_at,
  CASE WHEN l_partkey % 6 <> 0 THEN {plus("l_shipdate", "l_partkey % 60 - 50")} END AS source_event_at FROM {lineitem}),
asked AS (SELECT o_orderkey AS case_id, {plus("o_orderdate", "75")} AS replay_at, o_orderkey % 5 <> 0 AS resolver_ok FROM {orders})"""


DUCK = ctes("duck")


def part(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.sql(f"WITH {ctes('spark')} SELECT * FROM {name}", orders=table(spark, sf, "orders"), lineitem=table(spark, sf, "lineitem"))


def latest(spark: SparkSession, sf: str) -> DataFrame:
    # every fifth run repeats its case, so that there are duplicates
    runs = part(spark, sf, "run").withColumn("case_id", F.when(F.col("run_id") % 5 == 0, F.floor(F.col("case_id") / 2)).otherwise(F.col("case_id")))
    return metrics.latest_by_case(runs.filter("status = 'completed'"), ["case_id"], ["started_at", "run_id"])


LATEST = f"{DUCK}, cr AS (SELECT * REPLACE (CASE WHEN run_id % 5 = 0 THEN CAST(floor(case_id / 2) AS BIGINT) ELSE case_id END AS case_id) FROM run WHERE status = 'completed'), lat AS (SELECT *, count(*) OVER (PARTITION BY system, case_id) - 1 AS duplicates FROM cr QUALIFY row_number() OVER (PARTITION BY system, case_id ORDER BY started_at DESC, run_id DESC) = 1)"
PAIRS = f"{LATEST}, par AS (SELECT case_id, max(action) FILTER (system = 'A') AS \"A\", max(action) FILTER (system = 'B') AS \"B\", max(action) FILTER (system = 'R') AS \"R\" FROM lat GROUP BY case_id)"


def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return latest(spark, sf).select("system", "case_id", "run_id", "action", "duplicates")


def pairs_of(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.paired(latest(spark, sf), ["case_id"], ["A", "B", "R"], "action")


def paired_cases(spark: SparkSession, sf: str) -> DataFrame:
    return pairs_of(spark, sf)


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs_of(spark, sf)
    out = [metrics.agreement(metrics.compared(rows, "A", s), "A", s).withColumn("system", F.lit(s)) for s in ("B", "R")]
    return out[0].unionByName(out[1]).select("system", "compared", F.round("agreement", 6).alias("agreement"), F.round("macro_agreement", 6).alias("macro_agreement"))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(pairs_of(spark, sf), "A", "B")


def value_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.compared(pairs_of(spark, sf), "A", "B", "R").withColumn("B_probes", F.col("case_id") % 4).withColumn("R_probes", F.col("case_id") % 5)
    out = metrics.value_comparison(rows, "A", "B", "R")
    return out.select("compared", "only_candidate", "only_plain", "status", *[F.round(c, 6).alias(c) for c in ("relative_saving", "candidate_agreement", "plain_agreement", "candidate_macro", "plain_macro")])


def probe_dependence(spark: SparkSession, sf: str) -> DataFrame:
    """The decision with all evidence against the one without what dynamic probes give."""
    rows = inputs(spark, sf)
    bare = rows
    for c in ("repost_pattern", "corroborating_hiring_signal", "long_lived", "freeze_or_pause", "material_negative_event", "last_material_event_at"):
        bare = bare.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    both = policy.decided(rows).select("case_id", F.col("action").alias("actual")).join(policy.decided(bare).select("case_id", F.col("action").alias("bare")), "case_id")
    return metrics.dependence(both, "actual", "bare")


def exclusive_gains(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.exclusive_gains(pairs_of(spark, sf), "A", "B", "R")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("probe0", "low"), ("probe1", "low"), ("probe2", "medium"), ("probe3", "medium"), ("probe4", "high")], "probe_name string, tier string")


def step_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.step_metrics(part(spark, sf, "run"), part(spark, sf, "step"), tiers(spark))
    return out.select("system", "runs", "low_probes", "medium_probes", "high_probes", "hits", "probes", "repeats", F.round("cost_usd", 4).alias("cost_usd"), F.round("latency_s", 4).alias("latency_s"), F.round("probes_per_run", 6).alias("probes_per_run"))


def probe_order(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.probe_order(part(spark, sf, "step")).select("run_id", F.array_join("probes", ">").alias("probes"))


def unnecessary_steps(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.unnecessary_steps(part(spark, sf, "step"), part(spark, sf, "evidence"))


def citation_support(spark: SparkSession, sf: str) -> DataFrame:
    reasons = part(spark, sf, "step").select("run_id", F.col("step_index").alias("reason_index"), F.when(F.col("step_index") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("run_id") * 1000 + F.col("step_index"), F.col("run_id") * 1000 + 3)).alias("evidence_ids"))
    out = metrics.citation_support(reasons, part(spark, sf, "evidence"))
    return out.withColumn("support_rate", F.round("support_rate", 6))


def branch_counts(spark: SparkSession, sf: str) -> DataFrame:
    from larkspur.functions.scalars import prefix_argument

    return part(spark, sf, "step").withColumn("branch", prefix_argument("decision_type", "policy_decision")).filter("branch is not null").groupBy("branch").agg(F.count("*").alias("n"))


def token_sums(spark: SparkSession, sf: str) -> DataFrame:
    got = F.regexp_extract("decision_type", "^model_call:tokens=([0-9]+)/([0-9]+)$", 1)
    rows = part(spark, sf, "step").filter(got != "")
    return rows.groupBy("component").agg(F.sum(got.cast("long")).alias("tokens_in"), F.sum(F.regexp_extract("decision_type", "/([0-9]+)$", 1).cast("long")).alias("tokens_out"))


def event_signals(spark: SparkSession, sf: str) -> DataFrame:
    cases = part(spark, sf, "run").filter("system = 'A' and replay_at is not null").select("case_id", "company_id", "replay_at", (F.col("case_id") % 11 != 0).alias("searched"))
    return policy.event_signals(cases, part(spark, sf, "event"), 30).select("case_id", "material_negative_event", "freeze_or_pause", "last_material_event_at")


def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return policy.contradictions(part(spark, sf, "evidence"))


INPUTS = {
    "posting_state": "CASE case_id % 7 WHEN 0 THEN 'closed' WHEN 1 THEN NULL WHEN 2 THEN 'unknown' WHEN 3 THEN 'reposted' ELSE 'open' END",
    "failures": "CASE WHEN case_id % 23 = 0 THEN 1 ELSE 0 END",
    "primary_publish": "case_id % 13 <> 0",
    "contradiction": "case_id % 9 = 0",
    "freeze_or_pause": "CASE WHEN case_id % 17 = 0 THEN NULL ELSE case_id % 19 = 0 END",
    "material_negative_event": "CASE WHEN case_id % 17 = 0 THEN NULL ELSE case_id % 5 = 0 END",
    "long_lived": "CASE WHEN case_id % 3 = 0 THEN NULL ELSE case_id % 2 = 0 END",
    "repost_pattern": "CASE case_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'changed' WHEN 2 THEN 'repeated_unchanged' END",
    "corroborating_hiring_signal": "CASE case_id % 6 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END",
    "publish_recency": "CASE case_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'not_recent' ELSE 'recent' END",
}


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = part(spark, sf, "run").filter("system = 'A' and replay_at is not null").select("case_id", "replay_at").distinct()
    rows = rows.select("*", *[F.expr(e).alias(c) for c, e in INPUTS.items()])
    rows = rows.withColumn("declared_expiry", F.expr("CASE WHEN case_id % 12 = 0 THEN replay_at + make_dt_interval(cast(case_id % 40 - 5 as int), 7) END")).withColumn("last_material_event_at", F.expr("CASE WHEN case_id % 10 = 0 THEN replay_at - interval 9 days WHEN case_id % 5 = 0 THEN replay_at - interval 2 days END")).withColumn("last_refreshed_at", F.expr("CASE WHEN case_id % 4 <> 0 THEN replay_at - interval 5 days END"))
    return rows.withColumn("q", policy.evidence_quality()).withColumn("quality", F.col("q.quality")).withColumn("rule", F.col("q.rule")).drop("q")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return policy.decided(inputs(spark, sf)).select("case_id", "quality", "rule", "branch", "action", "recheck_after_days")


def unpopulated_inputs(spark: SparkSession, sf: str) -> DataFrame:
    names = ["posting_state", "freeze_or_pause", "long_lived", "repost_pattern", "corroborating_hiring_signal", "publish_recency"]
    return inputs(spark, sf).select("case_id", F.array_join(policy.unpopulated(names), ",").alias("unpopulated"))


def routed_probes(spark: SparkSession, sf: str) -> DataFrame:
    names = ["posting_state", "freeze_or_pause", "long_lived", "repost_pattern", "corroborating_hiring_signal", "publish_recency"]
    gives = {"board_history": ["long_lived", "repost_pattern"], "team_signal": ["corroborating_hiring_signal"], "company_events": ["freeze_or_pause"], "resolve": ["posting_state", "publish_recency"]}
    rows = inputs(spark, sf).withColumn("unknown", policy.unpopulated(names))
    for p, g in gives.items():
        rows = rows.withColumn(f"gives_{p}", F.array(*map(F.lit, g)))
    return rows.select("case_id", F.array_join(policy.routed({"board_history": 1.0, "team_signal": 3.0, "company_events": 3.0, "resolve": 10.0}, 2), ",").alias("probes"))


def budget_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = policy.budget(part(spark, sf, "step").select("run_id", "step_index", "cost_usd", "latency_s"), {"cost_usd": 0.15, "latency_s": 0.12})
    return rows.groupBy("run_id").agg(F.count("*").alias("steps"), F.count_if(F.col("allowed")).alias("allowed"), F.round(F.max("spent_cost_usd"), 4).alias("spent"))


def inputs_of(spark: SparkSession, sf: str) -> DataFrame:
    """Policy inputs from the evidence that was available at each case's moment."""
    cases = part(spark, sf, "asked")
    claims = part(spark, sf, "claim").join(cases.select("case_id", "replay_at"), "case_id").filter("available_at <= replay_at").drop("replay_at")
    history = cases.select("case_id", F.expr("CASE case_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'changed' WHEN 2 THEN 'repeated_unchanged' END").alias("repost_pattern"))
    return I.policy_inputs(cases, claims, history)


def policy_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return inputs_of(spark, sf).select("case_id", *I.NAMES, "last_refreshed_at", "expiry_known", "primary_publish", F.array_join(I.unresolved(), ",").alias("unresolved"))


def decided_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Those inputs with their evidence quality and what a history says of the posting."""
    rows = inputs_of(spark, sf).withColumn("failures", (F.col("case_id") % 23 == 0).cast("int")).withColumn("contradiction", F.col("case_id") % 9 == 0).withColumn("long_lived", F.expr("CASE WHEN case_id % 3 <> 0 THEN case_id % 2 = 0 END"))
    return rows.withColumn("quality", policy.evidence_quality()["quality"])


def decisions_from_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence to action, end to end."""
    return policy.decided(decided_inputs(spark, sf)).select("case_id", "quality", "branch", "action", "recheck_after_days")


def flipping_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The claims that alone set a signal."""
    cases, claims = part(spark, sf, "asked"), part(spark, sf, "claim")
    kinds = [I.flipping_claims(cases, claims, k).withColumn("kind", F.lit(k)) for k in ("material", "freeze")]
    return kinds[0].unionByName(kinds[1])


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """What the routing tree makes of each case, and what eligibility and the cap leave of it."""
    rows = decided_inputs(spark, sf).withColumn("first_seen_absent", F.when(F.col("case_id") % 4 == 0, F.col("replay_at"))).withColumn("reappeared_at", F.when(F.col("case_id") % 6 == 0, F.col("replay_at")))
    rows = rows.withColumn("r", routing.route()).withColumn("routed", F.col("r.probes")).withColumn("eligible", F.expr("CASE WHEN case_id % 10 <> 0 THEN CASE WHEN case_id % 3 = 0 THEN array('company_events', 'team_signal') ELSE array('repost_history', 'requirements_drift', 'company_events', 'team_signal') END END"))
    rows = rows.withColumn("s", routing.selected("routed", "eligible", 2))
    return rows.select("case_id", "r.rule", F.array_join("routed", ",").alias("routed"), F.array_join("s.probes", ",").alias("probes"), F.array_join(F.transform("s.dropped", lambda d: F.concat_ws(":", d["probe"], d["why"])), ",").alias("dropped"))


def relevant_from_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Which of all eight inputs could still change the action, what that makes the system that asks for all eligible probes propose, and what the controller does."""
    rows = corpus.could_change(decided_inputs(spark, sf)).withColumn("executed", F.expr("CASE WHEN case_id % 4 = 0 THEN array('repost_history') ELSE array() END"))
    rows = routing.proposed(rows, {"repost_history": 1.0, "requirements_drift": 2.0, "company_events": 3.0, "team_signal": 1.0})
    step = routing.next_step(F.col("case_id") % 4 * 1.0, F.size("executed"), 4, 4.0)
    return rows.withColumn("step", step).select("case_id", F.array_join("could_change", ",").alias("could_change"), F.array_join(F.transform("proposed", lambda p: p["probe"]), ",").alias("proposed"), "step.verdict", "step.probe", "step.why")


def outcome_funnel(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE (conv_id + turn) % 7 WHEN 0 THEN 'applied' WHEN 1 THEN 'reply' WHEN 2 THEN 'screen' WHEN 3 THEN 'interview' WHEN 4 THEN 'offer' WHEN 5 THEN 'rejection' ELSE 'silence' END")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("posting_id"), kind.alias("outcome_type"))
    out = metrics.outcome_funnel(rows, actions_of(spark, sf))
    return out.withColumn("applied_per_reply", F.round("applied_per_reply", 6)).withColumn("applied_per_interview", F.round("applied_per_interview", 6))


def actions_of(spark: SparkSession, sf: str) -> DataFrame:
    """The latest action of each posting; a third of the postings have several runs."""
    return metrics.latest_actions(part(spark, sf, "run").withColumn("posting_id", F.floor(F.col("case_id") / 3)).withColumn("action", F.when(F.col("run_id") % 8 != 0, F.col("action"))).filter("posting_id % 6 <> 0"))


def product_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations stand for outcomes of the posting of their number."""
    kind = F.expr("CASE (conv_id + turn) % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'screen' WHEN 2 THEN 'interview' ELSE 'silence' END")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("posting_id"), kind.alias("outcome_type"))
    splits = part(spark, sf, "run").select(F.floor(F.col("case_id") / 3).alias("posting_id")).distinct().withColumn("split", F.when(F.col("posting_id") % 3 == 0, "dev").otherwise("test"))
    out = metrics.product_gate(rows, splits, actions_of(spark, sf))
    return out.select("outcomes", "postings", "held_out", "matched", "missing", "status", *[F.round(f"{n}_per_{k}", 6).alias(f"{n}_per_{k}") for n in ("recommended", "other") for k in ("screen", "interview")])


def gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs_of(spark, sf)
    b, r = (metrics.agreement(metrics.compared(rows, "A", s), "A", s).withColumn("cost", F.lit(c)) for s, c in (("B", 0.6), ("R", 1.0)))
    return metrics.agent_gate(b, r)


def cache_of(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.concat_ws("/", "probe", "source_url").alias("probe"), "fetched_at", F.expr("fetched_at + interval 6 hours").alias("expires_at"))


def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """All eight kinds of violations, and a model's cache misses apart."""
    # of nine parts two need the numbers of steps or evidence: each reads the few columns it needs, and the windows of the others fall away with them
    runs, steps, evidence = (part(spark, sf, n) for n in ("run", "step", "evidence"))
    parts = [leakage.after_moment(evidence, runs), fetched(spark, sf, evidence, runs), captured(spark, sf), leakage.cache_misses(steps), leakage.cache_misses(steps, model=True), leakage.violations(steps, "net_call"), leakage.violations(steps, "missing_probe_result"), leakage.missing_moment(runs)]
    return leakage.audit([*parts, leakage.unbacked_inputs(branched(steps), runs, evidence)])


def branched(steps: DataFrame) -> DataFrame:
    """Steps whose decisions name branches of the table."""
    names = F.array(*map(F.lit, policy.ACTIONS))
    return steps.withColumn("decision_type", F.when(F.startswith("decision_type", F.lit("policy_decision:")), F.concat(F.lit("policy_decision:"), F.element_at(names, (F.col("args_hash") + F.col("step_index") % 7 + 1).cast("int")), F.lit(":x"))).otherwise(F.col("decision_type")))


def fetched(spark: SparkSession, sf: str, evidence: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    evidence, runs = part(spark, sf, "evidence") if evidence is None else evidence, part(spark, sf, "run") if runs is None else runs
    return leakage.fetched_after(evidence.withColumn("probe", F.concat_ws("/", "probe", "source_url")), cache_of(evidence), runs.withColumn("replay_at", F.col("started_at") + F.expr("interval 20 days")), 24)


def captured(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' days stand for captures, runs of snapshots start every tenth day and last up to four."""
    runs = part(spark, sf, "run").select("run_id", "company_id", (F.col("started_at") + F.expr("interval 30 hours")).alias("replay_at"))
    captures = part(spark, sf, "event").select("company_id", F.col("event_at").alias("captured_at"), F.when(F.col("materiality") == "minor", "archive").otherwise("own").alias("source"))
    windows = part(spark, sf, "run").select("started_at").distinct().filter("datediff(started_at, date '1992-01-01') % 10 = 0").select("started_at", F.expr("started_at + make_dt_interval(cast(1 + datediff(started_at, date '1992-01-01') % 4 as int))").alias("finished_at"))
    return leakage.capture_fetched_after(runs, captures, windows)


def leakage_fetched_after(spark: SparkSession, sf: str) -> DataFrame:
    return fetched(spark, sf)


def leakage_captures(spark: SparkSession, sf: str) -> DataFrame:
    return captured(spark, sf).select("kind", "run_id", F.substring("item", 1, 10).alias("day"))


def leakage_exposures(spark: SparkSession, sf: str) -> DataFrame:
    """Stored records that answer an input which no available evidence of their run backs. Steps stand for executed probes, their details for records."""
    rows = part(spark, sf, "step").filter("component = 'probe'").select("run_id", F.col("run_id").alias("posting_id"), F.lit(0).alias("replay_at"), F.when(F.col("step_index") % 2 == 0, "team_signal").otherwise("company_events").alias("probe_name"), F.col("step_index").alias("args_hash"))
    data = F.expr("CASE args_hash % 5 WHEN 0 THEN '{\"corroborating_hiring_signal\": true, \"freeze_or_pause\": null}' WHEN 1 THEN '{\"freeze_or_pause\": false, \"material_negative_event\": {\"unknown\": 1}, \"last_material_event_at\": \"2024-01-01\"}' WHEN 2 THEN '{\"corroborating_hiring_signal\": null}' WHEN 3 THEN 'broken' ELSE '{\"material_negative_event\": true, \"corroborating_hiring_signal\": [1]}' END")
    records = rows.drop("run_id").withColumn("ok", F.col("posting_id") % 7 != 0).withColumn("data", data)
    evidence = part(spark, sf, "claim").withColumnRenamed("case_id", "run_id")
    return leakage.exposed_inputs(rows, records, part(spark, sf, "asked").withColumnRenamed("case_id", "run_id"), evidence)


def resume(spark: SparkSession, sf: str) -> DataFrame:
    runs = part(spark, sf, "run")
    return asof.remaining(runs.select("case_id").distinct(), runs.filter("system = 'B' and status = 'completed'"), ["case_id"]).agg(F.count("*").alias("n"), F.min("case_id").alias("first"), F.max("case_id").alias("last"))


def shard_counts(spark: SparkSession, sf: str) -> DataFrame:
    from larkspur.functions.scalars import shard_of

    return part(spark, sf, "run").withColumn("shard", shard_of("case_id", "system", shards=7)).groupBy("shard").agg(F.count("*").alias("n"))


def holdout_breach(spark: SparkSession, sf: str) -> DataFrame:
    runs = part(spark, sf, "run").select((F.col("case_id") % 37).alias("company_id"))
    return asof.holdout_breach(runs, runs.filter("company_id % 9 = 4"))


def repeated_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = part(spark, sf, "step")
    return asof.repeated_keys(rows, ["run_id", "probe_name", "args_hash"])


def visible_events(spark: SparkSession, sf: str) -> DataFrame:
    cases = part(spark, sf, "run").filter("system = 'B' and replay_at is not null").select("case_id", "company_id", F.expr("replay_at - make_dt_interval(cast(case_id % 2000 as int))").alias("replay_at"))
    return at_moments(cases, part(spark, sf, "event"), ["company_id"], "available_at", {"events": ("sum", F.lit(1).cast("long")), "latest_event_at": ("max", F.col("event_at"))}).select("case_id", "events", "latest_event_at")


COSTS = {"probe0": ranking.TIERS["low"], "probe1": ranking.TIERS["medium"], "probe3": ranking.TIERS["high"], "probe4": ranking.TIERS["low"]}


def ranker_input(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows of the finished runs, some of whose evidence says that it comes from their first probes."""
    runs = part(spark, sf, "run").filter("status = 'completed' and replay_at is not null").withColumn("action", F.expr("CASE WHEN run_id % 13 <> 0 THEN action END"))
    claimed = part(spark, sf, "evidence").withColumn("claim_type", F.expr("CASE WHEN claim_type = 'event' THEN 'board_present' ELSE claim_type END"))
    return ranking.training_rows(runs, part(spark, sf, "step").filter("component = 'probe'"), claimed, COSTS)


def ranker_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a learned order of probes is trained on: the evidence before each probe of a run, and whether the probe mattered."""
    return ranker_input(spark, sf).drop("n_evidence_news", "n_evidence_enrichment")


def ranker_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """The split by time, by probe."""
    rows = ranking.temporal_holdout(ranker_input(spark, sf).select("case_id", "replay_at", "probe", "label"))
    return rows.groupBy("holdout", "probe").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.min("replay_at").alias("first_at"), F.max("replay_at").alias("last_at"))


def ranker(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a learned order of probes beats the order by cost. What the fit decides has no SQL; tests hold it against a plain fit."""
    return ranking.evaluated(ranker_input(spark, sf)).select("status", "rows", "train_rows", "holdout_rows", *[F.round(c, 4).alias(c) for c in ("positive_rate", "holdout_positive_rate", "learned_auc", "learned_accuracy", "deterministic_auc", "deterministic_accuracy")], "keep")


def ranker_by_cost(spark: SparkSession, sf: str) -> DataFrame:
    """AUC and accuracy of the order by cost on the holdout."""
    held = ranking.temporal_holdout(ranker_input(spark, sf)).filter("holdout")
    auc, accuracy = ranking.by_cost(held)
    return held.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")).withColumn("auc", F.lit(None if auc is None else round(auc, 6)).cast("double")).withColumn("accuracy", F.lit(round(accuracy, 6)))


#: Dialect-free pieces of what a controller is asked: inputs that could change the action, eligible and executed probes.
COULD = {"repost_pattern": "case_id % 2 = 0", "publish_recency": "case_id % 3 = 0", "freeze_or_pause": "case_id % 5 < 2", "material_negative_event": "case_id % 7 < 3", "corroborating_hiring_signal": "case_id % 11 < 5"}
ALLOWED = {"company_events": "case_id % 4 <> 1", "repost_history": "case_id % 6 <> 2", "requirements_drift": "case_id % 9 < 6", "team_signal": "case_id % 8 <> 3"}
DONE = {"company_events": "case_id % 10 = 3", "repost_history": "case_id % 10 = 7"}
PROBE = "CASE (evidence_id * 7 + case_id) % 6 WHEN 0 THEN 'repost_history' WHEN 1 THEN 'requirements_drift' WHEN 2 THEN 'team_signal' WHEN 3 THEN 'nonsense' ELSE 'company_events' END"
PRICES, WAITS = {"repost_history": 1.0, "requirements_drift": 3.0, "company_events": 1.0, "team_signal": 3.0}, {"repost_history": 2.0, "requirements_drift": 5.0, "company_events": 2.0, "team_signal": 5.0}


def controller_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What the controller makes of the proposals for every case."""
    chosen = lambda d: "filter(array(" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in d.items()) + "), x -> x IS NOT NULL)"
    said = part(spark, sf, "claim").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", F.expr(PROBE).alias("probe"), F.expr("evidence_id % 5 <> 0").alias("valid")))).alias("c"))
    rows = part(spark, sf, "asked").join(said, "case_id", "left").selectExpr(
        "case_id", f"{chosen(COULD)} AS could_change", f"CASE WHEN case_id % 13 <> 4 THEN {chosen(ALLOWED)} END AS eligible", f"transform({chosen(DONE)}, p -> named_struct('probe', p, 'args_hash', 'h0')) AS executed",
        "map('company_events', concat('h', cast(case_id % 2 as string)), 'repost_history', concat('h', cast(case_id % 2 as string)), 'requirements_drift', 'h1', 'team_signal', 'h1') AS hashes", "cast(4 - case_id % 17 % 5 AS int) AS steps_left",
        "case_id % 19 % 5 * 1.5D AS spent_cost", "case_id % 23 % 4 * 2.5D AS spent_latency", "CASE WHEN case_id % 29 <> 5 THEN named_struct('stop', case_id % 31 = 6, 'candidates', transform(coalesce(c, array()), x -> named_struct('probe', x.probe, 'valid', x.valid))) END AS output",
    )
    out = rows.select("case_id", controller.decision(PRICES, WAITS, 6.5, 9.5, 4).alias("d"))
    return out.select("case_id", "d.decision", "d.reason", "d.probe", "d.args_hash", F.array_join("d.considered", ",").alias("considered"), F.array_join(F.transform("d.rejected", lambda x: F.concat(x["probe"], F.lit(":"), x["reason"])), ",").alias("rejected"), F.array_join(F.transform("d.ranking", lambda x: x["probe"]), ",").alias("ranking"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_runs, paired_cases, agreement, confusion, exclusive_gains, step_metrics, probe_order, unnecessary_steps, citation_support, branch_counts, token_sums, event_signals, contradictions, decisions, unpopulated_inputs,
        routed_probes, budget_ledger, outcome_funnel, product_gate, gate, value_comparison, probe_dependence, leakage_audit, leakage_fetched_after, leakage_captures, leakage_exposures, policy_inputs, decisions_from_evidence, flipping_claims, routes, relevant_from_evidence, resume, shard_counts, holdout_breach, repeated_cases, visible_events, ranker, controller_decisions, ranker_rows, ranker_holdout, ranker_by_cost,
    )
}

AGREE = "SELECT '{s}' AS system, count(*) AS compared, round(avg(CAST(\"A\" = \"{s}\" AS INT)), 6) AS agreement, round((SELECT avg(m) FROM (SELECT avg(CAST(\"A\" = \"{s}\" AS INT)) AS m FROM par WHERE \"A\" IS NOT NULL AND \"{s}\" IS NOT NULL GROUP BY \"A\")), 6) AS macro_agreement FROM par WHERE \"A\" IS NOT NULL AND \"{s}\" IS NOT NULL"
CASES = f"{DUCK}, ca AS (SELECT DISTINCT case_id, replay_at FROM run WHERE system = 'A' AND replay_at IS NOT NULL), inp AS (SELECT case_id, replay_at, {', '.join(f'{e} AS {c}' for c, e in INPUTS.items())}, CASE WHEN case_id % 12 = 0 THEN replay_at + to_days(CAST(case_id % 40 - 5 AS INT)) + INTERVAL 7 HOUR END AS declared_expiry, CASE WHEN case_id % 10 = 0 THEN replay_at - INTERVAL 9 DAY WHEN case_id % 5 = 0 THEN replay_at - INTERVAL 2 DAY END AS ev, CASE WHEN case_id % 4 <> 0 THEN replay_at - INTERVAL 5 DAY END AS rf FROM ca)"
DECIDE = f"""{CASES}, q AS (SELECT *, CASE WHEN failures > 0 THEN 'probe_failure' WHEN NOT primary_publish THEN 'no_primary_publish_evidence' WHEN posting_state IS NULL OR posting_state = 'unknown' THEN 'posting_state_unknown' WHEN contradiction THEN 'contradiction' ELSE 'strong' END AS rule FROM inp),
q2 AS (SELECT *, CASE rule WHEN 'strong' THEN 'strong' WHEN 'contradiction' THEN 'mixed' ELSE 'weak' END AS quality FROM q),
b AS (SELECT *, CASE WHEN posting_state = 'closed' THEN 'P1_closed' WHEN posting_state IS NULL OR posting_state = 'unknown' THEN 'P2_state_unresolved' WHEN freeze_or_pause THEN 'P3a_freeze_or_pause' WHEN declared_expiry IS NOT NULL AND NOT (posting_state = 'open' AND quality = 'strong') THEN 'P3b_declared_expiry_unresolved'
 WHEN material_negative_event AND ev IS NOT NULL AND (rf IS NULL OR rf <= ev) THEN 'P3c_material_event_unrefreshed' WHEN repost_pattern = 'repeated_unchanged' AND long_lived AND corroborating_hiring_signal = false THEN 'P4_repeated_repost' WHEN posting_state = 'open' AND publish_recency = 'recent' AND material_negative_event IS DISTINCT FROM true AND quality = 'strong' THEN 'P5_open_recent_strong'
 WHEN posting_state = 'open' AND quality = 'strong' AND material_negative_event IS DISTINCT FROM true AND corroborating_hiring_signal THEN 'P5b_hiring_activity' WHEN quality IN ('mixed', 'weak') THEN 'P6_active_mixed_or_weak' ELSE 'P7_default' END AS branch FROM q2),
a AS (SELECT *, CASE WHEN branch IN ('P1_closed', 'P4_repeated_repost') THEN 'skip' WHEN branch LIKE 'P2%' OR branch LIKE 'P3%' THEN 'wait' WHEN branch LIKE 'P5%' THEN 'apply_now' ELSE 'quick_apply' END AS action FROM b)"""
LATEST_ACTION = "act AS (SELECT CAST(floor(case_id / 3.0) AS BIGINT) AS posting_id, action FROM run WHERE status = 'completed' AND run_id % 8 <> 0 AND CAST(floor(case_id / 3.0) AS BIGINT) % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY CAST(floor(case_id / 3.0) AS BIGINT) ORDER BY started_at DESC, run_id DESC) = 1)"
RECHECK = "CASE WHEN action = 'wait' THEN CASE WHEN declared_expiry IS NULL THEN 14 ELSE CAST(greatest(0, least(14, floor((epoch_us(declared_expiry) - epoch_us(replay_at)) / 86400e6))) AS INT) END END"
LADDER = DECIDE[DECIDE.index("q AS (SELECT *, CASE WHEN failures") :]
FETCHED = f"""{DUCK}, cache AS (SELECT probe || '/' || source_url AS k, fetched_at, fetched_at + INTERVAL 6 HOUR AS expires_at FROM evidence), cl AS (SELECT e.run_id, e.evidence_id, e.probe || '/' || e.source_url AS k, e.available_at, r.started_at + INTERVAL 20 DAY AS t FROM evidence e JOIN run r USING (run_id)),
 nx AS (SELECT cl.run_id, cl.evidence_id, t, bool_or(c.fetched_at <= available_at AND available_at < c.expires_at) AS ok, min(c.fetched_at) FILTER (c.fetched_at > available_at) AS f FROM cl JOIN cache c ON c.k = cl.k AND c.fetched_at <= available_at + INTERVAL 24 HOUR AND c.expires_at > available_at GROUP BY ALL),
 fet AS (SELECT 'evidence_fetched_after_t' AS kind, run_id, CAST(evidence_id AS VARCHAR) AS item FROM nx WHERE NOT ok AND f > t)"""
CAPTURED = """win AS (SELECT DISTINCT started_at AS a, started_at + to_days(CAST(1 + date_diff('day', DATE '1992-01-01', CAST(started_at AS DATE)) % 4 AS INT)) AS b FROM run WHERE date_diff('day', DATE '1992-01-01', CAST(started_at AS DATE)) % 10 = 0), st AS (SELECT e.company_id, e.event_at AS at_, b FROM event e JOIN win ON e.event_at >= a AND e.event_at < b WHERE materiality = 'material'),
 capt AS (SELECT r.run_id, min(at_) AS at_ FROM run r JOIN st ON st.company_id = r.company_id AND at_ <= r.started_at + INTERVAL 30 HOUR AND r.started_at + INTERVAL 30 HOUR < b GROUP BY r.run_id)"""
CAPTURED_ALONE = f"{DUCK}, {CAPTURED}"
BRANCHES = "['" + "', '".join(policy.ACTIONS) + "']"
EVENT_CLAIMS = "['company_events_searched', 'layoff', 'hiring_freeze', 'hiring_pause', 'shutdown', 'funding', 'expansion', 'acquisition', 'other']"
NEEDS = f"""bs AS (SELECT s.run_id, {BRANCHES}[args_hash + step_index % 7 + 1] AS branch FROM step s JOIN run r USING (run_id) WHERE component = 'controller' AND starts_with(decision_type, 'policy_decision:') AND r.replay_at IS NOT NULL),
 want AS (SELECT run_id, 'posting_state' AS input, ['posting_state'] AS claims FROM bs WHERE branch <> 'P2_state_unresolved' UNION SELECT run_id, 'freeze_or_pause', {EVENT_CLAIMS} FROM bs WHERE branch LIKE 'P3a%' UNION SELECT run_id, 'declared_expiry', ['declared_expiry'] FROM bs WHERE branch LIKE 'P3b%' UNION SELECT run_id, 'material_negative_event', {EVENT_CLAIMS} FROM bs WHERE branch LIKE 'P3c%'
  UNION SELECT run_id, 'corroborating_hiring_signal', ['corroborating_hiring_signal'] FROM bs WHERE branch LIKE 'P4%' OR branch LIKE 'P5b%' UNION SELECT run_id, 'publish_recency', ['first_published', 'refreshed_at'] FROM bs WHERE branch LIKE 'P5\\_%' ESCAPE '\\')"""
NEWEST = "QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY available_at DESC, fetched_at DESC, evidence_id DESC) = 1"
DERIVED = f"""{DUCK}, cv AS (SELECT c.*, q.replay_at FROM claim c JOIN asked q USING (case_id) WHERE c.available_at <= q.replay_at),
 st1 AS (SELECT case_id, lower(trim(value)) AS v FROM cv WHERE claim_type = 'posting_state' AND (probe = 'resolve_posting' OR case_id NOT IN (SELECT case_id FROM cv WHERE claim_type = 'posting_state' AND probe = 'resolve_posting')) {NEWEST}),
 pb AS (SELECT case_id, source_event_at AS t FROM cv WHERE claim_type = 'first_published' AND source_event_at IS NOT NULL AND source_quality IN ('ats_native', 'page_structured') QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY source_quality, source_event_at, evidence_id) = 1),
 rfr AS (SELECT case_id, source_event_at AS t FROM cv WHERE claim_type = 'refreshed_at' AND source_event_at IS NOT NULL {NEWEST}), xp AS (SELECT case_id, source_event_at AS t FROM cv WHERE claim_type = 'declared_expiry' AND source_event_at IS NOT NULL {NEWEST}),
 tm AS (SELECT case_id, lower(trim(value)) AS v FROM cv WHERE claim_type = 'corroborating_hiring_signal' {NEWEST}), rn AS (SELECT DISTINCT case_id FROM cv WHERE probe = 'resolve_posting'), se AS (SELECT DISTINCT case_id FROM cv WHERE claim_type = 'company_events_searched'),
 mv AS (SELECT case_id, max(CAST(source_event_at AS DATE)) FILTER (claim_type IN ('layoff', 'shutdown') AND lower(trim(split_part(value, ':', 1))) <> 'minor') AS m, bool_or(claim_type = 'hiring_freeze') AS f FROM cv WHERE probe = 'company_events' AND source_event_at IS NOT NULL AND CAST(source_event_at AS DATE) >= CAST(replay_at AS DATE) - 180 GROUP BY case_id),
 d0 AS (SELECT q.case_id, q.replay_at, q.resolver_ok, CASE WHEN st1.v IN ('open', 'closed', 'reposted', 'unknown') THEN st1.v END AS posting_state, greatest(pb.t, rfr.t) AS rf, xp.t AS declared_expiry, CASE WHEN tm.v = 'true' THEN true WHEN tm.v = 'no' THEN false END AS corroborating_hiring_signal, se.case_id IS NOT NULL AS searched, pb.case_id IS NOT NULL AS primary_publish, rn.case_id IS NOT NULL AS ran, mv.m, mv.f
  FROM asked q LEFT JOIN st1 USING (case_id) LEFT JOIN pb USING (case_id) LEFT JOIN rfr USING (case_id) LEFT JOIN xp USING (case_id) LEFT JOIN tm USING (case_id) LEFT JOIN rn USING (case_id) LEFT JOIN se USING (case_id) LEFT JOIN mv USING (case_id)),
 derived AS (SELECT *, CASE WHEN rf >= replay_at - INTERVAL 30 DAY THEN 'recent' WHEN rf IS NOT NULL THEN 'not_recent' END AS publish_recency, CASE WHEN searched THEN m IS NOT NULL END AS material_negative_event, CASE WHEN searched THEN coalesce(f, false) END AS freeze_or_pause, CASE WHEN searched THEN CAST(m AS TIMESTAMP) END AS last_material_event_at,
  declared_expiry IS NOT NULL OR (resolver_ok AND ran AND coalesce(posting_state IN ('open', 'closed', 'reposted'), false)) AS expiry_known, CASE case_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'changed' WHEN 2 THEN 'repeated_unchanged' END AS repost_pattern FROM d0)"""
UNPOP = "array_to_string(list_filter([CASE WHEN posting_state IS NULL THEN 'posting_state' END, CASE WHEN freeze_or_pause IS NULL THEN 'freeze_or_pause' END, CASE WHEN long_lived IS NULL THEN 'long_lived' END, CASE WHEN repost_pattern IS NULL THEN 'repost_pattern' END, CASE WHEN corroborating_hiring_signal IS NULL THEN 'corroborating_hiring_signal' END, CASE WHEN publish_recency IS NULL THEN 'publish_recency' END], lambda x: x IS NOT NULL), ',')"

RANKED = f"""{DUCK}, rr AS (SELECT * REPLACE (CASE WHEN run_id % 13 <> 0 THEN action END AS action) FROM run WHERE status = 'completed' AND replay_at IS NOT NULL), pl AS (SELECT s.run_id, probe_name AS probe, row_number() OVER (PARTITION BY s.run_id ORDER BY step_index) - 1 AS i FROM step s JOIN rr USING (run_id) WHERE component = 'probe'),
po AS MATERIALIZED (SELECT run_id, probe, min(i) AS i FROM pl GROUP BY ALL), ca AS (SELECT r.run_id, r.case_id, r.replay_at, r.action, p.probe, p.i FROM rr r JOIN po p USING (run_id) WHERE r.system = 'A'),
fe AS (SELECT c.run_id, c.probe, count(e.run_id) AS n, count(*) FILTER (e.source_quality = 'ats_native') AS na, count(*) FILTER (e.source_quality = 'page_structured') AS np, count(*) FILTER (e.source_quality = 'archive') AS nr, coalesce(bool_or(e.claim_type = 'first_published'), false) AS hp, coalesce(bool_or(e.claim_type = 'event'), false) AS hb, coalesce(bool_or(e.claim_type = 'board_absent'), false) AS ha
  FROM ca c LEFT JOIN (po q JOIN evidence e ON e.run_id = q.run_id AND e.probe = q.probe) ON q.run_id = c.run_id AND q.i < c.i GROUP BY ALL),
la AS (SELECT c.run_id, c.probe, bool_or(coalesce(o.action <> c.action, false) AND o.system <> 'A' AND NOT EXISTS (SELECT 1 FROM po WHERE po.run_id = o.run_id AND po.probe = c.probe)) AND NOT bool_or(coalesce(o.action <> c.action, false) AND EXISTS (SELECT 1 FROM po WHERE po.run_id = o.run_id AND po.probe = c.probe)) AS label FROM ca c JOIN rr o USING (case_id) GROUP BY ALL),
tr AS MATERIALIZED (SELECT case_id, replay_at, probe, CAST(label AS INT) AS label, CAST(n AS DOUBLE) AS n_evidence, CAST(na AS DOUBLE) AS n_evidence_ats_native, CAST(np AS DOUBLE) AS n_evidence_page_structured, CAST(nr AS DOUBLE) AS n_evidence_archive, CAST(hp AS DOUBLE) AS has_publish_evidence, CAST(hb AS DOUBLE) AS has_board_present, CAST(ha AS DOUBLE) AS has_board_absent,
  CAST(i AS DOUBLE) AS n_probes_before, CASE probe WHEN 'probe1' THEN 3.0 WHEN 'probe3' THEN 10.0 ELSE 1.0 END::DOUBLE AS probe_cost_points, CAST(probe = 'probe0' AS DOUBLE) AS probe_is_probe0, CAST(probe = 'probe1' AS DOUBLE) AS probe_is_probe1, CAST(probe = 'probe3' AS DOUBLE) AS probe_is_probe3, CAST(probe = 'probe4' AS DOUBLE) AS probe_is_probe4
  FROM ca JOIN fe USING (run_id, probe) JOIN la USING (run_id, probe) WHERE probe IN ('probe0', 'probe1', 'probe3', 'probe4')),
ho AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY replay_at, case_id, probe) > count(*) OVER () - least(greatest(1, round_even(count(*) OVER () * 0.25, 0)), count(*) OVER () - 1) AS holdout FROM tr)"""
CHOSEN = lambda d: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in d.items()) + "], lambda x: x IS NOT NULL)"
CONTROL = f"""{DUCK}, q AS MATERIALIZED (SELECT case_id, {CHOSEN(COULD)} AS could, CASE WHEN case_id % 13 <> 4 THEN {CHOSEN(ALLOWED)} END AS elig, CASE WHEN case_id % 2 = 0 THEN {CHOSEN(DONE)} ELSE [] END AS done, 4 - case_id % 17 % 5 AS steps, case_id % 19 % 5 * 1.5 AS cost, case_id % 23 % 4 * 2.5 AS lat, case_id % 29 <> 5 AS said, case_id % 31 = 6 AS stops FROM asked),
cd AS (SELECT c.case_id, row_number() OVER (PARTITION BY c.case_id ORDER BY evidence_id) AS i, {PROBE} AS probe, evidence_id % 5 <> 0 AS valid FROM claim c JOIN q USING (case_id) WHERE said),
gv AS (SELECT * FROM (VALUES ('repost_history', ['repost_pattern'], 1.0, 2.0), ('requirements_drift', ['publish_recency'], 3.0, 5.0), ('company_events', ['material_negative_event', 'freeze_or_pause', 'last_material_event_at'], 1.0, 2.0), ('team_signal', ['corroborating_hiring_signal'], 3.0, 5.0)) AS t(probe, gives, price, wait)),
c1 AS (SELECT cd.*, q.*  EXCLUDE (case_id), len(list_intersect(gives, could)) AS use, price, wait, gives IS NOT NULL AS known FROM cd JOIN q USING (case_id) LEFT JOIN gv USING (probe)),
c2 AS MATERIALIZED (SELECT *, CASE WHEN i > 4 THEN 'over_candidate_limit' WHEN NOT known THEN 'unknown_probe' WHEN elig IS NULL THEN 'ineligible' WHEN NOT valid THEN 'invalid_args' WHEN NOT list_contains(elig, probe) THEN 'ineligible' WHEN list_contains(done, probe) THEN 'duplicate'
  WHEN use > 0 AND coalesce(bool_or(valid) OVER (PARTITION BY case_id, probe ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'duplicate' WHEN use = 0 THEN 'no_useful_input' END AS refused FROM c1),
c3 AS (SELECT case_id, coalesce(list(probe ORDER BY i) FILTER (i <= 4), []) AS considered, coalesce(list(probe || ':' || refused ORDER BY i <= 4, i) FILTER (refused IS NOT NULL), []) AS rejected, coalesce(list(probe ORDER BY use / price DESC, probe) FILTER (refused IS NULL), []) AS ranking FROM c2 GROUP BY case_id),
c4 AS (SELECT q.*, coalesce(considered, []) AS considered, coalesce(rejected, []) AS rejected, coalesce(ranking, []) AS ranking, gv.price, gv.wait, CASE WHEN len(could) = 0 THEN 'no_unresolved_question' WHEN steps <= 0 THEN 'step_cap' WHEN elig IS NOT NULL AND len(list_filter(elig, lambda p: NOT list_contains(done, p))) = 0 THEN 'no_new_eligible_probe'
  WHEN NOT said THEN 'investigator_error' WHEN stops THEN 'investigator_stop' WHEN len(coalesce(ranking, [])) = 0 THEN 'no_eligible_candidate' WHEN cost + price > 6.5 THEN 'cost_cap' WHEN lat + wait > 9.5 THEN 'latency_cap' END AS why FROM q LEFT JOIN c3 USING (case_id) LEFT JOIN gv ON gv.probe = ranking[1])"""
ORACLE_SQL = {
    "latest_runs": f"WITH {LATEST} SELECT system, case_id, run_id, action, duplicates FROM lat",
    "paired_cases": f"WITH {PAIRS} SELECT * FROM par",
    "agreement": f"WITH {PAIRS} {AGREE.format(s='B')} UNION ALL {AGREE.format(s='R')}",
    "confusion": f'WITH {PAIRS} SELECT "A" AS reference_action, "B" AS system_action, count(*) AS n FROM par GROUP BY ALL',
    "gate": f"WITH {PAIRS}, g AS ({AGREE.format(s='B')} UNION ALL {AGREE.format(s='R')}), b AS (SELECT agreement AS a, macro_agreement AS m, 0.6 AS c FROM g WHERE system = 'B'), r AS (SELECT agreement AS a, macro_agreement AS m, 1.0 AS c FROM g WHERE system = 'R') SELECT b.a >= r.a - 0.02 AS agreement_held, b.m >= r.m - 0.02 AS macro_held, b.c <= 0.7 * r.c AS cheaper, b.a >= r.a - 0.02 AND b.m >= r.m - 0.02 AND b.c <= 0.7 * r.c AS passed FROM b, r",
    "exclusive_gains": f'WITH {PAIRS} SELECT "A" AS reference_action, count(*) FILTER ("A" = "B" AND "A" IS DISTINCT FROM "R") AS candidate_only, count(*) FILTER ("A" = "R" AND "A" IS DISTINCT FROM "B") AS baseline_only, count(*) FILTER ("A" = "B" AND "A" IS DISTINCT FROM "R") - count(*) FILTER ("A" = "R" AND "A" IS DISTINCT FROM "B") AS net FROM par GROUP BY "A"',
    "step_metrics": f"""WITH {DUCK}, p AS (SELECT * FROM step WHERE component = 'probe'), rep AS (SELECT run_id, sum(k - 1) AS repeats FROM (SELECT run_id, count(*) AS k FROM p GROUP BY run_id, probe_name, args_hash) GROUP BY run_id),
 own AS (SELECT run_id, sum(cost_usd) AS c, sum(latency_s) AS l, count(*) FILTER (component = 'probe' AND probe_name IN ('probe0', 'probe1')) AS lo, count(*) FILTER (component = 'probe' AND probe_name IN ('probe2', 'probe3')) AS me, count(*) FILTER (component = 'probe' AND probe_name = 'probe4') AS hi, count(*) FILTER (component = 'probe' AND cache_status = 'hit') AS h, count(*) FILTER (component = 'probe') AS p FROM step GROUP BY run_id)
 SELECT system, count(*) AS runs, coalesce(sum(lo), 0)::BIGINT AS low_probes, coalesce(sum(me), 0)::BIGINT AS medium_probes, coalesce(sum(hi), 0)::BIGINT AS high_probes, coalesce(sum(h), 0)::BIGINT AS hits, coalesce(sum(p), 0)::BIGINT AS probes, coalesce(sum(repeats), 0)::BIGINT AS repeats, round(sum(c), 4) AS cost_usd, round(sum(l), 4) AS latency_s, round(coalesce(sum(p), 0) / count(*), 6) AS probes_per_run FROM run LEFT JOIN own USING (run_id) LEFT JOIN rep USING (run_id) GROUP BY system""",
    "probe_order": f"WITH {DUCK}, f AS (SELECT run_id, probe_name, min(step_index) AS at_ FROM step WHERE component = 'probe' GROUP BY ALL) SELECT run_id, string_agg(probe_name, '>' ORDER BY at_) AS probes FROM f GROUP BY run_id",
    "unnecessary_steps": f"WITH {DUCK} SELECT run_id, count(*) AS unnecessary FROM step s WHERE component = 'probe' AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.run_id = s.run_id AND e.probe = s.probe_name) GROUP BY run_id",
    "citation_support": f"""WITH {DUCK}, r AS (SELECT run_id, step_index, CASE WHEN step_index % 5 = 0 THEN [] ELSE [run_id * 1000 + step_index, run_id * 1000 + 3] END AS ids FROM step), n AS (SELECT run_id, count(*) AS k FROM step GROUP BY run_id), c AS (SELECT len(ids) > 0 AS cited, len(ids) > 0 AND k >= 3 AS supported FROM r JOIN n USING (run_id))
 SELECT count(*) AS reasons, count(*) FILTER (cited) AS cited, count(*) FILTER (supported) AS supported, round(count(*) FILTER (supported) / count(*), 6) AS support_rate FROM c""",
    "branch_counts": f"WITH {DUCK} SELECT split_part(decision_type, ':', 2) AS branch, count(*) AS n FROM step WHERE starts_with(decision_type, 'policy_decision:') GROUP BY ALL",
    "token_sums": f"WITH {DUCK} SELECT component, sum(CAST(regexp_extract(decision_type, '=([0-9]+)/', 1) AS BIGINT))::BIGINT AS tokens_in, sum(12)::BIGINT AS tokens_out FROM step WHERE starts_with(decision_type, 'model_call:') GROUP BY component",
    "event_signals": f"""WITH {DUCK}, ca AS (SELECT case_id, company_id, replay_at, case_id % 11 <> 0 AS searched FROM run WHERE system = 'A' AND replay_at IS NOT NULL), f AS (SELECT case_id, bool_or(event_type IN ('layoff', 'shutdown') AND materiality = 'material') AS m, bool_or(event_type IN ('hiring_freeze', 'hiring_pause')) AS f, max(event_at) FILTER (event_type IN ('layoff', 'shutdown') AND materiality = 'material') AS last_material_event_at
 FROM ca JOIN event e USING (company_id) WHERE e.available_at <= replay_at AND CAST(event_at AS DATE) >= CAST(replay_at AS DATE) - 30 GROUP BY case_id) SELECT ca.case_id, CASE WHEN searched THEN coalesce(m, false) END AS material_negative_event, CASE WHEN searched THEN coalesce(f, false) END AS freeze_or_pause, last_material_event_at FROM ca LEFT JOIN f USING (case_id)""",
    "contradictions": f"""WITH {DUCK}, s AS (SELECT run_id, source_quality, source_url, min(source_event_at) AS t FROM evidence WHERE claim_type = 'first_published' AND source_event_at IS NOT NULL GROUP BY ALL), c1 AS (SELECT run_id, (epoch_us(max(t)) - epoch_us(min(t))) / 86400e6 > 3 AS x FROM s GROUP BY run_id),
 st AS (SELECT run_id, value, available_at FROM evidence WHERE claim_type = 'posting_state' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY available_at DESC, fetched_at DESC, evidence_id DESC) = 1), ab AS (SELECT run_id, max(available_at) AS t FROM evidence WHERE claim_type = 'board_absent' GROUP BY run_id)
 SELECT DISTINCT e.run_id, coalesce(x, false) AS publish_date_conflict, coalesce(lower(trim(st.value)) = 'open' AND ab.t >= st.available_at, false) AS open_but_absent FROM evidence e LEFT JOIN c1 USING (run_id) LEFT JOIN st USING (run_id) LEFT JOIN ab USING (run_id)""",
    "decisions": f"WITH {DECIDE} SELECT case_id, quality, rule, branch, action, CASE WHEN action = 'wait' THEN CASE WHEN declared_expiry IS NULL THEN 14 ELSE CAST(greatest(0, least(14, floor((epoch_us(declared_expiry) - epoch_us(replay_at)) / 86400e6))) AS INT) END END AS recheck_after_days FROM a",
    "probe_dependence": f"""WITH {DECIDE}, z AS (SELECT *, CASE WHEN posting_state = 'closed' THEN 'skip' WHEN posting_state IS NULL OR posting_state = 'unknown' THEN 'wait' WHEN declared_expiry IS NOT NULL AND NOT (posting_state = 'open' AND quality = 'strong') THEN 'wait' WHEN posting_state = 'open' AND publish_recency = 'recent' AND quality = 'strong' THEN 'apply_now' ELSE 'quick_apply' END AS bare FROM a) SELECT bare AS without, action AS with_evidence, count(*) AS n, bare <> action AS dependent FROM z GROUP BY ALL""",
    "value_comparison": f"""WITH {PAIRS}, c AS (SELECT *, case_id % 4 AS pb, case_id % 5 AS pr, CAST("A" = "B" AS INT) AS hb, CAST("A" = "R" AS INT) AS hr FROM par WHERE "A" IS NOT NULL AND "B" IS NOT NULL AND "R" IS NOT NULL),
 k AS (SELECT "A", avg(hb) AS b, avg(hr) AS r, sum(hb - hr) AS net FROM c GROUP BY "A"), t AS (SELECT count(*) AS n, sum(pb) AS pb, sum(pr) AS pr, count(*) FILTER (pb < pr) AS cb, count(*) FILTER (pr < pb) AS cr, avg(hb) AS b, avg(hr) AS r, count(*) FILTER (hb > hr) AS ob, count(*) FILTER (hr > hb) AS ore FROM c),
 m AS (SELECT avg(b) AS mb, avg(r) AS mr, sum(greatest(net, 0)) AS nb, sum(greatest(-net, 0)) AS nr FROM k),
 f AS (SELECT *, (pr - pb) / pr AS rel FROM t, m), v AS (SELECT *, (rel >= 0.01 AND cb >= 10) OR (b - r >= 0.01 AND ob >= 10) OR (mb - mr >= 0.01 AND nb >= 10) AS won, (rel <= -0.01 AND cr >= 10) OR (r - b >= 0.01 AND ore >= 10) OR (mr - mb >= 0.01 AND nr >= 10) AS lost, (rel >= 0.01 AND cb < 10) OR (b - r >= 0.01 AND ob < 10) OR (mb - mr >= 0.01 AND nb < 10) AS weak FROM f)
 SELECT n AS compared, ob AS only_candidate, ore AS only_plain, CASE WHEN n < 30 THEN 'inconclusive' WHEN won AND lost THEN 'mixed' WHEN won THEN 'candidate_better' WHEN weak THEN 'inconclusive' ELSE 'adds_nothing' END AS status, round(rel, 6) AS relative_saving, round(b, 6) AS candidate_agreement, round(r, 6) AS plain_agreement, round(mb, 6) AS candidate_macro, round(mr, 6) AS plain_macro FROM v""",
    "unpopulated_inputs": f"WITH {CASES} SELECT case_id, {UNPOP} AS unpopulated FROM inp",
    "routed_probes": f"""WITH {CASES}, u AS (SELECT case_id, unnest(['board_history', 'team_signal', 'company_events', 'resolve']) AS probe, unnest([CAST(long_lived IS NULL AS INT) + CAST(repost_pattern IS NULL AS INT), CAST(corroborating_hiring_signal IS NULL AS INT) / 3.0, CAST(freeze_or_pause IS NULL AS INT) / 3.0, (CAST(posting_state IS NULL AS INT) + CAST(publish_recency IS NULL AS INT)) / 10.0]) AS s FROM inp),
 k AS (SELECT * FROM u WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY s DESC, probe) <= 2) SELECT i.case_id, coalesce(string_agg(k.probe, ',' ORDER BY k.s DESC, k.probe), '') AS probes FROM inp i LEFT JOIN k USING (case_id) GROUP BY i.case_id""",
    "budget_ledger": f"WITH RECURSIVE {DUCK}, go AS (SELECT run_id, 0 AS i, 0.0::DOUBLE AS c, 0.0::DOUBLE AS l, 0 AS n FROM (SELECT DISTINCT run_id FROM step) UNION ALL SELECT g.run_id, g.i + 1, CASE WHEN c + cost_usd <= 0.15 + 1e-9 AND l + latency_s <= 0.12 + 1e-9 THEN c + cost_usd ELSE c END, CASE WHEN c + cost_usd <= 0.15 + 1e-9 AND l + latency_s <= 0.12 + 1e-9 THEN l + latency_s ELSE l END, n + CAST(c + cost_usd <= 0.15 + 1e-9 AND l + latency_s <= 0.12 + 1e-9 AS INT) FROM go g JOIN step s ON s.run_id = g.run_id AND s.step_index = g.i + 1) SELECT run_id, max(i) AS steps, max(n) AS allowed, round(max(c), 4) AS spent FROM go GROUP BY run_id",
    "outcome_funnel": f"""WITH {DUCK}, {LATEST_ACTION}, o AS (SELECT coalesce(action, 'none') AS action, (conv_id + turn) % 7 AS k FROM conversations c LEFT JOIN act ON act.posting_id = c.conv_id)
 SELECT action, count(*) FILTER (k = 0) AS applied, count(*) FILTER (k = 1) AS reply, count(*) FILTER (k = 2) AS screen, count(*) FILTER (k = 3) AS interview, count(*) FILTER (k = 4) AS offer, count(*) FILTER (k = 5) AS rejection, count(*) FILTER (k = 6) AS silence, round(count(*) FILTER (k = 0) / nullif(count(*) FILTER (k = 1), 0), 6) AS applied_per_reply, round(count(*) FILTER (k = 0) / nullif(count(*) FILTER (k = 3), 0), 6) AS applied_per_interview FROM o GROUP BY action""",
    "leakage_audit": f"""WITH {FETCHED}, {CAPTURED}, {NEEDS},
 v AS (SELECT 'evidence_after_t' AS kind, e.run_id FROM evidence e JOIN run r USING (run_id) WHERE e.available_at > r.replay_at UNION ALL SELECT 'evidence_fetched_after_t', run_id FROM fet UNION ALL SELECT 'capture_fetched_after_t', run_id FROM capt UNION ALL SELECT 'cache_miss', run_id FROM step WHERE component <> 'model' AND cache_status = 'miss' UNION ALL SELECT 'model_cache_miss', run_id FROM step WHERE component = 'model' AND cache_status = 'miss'
 UNION ALL SELECT substr(decision_type, 18), run_id FROM step WHERE starts_with(decision_type, 'replay_violation:') UNION ALL SELECT 'missing_replay_at', run_id FROM run WHERE replay_at IS NULL
 UNION ALL SELECT 'input_without_evidence', run_id FROM (SELECT DISTINCT w.run_id, w.input, w.claims FROM want w) w WHERE NOT EXISTS (SELECT 1 FROM evidence e JOIN run r USING (run_id) WHERE e.run_id = w.run_id AND e.available_at <= r.replay_at AND list_contains(w.claims, e.claim_type))) SELECT kind, count(*) AS violations, count(DISTINCT run_id) AS runs FROM v GROUP BY kind""",
    "leakage_fetched_after": f"WITH {FETCHED} SELECT * FROM fet",
    "leakage_captures": f"WITH {CAPTURED_ALONE} SELECT 'capture_fetched_after_t' AS kind, run_id, strftime(at_, '%Y-%m-%d') AS day FROM capt",
    "leakage_exposures": f"""WITH {DUCK}, ex AS (SELECT DISTINCT run_id, step_index, CASE WHEN step_index % 2 = 0 THEN 'team_signal' ELSE 'company_events' END AS probe FROM step WHERE component = 'probe' AND run_id % 7 <> 0),
 an AS (SELECT run_id, unnest(CASE WHEN probe = 'team_signal' AND step_index % 5 = 0 THEN ['corroborating_hiring_signal'] WHEN probe = 'company_events' AND step_index % 5 = 1 THEN ['freeze_or_pause', 'last_material_event_at'] WHEN probe = 'company_events' AND step_index % 5 = 4 THEN ['material_negative_event'] ELSE [] END) AS item FROM ex)
 SELECT DISTINCT run_id, item FROM an WHERE NOT EXISTS (SELECT 1 FROM claim c JOIN asked q USING (case_id) WHERE c.case_id = an.run_id AND c.available_at <= q.replay_at AND CASE WHEN item = 'corroborating_hiring_signal' THEN c.claim_type = item ELSE c.claim_type IN ('company_events_searched', 'layoff', 'hiring_freeze', 'funding', 'shutdown') END)""",
    "policy_inputs": f"WITH {DERIVED} SELECT case_id, posting_state, publish_recency, material_negative_event, freeze_or_pause, declared_expiry, repost_pattern, corroborating_hiring_signal, last_material_event_at, rf AS last_refreshed_at, expiry_known, primary_publish, array_to_string(list_filter([CASE WHEN posting_state IS NULL THEN 'posting_state' END, CASE WHEN publish_recency IS NULL THEN 'publish_recency' END, CASE WHEN NOT searched THEN 'material_negative_event' END, CASE WHEN NOT searched THEN 'freeze_or_pause' END, CASE WHEN NOT expiry_known THEN 'declared_expiry' END, CASE WHEN repost_pattern IS NULL THEN 'repost_pattern' END, CASE WHEN corroborating_hiring_signal IS NULL THEN 'corroborating_hiring_signal' END, CASE WHEN NOT searched THEN 'last_material_event_at' END], lambda x: x IS NOT NULL), ',') AS unresolved FROM derived",
    "decisions_from_evidence": f"WITH {DERIVED}, inp AS (SELECT *, last_material_event_at AS ev, CAST(case_id % 23 = 0 AS INT) AS failures, case_id % 9 = 0 AS contradiction, CASE WHEN case_id % 3 <> 0 THEN case_id % 2 = 0 END AS long_lived FROM derived), {LADDER} SELECT case_id, quality, branch, action, {RECHECK} AS recheck_after_days FROM a",
    "flipping_claims": f"WITH {DUCK}, m AS (SELECT c.*, CASE WHEN lower(trim(split_part(value, ':', 1))) = 'minor' THEN 'minor' ELSE 'material' END AS mat FROM claim c JOIN asked q USING (case_id) WHERE probe = 'company_events' AND source_event_at IS NOT NULL AND CAST(source_event_at AS DATE) >= CAST(q.replay_at AS DATE) - 180) SELECT case_id, evidence_id, 'material' AS kind FROM m WHERE claim_type IN ('layoff', 'shutdown') AND mat = 'material' UNION ALL SELECT case_id, evidence_id, 'freeze' FROM m WHERE claim_type = 'hiring_freeze'",
    "routes": f"""WITH {DERIVED}, inp AS (SELECT *, last_material_event_at AS ev, CAST(case_id % 23 = 0 AS INT) AS failures, case_id % 9 = 0 AS contradiction, CASE WHEN case_id % 3 <> 0 THEN case_id % 2 = 0 END AS long_lived FROM derived), {LADDER},
 t AS (SELECT *, CASE WHEN posting_state IS NULL OR posting_state NOT IN ('open', 'reposted') THEN 'R0_terminal' WHEN publish_recency IS DISTINCT FROM 'recent' OR long_lived OR case_id % 4 = 0 OR case_id % 6 = 0 THEN 'R1_repost_suspicious' WHEN quality = 'strong' THEN 'R2_healthy' ELSE 'R3_uncertain' END AS rl, NOT searched OR freeze_or_pause OR material_negative_event AS matters,
  corroborating_hiring_signal IS NULL AND (coalesce(repost_pattern = 'repeated_unchanged' AND long_lived, false) OR (posting_state = 'open' AND quality = 'strong' AND publish_recency IS DISTINCT FROM 'recent' AND material_negative_event IS DISTINCT FROM true)) AS reach FROM a),
 n AS (SELECT case_id, rl AS rule, CASE WHEN rl = 'R0_terminal' THEN [] ELSE list_filter([CASE WHEN rl <> 'R2_healthy' THEN 'repost_history' END, CASE WHEN rl = 'R1_repost_suspicious' THEN 'requirements_drift' END, CASE WHEN rl = 'R2_healthy' OR matters THEN 'company_events' END, CASE WHEN reach THEN 'team_signal' END], lambda x: x IS NOT NULL) END AS routed FROM t),
 f AS (SELECT *, CASE WHEN case_id % 10 = 0 THEN [] WHEN case_id % 3 = 0 THEN ['company_events', 'team_signal'] ELSE ['repost_history', 'requirements_drift', 'company_events', 'team_signal'] END AS el FROM n),
 k AS (SELECT *, list_filter(routed, lambda x: list_contains(el, x))[1:2] AS probes FROM f)
 SELECT case_id, rule, array_to_string(routed, ',') AS routed, array_to_string(probes, ',') AS probes, array_to_string(list_transform(list_filter(routed, lambda x: NOT list_contains(probes, x)), lambda x: x || ':' || CASE WHEN case_id % 10 = 0 THEN 'identity_unresolved' WHEN NOT list_contains(el, x) THEN 'ineligible' ELSE 'step_cap' END), ',') AS dropped FROM k""",
    "product_gate": f"""WITH {DUCK}, {LATEST_ACTION}, o AS (SELECT conv_id AS p, (conv_id + turn) % 4 AS k FROM conversations), h AS (SELECT DISTINCT CAST(floor(case_id / 3.0) AS BIGINT) AS p FROM run WHERE CAST(floor(case_id / 3.0) AS BIGINT) % 3 <> 0),
 j AS (SELECT o.p, k, h.p IS NOT NULL AS held, action FROM o LEFT JOIN h ON h.p = o.p LEFT JOIN act ON act.posting_id = o.p), g AS (SELECT count(*) AS outcomes, count(DISTINCT p) AS postings, count(DISTINCT p) FILTER (held) AS held_out, count(DISTINCT p) FILTER (held AND action IS NOT NULL) AS matched,
 {', '.join(f"count(*) FILTER (held AND action {op} ('apply_now', 'quick_apply') AND k = {k}) AS {n}{k}" for n, op in (('r', 'IN'), ('o', 'NOT IN')) for k in (0, 1, 2))} FROM j), e AS (SELECT *, round(r0 / nullif(r1, 0), 6) AS rs, round(o0 / nullif(o1, 0), 6) AS os, round(r0 / nullif(r2, 0), 6) AS ri, round(o0 / nullif(o2, 0), 6) AS oi FROM g),
 m AS (SELECT *, array_to_string(list_filter([CASE WHEN outcomes = 0 THEN 'no outcomes' WHEN outcomes < 30 THEN 'too few outcomes' END, CASE WHEN held_out = 0 THEN 'no held-out postings' END, CASE WHEN outcomes > 0 AND matched = 0 THEN 'no runs' END, CASE WHEN rs IS NULL OR os IS NULL THEN 'no screens' END, CASE WHEN ri IS NULL OR oi IS NULL THEN 'no interviews' END], lambda x: x IS NOT NULL), '; ') AS missing FROM e)
 SELECT outcomes, postings, held_out, matched, missing, CASE WHEN missing <> '' THEN 'unproven' WHEN rs < os AND ri < oi THEN 'pass' ELSE 'fail' END AS status, rs AS recommended_per_screen, ri AS recommended_per_interview, os AS other_per_screen, oi AS other_per_interview FROM m""",
    "resume": f"WITH {DUCK} SELECT count(*) AS n, min(case_id) AS first, max(case_id) AS last FROM (SELECT DISTINCT case_id FROM run) c WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.case_id = c.case_id AND system = 'B' AND status = 'completed')",
    "shard_counts": f"WITH {DUCK} SELECT CAST(CAST(('0x' || substr(sha256(case_id || chr(10) || system), 1, 16)) AS UBIGINT) % 7 AS INT) AS shard, count(*) AS n FROM run GROUP BY ALL",
    "holdout_breach": f"WITH {DUCK} SELECT case_id % 37 AS company_id, count(*) AS cases FROM run WHERE (case_id % 37) % 9 = 4 GROUP BY ALL",
    "repeated_cases": f"WITH {DUCK} SELECT run_id, probe_name, args_hash, count(*) AS n FROM step GROUP BY ALL HAVING count(*) > 1",
    "visible_events": f"WITH {DUCK}, ca AS (SELECT case_id, company_id, replay_at - to_days(CAST(case_id % 2000 AS INT)) AS replay_at FROM run WHERE system = 'B' AND replay_at IS NOT NULL) SELECT case_id, count(event_at) AS events, max(event_at) AS latest_event_at FROM ca LEFT JOIN event e ON e.company_id = ca.company_id AND e.available_at <= replay_at GROUP BY case_id",
    "ranker_rows": f"WITH {RANKED} SELECT * FROM tr",
    "ranker_holdout": f"WITH {RANKED} SELECT holdout, probe, count(*) AS n, sum(label)::BIGINT AS positives, min(replay_at) AS first_at, max(replay_at) AS last_at FROM ho GROUP BY ALL",
    "ranker_by_cost": f"""WITH {RANKED}, h AS (SELECT label, -probe_cost_points AS s FROM ho WHERE holdout), t AS (SELECT median(s) AS m FROM h), k AS (SELECT s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM h GROUP BY s),
 a AS (SELECT sum(x.p * (y.n * CASE WHEN y.s < x.s THEN 1 WHEN y.s = x.s THEN 0.5 ELSE 0 END)) AS r FROM k x, k y) SELECT (SELECT count(*) FROM h) AS n, (SELECT sum(label)::BIGINT FROM h) AS positives, round((SELECT r FROM a) / (SELECT sum(p) * sum(n) FROM k), 6) AS auc, (SELECT round(avg(CAST((s >= m) = (label = 1) AS DOUBLE)), 6) FROM h, t) AS accuracy""",
    "controller_decisions": f"""WITH {CONTROL}, l AS (SELECT *, why IS NULL OR why IN ('no_eligible_candidate', 'cost_cap', 'latency_cap') AS late FROM c4) SELECT case_id, CASE WHEN why IS NULL THEN 'run' ELSE 'stop' END AS decision, coalesce(why, 'ranked_best') AS reason, CASE WHEN why IS NULL THEN ranking[1] END AS probe,
 CASE WHEN why IS NULL THEN CASE WHEN ranking[1] IN ('company_events', 'repost_history') THEN 'h' || (case_id % 2) ELSE 'h1' END END AS args_hash, array_to_string(CASE WHEN why = 'no_new_eligible_probe' THEN list_sort(elig) WHEN late THEN considered ELSE [] END, ',') AS considered,
 array_to_string(CASE WHEN why = 'investigator_error' THEN [':investigator_error'] WHEN late THEN list_concat(rejected, CASE why WHEN 'cost_cap' THEN [ranking[1] || ':budget_cost'] WHEN 'latency_cap' THEN [ranking[1] || ':budget_latency'] ELSE [] END) ELSE [] END, ',') AS rejected, array_to_string(CASE WHEN late THEN ranking ELSE [] END, ',') AS ranking FROM l""",
}
