"""Pairing of systems' runs, agreement, costs, citations and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import ratio
from larkspur.session import sized_broadcast


def latest_by_case(runs: DataFrame, case: list[str], order: list[str]) -> DataFrame:
    """The latest run per system and case, with the number of others it stands for."""
    w = Window.partitionBy("system", *case)
    rows = runs.withColumn("duplicates", F.count("*").over(w) - 1)
    return rows.withColumn("__n", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).filter("__n = 1").drop("__n")


def paired(latest: DataFrame, case: list[str], systems: list[str], value: str) -> DataFrame:
    """A row per case with each system's value; null where a system has no run."""
    return latest.groupBy(*case).pivot("system", systems).agg(F.first(value))


def compared(pairs: DataFrame, *systems: str) -> DataFrame:
    """Cases in which all systems have a run."""
    for s in systems:
        pairs = pairs.filter(F.col(s).isNotNull())
    return pairs


def agreement(pairs: DataFrame, reference: str, system: str) -> DataFrame:
    """Cases, agreement, and macro agreement (the mean over the reference's classes). A null action never agrees, but counts."""
    rows = pairs.withColumn("same", F.coalesce((F.col(reference) == F.col(system)).cast("double"), F.lit(0.0)))
    by_class = rows.groupBy(reference).agg(F.count("*").alias("n"), F.sum("same").alias("s"))
    return by_class.agg(F.sum("n").alias("compared"), ratio(F.sum("s"), F.sum("n")).alias("agreement"), F.avg(F.when(F.col(reference).isNotNull(), F.col("s") / F.col("n"))).alias("macro_agreement"))


def value_comparison(cases: DataFrame, reference: str, candidate: str, plain: str, least_cases: int = 30, least_differing: int = 10, saving: float = 0.01, gain: float = 0.01) -> DataFrame:
    """Whether a candidate beats a plain system: one row with both rates and a status.

    cases: an action per system and <system>_probes, its costly probes. A side wins a dimension (probe use, agreement, macro agreement)
    by a large enough rate with enough cases behind it; rates without enough cases leave the result inconclusive.
    """
    r, c, d = (F.col(x) for x in (reference, candidate, plain))
    hit = lambda x: F.coalesce(r == x, F.lit(False))
    by_class = cases.groupBy(reference).agg(
        F.count("*").alias("n"), F.sum(F.col(f"{candidate}_probes")).alias("pc"), F.sum(F.col(f"{plain}_probes")).alias("pd"), F.count_if(F.col(f"{candidate}_probes") < F.col(f"{plain}_probes")).alias("cc"), F.count_if(F.col(f"{plain}_probes") < F.col(f"{candidate}_probes")).alias("cd"),
        F.count_if(hit(c)).alias("hc"), F.count_if(hit(d)).alias("hd"), F.count_if(hit(c) & ~hit(d)).alias("oc"), F.count_if(hit(d) & ~hit(c)).alias("od"),
    )
    known = r.isNotNull()
    better, worse = F.col("oc") > F.col("od"), F.col("od") > F.col("oc")
    out = by_class.agg(
        F.sum("n").alias("n"), F.sum("pc").alias("pc"), F.sum("pd").alias("pd"), F.sum("cc").alias("cc"), F.sum("cd").alias("cd"), ratio(F.sum("hc"), F.sum("n")).alias("ac"), ratio(F.sum("hd"), F.sum("n")).alias("ad"), F.sum("oc").alias("oc"), F.sum("od").alias("od"),
        F.avg(F.when(known, F.col("hc") / F.col("n"))).alias("mc"), F.avg(F.when(known, F.col("hd") / F.col("n"))).alias("md"), F.sum(F.when(known & better, F.col("oc") - F.col("od")).otherwise(0)).alias("nc"), F.sum(F.when(known & worse, F.col("od") - F.col("oc")).otherwise(0)).alias("nd"),
    )
    rel = ratio(F.col("pd") - F.col("pc"), F.col("pd"))
    sides = [((rel >= saving), F.col("cc")), (F.col("ac") - F.col("ad") >= gain, F.col("oc")), (F.col("mc") - F.col("md") >= gain, F.col("nc"))]
    against = [((rel <= -saving), F.col("cd")), (F.col("ad") - F.col("ac") >= gain, F.col("od")), (F.col("md") - F.col("mc") >= gain, F.col("nd"))]
    some = lambda xs, enough: F.greatest(*[F.coalesce((x & ((n >= least_differing) == F.lit(enough))).cast("int"), F.lit(0)) for x, n in xs]) == 1
    won, lost, weak = some(sides, True), some(against, True), some(sides, False)
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "not_run").when(F.col("n") < least_cases, "inconclusive").when(won & lost, "mixed").when(won, "candidate_better").when(weak, "inconclusive").otherwise("adds_nothing")
    return out.select(F.col("n").alias("compared"), rel.alias("relative_saving"), F.col("ac").alias("candidate_agreement"), F.col("ad").alias("plain_agreement"), F.col("mc").alias("candidate_macro"), F.col("md").alias("plain_macro"), F.col("oc").alias("only_candidate"), F.col("od").alias("only_plain"), status.alias("status"))


def dependence(decided: DataFrame, actual: str, bare: str) -> DataFrame:
    """Transitions between the action without extra evidence and the actual one, and whether the case depends on that evidence."""
    rows = decided.groupBy(F.col(bare).alias("without"), F.col(actual).alias("with_evidence")).agg(F.count("*").alias("n"))
    return rows.withColumn("dependent", ~F.col("without").eqNullSafe(F.col("with_evidence")))


def confusion(pairs: DataFrame, reference: str, system: str) -> DataFrame:
    return pairs.groupBy(F.col(reference).alias("reference_action"), F.col(system).alias("system_action")).agg(F.count("*").alias("n"))


def exclusive_gains(pairs: DataFrame, reference: str, candidate: str, baseline: str) -> DataFrame:
    """Per class of the reference: cases that only the candidate, or only the baseline, gets right, and the net."""
    a, b = (F.coalesce(F.col(reference) == F.col(s), F.lit(False)) for s in (candidate, baseline))
    out = pairs.groupBy(F.col(reference).alias("reference_action")).agg(F.count_if(a & ~b).alias("candidate_only"), F.count_if(b & ~a).alias("baseline_only"))
    return out.withColumn("net", F.col("candidate_only") - F.col("baseline_only"))


def step_metrics(runs: DataFrame, steps: DataFrame, costs: DataFrame) -> DataFrame:
    """Per system: probe executions by tier, repeats (the same probe and arguments again in a run), cost, latency and hits."""
    probes = steps.filter("component = 'probe'")
    again = probes.groupBy("run_id", "probe_name", "args_hash").agg(F.count("*").alias("k")).groupBy("run_id").agg(F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("repeats"))
    tiers = probes.join(sized_broadcast(costs), "probe_name", "left").groupBy("run_id").agg(*[F.count_if(F.col("tier") == t).alias(f"{t}_probes") for t in ("low", "medium", "high")], F.count_if(F.col("cache_status") == "hit").alias("hits"), F.count("*").alias("probes"))
    own = steps.groupBy("run_id").agg(F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"), F.sum(F.coalesce("latency_s", F.lit(0.0))).alias("latency"))
    rows = runs.select("run_id", "system").join(own, "run_id", "left").join(tiers, "run_id", "left").join(again, "run_id", "left")
    sums = ("low_probes", "medium_probes", "high_probes", "hits", "probes", "repeats")
    out = rows.groupBy("system").agg(F.count("*").alias("runs"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums], F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost_usd"), F.sum(F.coalesce("latency", F.lit(0.0))).alias("latency_s"))
    return out.withColumn("probes_per_run", ratio("probes", "runs"))


def probe_order(steps: DataFrame) -> DataFrame:
    """Per run, its probes in order of first execution, each once."""
    first = steps.filter("component = 'probe'").groupBy("run_id", "probe_name").agg(F.min("step_index").alias("at"))
    return first.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "probe_name"))), lambda x: x["probe_name"]).alias("probes"))


def unnecessary_steps(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per run: probe executions that left no evidence."""
    made = evidence.select("run_id", F.col("probe").alias("probe_name")).distinct()
    return steps.filter("component = 'probe'").join(made, ["run_id", "probe_name"], "left_anti").groupBy("run_id").agg(F.count("*").alias("unnecessary"))


def missed_probes(reference: Column | str, system: Column | str) -> Column:
    """Probes that the reference ran and the system didn't."""
    return F.array_except(reference, system)


def citation_support(reasons: DataFrame, evidence: DataFrame) -> DataFrame:
    """Reasons (run_id, reason_index, evidence_ids): how many cite something, and how many only what exists in their run."""
    cited = reasons.select("run_id", "reason_index", F.explode_outer("evidence_ids").alias("evidence_id"))
    there = evidence.select("run_id", "evidence_id", F.lit(1).alias("there")).distinct()
    per = cited.join(there, ["run_id", "evidence_id"], "left").groupBy("run_id", "reason_index").agg(F.count("evidence_id").alias("ids"), F.count("there").alias("found"))
    return per.agg(F.count("*").alias("reasons"), F.count_if(F.col("ids") > 0).alias("cited"), F.count_if((F.col("ids") > 0) & (F.col("ids") == F.col("found"))).alias("supported"), ratio(F.count_if((F.col("ids") > 0) & (F.col("ids") == F.col("found"))), F.count("*")).alias("support_rate"))


def latest_actions(runs: DataFrame) -> DataFrame:
    """posting_id, action of the latest completed run of each posting that decided on one, by (started_at, run_id)."""
    known = runs.filter((F.col("status") == "completed") & F.col("action").isNotNull() & F.col("posting_id").isNotNull())
    return known.groupBy("posting_id").agg(F.max_by("action", F.struct("started_at", "run_id")).alias("action"))


def outcome_funnel(outcomes: DataFrame, actions: DataFrame) -> DataFrame:
    """Per recommended action: how many postings reached each outcome, and effort for each reply and interview."""
    rows = outcomes.join(actions, "posting_id", "left").withColumn("action", F.coalesce("action", F.lit("none")))
    kinds = ("applied", "reply", "screen", "interview", "offer", "rejection", "silence")
    out = rows.groupBy("action").agg(*[F.count_if(F.col("outcome_type") == k).alias(k) for k in kinds])
    return out.withColumn("applied_per_reply", ratio("applied", "reply")).withColumn("applied_per_interview", ratio("applied", "interview"))


def product_gate(outcomes: DataFrame, splits: DataFrame | None, actions: DataFrame, allowed: tuple[str, ...] = ("test",), recommended: tuple[str, ...] = ("apply_now", "quick_apply"), least: int = 30) -> DataFrame:
    """One row: whether recommended postings took less effort for each screen and interview than the others, over held-out postings.

    outcomes: posting_id, outcome_type. splits: posting_id, split, or None, which shows no posting to be held out. actions: posting_id, action. status is
    unproven, with what is missing, unless there are `least` outcomes, held-out postings, runs of theirs, and all four ratios.
    """
    rows = outcomes.withColumn("held", F.lit(False)) if splits is None else outcomes.join(splits.filter(F.col("split").isin(*allowed)).select("posting_id", F.lit(True).alias("held")).distinct(), "posting_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    rows = rows.join(actions, "posting_id", "left").withColumn("scoped", F.lit(True) if splits is None else F.col("held"))
    matched, chosen = F.col("scoped") & F.col("action").isNotNull(), F.col("action").isin(*recommended)
    count = lambda side, kind: F.count_if(matched & side & (F.col("outcome_type") == kind))
    out = rows.agg(
        F.count("*").alias("outcomes"), F.countDistinct("posting_id").alias("postings"), F.countDistinct(F.when(F.col("held"), F.col("posting_id"))).alias("held_out"), F.countDistinct(F.when(matched, F.col("posting_id"))).alias("matched"),
        *[count(side, kind).alias(f"{n}_{kind}") for n, side in (("recommended", chosen), ("other", ~chosen)) for kind in ("applied", "screen", "interview")],
    )
    for n in ("recommended", "other"):
        for kind in ("screen", "interview"):
            out = out.withColumn(f"{n}_per_{kind}", ratio(f"{n}_applied", f"{n}_{kind}"))
    missing = [
        F.when(F.col("outcomes") == 0, "no outcomes").when(F.col("outcomes") < least, "too few outcomes"),
        F.lit("no splits") if splits is None else F.when(F.col("held_out") == 0, "no held-out postings"),
        F.when((F.col("outcomes") > 0) & (F.col("matched") == 0), "no runs"),
        F.when(F.col("recommended_per_screen").isNull() | F.col("other_per_screen").isNull(), "no screens"),
        F.when(F.col("recommended_per_interview").isNull() | F.col("other_per_interview").isNull(), "no interviews"),
    ]
    out = out.withColumn("missing", F.array_join(F.filter(F.array(*missing), lambda x: x.isNotNull()), "; "))
    better = (F.col("recommended_per_screen") < F.col("other_per_screen")) & (F.col("recommended_per_interview") < F.col("other_per_interview"))
    return out.withColumn("status", F.when(F.col("missing") != "", "unproven").when(better, "pass").otherwise("fail"))


def evidence_quality_coverage(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Per system and source quality: evidence, runs and cases that have any, and the share of the system's runs."""
    rows = evidence.join(runs.select("run_id", "system"), "run_id")
    total = runs.groupBy("system").agg(F.count("*").alias("runs_of_system"))
    out = rows.groupBy("system", "source_quality").agg(F.count("*").alias("evidence"), F.countDistinct("run_id").alias("runs"))
    return out.join(total, "system").withColumn("share", ratio("runs", "runs_of_system")).drop("runs_of_system")


def efficiency(orders: DataFrame, reference: str, system: str, settled: str, final: str) -> DataFrame:
    """One row over cases with each system's probes (arrays) and actions: probes saved and missed against the reference, cases in which a missed probe cost the reference's action (regret), and in which probes moved the action to it (recovery).

    orders: <system>_probes and <system>_action for both systems; settled is the action before dynamic probes, final the system's action.
    """
    ref, own = F.col(f"{reference}_probes"), F.col(f"{system}_probes")
    missed, extra = missed_probes(ref, own), missed_probes(own, ref)
    right = F.coalesce(F.col(final) == F.col(f"{reference}_action"), F.lit(False))
    before = F.coalesce(F.col(settled) == F.col(f"{reference}_action"), F.lit(False))
    out = orders.agg(
        F.count("*").alias("cases"), F.sum(F.size(ref)).alias("reference_probes"), F.sum(F.size(own)).alias("probes"), F.sum(F.size(missed)).alias("missed"), F.sum(F.size(extra)).alias("extra"),
        F.count_if(~right & (F.size(missed) > 0)).alias("regret"), F.count_if(right & ~before).alias("recovered"), F.count_if(~right & before).alias("spoiled"),
    )
    return out.withColumn("saving", ratio(F.col("reference_probes") - F.col("probes"), "reference_probes"))


def agent_gate(candidate: DataFrame, baseline: DataFrame, cost_ratio: float = 0.70, margin: float = 0.02, tolerance: float = 1e-9) -> DataFrame:
    """One row each (agreement, macro_agreement, cost): the legs of the gate and whether all hold."""
    rows = candidate.select(*[F.col(c).alias(f"c_{c}") for c in ("agreement", "macro_agreement", "cost")]).crossJoin(F.broadcast(baseline.select(*[F.col(c).alias(f"b_{c}") for c in ("agreement", "macro_agreement", "cost")])))
    legs = [F.col("c_agreement") >= F.col("b_agreement") - margin - tolerance, F.col("c_macro_agreement") >= F.col("b_macro_agreement") - margin - tolerance, F.col("c_cost") <= cost_ratio * F.col("b_cost") + tolerance]
    names = ("agreement_held", "macro_held", "cheaper")
    return rows.select(*[x.alias(n) for x, n in zip(legs, names, strict=True)], (legs[0] & legs[1] & legs[2]).alias("passed"))


def era(moment: Column | str, boundary: Column | str) -> Column:
    """archive before the boundary, live from it on, unknown without one."""
    b = F.col(boundary) if isinstance(boundary, str) else boundary
    m = F.col(moment) if isinstance(moment, str) else moment
    return F.when(b.isNull(), "unknown").when(m < b, "archive").otherwise("live")
