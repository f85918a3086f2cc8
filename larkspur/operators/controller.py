"""The controller: what an investigator proposes is checked, ranked and held to its budget, case by case, and one probe runs or the case stops.

Column expressions over a row per case: could_change (inputs that could still change the action), eligible (probes allowed now; null without an identity), executed
(structs of probe and args_hash), hashes (each known probe's canonical args_hash, by name), steps_left, spent_cost, spent_latency, error, and output: null
where the investigator failed, else a struct of stop and candidates (structs of probe and valid, in the order proposed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.scalars import bound
from larkspur.operators.policy import yes
from larkspur.operators.routing import POPULATES

# Why a case stops and why a candidate is refused, each in the order in which they are looked for.
STOPS = ("no_unresolved_question", "step_cap", "no_new_eligible_probe", "investigator_error", "investigator_stop", "no_eligible_candidate", "cost_cap", "latency_cap")
REFUSALS = ("over_candidate_limit", "unknown_probe", "invalid_args", "ineligible", "duplicate", "no_useful_input", "budget_cost", "budget_latency", "step_cap")
REFUSAL = "struct<probe:string,reason:string>"


def ran(probe: Column) -> Column:
    """Whether a probe was executed with its canonical arguments."""
    return yes(F.exists("executed", lambda e: (e["probe"] == probe) & (e["args_hash"] == F.try_element_at("hashes", probe))))


def usefulness(probe: Column) -> Column:
    """How many of the inputs that could change the action a probe may populate; null for unknown probes."""
    gives = F.create_map(*[x for p, names in POPULATES.items() for x in (F.lit(p), F.array(*map(F.lit, names)))])
    return F.size(F.array_intersect(F.try_element_at(gives, probe), F.col("could_change")))


def refusal(at: Column, candidates: Column, limit: int, useful: Callable[[Column], Column] = usefulness) -> Column:
    """Why the candidate at a place (from 0) is refused, or null: the first reason that holds. useful: the usefulness of a probe."""
    c = F.get(candidates, at)
    name, valid = c["probe"], yes(c["valid"])
    # of equal proposals the first one that gets this far counts; an invalid one does not
    again = F.exists(F.slice(candidates, F.lit(1), at), lambda x: (x["probe"] == name) & yes(x["valid"]))
    known = name.isin(*POPULATES)
    return (
        F.when(at >= limit, "over_candidate_limit")
        .when(~yes(known), "unknown_probe")
        .when(F.col("eligible").isNull(), "ineligible")
        .when(~valid, "invalid_args")
        .when(~yes(F.array_contains("eligible", name)), "ineligible")
        .when(ran(name) | (yes(again) & (useful(name) > 0)), "duplicate")
        .when(useful(name) == 0, "no_useful_input")
    )


def decision(costs: dict[str, float], latencies: dict[str, float], max_cost: float, max_latency: float, limit: int = 8) -> Column:
    """A struct of decision (run or stop), reason, probe and args_hash, considered, rejected (structs of probe and reason) and ranking (structs of probe and score).

    Facts stop a case before the investigator's opinion does: open questions, steps and probes left come first. Candidates that pass are ranked by useful inputs for
    their cost, then by name; only the best is held to the budget: cost first, then latency.
    """
    found = F.coalesce(F.col("output.candidates"), F.array().cast("array<struct<probe:string,valid:boolean>>"))
    each_probe = F.create_map(*[x for p in POPULATES for x in (F.lit(p), usefulness(F.lit(p)))])
    price, wait = (F.create_map(*[x for p, v in d.items() for x in (F.lit(p), F.lit(float(v)))]) for d in (costs, latencies))

    def ranked(each: Column, useful: Column) -> Column:
        passed = F.filter(each, lambda x: x["reason"].isNull())
        return F.array_sort(F.transform(passed, lambda x: F.struct((-F.try_element_at(useful, x["probe"]) / F.try_element_at(price, x["probe"])).alias("minus"), x["probe"].alias("probe"))))

    def reason(best: Column) -> Column:
        dear = F.col("spent_cost") + F.try_element_at(price, best) > max_cost
        slow = F.col("spent_latency") + F.try_element_at(wait, best) > max_latency
        new = F.exists("eligible", lambda p: ~ran(p))
        return (
            F.when(F.size("could_change") == 0, STOPS[0])
            .when(F.col("steps_left") <= 0, STOPS[1])
            .when(F.col("eligible").isNotNull() & ~yes(new), STOPS[2])
            .when(F.col("output").isNull(), STOPS[3])
            .when(yes(F.col("output.stop")), STOPS[4])
            .when(best.isNull(), STOPS[5])
            .when(dear, STOPS[6])
            .when(slow, STOPS[7])
        )

    def refusals(found: Column, useful: Column) -> Column:
        places = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.get(found, i)["probe"].alias("probe"), refusal(i, found, limit, lambda p: F.try_element_at(useful, p)).alias("reason")))

    # each step is bound before the next one names it: candidates and each probe's usefulness, refusals, the ranking, and why the case stops
    steps = bound(each_probe, lambda u: bound(found, lambda f: bound(refusals(f, u), lambda e: F.struct(f.alias("found"), e.alias("each"), ranked(e, u).alias("ranked")))))
    return bound(steps, lambda s: bound(reason(F.get(s["ranked"], F.lit(0))["probe"]), lambda why: _outcome(s["found"], s["each"], s["ranked"], why, limit)))


def _outcome(found: Column, each: Column, ranked: Column, why: Column, limit: int) -> Column:
    """The struct of a decision from the candidates, their refusals, the ranking and why the case stops."""
    none = F.array().cast("array<string>")
    best = F.get(ranked, F.lit(0))["probe"]
    over = F.filter(each, lambda x: yes(x["reason"] == "over_candidate_limit"))
    refused = F.concat(over, F.filter(each, lambda x: x["reason"].isNotNull() & (x["reason"] != "over_candidate_limit")))
    # what was looked at before the case stopped
    late = why.isNull() | why.isin(*STOPS[5:])
    considered = F.when(why == STOPS[2], F.array_sort("eligible")).when(late, F.slice(F.transform(found, lambda x: x["probe"]), 1, limit)).otherwise(none)
    last = F.when(why == STOPS[6], F.array(F.struct(best.alias("probe"), F.lit("budget_cost").alias("reason")))).when(why == STOPS[7], F.array(F.struct(best.alias("probe"), F.lit("budget_latency").alias("reason")))).otherwise(F.array().cast(f"array<{REFUSAL}>"))
    note = F.array(F.struct(F.lit("").alias("probe"), F.lit(STOPS[3]).alias("reason")))
    rejected = F.when(why == STOPS[3], note).when(late, F.concat(refused, last)).otherwise(F.array().cast(f"array<{REFUSAL}>"))
    ranking = F.when(late, F.transform(ranked, lambda x: F.struct(x["probe"].alias("probe"), (-x["minus"]).alias("score")))).otherwise(F.array().cast("array<struct<probe:string,score:double>>"))
    runs = why.isNull()
    return F.struct(
        F.when(runs, "run").otherwise("stop").alias("decision"), F.coalesce(why, F.lit("ranked_best")).alias("reason"), F.when(runs, best).alias("probe"), F.when(runs, F.try_element_at("hashes", best)).alias("args_hash"),
        considered.alias("considered"), rejected.alias("rejected"), ranking.alias("ranking"),
    )
