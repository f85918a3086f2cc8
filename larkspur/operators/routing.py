"""Which probes a system runs: the fixed routing tree, eligibility with a cap, and the ranking of all eligible probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.policy import ACTIVE, yes

# The dynamic probes, the inputs that each may populate, and the names of the tree's rules.
POPULATES = {
    "repost_history": ("repost_pattern",),
    "requirements_drift": ("publish_recency",),
    "company_events": ("material_negative_event", "freeze_or_pause", "last_material_event_at"),
    "team_signal": ("corroborating_hiring_signal",),
}
TERMINAL, SUSPICIOUS, HEALTHY, UNCERTAIN = "R0_terminal", "R1_repost_suspicious", "R2_healthy", "R3_uncertain"


def suspicion() -> Column:
    """Why a posting looks like a repost, or null: no recent publication, or a history that says so."""
    return (
        F.when(~yes(F.col("publish_recency") == "recent"), "no trustworthy recent primary publish date")
        .when(yes(F.col("long_lived")), "posting history says long_lived")
        .when(F.col("first_seen_absent").isNotNull(), "posting has been observed absent from the board")
        .when(F.col("reappeared_at").isNotNull(), "posting has been observed reappearing")
    )


def events_matter() -> Column:
    """Whether company events may still shape the action: a signal is unknown, or true and in need of a citation."""
    m, f = F.col("material_negative_event"), F.col("freeze_or_pause")
    return m.isNull() | f.isNull() | yes(m) | yes(f)


def team_reachable() -> Column:
    """Whether the team's signal is open and could matter: for a repeated long-lived repost, or for an open posting with strong evidence that isn't recent and has no negative event."""
    repost = yes(F.col("repost_pattern") == "repeated_unchanged") & yes(F.col("long_lived"))
    hiring = yes(F.col("posting_state") == "open") & yes(F.col("quality") == "strong") & ~yes(F.col("publish_recency") == "recent") & ~yes(F.col("material_negative_event"))
    return F.col("corroborating_hiring_signal").isNull() & (repost | hiring)


def route() -> Column:
    """(rule, probes, reason) of the routing tree, first match wins, over the inputs, quality, long_lived, first_seen_absent and reappeared_at."""
    active = yes(F.col("posting_state").isin(*ACTIVE))
    why = suspicion()
    healthy = yes(F.col("publish_recency") == "recent") & yes(F.col("quality") == "strong")
    rule = F.when(~active, TERMINAL).when(why.isNotNull(), SUSPICIOUS).when(healthy, HEALTHY).otherwise(UNCERTAIN)
    named = lambda c, *names: F.when(c, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    events = named(events_matter(), "company_events")
    probes = F.when(~active, F.array().cast("array<string>")).otherwise(
        F.concat(
            F.when(rule == SUSPICIOUS, F.concat(named(F.lit(True), "repost_history", "requirements_drift"), events)).when(rule == HEALTHY, named(F.lit(True), "company_events")).otherwise(F.concat(named(F.lit(True), "repost_history"), events)),
            named(team_reachable(), "team_signal"),
        )
    )
    reason = (
        F.when(~active, F.when(yes(F.col("posting_state") == "closed"), "closed").otherwise("unresolved"))
        .when(rule == SUSPICIOUS, F.concat(F.lit("repost-suspicious: "), why))
        .when(rule == HEALTHY, "recent with strong evidence")
        .otherwise("mixed or weak evidence without suspicion")
    )
    return F.struct(rule.alias("rule"), probes.alias("probes"), reason.alias("reason"))


def selected(routed: str, eligible: str, cap: int = 4) -> Column:
    """(probes, dropped) of a routed list: ineligible names go, then what exceeds the cap. A null eligible list (no identity) drops all."""
    names = F.col(routed)
    known = F.col(eligible).isNotNull()
    allowed = F.when(known, F.filter(names, lambda x: F.array_contains(F.col(eligible), x))).otherwise(F.array().cast("array<string>"))
    reason = lambda x: F.when(~known, "identity_unresolved").when(~F.array_contains(F.col(eligible), x), "ineligible").otherwise("step_cap")
    taken = F.slice(allowed, 1, cap)
    dropped = F.transform(F.filter(names, lambda x: ~F.array_contains(taken, x)), lambda x: F.struct(x.alias("probe"), reason(x).alias("why")))
    return F.struct(taken.alias("probes"), dropped.alias("dropped"))


def proposed(rows: DataFrame, costs: dict[str, float], could_change: str = "could_change", executed: str = "executed") -> DataFrame:
    """rows with proposed: every probe that could populate an input that matters and hasn't run, by useful inputs for its cost, then by name."""
    entries = []
    for probe, gives in POPULATES.items():
        useful = F.array_intersect(F.col(could_change), F.array(*map(F.lit, gives)))
        hit = (F.size(useful) > 0) & ~yes(F.array_contains(F.col(executed), probe))
        entries.append(F.when(hit, F.struct((-F.size(useful) / F.lit(float(costs[probe]))).alias("rank"), F.lit(probe).alias("probe"), F.sort_array(useful).alias("expected"), F.lit(float(costs[probe])).alias("cost"))))
    return rows.withColumn("proposed", F.array_sort(F.filter(F.array(*entries), lambda x: x.isNotNull())))


def next_step(spent: Column, steps: Column, most_steps: int, most_cost: float) -> Column:
    """(verdict, probe, why) of the controller, over action, could_change and proposed: run the best proposal that the budget bears, or stop for the first reason that holds."""
    best = F.get(F.filter("proposed", lambda x: spent + x["cost"] <= most_cost + 1e-9), F.lit(0))
    why = (
        F.when(F.size("could_change") == 0, "no_unresolved_question")
        .when(steps >= most_steps, "step_cap")
        .when(F.size("proposed") == 0, "no_eligible_candidate")
        .when(best.isNull(), "cost_cap")
    )
    return F.struct(F.when(why.isNull(), "RUN").otherwise("STOP").alias("verdict"), F.when(why.isNull(), best["probe"]).alias("probe"), why.alias("why"))
