"""Evidence quality, event signals and the first-match decision table, row by row.

Unknown is a null; conditions are coalesced to false, so that a null never reads as false where the table asks for a known answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import days_between, recheck_days
from larkspur.operators.running import at_moments
from larkspur.session import ship

# States that count as active, kinds of primary sources and of events.
ACTIVE = ("open", "reposted")
PRIMARY = ("ats_native", "page_structured")
MATERIAL_NEGATIVE, FREEZES = ("layoff", "shutdown"), ("hiring_freeze", "hiring_pause")


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def event_signals(cases: DataFrame, events: DataFrame, window_days: int = 180) -> DataFrame:
    """cases (case_id, company_id, replay_at, searched) with material_negative_event, freeze_or_pause and last_material_event_at.

    Events count if they were available at replay_at and not older than the window; a company that was never searched has unknown signals. Some
    event counts if and only if the latest one available does, so a running maximum of each kind answers all cases of a company in one pass.
    """
    material = F.col("event_type").isin(*MATERIAL_NEGATIVE) & (F.col("materiality") == "material")
    latest = {"__m": ("max", F.when(material, F.col("event_at"))), "__f": ("max", F.when(F.col("event_type").isin(*FREEZES), F.col("event_at")))}
    rows = at_moments(cases, events, ["company_id"], "available_at", latest)
    inside = lambda c: yes(F.to_date(c) >= F.date_sub(F.to_date("replay_at"), window_days))
    signal = lambda c: F.when(yes(F.col("searched")), inside(c))
    return rows.withColumn("last_material_event_at", F.when(inside("__m"), F.col("__m"))).withColumn("material_negative_event", signal("__m")).withColumn("freeze_or_pause", signal("__f")).drop("__m", "__f")


def contradictions(evidence: DataFrame, days: float = 3.0) -> DataFrame:
    """Per run: whether sources state publication dates further apart than days, and whether an open posting is absent from a fresher listing."""
    published = evidence.filter((F.col("claim_type") == "first_published") & F.col("source_event_at").isNotNull())
    by_source = published.groupBy("run_id", "source_quality", "source_url").agg(F.min("source_event_at").alias("at"))
    spread = by_source.groupBy("run_id").agg((days_between(F.max("at"), F.min("at")) > days).alias("publish_date_conflict"))
    order = F.struct("available_at", "fetched_at", "evidence_id")
    state = evidence.filter("claim_type = 'posting_state'").groupBy("run_id").agg(F.max_by("value", order).alias("state"), F.max_by("available_at", order).alias("state_at"))
    absent = evidence.filter("claim_type = 'board_absent'").groupBy("run_id").agg(F.max("available_at").alias("absent_at"))
    rows = evidence.select("run_id").distinct().join(spread, "run_id", "left").join(state, "run_id", "left").join(absent, "run_id", "left")
    fresher = (F.lower(F.trim("state")) == "open") & (F.col("absent_at") >= F.col("state_at"))
    return rows.select("run_id", yes(F.col("publish_date_conflict")).alias("publish_date_conflict"), yes(fresher).alias("open_but_absent"))


def evidence_quality() -> Column:
    """(quality, rule) from failures, primary_publish, posting_state and contradiction: the first rule that holds."""
    rule = (
        F.when(F.coalesce("failures", F.lit(0)) > 0, "probe_failure")
        .when(~yes(F.col("primary_publish")), "no_primary_publish_evidence")
        .when(F.coalesce("posting_state", F.lit("unknown")) == "unknown", "posting_state_unknown")
        .when(yes(F.col("contradiction")), "contradiction")
        .otherwise("strong")
    )
    return F.struct(F.when(rule == "strong", "strong").when(rule == "contradiction", "mixed").otherwise("weak").alias("quality"), rule.alias("rule"))


def branch() -> Column:
    """The first matching branch of the decision table."""
    state, strong = F.coalesce("posting_state", F.lit("unknown")), yes(F.col("quality") == "strong")
    active, negative = state.isin(*ACTIVE), yes(F.col("material_negative_event"))
    unanswered = F.col("last_material_event_at").isNotNull() & ~yes(F.col("last_refreshed_at") > F.col("last_material_event_at"))
    hiring = F.col("corroborating_hiring_signal")
    return (
        F.when(state == "closed", "P1_closed")
        .when(state == "unknown", "P2_state_unresolved")
        .when(active & yes(F.col("freeze_or_pause")), "P3a_freeze_or_pause")
        .when(active & F.col("declared_expiry").isNotNull() & ~((state == "open") & strong), "P3b_declared_expiry_unresolved")
        .when(active & negative & unanswered, "P3c_material_event_unrefreshed")
        .when(yes(F.col("repost_pattern") == "repeated_unchanged") & yes(F.col("long_lived")) & yes(~hiring), "P4_repeated_repost")
        .when((state == "open") & yes(F.col("publish_recency") == "recent") & ~negative & strong, "P5_open_recent_strong")
        .when((state == "open") & strong & ~negative & yes(hiring), "P5b_hiring_activity")
        .when(active & yes(F.col("quality").isin("mixed", "weak")), "P6_active_mixed_or_weak")
        .otherwise("P7_default")
    )


# The action of each branch.
ACTIONS = {
    "P1_closed": "skip", "P2_state_unresolved": "wait", "P3a_freeze_or_pause": "wait", "P3b_declared_expiry_unresolved": "wait", "P3c_material_event_unrefreshed": "wait",
    "P4_repeated_repost": "skip", "P5_open_recent_strong": "apply_now", "P5b_hiring_activity": "apply_now", "P6_active_mixed_or_weak": "quick_apply", "P7_default": "quick_apply",
}


def decided(inputs: DataFrame, now: str = "replay_at") -> DataFrame:
    """inputs with branch, action and, for wait alone, recheck_after_days."""
    rows = inputs.withColumn("branch", branch())
    action = F.coalesce(*[F.when(F.col("branch") == b, a) for b, a in ACTIONS.items()])
    return rows.withColumn("action", action).withColumn("recheck_after_days", F.when(F.col("action") == "wait", recheck_days("declared_expiry", now)))


def publish_recency(latest: Column | str, now: Column | str, recent_days: float = 30.0) -> Column:
    """recent or not_recent; a date in the future counts as recent; null without a date."""
    age = days_between(now, latest)
    return F.when(age <= recent_days, "recent").when(age > recent_days, "not_recent")


def unpopulated(names: list[str]) -> Column:
    """Names of the inputs that are unknown, in order."""
    return F.filter(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def routed(costs: dict[str, float], cap: int = 4) -> Column:
    """Probes that could populate an unknown input, the most useful for their cost first. Needs unknown (array of inputs) and, as columns, what each probe gives."""
    scored = [F.struct((-F.size(F.array_intersect("unknown", f"gives_{p}")) / F.lit(c)).alias("s"), F.lit(p).alias("probe")) for p, c in costs.items()]
    useful = F.filter(F.array_sort(F.array(*scored)), lambda x: x["s"] < 0)
    return F.slice(F.transform(useful, lambda x: x["probe"]), 1, cap)


def budget(steps: DataFrame, caps: dict[str, float], most: int | None = None) -> DataFrame:
    """steps (run_id, step_index and a column per cap) with what was spent up to each and whether it is allowed.

    A step runs while what its run spent before keeps to every cap together with the step itself; a step that doesn't fit is refused
    and costs nothing, and later ones may fit. most: how many steps of a run may be allowed. Steps are sorted by run and pass by one at a time, so a run may be of any length.
    """
    ship(steps.sparkSession)
    names, limits = list(caps), [cap + 1e-9 for cap in caps.values()]
    kept = ["run_id", "step_index", *[c for c in steps.columns if c not in ("run_id", "step_index")]]
    rows = steps.select(*kept, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{c}") for c in names])
    rows = rows.repartition("run_id").sortWithinPartitions("run_id", "step_index", *[f"__{c}" for c in names])
    schema = T.StructType([*steps.select(*kept).schema, T.StructField("allowed", T.BooleanType()), *[T.StructField(f"spent_{c}", T.DoubleType()) for c in names]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, spent, n = object(), [], 0
        for b in batches:
            allowed, sums = [], []
            for key, *costs in zip(b.column(0).to_pylist(), *[b.column(len(kept) + i).to_pylist() for i in range(len(names))], strict=True):
                if key != run:
                    run, spent, n = key, [0.0] * len(names), 0
                after = [x + c for x, c in zip(spent, costs)]  # noqa: B905
                fits = most is None or n < most
                for x, cap in zip(after, limits):  # noqa: B905
                    if not x <= cap:
                        fits = False
                if fits:
                    spent, n = after, n + 1
                allowed.append(fits)
                sums.append(spent)
            columns = [pa.array(c, pa.float64()) for c in (zip(*sums, strict=True) if sums else [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(allowed, pa.bool_()), *columns], schema.names)

    return rows.mapInArrow(fold, schema)
