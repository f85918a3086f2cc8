"""Policy inputs from evidence: what a case's claims say, in one pass over them.

evidence: case_id, evidence_id, probe, claim_type, value, source_quality, source_event_at, available_at, fetched_at. Null is unknown throughout. Of
several claims the newest counts, by (available_at, fetched_at, evidence_id). A claim without a date can't be placed in time and says nothing
where a date is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import split_value
from larkspur.operators.policy import FREEZES, MATERIAL_NEGATIVE, PRIMARY, publish_recency, yes

# Probes and claims.
RESOLVER, TEAM_PROBE, EVENTS_PROBE = "resolve_posting", "team_signal", "company_events"
STATE, FIRST_PUBLISHED, REFRESHED, EXPIRY, TEAM_CLAIM, SEARCHED = "posting_state", "first_published", "refreshed_at", "declared_expiry", "corroborating_hiring_signal", "company_events_searched"
EVENT_CLAIMS = ("layoff", "hiring_freeze", "hiring_pause", "shutdown", "funding", "expansion", "acquisition", "other")
# What states, answers and materialities are written as.
STATES, DECISIVE, TRUE_VALUES, FALSE_VALUES, MATERIALITIES = ("open", "closed", "reposted", "unknown"), ("open", "closed", "reposted"), ("true", "yes", "1"), ("false", "no", "0"), ("material", "minor")
NAMES = ("posting_state", "publish_recency", "material_negative_event", "freeze_or_pause", "declared_expiry", "repost_pattern", "corroborating_hiring_signal", "last_material_event_at")


def freshness() -> Column:
    return F.struct("available_at", "fetched_at", "evidence_id")


def newest(value: str, which: Column) -> Column:
    """Aggregate: the value of the newest of the claims that hold which."""
    return F.max_by(value, F.when(which, freshness()))


def dated() -> Column:
    return F.col("source_event_at").isNotNull()


def primary_publish() -> Column:
    """Whether a claim states a publication, with a date, from a primary source."""
    return (F.col("claim_type") == FIRST_PUBLISHED) & dated() & F.coalesce(F.col("source_quality").isin(*PRIMARY), F.lit(False))


def best_publish(value: str) -> Column:
    """Aggregate: the value of the best publication claim: the better source, then the earlier date, then the smaller id."""
    tier = F.when(F.col("source_quality") == PRIMARY[0], 0).otherwise(1)
    return F.min_by(value, F.when(primary_publish(), F.struct(tier, F.col("source_event_at"), F.col("evidence_id"))))


def event_claim() -> Column:
    return (F.col("probe") == EVENTS_PROBE) & F.col("claim_type").isin(*EVENT_CLAIMS) & dated()


def claim_materiality(value: Column | str) -> Column:
    """What stands before the first colon, if it is a materiality; material where the claim doesn't say: a layoff must not be dropped unseen."""
    head, _ = split_value(value, ":")
    token = F.lower(F.trim(head))
    return F.when(token.isin(*MATERIALITIES), token).otherwise("material")


def flips(kind: str, now: Column, window_days: int) -> Column:
    """Whether a claim alone makes material_negative_event (kind material) or freeze_or_pause (kind freeze) true."""
    inside = F.to_date("source_event_at") >= F.date_sub(F.to_date(now), window_days)
    what = F.col("claim_type").isin(*MATERIAL_NEGATIVE) & (claim_materiality("value") == "material") if kind == "material" else F.col("claim_type").isin(*FREEZES)
    return yes(event_claim() & inside & what)


def flipping_claims(cases: DataFrame, evidence: DataFrame, kind: str, window_days: int = 180) -> DataFrame:
    """case_id, evidence_id of the claims that alone set a signal: what a reason has to cite."""
    rows = evidence.join(cases.select("case_id", "replay_at"), "case_id")
    return rows.filter(flips(kind, F.col("replay_at"), window_days)).select("case_id", "evidence_id")


def policy_inputs(cases: DataFrame, evidence: DataFrame, history: DataFrame | None = None, recent_days: float = 30.0, window_days: int = 180) -> DataFrame:
    """cases (case_id, replay_at, resolver_ok) with the policy's inputs NAMES, and with last_refreshed_at, expiry_known, events_searched, primary_publish and first_published.

    history (case_id, repost_pattern) gives the repost pattern; without it the pattern is unknown. declared_expiry is null where none is declared and
    where that is unknown; expiry_known tells these apart: it is known if a dated claim states it, or if the resolver ran and succeeded and the state is decisive.
    One aggregate over the evidence; claims are never gathered in lists.
    """
    claims = evidence.filter(F.col("claim_type").isNotNull()).join(cases.select("case_id", "replay_at"), "case_id")
    state, expiry, team = F.col("claim_type") == STATE, F.col("claim_type") == EXPIRY, (F.col("claim_type") == TEAM_CLAIM) & (F.col("probe") == TEAM_PROBE)
    resolver = F.coalesce(F.col("probe") == RESOLVER, F.lit(False))
    now = F.col("replay_at")
    found = claims.groupBy("case_id").agg(
        newest("value", state & resolver).alias("resolved"), F.bool_or(state & resolver).alias("has_resolved"), newest("value", state).alias("stated"),
        best_publish("source_event_at").alias("first_published"), F.bool_or(primary_publish()).alias("primary_publish"), newest("source_event_at", (F.col("claim_type") == REFRESHED) & dated()).alias("refreshed"),
        newest("source_event_at", expiry & dated()).alias("expiry"), F.bool_or(resolver).alias("resolver_ran"), newest("value", team).alias("team"),
        F.bool_or((F.col("probe") == EVENTS_PROBE) & (F.col("claim_type") == SEARCHED)).alias("searched"),
        F.bool_or(flips("material", now, window_days)).alias("material"), F.bool_or(flips("freeze", now, window_days)).alias("freeze"),
        F.max(F.when(flips("material", now, window_days), F.to_date("source_event_at").cast("timestamp"))).alias("material_at"),
    )
    rows = cases.join(found, "case_id", "left")
    said = F.lower(F.trim(F.when(yes(F.col("has_resolved")), F.col("resolved")).otherwise(F.col("stated"))))
    rows = rows.withColumn("posting_state", F.when(said.isin(*STATES), said)).withColumn("events_searched", yes(F.col("searched")))
    answer = F.lower(F.trim("team"))
    known = F.col("expiry").isNotNull() | (yes(F.col("resolver_ok")) & yes(F.col("resolver_ran")) & yes(F.col("posting_state").isin(*DECISIVE)))
    rows = rows.withColumn("last_refreshed_at", F.greatest("first_published", "refreshed"))
    searched = lambda c: F.when(F.col("events_searched"), c)
    rows = rows.select(
        *cases.columns, "posting_state", publish_recency("last_refreshed_at", now, recent_days).alias("publish_recency"), searched(yes(F.col("material"))).alias("material_negative_event"), searched(yes(F.col("freeze"))).alias("freeze_or_pause"),
        F.col("expiry").alias("declared_expiry"), F.when(answer.isin(*TRUE_VALUES), True).when(answer.isin(*FALSE_VALUES), False).alias("corroborating_hiring_signal"), searched(F.col("material_at")).alias("last_material_event_at"),
        "last_refreshed_at", known.alias("expiry_known"), "events_searched", yes(F.col("primary_publish")).alias("primary_publish"), "first_published",
    )
    if history is None:
        return rows.withColumn("repost_pattern", F.lit(None).cast("string"))
    return rows.join(history.select("case_id", "repost_pattern"), "case_id", "left")


def unresolved() -> Column:
    """The inputs that are still unknown, in order. An expiry that is known to be absent, or a date of no event after a search, is no open question."""
    open_ = {n: F.col(n).isNull() for n in NAMES}
    open_["declared_expiry"] = ~yes(F.col("expiry_known"))
    open_["last_material_event_at"] = ~yes(F.col("events_searched"))
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in open_.items()]), lambda x: x.isNotNull())


def guarded_publish(claims: DataFrame, slack_hours: int = 14) -> DataFrame:
    """claims (claim_type, value, source_event_at, first_observed) with first_published claims that lie after the first sighting told apart.

    What was listed before its stated publication can't have been published first then: the claim becomes publish_date_after_first_seen. Bare dates
    hold somewhere on earth from slack_hours before midnight UTC on.
    """
    bare = F.coalesce(F.trim("value").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))
    earliest = F.when(bare, F.col("source_event_at") - F.expr(f"interval {int(slack_hours)} hours")).otherwise(F.col("source_event_at"))
    late = (F.col("claim_type") == FIRST_PUBLISHED) & yes(earliest > F.col("first_observed"))
    return claims.withColumn("claim_type", F.when(late, "publish_date_after_first_seen").otherwise(F.col("claim_type")))
