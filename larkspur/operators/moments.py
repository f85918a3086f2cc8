"""What could be seen of each case at its own moment, for the moments of all cases in one pass.

cases: case_id, company_id, job_id and replay_at (and team_key, where a team is asked about). Every function takes all cases at once: cases and
what was observed are merged in time, so that no case is multiplied by the captures, jobs or events of its company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import days_between, ratio, team_key
from larkspur.operators import lifecycle
from larkspur.operators.running import at_moments, newest, running
from larkspur.session import written

DAY = 86_400_000_000
#: Fixed value: the kind of board whose stated date is that of the last publication.
LAST_PUBLISHED_BOARD = "ashby"


def last_before(cases: DataFrame, rows: DataFrame, key: list[str], stamp: str, tie: str, value: Column, name: str, moment: str = "replay_at") -> DataFrame:
    """cases with the value of the last of their key's rows at or before their moment; of rows of one stamp the one with the greatest tie. For keys with few rows, such as jobs."""
    left = cases.withColumn("__at", F.col(moment)).withColumn("__case", F.lit(1))
    right = rows.select(*key, F.col(stamp).alias("__at"), F.lit(0).alias("__case"), F.col(tie).alias("__tie"), value.alias("__row"))
    w = Window.partitionBy(*key).orderBy("__at", "__case", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn(name, F.last("__row", ignorenulls=True).over(w)).filter("__case = 1").select(*cases.columns, name)


def lifecycles_at(cases: DataFrame, captures: DataFrame, listings: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """cases with the lifecycle of their job as it stood at their moment, and the capture that witnesses its state.

    First sightings, absences and returns only ever come into being, so those of the whole history count once they lie at or before the moment. The
    last sighting moves: it is the last listing by then, and the closure is the first complete capture behind that one, if it had been taken. state is
    open or closed, null for jobs that no capture had listed. Presence counts from any capture, absence from complete ones only. intervals: the
    whole history's lifecycles (lifecycle.intervals), where they are at hand.
    """
    order = lifecycle.ordered(captures)
    seen = listings.join(order, "snapshot_id").withColumn("own", (F.col("source") == "own").cast("int"))
    so_far = Window.partitionBy("company_id", "job_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("n", F.count(F.lit(1)).over(so_far)).withColumn("own", F.max("own").over(so_far))
    row = F.struct("captured_at", "c", "source", "coverage_status", "url", "title", "n", "own")
    out = last_before(cases, seen, ["company_id", "job_id"], "captured_at", "i", row, "__last")
    whole = (intervals or lifecycle.intervals(captures, listings)).select("company_id", "job_id", *[F.col(c).alias(f"__{c}") for c in ("first_observed", "first_seen_absent", "reappeared_at")])
    listed = listings.groupBy("snapshot_id").agg(F.countDistinct("job_id").alias("listed"))
    after = order.filter(lifecycle.is_complete()).join(listed, "snapshot_id", "left")
    after = after.select("company_id", F.col("c").alias("__c"), F.struct(F.col("captured_at"), F.col("source"), F.col("coverage_status"), F.coalesce("listed", F.lit(0)).alias("listed")).alias("__next"))
    out = out.join(whole, ["company_id", "job_id"], "left").withColumn("__c", F.col("__last.c") + 1).join(after, ["company_id", "__c"], "left")
    by = lambda c: F.when(F.col(c) <= F.col("replay_at"), F.col(c))
    known, closed = F.col("__last").isNotNull(), F.coalesce(F.col("__next.captured_at") <= F.col("replay_at"), F.lit(False))
    witness = lambda c: F.when(closed, F.col(f"__next.{c}")).otherwise(F.col(f"__last.{c}"))
    return out.select(
        *cases.columns, F.when(closed, "closed").when(known, "open").alias("state"), by("__first_observed").alias("first_observed"), F.col("__last.captured_at").alias("last_seen_open"),
        by("__first_seen_absent").alias("first_seen_absent"), by("__reappeared_at").alias("reappeared_at"), F.when(closed, F.col("__next.captured_at")).alias("closure_absent_at"),
        F.col("__last.n").alias("capture_count"), (F.col("__last.own") == 0).alias("archive_only"), F.col("__last.title").alias("title"), F.col("__last.url").alias("url"),
        witness("captured_at").alias("witnessed_at"), witness("source").alias("witness_source"), witness("coverage_status").alias("witness_coverage"), F.when(closed, F.col("__next.listed")).alias("listed"),
    )


def coverage_at(cases: DataFrame, captures: DataFrame) -> DataFrame:
    """cases with first_capture_at, last_capture_at, history_days and history_coverage (days with a complete capture over days with any) of their company at their moment.

    A day counts from its first capture on, and as complete from its first complete one on: both are running counts.
    """
    days = captures.groupBy("company_id", F.to_date("captured_at").alias("__day")).agg(F.min("captured_at").alias("tried"), F.min(F.when(lifecycle.is_complete(), F.col("captured_at"))).alias("complete"))
    marks = F.array(*[F.struct(F.col(c).alias("at"), F.lit(int(c == "tried")).alias("tried"), F.lit(int(c == "complete")).alias("complete")) for c in ("tried", "complete")])
    marks = days.select("company_id", F.inline(marks)).filter("at is not null").unionByName(captures.select("company_id", F.col("captured_at").alias("at"), F.lit(0).alias("tried"), F.lit(0).alias("complete")))
    values = {"__d": ("sum", F.col("tried")), "__k": ("sum", F.col("complete")), "first_capture_at": ("min", F.col("at")), "last_capture_at": ("max", F.col("at"))}
    rows = at_moments(cases, marks, ["company_id"], "at", values)
    return rows.select(*cases.columns, "first_capture_at", "last_capture_at", days_between("last_capture_at", "first_capture_at").alias("history_days"), ratio("__k", "__d").alias("history_coverage"))


#: How many events of a team are shown.
SHOWN = 5


def team_at(cases: DataFrame, intervals: DataFrame, new_days: int = 30, closure_days: int = 60, shown: int = SHOWN) -> DataFrame:
    """cases with what their team (or their whole company, where team_key is null) had done by their moment.

    in_scope and archive_only (jobs seen by then), open_roles, and for kind new and closed: the number in the window, how many of them are known from archives alone, the
    last one's time, and the newest `shown` as structs (at, job_id, title), ties by job_id. Counts in a window are differences of running counts, and the
    newest ones come with the last event at or before the moment.
    """
    scope = F.explode(F.array_distinct(F.array(F.coalesce(team_key("team"), F.lit("")), F.lit("")))).alias("__team")
    kinds = {"new": ("first_observed", new_days), "closed": ("first_seen_absent", closure_days)}
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("at")) for k, (c, _) in kinds.items()]))
    jobs = intervals.select("company_id", "team", "job_id", "title", (~F.array_contains("sources", "own")).cast("int").alias("archive"), F.lit(1).alias("one"), each).filter("at is not null")
    key = ["company_id", "__team"]
    events, stretch = written(jobs.select("*", scope)), F.floor(F.unix_micros("at") / F.lit(30 * DAY))
    # of one time the smallest job counts as the newest
    events = running(events, [*key, "kind"], [F.col("at"), F.col("job_id").desc()], stretch, {"n": ("sum", "one"), "a": ("sum", "archive")})
    events = written(newest(events, [*key, "kind"], "n", stretch, F.struct("at", "job_id", "title"), shown))
    # a case asks at its moment, and just before each window begins
    since = {k: F.col("replay_at") - F.expr(f"interval {int(d)} days") - F.expr("interval 1 microsecond") for k, (_, d) in kinds.items()}
    asked = F.inline(F.array(*[F.struct(F.lit(n).alias("__ask"), m.alias("__at_")) for n, m in {"now": F.col("replay_at"), **since}.items()]))
    rows = written(cases.select("case_id", "company_id", "replay_at", F.coalesce(team_key("team_key"), F.lit("")).alias("__team")))
    found = at_moments(rows.select("case_id", *key, asked), events, key, "at", {k: ("max", F.when(F.col("kind") == k, F.struct("n", "a", "at", "newest"))) for k in kinds}, "__at_")
    of = lambda k, ask: F.max(F.when(F.col("__ask") == ask, F.col(k)))
    found = found.groupBy("case_id").agg(*[of(k, "now").alias(f"__{k}_l") for k in kinds], *[of(k, k).alias(f"__{k}_p") for k in kinds])
    out = cases.join(found, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = [zero(F.col("__new_l.n")).alias("in_scope"), zero(F.col("__new_l.a")).alias("archive_only"), (zero(F.col("__new_l.n")) - zero(F.col("__closed_l.n"))).alias("open_roles")]
    for k in kinds:
        count = lambda c, k=k: zero(F.col(f"__{k}_l.{c}")) - zero(F.col(f"__{k}_p.{c}"))
        begin = since[k]
        recent = F.filter(f"__{k}_l.newest", lambda x: x["at"] > begin)  # noqa: B023
        cols += [count("n").alias(f"{k}_jobs"), count("a").alias(f"{k}_archive"), F.when(count("n") > 0, F.col(f"__{k}_l.at")).alias(f"{k}_at"), F.when(count("n") > 0, recent).alias(f"{k}_events")]
    return out.select(*cases.columns, *cols)


def stated_dates_at(cases: DataFrame, captures: DataFrame, stated: DataFrame, kinds: tuple[str, ...] = ("first_published", "updated_at", "last_published")) -> DataFrame:
    """A row for each case and kind of date that an own capture had carried by its moment: cases with kind, raw, carried_at, latest_at and url.

    stated: snapshot_id, job_id, url and a text column for each kind. The value is that of the latest capture that carries one; it was available from the
    earliest capture that carried the same. Captures without a value erase none.
    """
    own = captures.filter("source = 'own'").select("snapshot_id", "company_id", "captured_at")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("raw")) for k in kinds])).alias("s")
    rows = stated.join(own, "snapshot_id").select("company_id", "job_id", "snapshot_id", "captured_at", "url", each).select("*", "s.*").filter("raw is not null")
    same = Window.partitionBy("company_id", "job_id", "kind", "raw")
    row = F.struct("raw", "carried_at", F.col("captured_at").alias("latest_at"), "url")
    asked = cases.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    out = last_before(asked, rows.withColumn("carried_at", F.min("captured_at").over(same)), ["company_id", "job_id", "kind"], "captured_at", "snapshot_id", row, "__s")
    return out.filter("__s is not null").select(*cases.columns, "kind", "__s.*")


def guard_bound(rows: DataFrame, moment: str, windows: DataFrame, name: str) -> DataFrame:
    """rows with the end of the earliest window (started_at, finished_at) that holds their moment, else the moment: what is stamped by a run's start may be as late as its end."""
    held = windows.filter("finished_at > started_at").select("started_at", "finished_at", F.explode(F.sequence(F.floor(F.unix_micros("started_at") / DAY), F.floor(F.unix_micros("finished_at") / DAY))).alias("__day"))
    moments = rows.select(F.col(moment).alias("__m")).filter("__m is not null").distinct().withColumn("__day", F.floor(F.unix_micros("__m") / DAY))
    found = moments.join(held, "__day").filter((F.col("__m") >= F.col("started_at")) & (F.col("__m") < F.col("finished_at"))).groupBy("__m").agg(F.min_by("finished_at", F.struct("started_at", "finished_at")).alias("__end"))
    return rows.join(found, F.col(moment) == F.col("__m"), "left").withColumn(name, F.coalesce("__end", moment)).drop("__m", "__end")


def first_publications(cases: DataFrame, captures: DataFrame, stated: DataFrame, windows: DataFrame, max_lag_days: int = 2) -> DataFrame:
    """cases for which a stated date of last publication must be the first one: with raw, published_at, carried_at, absent_at and url.

    cases have first_observed (as of their moment) and ats. The job was missing from the last complete own capture before its first sighting, no own capture
    in between lists it, and the date lies behind that capture (as late as that may have been taken), not behind the first sighting, and at most
    max_lag_days before it. Of several such values the earliest counts, then the earliest carried. Only captures at or before the moment speak.
    """
    kept = [c for c in cases.columns if c not in ("raw", "published_at", "carried_at", "absent_at", "url")]
    asked = written(cases.select(*kept).filter((F.col("ats") == LAST_PUBLISHED_BOARD) & F.col("job_id").isNotNull() & (F.col("first_observed") <= F.col("replay_at"))))
    own = captures.filter("source = 'own'").select("snapshot_id", "company_id", "captured_at", "coverage_status")
    seen = stated.join(own, "snapshot_id").select("company_id", "job_id", "captured_at", "snapshot_id", "url", F.col("last_published").cast("string").alias("raw"))
    jobs = asked.select("company_id", "job_id", "first_observed").distinct().withColumn("__before", F.col("first_observed") - F.expr("interval 1 microsecond"))
    jobs = written(at_moments(jobs, own.filter(lifecycle.is_complete()), ["company_id"], "captured_at", {"absent_at": ("max", F.col("captured_at"))}, "__before").filter("absent_at is not null"))
    early = seen.select("company_id", "job_id", F.col("captured_at").alias("__seen"))
    contradicted = jobs.join(early, ["company_id", "job_id"]).filter((F.col("__seen") >= F.col("absent_at")) & (F.col("__seen") < F.col("first_observed"))).select("company_id", "job_id", "first_observed").distinct()
    jobs = written(jobs.join(contradicted, ["company_id", "job_id", "first_observed"], "left_anti").drop("__before"))
    jobs = guard_bound(guard_bound(jobs, "absent_at", windows, "__absent"), "first_observed", windows, "__seen")
    carried = seen.filter("raw is not null").groupBy("company_id", "job_id", "raw").agg(F.min(F.struct("captured_at", "snapshot_id", "url")).alias("__c"))
    value = F.try_to_timestamp("raw")
    rows = jobs.join(carried, ["company_id", "job_id"]).withColumn("published_at", value)
    rows = rows.filter((F.col("published_at") > F.col("__absent")) & (F.col("published_at") <= F.col("__seen")) & (F.col("first_observed") - F.expr(f"interval {int(max_lag_days)} days") <= F.col("published_at")))
    rows = rows.select("company_id", "job_id", "first_observed", F.col("__c.captured_at").alias("carried_at"), F.struct("published_at", F.col("__c.captured_at").alias("carried_at"), "raw", F.col("__c.url").alias("url"), "absent_at").alias("__v"))
    found = at_moments(asked, rows, ["company_id", "job_id", "first_observed"], "carried_at", {"__best": ("min", F.col("__v"))})
    return found.filter("__best is not null").select(*kept, "__best.*")
