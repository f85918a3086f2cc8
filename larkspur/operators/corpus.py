"""Housekeeping of the corpus: status, caches as of a moment, identity, samples, reasons and the relevance of unknown inputs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import host
from larkspur.operators import policy
from larkspur.operators.running import at_moments
from larkspur.session import written

# Words by which a reason is counted to a family of claims.
FAMILIES = {
    "posting_state": ("still listed", "no longer listed", "job board", "board snapshot", "removed", "closed", "open", "listed"),
    "publish": ("published", "posted", "days ago", "first published", "updated", "refreshed"),
    "expiry": ("expire", "expiry", "valid through", "closing"),
    "repost": ("repost", "reappear", "relisted", "disappeared", "previously"),
    "requirements": ("requirement", "description chang", "unchanged", "drift"),
    "company_event": ("layoff", "freeze", "hiring pause", "funding", "expansion", "acquisition"),
}


def snapshot_status(companies: DataFrame, captures: DataFrame) -> DataFrame:
    """Every company with its latest capture and how many were gaps; companies without captures stay."""
    order = F.struct("captured_at", "snapshot_id")
    found = captures.groupBy("company_id").agg(F.max("captured_at").alias("last_captured_at"), F.max_by("coverage_status", order).alias("last_coverage"), F.count_if(F.col("coverage_status") == "gap").alias("gaps"))
    return companies.join(found, "company_id", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))


def cached(asks: DataFrame, cache: DataFrame, key: list[str], asked: str, days: float = 1.0) -> DataFrame:
    """Each ask with the latest response that was fetched by then and hadn't expired, or nulls. cache: key, fetched_at, expires_at, response.

    One sorted pass gives the latest response and the latest expiry so far. Where the latest response has expired but an earlier, longer one
    hasn't, the ask meets the responses of its key that hold in its stretch of so many days.
    """
    asks = written(asks.withColumn("__id", F.monotonically_increasing_id()))
    cache = cache.filter(F.col("expires_at") > F.col("fetched_at"))
    row = F.struct("fetched_at", "expires_at", "response")
    seen = written(at_moments(asks, cache, key, "fetched_at", {"__last": ("max", row), "__until": ("max", F.col("expires_at"))}, asked, 30.0))
    fresh = F.col("__last.expires_at") > F.col(asked)
    width = int(days * 86_400_000_000)
    stretch = lambda c: F.floor(F.unix_micros(c) / F.lit(width))
    # only these asks need the responses before the latest one: the others are answered where they lie
    older = F.coalesce(~fresh & (F.col("__until") > F.col(asked)), F.lit(False))
    left = seen.filter(older).select(*key, "__id", F.col(asked).alias("__asked"), stretch(asked).alias("__s"))
    held = cache.withColumn("__s", F.explode(F.sequence(stretch("fetched_at"), stretch("expires_at"))))
    hit = held.join(left, [*key, "__s"]).filter((F.col("fetched_at") <= F.col("__asked")) & (F.col("__asked") < F.col("expires_at"))).groupBy("__id").agg(F.max(row).alias("__older"))
    found = seen.filter(~older).withColumn("__x", F.when(fresh, F.col("__last"))).unionByName(seen.filter(older).join(hit, "__id", "left").withColumn("__x", F.col("__older")).drop("__older"))
    return found.select(*[c for c in asks.columns if c != "__id"], "__x.fetched_at", "__x.response")


def stratified(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """About n rows, each stratum in proportion and none without a row, in hash order: a sampling operator."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(key), key)
    share = rows.groupBy(stratum).agg(F.count("*").alias("__n"))
    total = share.agg(F.sum("__n").alias("__t"))
    quota = share.crossJoin(F.broadcast(total)).withColumn("__q", F.greatest(F.lit(1), F.round(F.col("__n") * n / F.col("__t"))))
    return rows.withColumn("__r", F.row_number().over(w)).join(quota, stratum).filter("__r <= __q").select(rows.columns)


def reason_families(text: Column | str) -> Column:
    """The families whose words a reason holds, in order; a reason without any is unclassified."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    hits = []
    for family, words in FAMILIES.items():
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        hits.append(F.when(found, F.lit(family)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def by_correlation_key(rows: DataFrame, key: list[str], posting: str) -> DataFrame:
    """The lowest posting of each key, and how many share it."""
    return rows.groupBy(*key).agg(F.min(posting).alias(posting), F.count("*").alias("matches"))


def resolved(asks: DataFrame, known: DataFrame, asked: str, url: str, key: str) -> DataFrame:
    """asks with found (a key of known) and found_by: by the exact URL, else by a host that only one key has."""
    exact = known.groupBy(F.col(url).alias("__u")).agg(F.min(key).alias("__e"))
    hosts = known.groupBy(host(url).alias("__h")).agg(F.min(key).alias("__k"), F.countDistinct(key).alias("__n")).filter("__n = 1")
    rows = asks.join(exact, F.col(asked) == F.col("__u"), "left").join(hosts.select("__h", "__k"), host(asked) == F.col("__h"), "left")
    return rows.withColumn("found", F.coalesce("__e", "__k")).withColumn("found_by", F.when(F.col("__e").isNotNull(), "exact").when(F.col("__k").isNotNull(), "host")).drop("__u", "__h", "__e", "__k")


def dataset_status(cases: DataFrame, done: DataFrame, key: list[str], systems: list[str]) -> DataFrame:
    """Per system: completed and remaining cases."""
    all_ = cases.withColumn("system", F.explode(F.array(*map(F.lit, systems))))
    ended = done.select("system", *key).distinct().withColumn("__d", F.lit(1))
    return all_.join(ended, ["system", *key], "left").groupBy("system").agg(F.count("__d").alias("completed"), (F.count("*") - F.count("__d")).alias("remaining"))


#: What an unknown input may turn out to be.
DOMAINS = {
    "posting_state": ("open", "closed", "reposted", "unknown"),
    "freeze_or_pause": (True, False),
    "material_negative_event": (True, False),
    "repost_pattern": ("none", "changed", "repeated_unchanged"),
    "corroborating_hiring_signal": (True, False),
    "publish_recency": ("recent", "not_recent"),
}


#: Dates that may be unknown, and the columns that tell whether they are known; where inputs have no such column they are.
DATES = {"declared_expiry": "expiry_known", "last_material_event_at": "events_searched"}


#: Tasks that the fillings of signatures are dealt over.
SIGNATURES = 48


def could_change(inputs: DataFrame) -> DataFrame:
    """inputs with could_change: the unknown inputs of which some value, with some values of the other unknown ones, leads to another action than if they stayed unknown.

    The decision table has finitely many rows in these inputs. What doesn't depend on them (quality, dates) makes up a small signature; for each
    signature and set of known values, all fillings of the unknown ones are decided once, and cases are joined to the outcome. Of an unknown expiry it
    matters whether one is declared, of an unknown event whether there is one and on which side of the last refresh it lies.
    """
    rest = ["quality", "long_lived", "declared_expiry", "last_material_event_at", "last_refreshed_at"]
    answered = policy.yes(F.col("last_refreshed_at") > F.col("last_material_event_at"))
    open_ = {c: ~policy.yes(F.col(known)) if known in inputs.columns else F.lit(False) for c, known in DATES.items()}
    flags = {"quality": F.col("quality"), "long_lived": F.col("long_lived"), "expiry": F.col("declared_expiry").isNotNull(), "event": F.col("last_material_event_at").isNotNull(), "answered": answered, "refreshed": F.col("last_refreshed_at").isNotNull(), **{f"open_{n}": c for n, c in open_.items()}, **{d: F.col(d) for d in DOMAINS}}
    # a null is told from every text by its place in front of the texts
    marks = [F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in flags.values()]), *[F.coalesce(c.cast("string"), F.lit("")) for c in flags.values()]]
    rows = inputs.withColumn("__sig", F.concat_ws("\x1f", *marks))
    # all but the dates follow from the signature, so they are keys: cases are counted down in hash tables, not sorted
    fixed = [c for c in (*rest, *DOMAINS) if c not in DATES and c != "last_refreshed_at"]
    each = rows.groupBy("__sig", *fixed).agg(*[F.first(c).alias(c) for c in (*DATES, "last_refreshed_at")], *[F.first(c).alias(f"__open_{n}") for n, c in open_.items()])
    # few signatures have many fillings each: small before they are filled, so Spark would put them into one task
    each = each.repartition(SIGNATURES, "__sig")
    filled = each
    for c, values in DOMAINS.items():
        options = F.when(F.col(c).isNull(), F.array(F.lit(None).cast(inputs.schema[c].dataType), *map(F.lit, values))).otherwise(F.array(F.col(c)))
        filled = filled.withColumn(f"__open_{c}", F.col(c).isNull()).withColumn(c, F.explode(options))
    anchor = F.coalesce(F.col("last_refreshed_at").cast("timestamp"), F.lit("2000-01-02").cast("timestamp"))
    dates = {"declared_expiry": [F.lit("2000-01-01").cast("timestamp")], "last_material_event_at": [anchor - F.expr("interval 1 day"), anchor + F.expr("interval 1 day")]}
    for c, values in dates.items():
        kind = inputs.schema[c].dataType
        filled = filled.withColumn(c, F.explode(F.when(F.col(f"__open_{c}"), F.array(F.lit(None).cast(kind), *[v.cast(kind) for v in values])).otherwise(F.array(F.col(c)))))
    filled = filled.withColumn("branch", policy.branch()).withColumn("__act", action("branch"))
    # an input matters if two fillings that differ in it alone lead to different actions
    names, marks = [*DOMAINS, *DATES], []
    for c in names:
        w = Window.partitionBy("__sig", *[F.col(o) for o in names if o != c])
        filled = filled.withColumn(f"__m_{c}", F.col(f"__open_{c}") & (F.min("__act").over(w) != F.max("__act").over(w)))
        marks.append(F.max(f"__m_{c}").alias(f"__m_{c}"))
    found = filled.groupBy("__sig").agg(*marks)
    out = F.filter(F.array(*[F.when(F.col(f"__m_{c}"), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return rows.join(found, "__sig").withColumn("could_change", out).drop("__sig", *[f"__m_{c}" for c in names])


def action(branch: str) -> Column:
    return F.coalesce(*[F.when(F.col(branch) == b, a) for b, a in policy.ACTIONS.items()])


def fillings(known: dict) -> list[dict]:
    """All ways to fill the unknown inputs of one case: the brute-force form of could_change, for tests."""
    names = list(DOMAINS)
    return [dict(zip(names, v, strict=True)) for v in product(*[(known[n],) if known.get(n) is not None else (None, *DOMAINS[n]) for n in names])]


def page_date_candidates(postings: DataFrame, captured: DataFrame, tried: DataFrame, limit: int, most_attempts: int = 3, kind: str = "lever") -> DataFrame:
    """The postings (posting_id, company_id, ats, url, first_observed, last_seen_open) whose page is to be read for its date: posting_id and url, newest first, `limit` at most.

    captured: company_id, captured_at of this run's captures; a posting counts if that very capture listed it. tried: posting_id, status, attempts of pages read
    before; only failed ones with attempts left are read again.
    """
    rows = postings.filter((F.col("ats") == kind) & F.startswith("url", F.lit("https://"))).join(captured.withColumnRenamed("captured_at", "last_seen_open").distinct(), ["company_id", "last_seen_open"], "left_semi")
    done = tried.filter((F.col("status") != "failed") | (F.col("attempts") >= most_attempts)).select("posting_id")
    return rows.join(done, "posting_id", "left_anti").orderBy(F.desc("first_observed"), "posting_id").limit(max(0, limit)).select("posting_id", "url")
