"""Repost links: jobs that disappeared, matched to later ones of the same company."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import days_between, hash_score, normalized_text, token_jaccard
from larkspur.session import ship, written

# Weights of the components.
WEIGHTS = {"title": 0.45, "description": 0.25, "team": 0.15, "location": 0.15}
# Normalized titles that name no job, first words of links, and how many words such a link has at most.
GENERIC_TITLES = (
    "apply", "apply now", "apply here", "apply today", "apply for this job", "apply to this job",
    "view", "view job", "view jobs", "view role", "view posting", "view details", "view opening",
    "see job", "see details", "see more", "learn more", "read more", "more", "more info", "more information", "details",
    "click here", "here", "link", "submit", "submit application", "start application",
    "job", "jobs", "role", "roles", "position", "positions", "opening", "openings", "open role", "open roles", "open position", "open positions",
    "current openings", "all openings", "all jobs", "all roles", "career", "careers", "vacancy", "vacancies", "listing", "listings", "posting", "postings",
    "department", "departments", "team", "teams", "location", "locations",
    "home", "menu", "search", "back", "next", "previous", "sign in", "log in", "login", "share", "print", "email", "contact", "contact us", "about", "about us",
    "join us", "join our team", "we are hiring", "hiring", "work with us",
    "remote", "onsite", "on site", "hybrid", "full time", "part time", "fulltime", "parttime", "contract", "temporary", "permanent", "internship", "intern",
    "n a", "na", "tbd", "untitled", "unknown",
)
LINK_WORDS = ("view", "see", "read", "learn", "browse", "explore", "show", "discover", "check")
LINK_MOST_WORDS = 4


@dataclass(frozen=True)
class Matching:
    title_min: float = 0.85
    title_only_min: float = 0.95
    team_min: float = 0.80
    location_min: float = 0.90
    description_min: float = 0.80
    combined_min: float = 0.70
    max_gap_days: float = 120.0
    tolerance_days: float = 7.0
    junk_title_min_chars: int = 3


def junk_title(title: Column | str, min_chars: int = 3) -> Column:
    """Why a title names no job, or null."""
    t = F.coalesce(normalized_text(title), F.lit(""))
    first, words = F.get(F.split(t, " "), F.lit(0)), F.size(F.split(t, " "))
    return (
        F.when(t == "", "blank")
        .when(F.length(t) < min_chars, "short")
        .when(t.rlike("^(?U)[\\p{Nd}]+$"), "digits")
        .when(t.isin(*GENERIC_TITLES), "generic")
        .when(first == "apply", "apply link")
        .when(first.isin(*LINK_WORDS) & (words <= LINK_MOST_WORDS), "link")
    )


def prepared(intervals: DataFrame, cfg: Matching) -> DataFrame:
    url = F.regexp_replace(F.trim("url"), "/+$", "")
    return intervals.filter(junk_title("title", cfg.junk_title_min_chars).isNull()).withColumn("url_key", F.when(url != "", url))


def gated_pairs(intervals: DataFrame, cfg: Matching = Matching()) -> DataFrame:
    """Pairs (old, new) of one company that pass all hard gates, with gap_days.

    The band join has an equi-key: time is cut into buckets as wide as the band, an old job looks into the two buckets its band
    touches, and a new one lies in one. A company with a third of all jobs is thus spread over its buckets.
    """
    width = cfg.max_gap_days + cfg.tolerance_days
    side = prepared(intervals, cfg)
    keep = ["company_id", "job_id", "url_key", "first_observed", "last_seen_open", "first_seen_absent", "description_hash", "title", "team", "location", "present_snapshot_ids"]
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86_400_000_000.0)
    old = side.filter("first_seen_absent is not null").select(*[F.col(c).alias(f"old_{c}") if c != "company_id" else F.col(c) for c in keep])
    low = F.floor((day("old_first_seen_absent") - cfg.tolerance_days) / width)
    old = old.withColumn("bucket", F.explode(F.array(low, low + 1)))
    new = side.select(*[F.col(c).alias(f"new_{c}") if c != "company_id" else F.col(c) for c in keep]).withColumn("bucket", F.floor(day("new_first_observed") / width))
    gap = days_between("new_first_observed", "old_first_seen_absent")
    rows = old.join(new, ["company_id", "bucket"]).withColumn("gap_days", gap)
    return rows.filter(
        (F.col("old_job_id") != F.col("new_job_id"))
        & ~F.coalesce(F.col("old_url_key") == F.col("new_url_key"), F.lit(False))
        & (F.col("new_first_observed") > F.col("old_last_seen_open"))
        & (F.col("gap_days") > -cfg.tolerance_days)
        & (F.col("gap_days") <= cfg.max_gap_days)
        & ~F.arrays_overlap("old_present_snapshot_ids", "new_present_snapshot_ids")
    ).drop("bucket")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    return pd.Series([known.setdefault((x, y), SequenceMatcher(None, x, y).ratio()) if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: str, b: str) -> Column:
    """The mean of token Jaccard and matching-blocks ratio; 1 for equal texts, null if either is blank."""
    x, y = normalized_text(a), normalized_text(b)
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), F.lit(None).cast("double")).when(x == y, F.lit(1.0)).otherwise((token_jaccard(a, b) + sequence_ratio(x, y)) / 2)


def scored(pairs: DataFrame, cfg: Matching = Matching()) -> DataFrame:
    """Component scores, their weighted mean over the known ones, and whether the pair passes."""
    ship(pairs.sparkSession)
    for c in ("title", "team", "location"):
        pairs = pairs.withColumn(f"{c}_score", similarity(f"old_{c}", f"new_{c}"))
    return combined(pairs.withColumn("description_score", hash_score("old_description_hash", "new_description_hash")), cfg)


def combined(pairs: DataFrame, cfg: Matching = Matching()) -> DataFrame:
    """From the four scores: combined, title_only, corroborated, passes. Unknown components drop out of the weights."""
    total = sum(F.when(F.col(f"{c}_score").isNotNull(), F.lit(w)).otherwise(0.0) for c, w in WEIGHTS.items())
    value = sum(F.coalesce(F.col(f"{c}_score") * w, F.lit(0.0)) for c, w in WEIGHTS.items())
    least = {"team": cfg.team_min, "location": cfg.location_min, "description": cfg.description_min}
    known = [F.col(f"{c}_score").isNotNull() for c in least]
    passed = [F.coalesce(F.col(f"{c}_score") >= m, F.lit(False)) for c, m in least.items()]
    rows = pairs.withColumn("combined", F.try_divide(value, total)).withColumn("title_only", ~(known[0] | known[1] | known[2])).withColumn("corroborated", passed[0] | passed[1] | passed[2])
    bar = F.when(F.col("title_only"), cfg.title_only_min).otherwise(cfg.title_min)
    return rows.withColumn("passes", F.coalesce((F.col("title_score") >= bar) & (F.col("combined") >= cfg.combined_min) & (F.col("title_only") | F.col("corroborated")), F.lit(False)))


#: Keys with so many candidates at most are assigned in one pass each; others in rounds.
FEW_CANDIDATES = 50_000


def assigned(candidates: DataFrame, key: list[str], old: str, new: str, score: str) -> DataFrame:
    """The greedy one-to-one assignment in order of (-score, old, new), with candidates as rows of key, old, new and score.

    Keys of a bounded number of candidates are walked through in order, each in one group. For larger keys, rounds of mutual
    best candidates give the same in a total order: a candidate that is the best of its old and of its new side is taken, and what shares
    a side with it goes. Rounds are shuffles, not loops over rows.
    """
    candidates = written(candidates)
    large = written(candidates.groupBy(*key).count().filter(F.col("count") > FEW_CANDIDATES).select(*key))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, old, new], ascending=[False, True, True])
        olds, news, keep = set(), set(), []
        for a, b in zip(rows[old], rows[new], strict=True):
            free = a not in olds and b not in news
            keep.append(free)
            if free:
                olds.add(a)
                news.add(b)
        return rows[keep]

    few = candidates.join(large, key, "left_anti").groupBy(*key).applyInPandas(walk, candidates.schema)
    return few.unionByName(rounds(candidates.join(large, key, "left_semi"), key, old, new, score)) if large.limit(1).count() else few


def rounds(candidates: DataFrame, key: list[str], old: str, new: str, score: str) -> DataFrame:
    """The same by rounds of mutual best candidates."""
    rank = F.struct(-F.col(score), F.col(old), F.col(new))
    left, taken = written(candidates), None
    while left.limit(1).count():
        a, b = Window.partitionBy(*key, old), Window.partitionBy(*key, new)
        best = left.withColumn("r", rank).withColumn("ra", F.min("r").over(a)).withColumn("rb", F.min("r").over(b))
        now = written(best.filter("r = ra and r = rb").drop("r", "ra", "rb"))
        taken = now if taken is None else taken.unionByName(now)
        left = written(left.join(now.select(*key, old), [*key, old], "left_anti").join(now.select(*key, new), [*key, new], "left_anti"))
    return candidates.limit(0) if taken is None else taken


def repost_links(intervals: DataFrame, cfg: Matching = Matching()) -> DataFrame:
    """company_id, old_job_id, new_job_id, combined, gap_days and component scores of the accepted links."""
    keep = ["company_id", "old_job_id", "new_job_id", "combined", "gap_days", "title_score", "team_score", "location_score", "description_score"]
    return assigned(scored(gated_pairs(intervals, cfg), cfg).filter("passes").select(*keep), ["company_id"], "old_job_id", "new_job_id", "combined")


def best_link(links: DataFrame) -> DataFrame:
    """The best link of each old job: the highest score, then the smallest new job."""
    return links.groupBy("company_id", "old_job_id").agg(F.min_by(F.struct("new_job_id", "combined", "title_score", "description_score"), F.struct(-F.col("combined"), F.col("new_job_id"))).alias("x")).select("company_id", "old_job_id", "x.*")


def retained(candidates: DataFrame, k: int) -> DataFrame:
    """All candidates that pass, and of each company the best k that don't: enough for any ranking of k, without the pairs that no one will look at.

    The rank limit is applied in every task before the shuffle, so a company sends k rejected pairs a task, however many it has.
    """
    w = Window.partitionBy("company_id").orderBy(F.desc("combined"), "old_job_id", "new_job_id")
    best = candidates.filter(~F.col("passes")).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
    return candidates.filter("passes").unionByName(best)


def ranked(candidates: DataFrame, n: int) -> DataFrame:
    """The best n of all companies, by score, then by the jobs: each task keeps n."""
    return candidates.orderBy(F.desc("combined"), "old_job_id", "new_job_id", "company_id").limit(n)
