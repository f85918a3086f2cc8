"""Which postings are for development, validation and test, and what a dataset keeps of that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import stable_position
from larkspur.operators.asof import greedy_split, temporal_split

FRACTIONS = (0.6, 0.2, 0.2)


def checked(fractions: tuple[float, float, float]) -> tuple[float, float, float]:
    """Three positive fractions that sum to 1."""
    if len(fractions) != 3 or min(fractions) <= 0 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions must be three positive numbers that sum to 1")
    return fractions


def stable_companies(companies: DataFrame, seed: int, fractions: tuple[float, float, float] = FRACTIONS) -> DataFrame:
    """company_id, split of each distinct company by its stable position: adding companies moves none."""
    a, b, _ = checked(fractions)
    x = F.col("__x")
    rows = companies.select("company_id").filter("company_id is not null").distinct().withColumn("__x", stable_position(seed, "company_id"))
    return rows.select("company_id", F.when(x < a, "dev").when(x < a + b, "validation").otherwise("test").alias("split"))


def stable_test_companies(companies: DataFrame, postings: DataFrame, seed: int, fractions: tuple[float, float, float] = FRACTIONS) -> DataFrame:
    """Every known company that the stable split holds out, whether it has a company row or postings only."""
    known = companies.select("company_id").unionByName(postings.select("company_id"))
    return stable_companies(known, seed, fractions).filter("split = 'test'").select("company_id")


def assigned_splits(postings: DataFrame, cutoff: Column, validation_cutoff: Column | None = None, seed: int = 0, fractions: tuple[float, float, float] = FRACTIONS, method: str = "greedy") -> DataFrame:
    """postings (posting_id, company_id, first_observed) with temporal_split and company_split, by the greedy or the hash method."""
    if method == "hash":
        companies = stable_companies(postings, seed, fractions)
    elif method == "greedy":
        names = dict(zip(("dev", "validation", "test"), checked(fractions), strict=True))
        companies = greedy_split(postings.groupBy("company_id").agg(F.count("*").alias("__n")), "company_id", "__n", names, seed=seed)
    else:
        raise ValueError("method is greedy or hash")
    rows = postings.join(companies.withColumnRenamed("split", "company_split"), "company_id", "left")
    return rows.withColumn("temporal_split", temporal_split("first_observed", cutoff, validation_cutoff))


def dataset_splits(base: DataFrame, cases: DataFrame, runs: DataFrame, rebuilt: DataFrame | None = None) -> DataFrame:
    """posting_id, split of a dataset: what its cases froze comes first, then (for datasets without frozen splits) what is rebuilt as of their making, then today's.

    base and rebuilt: posting_id, split. cases: posting_id, canonical_url, replay_at, split (null if not frozen). runs: posting_id, input_url,
    replay_at; a run whose own posting differs from its case's gets the case's split.
    """
    frozen = cases.filter("split is not null").groupBy("posting_id").agg(F.max("split").alias("f"))
    rows = base.select("posting_id", F.col("split").alias("b")).join(frozen, "posting_id", "full")
    if rebuilt is not None:
        rows = rows.join(rebuilt.select("posting_id", F.col("split").alias("r")), "posting_id", "full").withColumn("f", F.coalesce("f", "r")).drop("r")
    rows = rows.select("posting_id", F.coalesce("f", "b").alias("split"))
    own = cases.select(F.col("posting_id").alias("__case"), F.col("canonical_url").alias("input_url"), "replay_at")
    other = runs.select("posting_id", "input_url", "replay_at").join(own, ["input_url", "replay_at"]).filter("posting_id <> __case")
    alias = other.join(rows.select(F.col("posting_id").alias("__case"), F.col("split").alias("a")), "__case").groupBy("posting_id").agg(F.max("a").alias("a"))
    return rows.join(alias, "posting_id", "full").select("posting_id", F.coalesce("a", "split").alias("split"))


def permitted(rows: DataFrame, allowed: tuple[str, ...] = ("dev", "validation")) -> DataFrame:
    """Rows of the permitted splits; the holdout has to be asked for by name. Rows without a split aren't permitted."""
    return rows.filter(F.col("split").isin(*allowed))


def excluded_companies(cases: DataFrame, dataset: str) -> DataFrame:
    """Companies that other datasets use."""
    return cases.filter(F.col("dataset_id") != dataset).select("company_id").distinct()


def retired(datasets: DataFrame, which: Column, now: Column) -> DataFrame:
    """datasets with retired_at set where which holds; a first stamp stays."""
    return datasets.withColumn("retired_at", F.when(which, F.coalesce("retired_at", now)).otherwise(F.col("retired_at")))


def unretired(datasets: DataFrame, which: Column) -> DataFrame:
    return datasets.withColumn("retired_at", F.when(~F.coalesce(which, F.lit(False)), F.col("retired_at")))


def usable(cases: DataFrame, datasets: DataFrame) -> DataFrame:
    """Cases of datasets that aren't retired."""
    return cases.join(datasets.filter("retired_at is not null").select("dataset_id"), "dataset_id", "left_anti")
