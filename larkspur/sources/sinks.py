"""Writes: appends, upserts by key, and rebuilding single companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.mode("append").partitionBy(*partition_by or []).parquet(path)


def upserted(stored: DataFrame, new: DataFrame, key: list[str], keep_earliest: list[str] | None = None) -> DataFrame:
    """stored with new rows in place of those of the same key; columns keep_earliest keep the smaller value."""
    both = stored.select("*", F.lit(0).alias("__v")).unionByName(new.select(*stored.columns, F.lit(1).alias("__v")))
    for c in keep_earliest or []:
        both = both.withColumn(c, F.min(c).over(Window.partitionBy(*key)))
    w = Window.partitionBy(*key).orderBy(F.desc("__v"), *[F.col(c) for c in stored.columns if c not in key])
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__v", "__r")


def recorded(stored: DataFrame, attempts: DataFrame) -> DataFrame:
    """Page dates after new attempts: only failed ones are tried again, and every attempt counts. Both: posting_id, status, date_posted, attempts."""
    s, a = stored.alias("s"), attempts.alias("a")
    rows = s.join(a, "posting_id", "full")
    take = F.col("s.status").isNull() | ((F.col("s.status") == "failed") & F.col("a.status").isNotNull())
    pick = lambda c: F.when(take, F.col(f"a.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    tried = F.coalesce("s.attempts", F.lit(0)) + F.when(take, F.coalesce("a.attempts", F.lit(1))).otherwise(0)
    return rows.select("posting_id", pick("status"), pick("date_posted"), tried.alias("attempts"))


def rebuild(rows: DataFrame, path: str, partition: str = "company_id") -> None:
    """Replace only the partitions that rows hold; each is replaced as a whole."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def new_links(links: DataFrame, stored: DataFrame) -> DataFrame:
    """Links whose sides no stored link claims: writing them again adds nothing."""
    keep = links
    for side in ("old_job_id", "new_job_id"):
        keep = keep.join(stored.select("company_id", side).distinct(), ["company_id", side], "left_anti")
    return keep.select(links.columns)


def evidence_ids(claims: DataFrame, start: int = 1) -> DataFrame:
    """Ids e1, e2, ... within each run, in order of place."""
    w = Window.partitionBy("run_id").orderBy("place")
    return claims.withColumn("evidence_id", F.concat(F.lit("e"), (F.row_number().over(w) + start - 1).cast("string")))


def deletable(runs: DataFrame, doomed: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """run_id of the runs to delete. With allowed (input_url, replay_at: the cases that this shard owns) any run of another shard's case refuses the whole deletion.

    runs: run_id, input_url, replay_at. doomed: run_id.
    """
    ids = runs.join(doomed.select("run_id").distinct(), "run_id", "left_semi")
    if allowed is not None:
        own = allowed.select(F.col("input_url").alias("__u"), F.col("replay_at").alias("__t"))
        foreign = ids.join(own, F.col("input_url").eqNullSafe(F.col("__u")) & F.col("replay_at").eqNullSafe(F.col("__t")), "left_anti").select("run_id").limit(5).collect()
        if foreign:
            raise ValueError(f"runs of another shard's cases: {[r[0] for r in foreign]}")
    return ids.select("run_id")


def without(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    """rows of other runs than the doomed ones: the same for runs, steps and evidence."""
    return rows.join(doomed.select("run_id"), "run_id", "left_anti")


def marked(steps: DataFrame, runs: DataFrame, mark: str) -> DataFrame:
    """steps (run_id, step_index, decision_type and others) with a last step that marks each of runs; a run that carries the mark isn't marked again."""
    have = steps.filter(F.col("decision_type") == mark).select("run_id")
    last = steps.groupBy("run_id").agg(F.max("step_index").alias("__last"))
    new = runs.select("run_id").distinct().join(have, "run_id", "left_anti").join(last, "run_id", "left")
    kind = steps.schema["step_index"].dataType
    return steps.unionByName(new.select("run_id", (F.coalesce("__last", F.lit(0)) + 1).cast(kind).alias("step_index"), F.lit(mark).alias("decision_type")), allowMissingColumns=True)
