"""The log of runs: numbered steps, closing with totals, and writes that a killed or repeated job leaves once."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import sized_broadcast

#: The step that records why a run failed (fixed value).
RUN_FAILED = "run_failed"
MANIFEST = "_published"
ENTRY = "batch string, attempt string, place long"


def numbered(steps: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """steps (run_id, place and others) with step_index: 1, 2, ... by place within each run, behind the steps that stored (run_id, step_index) has of it. Nulls come first, ties in no fixed order."""
    rows = steps.withColumn("step_index", F.row_number().over(Window.partitionBy("run_id").orderBy("place")).cast("long"))
    if stored is None:
        return rows
    last = stored.groupBy("run_id").agg(F.max("step_index").alias("__last"))
    return rows.join(last, "run_id", "left").withColumn("step_index", F.col("step_index") + F.coalesce("__last", F.lit(0))).drop("__last")


def closed(runs: DataFrame, steps: DataFrame, endings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, steps) after endings (run_id, status, decision, error): open runs get their status, decision, total cost and latency, and finish when they started, so that a replay gives the same rows.

    A run that has finished_at is left as it is, and so is one without an ending. An error becomes a last step of the run, by the controller. Null costs and latencies count nothing; a run without steps has totals of 0. Repeated endings of a run count once:
    the first by status, decision and error.

    runs: run_id, started_at, finished_at, status, decision, total_cost_usd, total_latency_ms. steps: run_id, step_index, component, decision_type, cost_usd, latency_s, error, created_at.
    """
    one = endings.groupBy("run_id").agg(F.min(F.struct("status", "decision", "error")).alias("__end"))
    spent = steps.groupBy("run_id").agg(F.sum("cost_usd").alias("__cost"), F.sum("latency_s").alias("__latency"), F.max("step_index").alias("__last"))
    rows = runs.join(one, "run_id", "left").join(spent, "run_id", "left").withColumn("__open", F.col("finished_at").isNull() & F.col("__end").isNotNull())
    new = {
        "finished_at": F.col("started_at"), "status": F.col("__end")["status"], "decision": F.col("__end")["decision"], "total_cost_usd": F.coalesce("__cost", F.lit(0.0)), "total_latency_ms": F.bround(F.coalesce("__latency", F.lit(0.0)) * 1000).cast("long"),
    }
    out = rows.select(*[F.when(F.col("__open"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns])
    why = F.col("__end")["error"]
    failed = rows.filter(F.col("__open") & why.isNotNull()).select("run_id", (F.coalesce("__last", F.lit(0)) + 1).cast(steps.schema["step_index"].dataType).alias("step_index"), F.lit("controller").alias("component"), F.lit(RUN_FAILED).alias("decision_type"), why.alias("error"), F.col("started_at").alias("created_at"))
    return out, steps.unionByName(failed, allowMissingColumns=True)


def publish(tables: dict[str, DataFrame], root: str, batch: str, attempt: str | None = None) -> str:
    """Write the tables of a batch (a shard's runs, say) and publish them together; the attempt's name.

    Every table goes to a folder of this attempt alone. One line in the manifest, written last by one commit, makes all of them visible and those of earlier attempts of the batch invisible: a killed job leaves folders that no reader
    sees, a repeated one takes the place of the first. Batches of other shards are never touched. root must be a folder that all executors share.
    """
    attempt = attempt or uuid.uuid4().hex
    if not all(re.fullmatch(r"[A-Za-z0-9.-][\w.-]*", name) for name in (batch, attempt)):
        raise ValueError("names of batches and attempts are folders: letters, digits, '.', '-' and '_'")
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}/attempt={attempt}")
    spark = next(iter(tables.values())).sparkSession
    place = 1 + (manifest(spark, root).agg(F.max("place")).first()[0] or 0)
    spark.createDataFrame([(batch, attempt, place)], ENTRY).coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return attempt


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """batch, attempt and place of all that was ever published; empty before the first time."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{root}/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def published(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table's rows of the latest published attempt of every batch, with the column batch. Folders of other attempts are pruned, not read."""
    latest = manifest(spark, root).groupBy("batch").agg(F.max_by("attempt", F.struct("place", "attempt")).alias("attempt"))
    try:
        rows = spark.read.schema(f"{schema}, batch string, attempt string").parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, batch string, attempt string")
    return rows.join(sized_broadcast(latest), ["batch", "attempt"]).drop("attempt")
