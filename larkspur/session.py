"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: str = "*", name: str = "larkspur") -> SparkSession:
    """A local session with the settings the library expects."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *os.environ.get("PYTHONPATH", "").split(os.pathsep)])).strip(os.pathsep)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once a session, where PYTHONPATH doesn't do so already."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_larkspur_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "larkspur.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in (ROOT / "larkspur").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._larkspur_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where that is unset, in a folder of this process's own if the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext._larkspur_scratch = getattr(spark.sparkContext, "_larkspur_scratch", None) or tempfile.mkdtemp(prefix="larkspur-")
    return f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}"


#: With this, Spark removes the files of a query's shuffles when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. Unlike cached blocks, the files outlive a lost executor; the shuffles behind them are removed."""
    spark = df.sparkSession
    path, before = scratch(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df, joined by sorting. Spark broadcasts files of up to 10 MB, whose rows may be ten times as large; tables that grow with the input shouldn't pass through the driver each time they are joined."""
    return df.hint("merge")


#: So many rows of so many bytes of text, at most, are broadcast; more are joined by a shuffle.
FEW, FEW_BYTES = 1_000_000, 64 << 20


def sized_broadcast(rows: DataFrame) -> DataFrame:
    """rows, broadcast if their number and their size are within FEW and FEW_BYTES. Columns of variable length are measured, others count 16 bytes."""
    size = F.lit(0).cast("long")
    for f in rows.schema.fields:
        long = f.dataType.simpleString() in ("string", "binary")
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if long else F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) if f.dataType.simpleString()[:5] in ("array", "struc", "map<") else F.lit(16))
    n, total = rows.limit(FEW + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(rows) if n <= FEW and (total or 0) <= FEW_BYTES else rows
