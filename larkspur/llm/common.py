"""What the operators of this subpackage share: column access, batches and word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import ship

#: A word, as the contracts define it: a run of anything but these six white-space characters.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Batches for Python are bounded by rows and by bytes, so that long texts don't add up."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def crc_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def words(text: str | bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.lower and bytes.split know ASCII only, as the rule does."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()


def sized(text: Column) -> Column:
    """The number of words of a text, on the JVM; null has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != ""))).cast("long")


def release() -> None:
    """Give freed memory back at the end of a task: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """df through a Python function of Arrow batches. make() runs once a task and returns the function, which returns columns."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                cols = f(b)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for t in arrow for c in [cols[t.name]]], schema=arrow)
                del cols
        del f
        release()

    return df.mapInArrow(run, schema)
