"""Drift between versions of a posting: changed fields and line differences, and reasons with enforced citations."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import changed

SAMPLE_LINES = 5
DIFF = T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("added_sample", T.ArrayType(T.StringType())), T.StructField("removed_sample", T.ArrayType(T.StringType()))])


def lines_of(text: str) -> list[str]:
    return [x for x in map(str.strip, text.splitlines()) if x]


@F.pandas_udf(DIFF)
def line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """How many lines came and went, with samples; nulls if either text is blank. The order of lines counts."""
    out = []
    for a, b in zip(old, new, strict=True):
        if not a or not b:
            out.append((None, None, None, None))
            continue
        a, b = lines_of(a), lines_of(b)
        gone, came = [], []
        for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
            if kind != "equal":
                gone += a[i:j]
                came += b[k:m]
        out.append((len(came), len(gone), came[:SAMPLE_LINES], gone[:SAMPLE_LINES]))
    frame = pd.DataFrame(out, columns=[f.name for f in DIFF])
    return frame.astype({"added": "Int32", "removed": "Int32"})


def field_drift(rows: DataFrame, fields: list[str], live: str = "live_", stored: str = "stored_") -> DataFrame:
    """rows with a column <field>_changed per field (null if either side is blank) and drifted: whether any changed."""
    marks = [changed(live + f, stored + f) for f in fields]
    drifted = F.lit(False)
    for m in marks:
        drifted = drifted | F.coalesce(m, F.lit(False))
    return rows.select("*", *[m.alias(f"{f}_changed") for f, m in zip(fields, marks, strict=True)], drifted.alias("drifted"))


def reasons(cases: DataFrame, evidence: DataFrame, families: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """case_id, reason, evidence_ids: for each family (condition over the case, claim types) that holds, the evidence that backs it, in order.

    A reason without evidence is dropped: what can't be cited isn't said.
    """
    cited = evidence.groupBy("case_id", "claim_type").agg(F.sort_array(F.collect_list("evidence_id")).alias("ids"))
    by_case = cited.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("claim_type", "ids"))).alias("by_type"))
    rows = cases.join(by_case, "case_id", "left")
    empty = F.array().cast(cited.schema["ids"].dataType)
    made = []
    for name, (holds, claims) in families.items():
        ids = F.flatten(F.array(*[F.coalesce(F.element_at("by_type", c), empty) for c in claims]))
        made.append(F.when(holds, F.struct(F.lit(name).alias("reason"), ids.alias("evidence_ids"))))
    found = F.filter(F.array(*made), lambda r: r.isNotNull() & (F.size(r["evidence_ids"]) > 0))
    return rows.select("case_id", F.posexplode(found).alias("place", "r")).select("case_id", "place", "r.reason", "r.evidence_ids")


def dangling_citations(reasons_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations of evidence that doesn't exist in the case: must be empty."""
    cited = reasons_.select("case_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return cited.join(evidence.select("case_id", "evidence_id").distinct(), ["case_id", "evidence_id"], "left_anti")
