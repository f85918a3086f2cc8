"""Stored records as canonical JSON that loses nothing: times, claims and what is unknown carry tags, so that unknown, null and a value stay apart.

Encoding builds texts from columns (names sorted, no spaces, nulls kept); decoding reads them as variants. An object {TAG: kind, "v": value} stands for a
value that JSON lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import bound, utc_text

TAG = "__type__"
UNKNOWN, TIME, CLAIM, JOB = KINDS = ("unknown", "datetime", "probe_claim", "board_job")
# The addresses and parameters of board fetches, and the probes that fetch.
BOARD_FETCHES = {
    "greenhouse": ("https://boards-api.greenhouse.io/v1/boards/{}/jobs", "content"),
    "ashby": ("https://api.ashbyhq.com/posting-api/job-board/{}", "includeCompensation"),
    "lever": ("https://api.lever.co/v0/postings/{}", "mode"),
}
PARAMETERS = {"content": "true", "includeCompensation": "false", "mode": "json"}
RESOLVER, BOARD, DRIFT, PAGE = "resolve_posting", "board_snapshot", "requirements_drift", "json_ld"


def plain(value: Column) -> Column:
    """A scalar or an array as JSON; null as null."""
    whole = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.when(value.isNull(), "null").otherwise(bound(whole, lambda w: F.substring(w, F.lit(2), F.length(w) - 2)))


def members(**fields: Column) -> Column:
    """An object of fields that are JSON already, by name."""
    parts = [F.concat(F.lit(("," if i else "") + f'"{n}":'), fields[n]) for i, n in enumerate(sorted(fields))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def tagged(kind: str, value: Column | None = None) -> Column:
    head = f'{{"{TAG}":"{kind}"'
    return F.lit(head + "}") if value is None else F.concat(F.lit(head + ',"v":'), value, F.lit("}"))


def time(value: Column) -> Column:
    return F.when(value.isNull(), "null").otherwise(tagged(TIME, F.concat(F.lit('"'), utc_text(value), F.lit('"'))))


def or_unknown(known: Column, value: Column) -> Column:
    """value (JSON) where it is known, the tag of the unknown where not."""
    return F.when(F.coalesce(known, F.lit(False)), value).otherwise(tagged(UNKNOWN))


def listed(items: Column) -> Column:
    """An array of texts that are JSON already."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def tag_of(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f'{path}["{TAG}"]', "string")


def is_unknown(record: Column, path: str) -> Column:
    return F.coalesce(tag_of(record, path) == UNKNOWN, F.lit(False))


def value(record: Column, path: str, kind: str) -> Column:
    """A member of a decoded record: times from their tags, null for null and for the unknown (is_unknown tells these apart)."""
    if kind == "timestamp":
        return F.when(tag_of(record, path) == TIME, F.try_to_timestamp(F.try_variant_get(record, f"{path}.v", "string")))
    return F.when(tag_of(record, path).isNull(), F.try_variant_get(record, path, kind))


def claims_of(records: DataFrame, data: str, path: str = "$.evidence") -> DataFrame:
    """records with place and claim (a variant) for each tagged claim of a record, in order."""
    items = F.try_variant_get(F.try_parse_json(data), path, "array<variant>")
    rows = records.select("*", F.posexplode(items).alias("place", "__i"))
    return rows.filter(F.try_variant_get("__i", f'$["{TAG}"]', "string") == CLAIM).withColumn("claim", F.try_variant_get("__i", "$.v", "variant")).drop("__i")


def foreign_tags(data: Column) -> Column:
    """The tags in a record that no reader knows: such a record was written by something newer and must not be read as if it were plain."""
    found = F.regexp_extract_all(data, F.lit(f'(?<!\\\\)"{TAG}":"([^"]*)"'), 1)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*KINDS)))


def fetch_key(probe: Column, url: Column, name: str | None = None) -> Column:
    """The cache key of a fetch: SHA-256 of the canonical JSON of its probe, address and parameter. Addresses are ASCII."""
    params = f'{{"{name}":"{PARAMETERS[name]}"}}' if name else "{}"
    return F.sha2(F.concat(F.lit(f'{{"args":{{"params":{params},"url":"'), url, F.lit('"},"probe":"'), probe, F.lit('"}')), 256)


def board_key(probe: Column, ats: Column, tenant: Column, job: Column) -> Column:
    """The key of the fetch that a probe makes for one posting: its own record on boards that serve single ones, else the whole board; null without a tenant."""
    out = F.lit(None).cast("string")
    for kind, (url, name) in BOARD_FETCHES.items():
        whole = F.concat(F.lit(url.split("{}")[0]), tenant, F.lit(url.split("{}")[1]))
        one = F.when(job != "", F.concat(whole, F.lit("/"), job)).otherwise(whole) if kind == "greenhouse" else whole
        out = F.when(ats == kind, fetch_key(probe, F.coalesce(one, whole), name)).otherwise(out)
    return F.when(tenant != "", out)


def fetch_keys(records: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """records (record_id, probe_name, data) with a row for each fetch behind them: record_id, probe, args_hash.

    The resolver fetches its board and the page it names, the board probe its board; the drift probe fetches what postings (posting_id, ats, tenant, job_id) say of its posting.
    """
    # a record is parsed once, its fields are columns of their own, and it gives all its fetches in one pass
    parsed = records.filter(F.col("probe_name").isin(RESOLVER, BOARD, DRIFT)).select("record_id", F.col("probe_name").alias("probe"), F.try_parse_json("data").alias("__r"))
    field = lambda n: F.when(F.schema_of_variant(F.try_variant_get("__r", f"$.{n}", "variant")) == "STRING", F.try_variant_get("__r", f"$.{n}", "string"))
    rows = parsed.select("record_id", "probe", *[field(n).alias(n) for n in ("ats", "tenant", "job_id", "canonical_url", "posting_id")])
    resolver = F.col("probe") == RESOLVER
    board = F.struct("probe", board_key(F.col("probe"), F.col("ats"), F.col("tenant"), F.when(resolver, F.col("job_id"))).alias("args_hash"))
    page = F.struct(F.lit(PAGE).alias("probe"), F.when(resolver & F.startswith("canonical_url", F.lit("http")), fetch_key(F.lit(PAGE), F.col("canonical_url"))).alias("args_hash"))
    out = rows.filter(F.col("probe") != DRIFT).select("record_id", F.inline(F.array(board, page)))
    if postings is not None:
        known = rows.filter(F.col("probe") == DRIFT).select("record_id", "probe", "posting_id").join(postings, "posting_id")
        out = out.unionByName(known.select("record_id", "probe", board_key(F.col("probe"), F.col("ats"), F.col("tenant"), F.col("job_id")).alias("args_hash")))
    return out.filter("args_hash is not null")
