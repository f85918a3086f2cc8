"""Scalar functions as column expressions: text, URLs, hashes, dates and JSON."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hosts of job boards and the kind each stands for.
BOARD_HOSTS = {"boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "jobs.ashbyhq.com": "ashby", "jobs.lever.co": "lever"}
# Event types.
NEGATIVE_EVENTS = ("hiring_freeze", "hiring_pause", "shutdown")
MATERIAL_PERCENT, MATERIAL_HEADCOUNT = 10.0, 100


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Days as a double; null if either is null."""
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) / F.lit(86_400_000_000.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null, never 0, where the denominator is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def normalized_text(c: Column | str) -> Column:
    """Lower case, with runs of anything but letters, digits and marks as one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "(?U)[\\W_]+", " "))


def tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(normalized_text(c), " "), lambda x: x != ""))


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    """Null if either side is blank."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double"))


def blank_to_null(c: Column | str) -> Column:
    x = F.trim(F.regexp_replace(col(c), "\\s+", " "))
    return F.when(x != "", x)


def team_key(c: Column | str) -> Column:
    x = F.trim(F.lower(col(c)))
    return F.when(x != "", x)


def content_hash(c: Column | str) -> Column:
    return F.when(col(c) != "", F.sha2(col(c), 256))


def hash_score(a: Column | str, b: Column | str) -> Column:
    known = (F.coalesce(col(a), F.lit("")) != "") & (F.coalesce(col(b), F.lit("")) != "")
    return F.when(known, (col(a) == col(b)).cast("double"))


def changed(a: Column | str, b: Column | str) -> Column:
    """Whether two texts differ once normalized; null if either is blank."""
    x, y = normalized_text(a), normalized_text(b)
    return F.when((x != "") & (y != ""), x != y)


def host(url: Column | str) -> Column:
    """The lower-case host of a URL or bare domain, without port, user and a leading www."""
    rest = F.regexp_replace(F.lower(F.trim(col(url))), "^[a-z][a-z0-9+.-]*://|^//", "")
    name = F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), "^.*@|:[0-9]*$", "")
    name = F.regexp_replace(F.rtrim(name), "^www\\.", "")
    return F.when(name != "", name)


def path(url: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(col(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "^[^/?#]*(/[^?#]*)", 1)


def query_value(url: Column | str, key: str) -> Column:
    """The first value of a query parameter."""
    x = F.regexp_extract(col(url), f"[?&]{key}=([^&#]*)", 1)
    return F.when(x != "", x)


def board_kind(url: Column | str) -> Column:
    """Which kind of board a URL belongs to: by host, or by a numeric gh_jid parameter; other where neither tells."""
    out = F.when(query_value(url, "gh_jid").rlike("^[0-9]+$"), "greenhouse").otherwise("other")
    for name, kind in BOARD_HOSTS.items():
        out = F.when(host(url) == name, kind).otherwise(out)
    return out


def board_tenant(url: Column | str) -> Column:
    x = F.regexp_extract(path(url), "^/([^/]+)", 1)
    return F.when(host(url).isin(*BOARD_HOSTS) & (x != ""), F.lower(x))


def watch_key(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(url))), "/+$", "")


#: Fixed-width UTC text, so that order of text is order of time.
UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def utc_text(ts: Column | str) -> Column:
    return F.date_format(col(ts).cast("timestamp"), UTC_TEXT)


def flexible_time(text: Column | str) -> Column:
    """A timestamp or bare date; null if it is neither."""
    return F.try_to_timestamp(F.trim(col(text)))


def wayback_time(text: Column | str) -> Column:
    """A stamp of 14 digits."""
    return F.try_to_timestamp(F.when(col(text).rlike("^[0-9]{14}$"), col(text)), F.lit("yyyyMMddHHmmss"))


def materiality(event_type: Column | str, headline: Column | str, excerpt: Column | str) -> Column:
    """material or minor: freezes and shutdowns always; layoffs by the percentages and headcounts they state, or material if none is."""
    text = F.concat_ws(" ", F.coalesce(col(headline), F.lit("")), F.coalesce(col(excerpt), F.lit("")))
    percents = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+(?:\\.[0-9]+)?)\\s*%"), 1), lambda x: x.cast("double"))
    heads = F.transform(F.regexp_extract_all(text, F.lit("(?i)([0-9][0-9,]*)\\s*(?:employees|jobs|positions|staff|workers|roles)"), 1), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    large = F.exists(percents, lambda x: x >= MATERIAL_PERCENT) | F.exists(heads, lambda x: x >= MATERIAL_HEADCOUNT)
    none = (F.size(percents) == 0) & (F.size(heads) == 0)
    return F.when(col(event_type).isin(*NEGATIVE_EVENTS), "material").when((col(event_type) == "layoff") & (large | none), "material").otherwise("minor")


def shard_of(*parts: Column | str, shards: int) -> Column:
    """The first 8 bytes of a SHA-256 over the parts, joined by line breaks, modulo the number of shards."""
    digest = F.sha2(F.concat_ws("\n", *[col(p).cast("string") for p in parts]), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(shards).cast("decimal(20,0)")).cast("int")


def hash_fraction(seed: int, key: Column | str) -> Column:
    """A stable position in [0, 1) for a key, by SHA-256 on the JVM."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


@F.pandas_udf(T.StringType())
def _blake_key(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest())


@F.pandas_udf(T.DoubleType())
def _blake_position(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / 2.0**64).astype("float64")


def stable_key(seed: int, key: Column | str) -> Column:
    """A stable order of keys for a seed: the 16-byte BLAKE2b of seed:key in hex, which the JVM lacks."""
    return _blake_key(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def stable_position(seed: int, key: Column | str) -> Column:
    """A stable position in [0, 1) for a key: the 8-byte BLAKE2b of seed:key as a fraction. Put it on distinct keys."""
    return _blake_position(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def recheck_days(expiry: Column | str, now: Column | str, default: int = 14, cap: int = 14) -> Column:
    """Whole days until a declared expiry, within 0 and the cap; the default without one."""
    return F.when(col(expiry).isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(days_between(expiry, now))))).cast("int")


def grid(start: Column | str, end: Column | str, step_days: int) -> Column:
    """start, every step_days days on, and end, each once."""
    a, b = col(start).cast("timestamp"), col(end).cast("timestamp")
    steps = F.when(a <= b, F.sequence(a, b, F.expr(f"interval {int(step_days)} days"))).otherwise(F.array().cast("array<timestamp>"))
    return F.array_sort(F.array_union(steps, F.when(a <= b, F.array(b)).otherwise(F.array().cast("array<timestamp>"))))


def split_value(value: Column | str, separator: str = ": ") -> tuple[Column, Column]:
    """What stands before and behind the first separator."""
    at = F.instr(col(value), separator)
    head = F.when(at > 0, F.substring(col(value), F.lit(1), at - 1)).otherwise(F.lit(None).cast("string"))
    return head, F.when(at > 0, F.substring(col(value), at + len(separator), F.length(col(value)))).otherwise(col(value))


def prefix_argument(value: Column | str, prefix: str) -> Column:
    """The argument of a structured string prefix:argument; null for another prefix."""
    return F.when(F.startswith(col(value), F.lit(prefix + ":")), F.substring(col(value), len(prefix) + 2, 1 << 20))
