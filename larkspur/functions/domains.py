"""Registrable domains of hosts, and the domain of a page's owner by the links on the page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import col, host
from larkspur.session import sized_broadcast

# Public suffixes of two labels.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.jp", "co.kr", "co.in", "co.il", "co.id", "co.th", "com.br", "com.mx", "com.ar", "com.sg", "com.tr", "com.cn", "com.hk", "com.tw",
    "com.my", "com.ph", "com.pl", "com.ua", "com.co", "com.pe", "com.vn", "or.jp", "ne.jp", "co.ke", "co.ug",
)
# Two-letter top-level domains beside the countries' codes, and those of public bodies.
NO_COUNTRIES = ("ac", "eu", "su", "tp", "uk")
PUBLIC = ("gov", "mil", "edu")
#: A domain that doesn't name its owner needs so many links, and so many times those of the next.
LEAST_LINKS, TIMES_NEXT = 4, 2


def country_codes(spark: SparkSession) -> list[str]:
    """The two-letter top-level domains: the ISO codes of countries, from Java's own table, and a few more."""
    return sorted({c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()} | set(NO_COUNTRIES))


def registrable(name: Column | str, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last two labels of a host, three if the last two are a public suffix; null for a null host or a single label."""
    labels = F.split(col(name), "\\.", -1)
    two, three = F.array_join(F.slice(labels, -2, 2), "."), F.array_join(F.slice(labels, -3, 3), ".")
    return F.when(F.size(labels) >= 3, F.when(two.isin(*suffixes), three).otherwise(two)).when(F.size(labels) == 2, two)


def plausible(domain: Column | str, countries: Sequence[str]) -> Column:
    """Whether a domain may be an owner's: no blank or overlong label, and a top level that is a country's code, of letters only (3 to 24), or encoded. False for null."""
    labels = F.split(col(domain), "\\.", -1)
    top = F.lower(F.element_at(labels, -1))
    real = F.when(F.length(top) == 2, top.isin(*countries)).when(F.startswith(top, F.lit("xn--")), F.length(top) > 4).otherwise(top.rlike("^(?U)\\p{L}{3,24}$"))
    return F.coalesce((F.size(labels) > 1) & F.forall(labels, lambda x: F.length(x).between(1, 63)) & real, F.lit(False))


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def names_owner(domain: Column | str, *names: Column | str) -> Column:
    """Whether the first label of a domain and one of the names contain one another, by letters and digits. Blank names and labels match nothing."""
    core = _letters(F.get(F.split(col(domain), "\\."), F.lit(0)))
    hits = F.lit(False)
    for n in names:
        x = _letters(col(n))
        hits = hits | ((x != "") & (F.contains(x, core) | F.contains(core, x)))
    return (core != "") & hits


def mined(pages: DataFrame, blocked: DataFrame, key: str = "page_id", html: str = "html", names: Sequence[str] = ("company_name", "tenant"), urls: str | None = None) -> DataFrame:
    """key, domain and found_by of every page: the most linked domain that names the owner (name), else one that dominates the page's links (dominant), else nulls.

    Links are the absolute ones of html, behind those of the array column urls. Domains of blocked (one column, domain), whatever is below them, and public bodies' don't count. Of domains with as many
    links the first linked comes first. Links are counted by page and domain before anything is gathered by page, so a page of very many links is spread.
    """
    found = F.coalesce(F.regexp_extract_all(html, F.lit('href=\\\\?"(https?://[^"\\\\\\s]+)'), 1), F.array().cast("array<string>"))
    if urls:
        found = F.concat(F.coalesce(urls, F.array().cast("array<string>")), found)
    domain = registrable(host("__url"))
    real = plausible("__domain", country_codes(pages.sparkSession)) & ~F.element_at(F.split("__domain", "\\."), -1).isin(*PUBLIC)
    links = pages.select(key, *names, F.posexplode_outer(found).alias("__place", "__url")).withColumn("__domain", domain).withColumn("__domain", F.when(real, F.col("__domain")))
    counts = links.groupBy(key, "__domain").agg(F.count("__domain").alias("__n"), F.min("__place").alias("__place"), *[F.any_value(n, True).alias(n) for n in names])
    stop = sized_broadcast(blocked.select(F.col("domain").alias("__stop")).distinct())
    below = F.array_join(F.slice(F.split("__domain", "\\."), -2, 2), ".")
    for side in (F.col("__domain"), below):
        counts = counts.join(stop, side == F.col("__stop"), "left").withColumn("__domain", F.when(F.col("__stop").isNull(), F.col("__domain"))).drop("__stop")
    ranked = counts.withColumn("__n", F.when(F.col("__domain").isNotNull(), F.col("__n"))).withColumn("__top", F.max("__n").over(Window.partitionBy(key)))
    order = F.struct("__n", -F.col("__place"))
    owner = names_owner("__domain", *names)
    best = ranked.groupBy(key).agg(
        F.max_by("__domain", F.when(owner & F.col("__domain").isNotNull(), order)).alias("__named"), F.max_by("__domain", F.when(F.col("__domain").isNotNull(), order)).alias("__most"),
        F.max("__top").alias("__top"), F.count_if(F.col("__n") * TIMES_NEXT > F.col("__top")).alias("__near"),
    )
    dominant = (F.col("__top") >= LEAST_LINKS) & (F.col("__near") == 1)
    return best.select(
        key, F.coalesce("__named", F.when(dominant, F.col("__most"))).alias("domain"), F.when(F.col("__named").isNotNull(), "name").when(dominant, "dominant").alias("found_by")
    )
