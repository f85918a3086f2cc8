"""Job postings in the JSON-LD of pages, to any depth of arrays and @graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import host
from larkspur.session import written

#: Behind all of a node's children: a node comes after what its @graph holds.
LAST = 2**31 - 1


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, path (the block's place) and node (a variant) of each JSON-LD block that parses; broken and empty ones are passed over."""
    found = F.regexp_extract_all(html, F.lit("(?is)<script[^>]*type\\s*=\\s*[\"']?application/ld\\+json[^>]*>(.*?)</script>"), 1)
    rows = pages.select(key, F.posexplode(found).alias("__place", "__text"))
    return rows.select(key, F.array("__place").alias("path"), F.try_parse_json("__text").alias("node")).filter("node is not null")


def kind(node: Column) -> Column:
    """ARRAY, OBJECT or the type of a scalar."""
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def text_of(node: Column, path: str) -> Column:
    """A member of a node if it is a text, else null: numbers aren't read as texts."""
    found = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(node, path, "string"))


def nodes(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, place and node of every object in found (key, path, node), of all arrays in arrays and @graph lists; sorting by place gives the order of the document.

    Each level of nesting is one pass over the nodes that hold others, written as it is found: as many passes as the deepest page has levels, and no cap on nodes.
    """
    spark, level, all_ = found.sparkSession, written(found), []
    while not level.isEmpty():
        all_.append(level.filter(kind(F.col("node")) == "OBJECT").select(key, F.array_append("path", F.lit(LAST)).alias("place"), "node"))
        graph = F.try_variant_get("node", '$["@graph"]', "variant")
        held = F.when(kind(F.col("node")) == "ARRAY", F.col("node")).when((kind(F.col("node")) == "OBJECT") & (kind(graph) == "ARRAY"), graph)
        inner = level.select(key, "path", held.alias("__held")).filter("__held is not null")
        inner = inner.lateralJoin(spark.tvf.variant_explode(F.col("__held").outer()))
        level = written(inner.select(key, F.array_append("path", F.col("pos")).alias("path"), F.col("value").alias("node")))
    if not all_:
        return found.select(key, F.col("path").alias("place"), "node")
    out = all_[0]
    for rows in all_[1:]:
        out = out.unionByName(rows)
    return out


def is_posting(node: Column) -> Column:
    type_ = F.try_variant_get(node, '$["@type"]', "variant")
    listed = F.array_contains(F.try_variant_get(node, '$["@type"]', "array<string>"), "JobPosting")
    return F.coalesce(F.when(kind(type_) == "ARRAY", listed).otherwise(text_of(node, '$["@type"]') == "JobPosting"), F.lit(False))


def job_postings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The first posting of each page that has one: key, title, date_posted_raw, date_posted, valid_through_raw, valid_through, org_domain."""
    found = nodes(blocks(pages, key, html), key).filter(is_posting(F.col("node")))
    # a variant can't be compared, so the place alone decides
    first = found.groupBy(key).agg(F.min_by(F.to_json("node"), "place").alias("__n")).withColumn("__n", F.parse_json("__n"))
    node = F.col("__n")
    org = lambda p: host(text_of(node, f"$.hiringOrganization.{p}"))
    fields = {"title": text_of(node, "$.title"), "date_posted_raw": text_of(node, "$.datePosted"), "valid_through_raw": text_of(node, "$.validThrough")}
    rows = first.select(key, *[c.alias(n) for n, c in fields.items()], F.coalesce(org("sameAs"), org("url")).alias("org_domain"))
    return rows.withColumn("date_posted", F.try_to_timestamp("date_posted_raw")).withColumn("valid_through", F.try_to_timestamp("valid_through_raw"))
