"""Mixing sources to target weights (operator 9) along a time-varying curriculum.

Each source has a weight schedule over training time 0..1: w(t) = 1 + a (2 t - 1), with a slope a that runs from -SLOPE
(early sources) to +SLOPE (late ones) with the source's rank. Its integral t + a (t^2 - t) is the share of the source's
demand that training has met by time t. A document that stands at share u of its source's demand (of all words taken from it, full passes
first, then those of the documents taken once more) is assigned the time at which the integral reaches u, found by inverting the quadratic; sorting
by these positions by range gives the training order. A source's target may exceed its size: then its documents are passed over again, up to LIMIT times.

Targets: sources in code point order (null last) weigh WEIGHTS in turn and share all words; a target stops at LIMIT
times its source's size and the excess is shared again by weight until none is above. Every document is taken
floor(target / size of source) times; the first documents in hash order are taken once more while they fit into the rest.
What is left then (less than a document) takes FITS times the longest document that fits, so that a long document at the bound doesn't
keep its source from its target.

Running sums are taken over hash buckets within sources, so that a source with a third of all rows is spread over BUCKETS
groups. Null texts have size 0; documents of size 0 are taken 0 words (but keep a position). Equal rows take equal
places: ties in hash order are broken by key, and rows that repeat a key follow one another; the curriculum takes rows of one key and text as often as the
one of them that is taken most. An empty table gives an empty table. Extra columns stay, whatever their names. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import prepare, sized
from larkspur.session import written

WEIGHTS, LIMIT, SLOPE, BUCKETS = (5.0, 2.0, 1.0), 3, 0.5, 4096


def ranked(sources: DataFrame) -> DataFrame:
    """__rank from 0 in code point order, null last, by a range sort: no task sees all sources."""
    schema = T.StructType([*sources.schema.fields, T.StructField("__rank", T.LongType(), False)])
    order = sources.orderBy(F.col("__source").asc_nulls_last())
    return sources.sparkSession.createDataFrame(order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def targets(sources: DataFrame) -> DataFrame:
    """__source, __size (words), __rank, __slope, __target for rows of __source and __size. Every round of sharing is one aggregate."""
    count = sources.count()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("__rank") % len(WEIGHTS) + 1).cast("int"))
    rows = written(ranked(sources).withColumn("__weight", weight).withColumn("__most", F.col("__size") * float(LIMIT)))
    level = 0.0
    while True:
        free = F.col("__most") > F.col("__weight") * level
        total, held, weights = rows.agg(F.sum("__size"), F.sum(F.when(~free, F.col("__most")).otherwise(0.0)), F.sum(F.when(free, F.col("__weight")).otherwise(0.0))).first()
        new = (total - held) / weights if total and weights else level
        if new <= level:
            break
        level = new
    slope = F.lit(SLOPE) * (2 * F.col("__rank") / max(1, count - 1) - 1)
    return rows.select("__source", "__size", "__rank", slope.alias("__slope"), F.least("__most", F.col("__weight") * level).alias("__target"))


def when_met(share: Column, slope: Column) -> Column:
    """The time t with t + a (t^2 - t) = share."""
    t = F.when(F.abs(slope) < 1e-9, share).otherwise((slope - 1 + F.sqrt(F.pow(1 - slope, 2) + 4 * slope * share)) / (2 * slope))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def running(rows: DataFrame) -> DataFrame:
    """rows with __start: the words of their source before them in hash order. Sums run within buckets; those of whole buckets are added."""
    groups = rows.groupBy(F.col("__source").alias("__s"), F.col("__bucket").alias("__b")).agg(F.sum("__words").alias("__n"))
    before = groups.withColumn("__before", F.sum("__n").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__n")).drop("__n")
    within = Window.partitionBy("__source", "__bucket").orderBy("__hash", "__key", "__copy").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__sum", F.sum("__words").over(within) - F.col("__words"))
    out = out.join(before, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return out.withColumn("__start", F.col("__sum") + F.col("__before")).drop("__sum", "__before", "__s", "__b")


def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of table, which has a row for each source."""
    table = table.withColumnRenamed("__source", "__s")
    return rows.join(F.broadcast(table) if small(table) else table, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """A row per document: __key, __copy (tells texts of one key apart), __source, __words, __source_size, __slope, __target, __start (words before it in its source), __full (full passes), __last (words before it in the last pass), __demand (all words taken from its source), __times, __taken, __position (of its first taking; null if it isn't taken)."""
    prepare(docs.sparkSession)
    order = F.xxhash64(F.col(key).cast("string"), F.lit("mix"))
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__copy"), F.col(source).alias("__source"), sized(F.col(text)).alias("__words"), order.alias("__hash"))
    rows = written(rows.withColumn("__bucket", F.pmod(F.shiftright("__hash", 40), F.lit(BUCKETS))).withColumn("__row", F.monotonically_increasing_id()))
    want = written(targets(rows.groupBy("__source").agg(F.sum("__words").alias("__size"))).withColumnRenamed("__size", "__source_size").drop("__rank"))
    full = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    out = by_source(running(rows), want).withColumn("__full", full).withColumn("__rest", F.col("__target") - F.col("__full") * F.col("__source_size"))
    base = written(out.withColumn("__more", (F.col("__start") + F.col("__words") <= F.col("__rest") + 1e-6).cast("long")))
    picks, out = base.limit(0).select("__row", F.lit(1).cast("long").alias("__fill")), base
    for _ in range(FITS):
        left = out.groupBy("__source").agg((F.max("__rest") - F.sum(F.col("__more") * F.col("__words"))).alias("__left"))
        free = by_source(out.filter((F.col("__more") == 0) & (F.col("__words") > 0) & (F.col("__full") < LIMIT)).select(*rows.columns), left)
        longest = free.filter(F.col("__words") <= F.col("__left")).groupBy("__source").agg(F.max_by("__row", F.struct("__words", "__hash", "__row")).alias("__row"))
        picks = written(picks.unionByName(longest.select("__row", F.lit(1).cast("long").alias("__fill"))))
        out = base.join(picks, "__row", "left").withColumn("__more", F.coalesce("__fill", "__more")).drop("__fill")
    out = written(out)
    out = out.withColumn("__times", F.least(F.col("__full") + F.col("__more"), F.lit(LIMIT)).cast("long"))
    # the last pass goes over the documents taken once more, in hash order: their demand starts where the full passes end
    last = running(out.filter("__more = 1").select(*rows.columns)).select("__row", F.col("__start").alias("__last"))
    taken = out.groupBy("__source").agg(F.sum(F.col("__times") * F.col("__words")).alias("__demand"))
    out = by_source(out.join(last, "__row", "left"), taken)
    return out.select("__key", "__copy", "__source", "__words", "__source_size", "__slope", "__target", "__start", "__full", "__last", "__demand", "__times", (F.col("__times") * F.col("__words")).alias("__taken"), position(F.lit(0)).alias("__position"))


def position(pass_: Column) -> Column:
    """When training reaches a document's pass_-th taking: the inverse of its source's demand at the middle of the document. Documents that aren't taken have none."""
    start = F.when(pass_ < F.col("__full"), pass_ * F.col("__source_size") + F.col("__start")).otherwise(F.col("__full") * F.col("__source_size") + F.col("__last"))
    share = F.coalesce(F.try_divide(start + F.col("__words") / 2, F.col("__demand")), F.lit(0.0))
    return F.when(pass_ < F.col("__times"), when_met(F.least(F.lit(1.0), share), F.col("__slope")))


#: How often what is left of a target takes the longest document that fits.
FITS = 4
#: Targets are broadcast up to so many sources and joined by a shuffle beyond.
FEW = 10_000


def small(rows: DataFrame) -> bool:
    return len(rows.limit(FEW + 1).select(F.lit(1)).collect()) <= FEW


def curriculum(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs in training order: each document as often as the mix takes it, range-sorted by its positions. The columns of docs stay."""
    plan = mix(docs, text, key, source)
    plan = plan.filter("__times > 0").withColumn("__pass", F.explode(F.sequence(F.lit(0), F.col("__times") - 1))).withColumn("__at", position(F.col("__pass")))
    plan = plan.groupBy("__key", "__copy", "__pass").agg(F.min("__at").alias("__at"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__k"), F.xxhash64(F.col(text)).alias("__c"))
    out = row.join(plan, F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__c") == F.col("__copy")))
    return out.repartitionByRange("__at", "__key", "__pass").sortWithinPartitions("__at", "__key", "__pass").select("__row.*")
