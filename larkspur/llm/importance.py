"""Target-distribution importance resampling (operator 13), with DataFrame functions only.

Features of a text are its runs of 1 to LONGEST consecutive words; a feature's bucket is its crc32 modulo BUCKETS. The gain of a bucket
compares how often its features occur in the target (smoothed by one a bucket) with how often they occur in the pool; a document's weight is the
sum of the gains of its features. Adding Gumbel noise made from a hash of the key and taking the highest sums draws documents without
replacement, with probabilities in proportion to exp(weight / 1000).

Words are exploded with their positions, and the runs from each are put together in the same stage: no array of all runs of a
long text is ever built. Bucket counts are combined before their shuffle, so a task sends BUCKETS rows at most and a feature that a third of all rows hold is no hot
key. The gain table has BUCKETS rows at most and is broadcast by that bound. The sums of a document are combined where its text is
read; one row a document is shuffled. Ranks come from a sort by ranges of score and key: a row's place within its partition
plus the number of rows in the partitions before it. No task sees all rows, and equal scores spread over partitions by key.

Null and empty texts, and those without words, have no features, weight 0 and no rank (they have fewer than LEAST words). A text is taken whole,
whatever its length. Rows that repeat a key with another text are documents of their own; equal rows are ranked one after the other. A null
key hashes as the empty string and ties last. Without a target every t is 0. An empty table gives an empty table. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import LOWER, UPPER
from larkspur.session import written

LONGEST, BUCKETS, LEAST, PERCENT, SEED = 3, 10_000, 20, 5, 42
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in lower case (A-Z only); null has none."""
    found = F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def features(rows: DataFrame, kept: list[str]) -> DataFrame:
    """kept columns and __b, a row for each feature of __w; a row without words comes once, with a null bucket. __first marks one row of each of rows."""
    rows = rows.select(*kept, "__w", F.posexplode_outer("__w").alias("__p", "__v"))
    run, runs = F.col("__v"), [bucket(F.col("__v"))]
    for k in range(1, LONGEST):
        # concat of a run that ends beyond the text is null, and so is its bucket
        run = F.concat(run, F.lit(" "), F.get("__w", F.col("__p") + k))
        runs.append(bucket(run))
    each = F.array(*[F.struct(b.alias("__b"), F.lit(k == 0).alias("__word")) for k, b in enumerate(runs)])
    rows = rows.select(*kept, "__p", F.inline(each))
    first = F.col("__word") & (F.coalesce("__p", F.lit(0)) == 0)
    return rows.filter(F.col("__b").isNotNull() | first).select(*kept, "__b", first.alias("__first"))


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """__b and __n: how many features of all texts fall into each bucket that any falls into."""
    rows = docs.select(words(F.col(text)).alias("__w"))
    return features(rows, []).filter(F.col("__b").isNotNull()).groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))


def gains(pool: DataFrame, target: DataFrame) -> DataFrame:
    """__b and __gain of each bucket that pool counts; both tables have __b and __n, BUCKETS rows at most."""
    pool, target = written(pool), written(target)
    s, t = (F.lit(float(x.agg(F.sum("__n")).first()[0] or 0) + BUCKETS) for x in (pool, target))
    both = pool.withColumnRenamed("__n", "__s").join(F.broadcast(target.withColumnRenamed("__n", "__t")), "__b", "left")
    ratio = (F.coalesce("__t", F.lit(0)).cast("double") + 1) * s / ((F.col("__s").cast("double") + 1) * t)
    return both.select("__b", F.floor(1000 * F.log(ratio)).alias("__gain"))


def noise(key: Column) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of SEED and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: __key, __words, __features, __weight, __score."""
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__copy"), words(F.col(text)).alias("__w"))
    rows = rows.withColumn("__words", F.size("__w").cast("long"))
    met = features(rows, ["__key", "__copy", "__words"]).join(F.broadcast(gain), "__b", "left")
    sums = met.groupBy("__key", "__copy", "__words").agg(F.count("__b").alias("__n"), F.coalesce(F.sum("__gain"), F.lit(0)).alias("__g"), F.sum(F.col("__first").cast("int")).cast("int").alias("__m"))
    # __m equal rows were summed together
    sums = sums.select("__key", "__words", F.expr("__n div __m").alias("__features"), F.expr("__g div __m").alias("__weight"), F.explode(F.array_repeat(F.lit(1), F.col("__m"))).alias("__one"))
    return sums.select("__key", "__words", "__features", "__weight", (F.col("__weight") + noise(F.col("__key"))).alias("__score"))


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """rows with their ranks from 1: places within partitions of a range sort, plus the rows of the partitions before."""
    ids = F.monotonically_increasing_id()  # the number of the partition, and 33 bits of the place in it
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", ids)
    placed = written(placed.select("*", F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__place")).drop("__id"))
    # one row a partition
    counts = sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    if not offsets:
        return placed.drop("__part", "__place").withColumn(rank, F.lit(0).cast("long"))
    table = placed.sparkSession.createDataFrame(offsets, "__part long, __before long")
    return placed.join(F.broadcast(table), "__part").withColumn(rank, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text") -> DataFrame:
    """A row for each document: __key, __words, __features, __weight, __score, and __rank of those that are drawn."""
    gain = written(gains(bucket_counts(docs, text), bucket_counts(target, target_text)))
    rows = written(weighed(docs, gain, text, key))
    enough = F.col("__words") >= LEAST
    drawn = rows.filter(enough).count() * PERCENT // 100
    placed = ranked(rows.filter(enough), [F.col("__score").desc(), F.col("__key").asc_nulls_last()], "__rank")
    placed = placed.withColumn("__rank", F.when(F.col("__rank") <= drawn, F.col("__rank")))
    return placed.unionByName(rows.filter(~enough).withColumn("__rank", F.lit(None).cast("long")))


#: The polynomial of crc32 makes a table of 256 rows; every distinct feature is hashed once, byte by byte.
ORACLE = rf"""
WITH RECURSIVE steps AS (SELECT range AS i, range AS c, 0 AS n FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
polynomial AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
worded AS MATERIALIZED (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda w: w <> '') AS w FROM texts),
runs AS (SELECT kind, id, w[p:p + k - 1] AS f FROM (SELECT kind, id, w, unnest(range(1, len(w) + 1)) AS p FROM worded), range(1, {LONGEST + 1}) AS t(k) WHERE p + k - 1 <= len(w)),
feats AS MATERIALIZED (SELECT kind, id, array_to_string(f, ' ') AS f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b[i:i]))::BIGINT)),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % {BUCKETS} AS b FROM (SELECT DISTINCT f, encode(f) AS b FROM feats), polynomial),
counts AS (SELECT b, sum(n) FILTER (kind = 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM feats JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM counts),
gain AS (SELECT b, CAST(floor(1000 * ln((c.t::DOUBLE + 1) * (a.s + {BUCKETS}) / ((c.s::DOUBLE + 1) * (a.t + {BUCKETS})))) AS BIGINT) AS g FROM counts c, totals a WHERE c.s IS NOT NULL),
weights AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS w FROM feats JOIN hashed USING (f) JOIN gain USING (b) WHERE kind = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(g.w, 0) AS weight,
  coalesce(g.w, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM worded d LEFT JOIN weights g USING (id) WHERE kind = 0),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= {LEAST}
  QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= count(*) OVER () * {PERCENT} // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
