"""Line dedup (operator 8), with DataFrame functions only.

Every window of three consecutive lines of a text gets a 128-bit hash of its lines (white space at their ends apart).
A window that occurs again, in any document, is kept at its first place in the order of key and line number; at every
later place its three lines are marked, and the marked positions of overlapping windows merge into what is removed.

Groups of equal windows are only ever reduced to their first place (combined before the shuffle), and each window meets
at most one such row. The windows that make up more than one in HOT_SHARE of all are at most so many: their first places are broadcast, and
others meet theirs by a shuffle, so no task gets the rows of a passage that a third of all documents share. Windows of blank lines alone don't count. Null texts stay null, empty ones and those of fewer than three lines stay as they
are. A text that loses all its lines becomes empty. Rows that repeat a key are told apart by a number that their text
gives them; equal rows share their fate. An empty table gives an empty table. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import written

WINDOW = 3


def line_hashes(lines: Column, seed: int) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.trim(x), F.lit(seed)))


def windows(rows: DataFrame, lines: str) -> DataFrame:
    """A row for each window: id, pos, h1, h2."""
    n = F.size("__l")
    spans = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))

    def hashed(col: str, seed: int) -> Column:
        return F.transform("__s", lambda i: F.xxhash64(*[F.get(F.col(col), i + d) for d in range(WINDOW)], F.lit(seed)))

    rows = rows.select("__id", F.col(lines).alias("__l")).select("__id", "__l", spans.alias("__s"))
    rows = rows.select("__id", "__s", line_hashes(F.col("__l"), 1).alias("__a"), line_hashes(F.col("__l"), 2).alias("__b"), F.transform("__l", lambda x: (F.trim(x) == "").cast("int")).alias("__e"))
    filled = F.transform("__s", lambda i: F.get(F.col("__e"), i) + F.get(F.col("__e"), i + 1) + F.get(F.col("__e"), i + 2) < WINDOW)
    packed = F.arrays_zip(hashed("__a", 11).alias("h1"), hashed("__b", 12).alias("h2"), filled.alias("f"))
    return rows.select("__id", F.posexplode(packed).alias("pos", "w")).filter("w.f").select("__id", "pos", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))


def added(docs: DataFrame) -> tuple[str, str, str]:
    """The names of the columns that line_dedup adds to docs: the text's lines, the sorted positions of the removed ones, and what is left. They don't clash with those of docs."""
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return f"{mark}lines", f"{mark}gone", f"{mark}text"


#: A window is hot if this many would make up all windows: hot ones are so few that their first places are broadcast.
HOT_SHARE, LEAST_HOT = 10_000, 1_000


def later_places(found: DataFrame) -> DataFrame:
    """__id, pos of the windows that occurred before. The windows of most rows meet their first places without a shuffle, so no task holds all rows of a common passage."""
    first = written(found.groupBy("h1", "h2").agg(F.min(F.struct("__id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    bar = max(LEAST_HOT, found.count() // HOT_SHARE)
    hot, cold = F.broadcast(first.filter(F.col("n") > bar).drop("n")), first.filter(F.col("n") <= bar).drop("n")
    rest = found.join(F.broadcast(first.filter(F.col("n") > bar).select("h1", "h2")), ["h1", "h2"], "left_anti")
    met = found.join(hot, ["h1", "h2"]).unionByName(rest.join(cold, ["h1", "h2"]))
    return met.filter(F.struct("__id", "pos") > F.col("first")).select("__id", "pos")


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the three columns that added() names; the columns of docs stay, whatever their names."""
    lines, gone, left = added(docs)
    rows = docs.withColumn(lines, F.split(F.col(text), "\n", -1))
    # the same key with different texts: both are part of the identity
    identity = F.struct(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"))
    found = written(windows(rows.select(identity.alias("__id"), F.col(lines).alias("__lines")), "__lines"))
    removed = later_places(found).select("__id", F.explode(F.sequence(F.col("pos"), F.col("pos") + WINDOW - 1)).alias("p")).groupBy("__id").agg(F.sort_array(F.collect_set("p")).alias("__p"))
    # one struct carries the columns of docs, so that none of theirs can clash with one of the join's
    packed = rows.select(identity.alias("__id"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    out = packed.join(removed, "__id", "left").select("__row.*", F.coalesce("__p", F.array().cast("array<int>")).alias(gone))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(F.col(lines), i))
    return out.withColumn(left, F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))


ORACLE = """
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
spans AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 0))) AS pos FROM lines),
wins AS (SELECT doc_id, pos, trim(l[pos + 1], ' ') AS a, trim(l[pos + 2], ' ') AS b, trim(l[pos + 3], ' ') AS c FROM spans),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS r FROM wins WHERE a <> '' OR b <> '' OR c <> ''),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(pos, pos + 3)) AS p FROM ranked WHERE r > 1)),
each AS (SELECT doc_id, l[p + 1] AS line, p FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS p FROM lines)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.l) AS n_lines, coalesce(g.n, 0) AS n_removed, CASE WHEN g.n > 0 THEN coalesce(k.text, '') ELSE d.text END AS text
FROM lines d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
