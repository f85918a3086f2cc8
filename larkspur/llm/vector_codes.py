"""Vector code compression (operator 12): product codes by weighted Lloyd over distinct parts.

A component x becomes the integer floor(SCALE x); a vector's integers are cut into PARTS consecutive parts. Equal parts of a
position are reduced to one weighted row first (combined before the shuffle), and every round of Lloyd reads these rows only: a task
returns the sums and counts of its rows by codebook entry, so a round moves PARTS x ENTRIES rows a task, and the driver keeps nothing
but the codebooks. All arithmetic is in integers: results don't depend on the order of rows. Codes and errors of the distinct
parts are then joined back to the vectors; the parts that make up more than one in HOT_SHARE of all are so few that
they are broadcast, so that no task gets all copies of a common vector.

Null vectors and those that hold null or non-finite components are dropped. Codebooks start from the ENTRIES smallest kept keys (null keys
last, ties by components); with fewer vectors there are fewer entries. One length is coded, that of the vector with the smallest key:
vectors of other lengths are kept without code and error, and don't count in label_error. A length that PARTS doesn't divide is cut as
equally as can be; empty vectors have empty parts, at distance 0. Components beyond LARGEST after scaling are held at it, so
that no sum of squares overflows. Rows that repeat a key are coded each; equal rows come back as often as they were given.
Null labels are one label. An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import prepare, release
from larkspur.session import sized_broadcast, written

PARTS, ENTRIES, ROUNDS, SCALE, LARGEST = 8, 16, 6, 4096, 1 << 24
#: A part is hot if this many would make up all parts, and LEAST_HOT vectors at least share it.
HOT_SHARE, LEAST_HOT = 10_000, 1_000
#: So many parts are held against a codebook at once.
BLOCK = 4096


def finite(vector: str) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def integers(vector: str) -> Column:
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return F.coalesce(scaled, F.array().cast("array<int>"))


def bounds(length: int) -> list[tuple[int, int]]:
    """Start and end of each part of a vector."""
    return [(p * length // PARTS, (p + 1) * length // PARTS) for p in range(PARTS)]


def parts_of(rows: DataFrame, length: int) -> DataFrame:
    """rows without __x, once for each part: p and v."""
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.slice("__x", a + 1, b - a).alias("v")) for p, (a, b) in enumerate(bounds(length))])
    return rows.select(*[c for c in rows.columns if c != "__x"], F.inline(each))


@dataclass
class Codebooks:
    """The entries of each part position, as rows of integers."""

    length: int
    entries: list[np.ndarray]

    def nearest(self, p: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry with the least squared distance (the first of several) and that distance."""
        book, codes, errors = self.entries[p], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(parts), BLOCK):
            square = ((parts[a : a + BLOCK, None, :] - book[None]) ** 2).sum(2)
            codes.append(square.argmin(1))
            errors.append(square.min(1))
        return np.concatenate(codes), np.concatenate(errors)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book.tolist() for x in entry).encode()).hexdigest()

    def positions(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of a batch with columns p and v: each position, its rows, and their parts."""
        p, values, ends = batch.column("p").to_numpy(), batch.column("v").flatten().to_numpy().astype(np.int64), batch.column("v").value_lengths().to_numpy().cumsum()
        for k in np.unique(p).tolist():
            at, width = np.flatnonzero(p == k), self.entries[k].shape[1]
            yield k, at, values[(ends[at] - width)[:, None] + np.arange(width)]


def code(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """p, v, n with the code and the error of each distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for p, at, parts in books.positions(b):
                codes[at], errors[at] = books.nearest(p, parts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes), pa.array(errors)], ["p", "v", "n", "code", "error"])
        release()

    return distinct.select("p", "v", "n").mapInArrow(run, "p int, v array<int>, n long, code int, error long")


def next_books(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floors of the means of the parts that are nearest to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last place of a row of sums is the count
        sums = [np.zeros((len(e), e.shape[1] + 1), np.int64) for e in books.entries]
        for b in batches:
            n = b.column("n").to_numpy()
            for p, at, parts in books.positions(b):
                weight = n[at, None]
                np.add.at(sums[p], books.nearest(p, parts)[0], np.concatenate([parts * weight, weight], axis=1))
        used = [(p, k, row) for p, s in enumerate(sums) for k, row in enumerate(s.tolist()) if row[-1]]
        yield pa.RecordBatch.from_arrays([pa.array([u[i] for u in used], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["p", "k", "sums"])
        release()

    found = distinct.select("p", "v", "n").mapInArrow(run, "p int, k int, sums array<long>").select("p", "k", F.posexplode("sums").alias("i", "s"))
    entries = [e.copy() for e in books.entries]
    sums = [np.zeros((len(e), e.shape[1] + 1), np.int64) for e in entries]
    for r in found.groupBy("p", "k", "i").agg(F.sum("s").alias("s")).collect():  # as many as the codebooks have components and entries
        sums[r.p][r.k, r.i] = r.s
    for e, s in zip(entries, sums, strict=True):
        taken = s[:, -1] > 0
        e[taken] = s[taken, :-1] // s[taken, -1:]
    return Codebooks(books.length, entries)


def first_books(rows: DataFrame) -> Codebooks | None:
    """From the ENTRIES smallest keys of rows (__key, __x); None if there are no rows."""
    order = (F.col("__key").asc_nulls_last(), "__x")
    first = rows.orderBy(*order).select("__x").first()
    if first is None:
        return None
    length = len(first[0])
    start = [r[0] for r in rows.filter(F.size("__x") == length).orderBy(*order).limit(ENTRIES).select("__x").collect()]
    return Codebooks(length, [np.array([x[a:b] for x in start], np.int64).reshape(len(start), b - a) for a, b in bounds(length)])


def joined(parts: DataFrame, coded: DataFrame, hot: Column) -> DataFrame:
    """parts with code and error; only the parts of which hot doesn't hold are shuffled."""
    few, rest = F.broadcast(coded.filter(hot).select("p", "v", "code", "error")), coded.filter(~hot).select("p", "v", "code", "error")
    cold = parts.join(F.broadcast(coded.filter(hot).select("p", "v")), ["p", "v"], "left_anti")
    return parts.join(few, ["p", "v"]).unionByName(cold.join(rest, ["p", "v"]))


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """A row for each kept vector (__key, __label, __codes: an entry a part, __error), and the codebooks."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.filter(finite(vector)).select(F.col(key).alias("__key"), F.col(label).alias("__label"), integers(vector).alias("__x"))
    rows = rows.withColumn("__copy", F.xxhash64("__x"))
    books = first_books(rows)
    if books is None:
        return rows.select("__key", "__label", F.lit(None).cast("array<int>").alias("__codes"), F.lit(None).cast("long").alias("__error")), None
    parts = parts_of(rows.filter(F.size("__x") == books.length), books.length)
    distinct = written(parts.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(ROUNDS):
        books = next_books(distinct, books)
    coded = written(code(distinct, books))
    bar = max(LEAST_HOT, coded.agg(F.sum("n")).first()[0] // HOT_SHARE)
    # rows that are equal give equal parts: each of the PARTS triples comes as often as the row
    whole = joined(parts, coded, F.col("n") > bar).groupBy("__key", "__label", "__copy").agg(F.sort_array(F.collect_set(F.struct("p", "code", "error"))).alias("__t"), (F.count(F.lit(1)) / PARTS).cast("int").alias("__m"))
    whole = whole.select("__key", "__label", F.col("__t.code").alias("__codes"), F.aggregate("__t.error", F.lit(0).cast("long"), lambda a, x: a + x).alias("__error"), F.explode(F.array_repeat(F.lit(1), F.col("__m"))).alias("__one")).drop("__one")
    other = rows.filter(F.size("__x") != books.length).select("__key", "__label", F.lit(None).cast("array<int>").alias("__codes"), F.lit(None).cast("long").alias("__error"))
    return whole.unionByName(other), books


def digest(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """key, code (two hex digits a part), error, label_error, codebooks_sha256, label."""
    rows, books = compress(vectors, vector, key, label)
    rows = written(rows)
    sums = rows.groupBy("__label").agg(F.sum("__error").alias("__sum")).withColumnRenamed("__label", "__l")
    hexed = F.array_join(F.transform("__codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = rows.join(sized_broadcast(sums), F.col("__label").eqNullSafe(F.col("__l")))
    return out.select(F.col("__key").alias(key), hexed.alias("code"), F.col("__error").alias("error"), F.col("__sum").alias("label_error"), F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"), F.col("__label").alias(label))


def oracle() -> str:
    """The same by plain assignment of every vector's part in every round, for vectors of one length that PARTS divides."""
    steps = [
        f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS v FROM kept, range({PARTS}) AS t(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))"""
    ]
    square = "list_inner_product(a.v::DOUBLE[], a.v::DOUBLE[]) - 2 * list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[]) + list_inner_product(b.v::DOUBLE[], b.v::DOUBLE[])"
    for r in range(ROUNDS + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT a.vec_id, p, any_value(a.v) AS v, min({{'d': CAST({square} AS BIGINT), 'k': b.k}}) AS m FROM part a JOIN book{r} b USING (p) GROUP BY a.vec_id, p)")
        if r < ROUNDS:
            steps.append(f"""mean{r} AS (SELECT p, k, list(m ORDER BY i) AS v FROM (
  SELECT p, m.k AS k, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM near{r}, range(1, len(v) + 1) AS t(i) GROUP BY p, m.k, i) GROUP BY p, k),
book{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} n USING (p, k))""")
    return ",\n".join(steps) + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM book{ROUNDS}) AS codebooks_sha256, label
FROM coded JOIN kept USING (vec_id)"""


ORACLE = oracle()
