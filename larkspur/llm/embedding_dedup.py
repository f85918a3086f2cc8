"""Embedding near-dedup (operator 2): randomised-rotation binary codes with bounds.

Vectors of one label are compared by cosine. A random orthogonal rotation (of the vector, repeated in as many rotated
blocks as give the bits wanted) turns each unit vector x into the signs of its coordinates; x' is the unit vector of these
signs. With the stored correction factor f = <x', x>, <x', y> / f estimates <x, y> without bias. x' = f x + sqrt(1 - f^2) e
with e at right angles to x, so the estimate is off by at most sqrt(1 - f^2) / f * sqrt(1 - <x, y>^2): a bound that
holds for every pair. Pairs that cannot reach the threshold by it are rejected by their codes; the others are
recomputed exactly, in double precision. No pair is left out by chance.

Labels of over a chunk of vectors are cut into chunks by hash, and each pair of chunks is a group of its own: no group
holds more than two chunks (whatever exceeds a chunk by chance stays in it), and every pair of a label meets in exactly
one. This grows with the square of a label's distinct vectors, as an exact answer at any dimension does, but in equal groups over all tasks. A group returns,
for a vector, its number of links and the least vector of its connected part of the group, so that links are counted
and components found without listing pairs. Groups lie sorted in their partitions, and all groups that end in a batch
are compared at once.

Vectors of equal components are reduced to one with a weight first. Null labels, null or empty vectors, vectors of zeros, and
vectors with null or non-finite components link with nothing. Labels compare vectors of one length only. vec_id is unique;
equal rows count as vectors that link with each other (different vectors under one id are outside the contract). An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import prepare
from larkspur.llm.components import components
from larkspur.session import sized_broadcast, written

THRESHOLD, BITS, CHUNK, SEED = 0.98, 64, 1024, 20_240_501
#: Chunks of large labels grow up to so many vectors: a vector is sent to as many groups as its label has chunks.
MOST = 8192


def table_shape(largest: int) -> tuple[int, int]:
    """(bits of a code, vectors of a chunk) for labels of up to so many vectors."""
    return BITS, min(MOST, max(CHUNK, largest // 16))


@dataclass
class Rotation:
    """Rotations of one length of vectors, made from SEED alone: every task makes the same."""

    length: int
    shape: tuple[int, int]

    def __post_init__(self) -> None:
        rng = np.random.default_rng([SEED, self.length])
        self.blocks = [np.linalg.qr(rng.standard_normal((self.length, self.length)))[0] for _ in range(max(1, -(-self.shape[0] // self.length)))]

    def turned(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ b for b in self.blocks], axis=1) / np.sqrt(len(self.blocks))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; divided by their largest magnitude first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, initial=0)[:, None]
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


class Codes:
    """Unit vectors of one length with their binary codes: signs of length 1, correction factors, and how far an estimate may be off for a pair at right angles."""

    def __init__(self, x: np.ndarray, r: Rotation) -> None:
        turned = r.turned(x)
        self.x, self.turned = x, turned.astype(np.float32)
        bits = turned.shape[1]
        self.signs = np.where(turned >= 0, 1, -1).astype(np.float32) / np.float32(np.sqrt(bits))
        self.factor = np.abs(turned).sum(1) / np.sqrt(bits)
        across = np.sqrt(np.maximum(0, 1 - self.factor**2))
        lost = 1e-6 + bits * 2.0**-22  # what products in single precision may lose
        self.error = (across + lost) / self.factor
        # f c - sqrt(1 - f^2) sqrt(1 - c^2) grows with c: no pair at the threshold or nearer has a product <x', y> below this
        self.floor = (THRESHOLD * self.factor - across * math.sqrt(1 - THRESHOLD**2) - lost).astype(np.float32)

    def block(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of left and right that the bounds don't reject."""
        i, j = np.nonzero(self.signs[left] @ self.turned[right].T >= self.floor[left, None])
        return left[i], right[j]

    def listed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (i, j) that the bounds don't reject."""
        keep = np.einsum("ij,ij->i", self.signs[i], self.turned[j]) >= self.floor[i]
        return i[keep], j[keep]

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", self.x[i[a : a + 65_536]], self.x[j[a : a + 65_536]]) >= THRESHOLD for a in range(0, len(i), 65_536))])


def within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside small runs: the first of each pair with all behind it in the run."""
    at = np.concatenate([np.zeros(0, int), *(s + np.arange(n) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True))])
    behind = np.repeat(starts + sizes, sizes) - at - 1
    i = np.repeat(at, behind)
    first = np.repeat(np.r_[0, np.cumsum(behind)[:-1]], behind) if len(behind) else np.zeros(0, int)
    return i, i + 1 + np.arange(len(i)) - first


#: Runs of more vectors are compared as matrices.
SMALL_RUN = 48


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (the least place of each place's part) after the links (i, j)."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def compare(rows: dict[str, np.ndarray], vectors: np.ndarray, r: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole groups (runs of equal g, lo and hi, sorted): the vectors that link, by how much weight, and the least vector that each reaches by links of its group."""
    c = Codes(unit(vectors), r)
    rep, weight, chunk = rows["rep"], rows["w"], rows["c"]
    key = np.stack([rows[k] for k in ("g", "lo", "hi")])
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
    sizes = np.diff(np.r_[starts, len(rep)])
    small = (sizes <= SMALL_RUN) & (rows["lo"][starts] == rows["hi"][starts])
    count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        if len(i):
            hit = c.exact(i, j)
            i, j = i[hit], j[hit]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            root = united(root, i, j)

    add(*c.listed(*within(starts[small], sizes[small])))
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        lo, hi = rows["lo"][s], rows["hi"][s]
        left, right = (s + np.flatnonzero(chunk[s : s + n] == x) for x in (lo, hi))
        for a in range(0, len(left), CHUNK):
            # within a chunk a block meets itself and those behind it
            for b in range(a if lo == hi else 0, len(right), CHUNK):
                i, j = c.block(left[a : a + CHUNK], right[b : b + CHUNK])
                add(*((i[i < j], j[i < j]) if lo == hi else (i, j)))
    least = rep.copy()
    np.minimum.at(least, root, rep)
    hit = count > 0
    return rep[hit], count[hit], least[root][hit]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id and kept of each vector."""
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(embedding)
    fine = F.col(label).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(label).cast("string").alias("l"), F.when(fine, F.transform(v, lambda e: F.when(e == 0, F.lit(0).cast("float")).otherwise(e))).alias("v"))
    rows = written(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws("|", "l", F.col("v").cast("string")), 256))))
    reps = written(rows.filter("v is not null").groupBy("h").agg(F.min("k").alias("rep"), F.count("*").alias("w"), F.first("l").alias("l"), F.first("v").alias("v")).withColumn("g", F.xxhash64("l", F.size("v"))))
    sizes = written(reps.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"))
    shape = table_shape(sizes.agg(F.max("m")).first()[0] or 0)
    there = reps.select("g", "rep", "w", "v").join(sized_broadcast(sizes), "g").withColumn("chunks", F.ceil(F.col("m") / shape[1]).cast("int"))
    there = there.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # a chunk meets itself and every other chunk of its label once
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("lo"), F.greatest(F.col("c"), o).alias("hi")))
    there = there.withColumn("p", F.explode(pairs)).select("g", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), "c", "rep", "w", "v")
    bucket = ["g", "lo", "hi"]
    sorted_rows = there.repartition(*bucket).sortWithinPartitions(*bucket)
    names = bucket + ["c", "rep", "w"]

    def scan(batches):
        known: dict[int, Rotation] = {}
        held: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            cols = {n: t.column(n).to_numpy() for n in names}
            lists = t.column("v").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            size = lists.value_lengths().to_numpy()
            flat, first = lists.flatten().to_numpy().astype(np.float64), np.r_[0, np.cumsum(size)]
            parts = []
            for d in np.unique(size).tolist():
                known[d] = known.get(d) or Rotation(d, shape)
                at = np.flatnonzero(size == d)
                parts.append(compare({n: c[at] for n, c in cols.items()}, flat[first[at][:, None] + np.arange(d)], known[d]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], ["rep", "n", "least"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            last = np.stack([held.column(n).to_numpy() for n in bucket])
            ends = np.flatnonzero((last[:, 1:] != last[:, :-1]).any(0))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    found = written(sorted_rows.mapInArrow(scan, "rep long, n long, least long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    final = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    out = rows.drop("v").join(reps.select("h", "rep", "w"), "h", "left").join(counts, "rep", "left").join(final, F.col("rep") == F.col("node"), "left")
    links = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.col("w") - 1 + F.coalesce("n", F.lit(0))).cast("long")
    comp = F.coalesce("component", "rep", "k")
    return out.select(F.col("k").alias(key), links.alias("n_links"), comp.alias("component_id"), (F.col("k") == comp).alias("kept"))
