"""Quality (operator 11): nearest-neighbour voting among labelled vectors of a latent semantic space.

Terms of a text are its words in lower case, the shapes of its words as written (runs of small letters, capitals, digits and other letters
by a sign each, all other characters as they are), pairs of consecutive shapes, and a term for every tenth of the words that repeat the word before them.
They are hashed into TERMS buckets, so no word of any text is left out and the space is bounded. A bucket weighs
(1 + ln tf) ln((1 + documents) / (1 + df)), with df counted over all documents. The latent space is spanned by the RANK largest
singular vectors of the labelled sample: up to SAMPLE rows of each class in hash order and up to SAMPLE_BYTES of their text (documented
bounds; all rows where there are fewer).

The labelled vectors are broadcast (2 x SAMPLE x RANK numbers at most). Every document is projected, scaled to unit length and rounded to
multiples of 1 / SCALE; cosine products with all labelled vectors are taken in blocks, in integers that double precision holds exactly, so a
text scores alike whatever texts share its batch. The K nearest (and all as near as the K-th) vote with their cosines to the power of SHARP, each class
weighed by its share among the labels over that in the sample, with a prior vote of PRIOR. Votes are calibrated by isotonic regression on
the examples themselves, each left out of its own vote.

Null and empty texts, and those without words, have no neighbours: their score is the calibrated prior vote. Without labels, or with one
class only, every score is the rate of the label 1 (0 without labels). Texts count whole, whatever their length. Repeated rows
are scored alike. Repeated labels of a key count once, as the largest; of repeated rows of a key the least text is learned from. Null labels
are no labels. An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import crc_of_id, map_rows, prepare, release
from larkspur.llm.toxicity import isotonic
from larkspur.session import written

TERMS, RANK, SAMPLE, SAMPLE_BYTES, K, SHARP, PRIOR = 4096, 64, 1500, 32 << 20, 25, 4, 0.5
SCALE = float(1 << 20)
#: So many words are counted, and so many texts are held against the examples, at once.
WORDS, TEXTS = 1 << 19, 512
#: Signs of shapes.
SHAPES = ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{L}+", "x"), (r"\p{N}+", "0"))
MIX = np.uint64(0x9E3779B97F4A7C15)

Bags = tuple[np.ndarray, np.ndarray, np.ndarray]


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), hash_key=f"{seed:016d}", categorize=False)


def bucket(h: np.ndarray) -> np.ndarray:
    """Of 64-bit hashes, by multiplication: consecutive hashes don't share one."""
    return ((h * MIX) >> np.uint64(40)).astype(np.int64) % TERMS


def bags(texts: pa.Array) -> Bags:
    """(ptr, ids, tf): text k holds buckets ids[ptr[k] : ptr[k + 1]], each tf times."""
    n = len(texts)
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends, words = split.offsets.to_numpy(), split.values
    own = np.repeat(np.arange(n), np.diff(ends))
    words = words.slice(ends[0], ends[-1] - ends[0])
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    repeats, counted = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(0, len(words), WORDS):
        # one word more, for the pair that starts at the last
        part = words.slice(a, WORDS + 1).dictionary_encode()
        at, distinct = part.indices.to_numpy(), part.dictionary
        shapes = distinct
        for pattern, sign in SHAPES:
            shapes = pc.replace_substring_regex(shapes, pattern, sign)
        word, shape, text = hashes(pc.utf8_lower(distinct), 1)[at], hashes(shapes, 2)[at], own[a : a + WORDS + 1]
        filled = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)[at]
        pair = (text[1:] == text[:-1]) & filled[1:] & filled[:-1]
        repeats += np.bincount(text[:-1][pair & (at[1:] == at[:-1])], minlength=n)
        here = slice(0, min(WORDS, len(text)))
        found = [
            text[here][filled[here]] * TERMS + bucket(word[here][filled[here]]),
            text[here][filled[here]] * TERMS + bucket(shape[here][filled[here]]),
            text[:-1][pair] * TERMS + bucket(shape[:-1][pair] * np.uint64(31) + shape[1:][pair]),
        ]
        counted += np.bincount(text[here][filled[here]], minlength=n)
        k, t = np.unique(np.concatenate(found), return_counts=True)
        keys.append(k)
        times.append(t)
    tenths = 10 * repeats // np.maximum(counted, 1)
    marks = bucket(np.arange(1, 11, dtype=np.uint64))
    keys.append(np.repeat(np.arange(n), tenths) * TERMS + np.concatenate([marks[:0], *(marks[:k] for k in tenths[tenths > 0])]))
    times.append(np.ones(len(keys[-1]), np.int64))
    # a text may go on in the next round of words
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.bincount(back, weights=np.concatenate(times)).astype(np.int64)
    return np.searchsorted(key, np.arange(n + 1) * TERMS), key % TERMS, tf


def rows_of(found: Bags) -> np.ndarray:
    """The text of each entry."""
    return np.repeat(np.arange(len(found[0]) - 1), np.diff(found[0]))


def span(matrix: np.ndarray, rank: int) -> np.ndarray:
    """The largest right singular vectors of a matrix, as columns: power iterations from a fixed start."""
    rank = min(rank, *matrix.shape)
    q = np.random.default_rng(20_240_501).standard_normal((matrix.shape[1], min(rank + 16, *matrix.shape)))
    for _ in range(6):
        q = np.linalg.qr(matrix.T @ (matrix @ q))[0]
    return q @ np.linalg.svd(matrix @ q, full_matrices=False)[2].T[:, :rank]


@dataclass
class Model:
    """Weights of the buckets, the latent space, the examples' vectors (integers, in double precision) with their keys and labels, and the calibration."""

    rate: float
    weight: np.ndarray | None = None
    space: np.ndarray | None = None
    vectors: np.ndarray | None = None
    keys: np.ndarray | None = None
    labels: np.ndarray | None = None
    share: np.ndarray | None = None  # of each class among all labels over its share in the sample
    x: np.ndarray | None = None
    y: np.ndarray | None = None

    def weights(self, found: Bags) -> np.ndarray:
        return (1 + np.log(found[2])) * self.weight[found[1]]

    def project(self, found: Bags) -> np.ndarray:
        """Unit vectors in the latent space, in multiples of 1 / SCALE; zeros for texts without terms. A text's sum has an order of its own terms."""
        ptr, ids, _ = found
        out, w, filled = np.zeros((len(ptr) - 1, self.space.shape[1])), self.weights(found), np.flatnonzero(np.diff(ptr))
        for a in range(0, len(filled), TEXTS):
            some = filled[a : a + TEXTS]
            start, end = ptr[some[0]], ptr[some[-1] + 1]
            out[some] = np.add.reduceat(self.space[ids[start:end]] * w[start:end, None], ptr[some] - start, axis=0)
        length = np.sqrt(np.einsum("ij,ij->i", out, out))
        return np.round(out / np.where(length > 0, length, 1)[:, None] * SCALE)

    def nearest(self, texts: np.ndarray, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the K nearest examples and all as near as the last of them, by cosine above 0: examples and cosines, nearest first."""
        own, other = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (self.vectors, texts))
        for a in range(0, len(texts), TEXTS):
            dots = texts[a : a + TEXTS] @ self.vectors.T  # sums below 2^53: exact in any order
            cosine = dots / own / np.where(other[a : a + TEXTS] > 0, other[a : a + TEXTS], 1)[:, None]
            if skip is not None:
                cosine[np.arange(len(cosine)), skip[a : a + TEXTS]] = -1
            k = min(K, cosine.shape[1])
            least = np.maximum(np.partition(cosine, -k, 1)[:, -k], 1e-12)
            for row, bar in zip(cosine, least, strict=True):
                at = np.flatnonzero(row >= bar)
                at = at[np.lexsort((at, -row[at]))]
                yield at, row[at]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        y = self.labels[at]
        w = cosine**SHARP * self.share[y]
        return float(((w * y).sum() + PRIOR * self.rate) / (w.sum() + PRIOR))

    def scores(self, found: Bags) -> list[tuple[float, int, float]]:
        """Of each text the calibrated score; position and cosine of the nearest example, or -1 and 0. Votes that isotonic regression ties are told apart in the sixth decimal."""
        if self.vectors is None:
            return [(self.rate, -1, 0.0)] * (len(found[0]) - 1)
        out = []
        for at, cosine in self.nearest(self.project(found)):
            v = self.vote(at, cosine)
            p = float(np.interp(v, self.x, self.y))
            out.append((min(1.0, max(0.0, p * (1 - 1e-6) + 1e-6 * v)), int(at[0]) if len(at) else -1, float(cosine[0]) if len(at) else 0.0))
        return out


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many of all documents hold each bucket, and how many there are. Every task counts in one array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(TERMS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            seen += np.bincount(bags(b.column(0))[1], minlength=TERMS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[seen[at], rows])], ["i", "n"])
        release()

    found = docs.select(text).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df, i, n = np.zeros(TERMS), found["i"].to_numpy(), found["n"].to_numpy()
    df[i[i >= 0]] = n[i >= 0]
    return df, int(n[i < 0].sum())


def sampled(docs: DataFrame, labels: DataFrame, learns: Column, text: str, key: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """__key, __y, __t of the sample, and how many labels each class has. Only keys, lengths and labels are sorted; texts come last."""
    known = labels.filter(F.col(label).cast("int").isin(0, 1) & F.col(key).isNotNull() & learns).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    size = docs.select(F.col(key).alias("__key"), F.octet_length(text).alias("__n")).groupBy("__key").agg(F.max(F.coalesce("__n", F.lit(0))).alias("__n"))
    known = written(known.join(size, "__key"))
    totals = {int(r[0]): int(r[1]) for r in known.groupBy("__y").count().collect()}
    order = (F.xxhash64("__key"), F.col("__key"))
    chosen = known.filter("__y = 1").orderBy(*order).limit(SAMPLE).unionByName(known.filter("__y = 0").orderBy(*order).limit(SAMPLE))
    # at most SAMPLE rows of a class are left
    within = Window.partitionBy("__y").orderBy(*order)
    chosen = chosen.withColumn("__before", F.sum("__n").over(within) - F.col("__n")).filter((F.col("__before") == 0) | (F.col("__before") + F.col("__n") <= SAMPLE_BYTES))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__t")).join(F.broadcast(chosen.select("__key", "__y")), "__key")
    return written(rows.groupBy("__key", "__y").agg(F.min("__t").alias("__t"))), totals


def learn(docs: DataFrame, labels: DataFrame, learns: Column, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """The model, from docs (document frequencies) and the labelled rows for which learns, an expression over key, holds."""
    prepare(docs.sparkSession)
    sample, totals = sampled(docs, labels, learns, text, key, label)
    model = Model(totals.get(1, 0) / max(1, sum(totals.values())))
    if len(totals) < 2:
        return model
    df, count = frequencies(docs, text)

    def make() -> Callable[[pa.RecordBatch], dict]:
        def f(b: pa.RecordBatch) -> dict:
            ptr, ids, tf = bags(b.column(2))
            return {"k": b.column(0), "y": b.column(1), **{c: [v[a:z].astype("<i4").tobytes() for a, z in zip(ptr[:-1], ptr[1:], strict=True)] for c, v in (("ids", ids), ("tf", tf))}}

        return f

    kind = sample.schema["__key"].dataType.simpleString()
    # examples come packed: their number and their buckets are bounded
    rows = map_rows(sample.select("__key", "__y", "__t"), f"k {kind}, y int, ids binary, tf binary", make).toArrow().sort_by("k")
    model.keys, model.labels = np.array(rows["k"].to_pylist()), rows["y"].to_numpy()
    ids, tf = ([np.frombuffer(x.as_py(), "<i4") for x in rows[c]] for c in ("ids", "tf"))
    found = (np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64), np.concatenate(ids).astype(np.int64), np.concatenate(tf).astype(np.int64))
    model.weight = np.log((1 + count) / (1 + df))
    matrix = np.zeros((len(ids), TERMS))
    matrix[rows_of(found), found[1]] = model.weights(found)
    matrix /= np.maximum(np.sqrt(np.einsum("ij,ij->i", matrix, matrix)), 1e-300)[:, None]
    model.space = span(matrix, RANK)
    model.vectors = model.project(found)
    # examples without terms have no direction and no vote
    keep = model.vectors.any(1)
    model.vectors, model.keys, model.labels = model.vectors[keep], model.keys[keep], model.labels[keep]
    n = np.bincount(model.labels, minlength=2)
    if not n.all():
        return Model(model.rate)
    model.share = np.array([totals[0] / n[0], totals[1] / n[1]]) / (sum(totals.values()) / n.sum())
    votes = np.array([model.vote(*x) for x in model.nearest(model.vectors, np.arange(len(model.keys)))])
    model.x, model.y = isotonic(votes, model.labels.astype(float), model.share[model.labels])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k, score, nearest (an example's key or null) and cosine of each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], dict]:
        m = shared.value

        def f(b: pa.RecordBatch) -> dict:
            got = m.scores(bags(b.column(1)))
            return {"k": b.column(0), "score": [g[0] for g in got], "nearest": [None if g[1] < 0 else m.keys[g[1]].item() for g in got], "cosine": [g[2] for g in got]}

        return f

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return map_rows(rows, f"k {kind}, score double, nearest {kind}, cosine double", make)


def held_out(key: str = "doc_id") -> Column:
    return crc_of_id(key) % 3 == 1
