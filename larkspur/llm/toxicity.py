"""Toxicity (operator 3): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Learning takes labelled rows only: up to SAMPLE of each class in hash order and up to SAMPLE_BYTES of their text (documented
bounds; all rows where there are fewer). All their words, and beginnings of PREFIXES letters of longer words, are the terms: none
is left out. A term weighs (1 + ln tf) idf rf: its document frequency is counted over all documents, and the relevance rf =
log2(2 + a / max(1, c n1 / n0)), from its a of n1 toxic and c of n0 other examples, lets words count by what labels tell of them.
The examples' vectors, of unit length, are the index: posting lists by term and, for the DENSE terms with the longest lists, rows in
blocks of BLOCK examples, with the largest weight of every such term in each block. It is broadcast; the sample bounds its size.

A text's vector has the same weights and unit length over the terms of the index. Its short lists are added up; then the blocks
with the highest bounds are scored first, and of the others those whose bound reaches the K-th best cosine so far: no other can
hold one of the K nearest (examples as near as the K-th all count). The neighbours vote with their cosines, each class weighed by its
share among the labels over that in the sample, and with a prior vote of PRIOR. Votes are calibrated by isotonic regression on the
examples themselves, each left out of its own vote. The evidence is the nearest example's key and cosine.

Null and empty texts, and those without a known term, have no neighbours: their score is the calibrated prior vote.
Without labels, or with one class only, every score is the rate of toxic labels (0 without labels). Repeated rows are
scored alike. Repeated labels of a key count once, as the largest; of repeated rows of a key the least text is learned from. Null labels
are no labels. An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import crc_of_id, map_rows, prepare, release
from larkspur.session import written

SAMPLE, SAMPLE_BYTES, PREFIXES, DENSE, BLOCK, K, PRIOR = 1250, 32 << 20, (3, 4, 5, 6), 3072, 64, 15, 0.5
WORD = re.compile(r"[^\W\d_]+")
#: Bytes of UTF-8 with A-Z in lower case and a space for each ASCII character that is no letter.
GAPS = bytes(b if b > 127 else ord(chr(b).lower()) if WORD.fullmatch(chr(b)) else 32 for b in range(256))
#: White space beyond ASCII that texts hold often; the small form of capital sigma alone depends on what is around it.
WIDE, SIGMA = (b"\xc2\xa0", b"\xe3\x80\x80"), "\u03a3".encode()
#: So many texts and entries of lists are taken at once; bits for how often a word occurs in a text.
TEXTS, ENTRIES, TIMES = 256, 2_000_000, 24
#: So many blocks are visited before the others are held against the K-th best.
FIRST = 3


def terms_of(word: str) -> tuple[str, ...]:
    """A word of lower case, and its beginnings with a mark."""
    return (word, *(word[:n] + "~" for n in PREFIXES if len(word) > n))


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(ptr, codes, found): text k, cut at ASCII characters that are no letters and at white space, has the chunks found[c] for c of codes[ptr[k] : ptr[k + 1]].

    No word is cut; chunks are in lower case, and equal ones have one code but for letters beyond ASCII in both cases. All texts are cut at once as one run of bytes.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), []
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b""
    if SIGMA in data:
        return chunks(pa.array([t.decode().lower() for t in texts.to_pylist()], pa.large_string()))
    data = data.translate(GAPS)
    for gap in WIDE:
        data = data.replace(gap, b" " * len(gap))
    held = np.frombuffer(data, np.uint8) != 32
    rows = offsets - offsets[0]
    starts = held.copy()
    starts[1:] &= ~held[:-1]
    first = rows[rows < len(held)]
    starts[first] = held[first]
    ends = held.copy()
    ends[:-1] &= ~held[1:] | starts[1:]
    starts = np.flatnonzero(starts)
    at = np.r_[0, np.cumsum(np.flatnonzero(ends) + 1 - starts)]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data.translate(None, b" "))]).dictionary_encode()
    if not len(starts):
        return np.zeros(len(rows), np.int64), np.zeros(0, np.int64), []
    found = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(b" ", pa.large_binary()))[0].as_py()
    return np.searchsorted(starts, rows), coded.indices.to_numpy(), found.decode().lower().split(" ")


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


class Bag:
    """Counts of the vocabulary's terms in texts."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.size = len(vocabulary)
        begins = np.array([len(t) - 1 if t.endswith("~") else 0 for t in vocabulary], np.int64)
        # the words, then the beginnings of each length: numbers of these terms, and the terms without their mark
        self.sets = []
        for n in (0, *PREFIXES):
            at = np.flatnonzero(begins == n)
            self.sets.append((n, at, pa.array([vocabulary[i][: n or None] for i in at], pa.string())))

    def terms(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, terms): chunk c holds terms[ends[c] : ends[c + 1]]. A chunk's words are searched for once; all words are looked up at once."""
        words = list(map(WORD.findall, found))
        size = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        flat = pa.array(itertools.chain.from_iterable(words), pa.string(), size=int(size[-1]))
        ids, letters = np.full((len(flat), len(self.sets)), -1, np.int32), pc.utf8_length(flat).to_numpy()
        for k, (n, at, held) in enumerate(self.sets):
            got = pc.index_in(pc.utf8_slice_codeunits(flat, 0, n) if n else flat, held).fill_null(-1).to_numpy()
            hit = (got >= 0) & (letters > n)
            ids[hit, k] = at[got[hit]]
        known = ids >= 0
        return np.r_[0, np.cumsum(known.sum(1))][size], ids[known]

    def found(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Text times the vocabulary's size plus term, and how often: for each term of each distinct chunk of each text."""
        ptr, codes, found = chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        key = np.sort(np.repeat(np.arange(len(ptr) - 1) * len(found), np.diff(ptr)) + codes)
        starts = runs(key)
        times, key = np.diff(np.r_[starts, len(key)]), key[starts]
        text, chunk = np.divmod(key, max(1, len(found)))
        ends, terms = self.terms(found)
        n = ends[chunk + 1] - ends[chunk]
        at = np.repeat(ends[chunk] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(text * self.size, n) + terms[at], np.repeat(times, n)

    def held(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """How many of the texts hold each term."""
        key = self.found(texts)[0]
        key = np.sort(key.astype(np.int32) if len(texts) * self.size < 1 << 31 else key)
        return np.bincount(key[runs(key)] % max(1, self.size), minlength=self.size)

    def __call__(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ptr, ids, tf): text k holds terms ids[ptr[k] : ptr[k + 1]], each tf times."""
        key, times = self.found(texts)
        # sorted numbers of text, term and times in one; longer counts than TIMES bits hold are written as the most they hold
        key = np.sort(key << TIMES | np.minimum(times, (1 << TIMES) - 1))
        tf, key = key & ((1 << TIMES) - 1), key >> TIMES
        starts = runs(key)
        key = key[starts]
        return np.searchsorted(key, np.arange(len(texts) + 1) * self.size), (key % max(1, self.size)).astype(np.int32), np.add.reduceat(tf, starts) if len(starts) else tf


@dataclass
class Vectors:
    """Sparse rows of unit length: row k has terms ids[ptr[k] : ptr[k + 1]] with weights w."""

    ptr: np.ndarray
    ids: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, bags: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray) -> Vectors:
        """From the terms of each row and how often each occurs."""
        ptr, ids, tf = bags
        w = (1 + np.log(tf)) * weight[ids]
        own = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        return cls(ptr, ids, w / np.sqrt(np.bincount(own, weights=w**2, minlength=len(ptr) - 1))[own])

    def own(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def part(self, a: int, b: int) -> Vectors:
        return Vectors(self.ptr[a : b + 1] - self.ptr[a], self.ids[self.ptr[a] : self.ptr[b]], self.w[self.ptr[a] : self.ptr[b]])


class Index:
    """Examples in blocks of BLOCK: rows of the terms with the longest lists, their largest weight by block, and the lists of the others."""

    def __init__(self, vectors: Vectors, terms: int) -> None:
        self.count = len(vectors.ptr) - 1
        self.blocks = max(1, -(-self.count // BLOCK))
        held = np.bincount(vectors.ids, minlength=terms)
        longest = np.argsort(-held, kind="stable")[:DENSE]
        self.row = np.full(terms, -1)
        self.row[longest] = np.arange(len(longest))
        own, row = vectors.own(), self.row[vectors.ids]
        self.dense = np.zeros((self.blocks * BLOCK, len(longest)), np.float32)
        self.dense[own[row >= 0], row[row >= 0]] = vectors.w[row >= 0]
        self.largest = self.dense.reshape(self.blocks, BLOCK, len(longest)).max(1)
        listed = np.flatnonzero(row < 0)
        listed = listed[np.argsort(vectors.ids[listed], kind="stable")]
        self.starts = np.searchsorted(vectors.ids[listed], np.arange(terms + 1))
        self.examples, self.weights = own[listed].astype(np.int32), vectors.w[listed]

    def nearest(self, texts: Vectors, skip: np.ndarray | None = None, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the k nearest examples and all as near as the last of them, by exact cosine above 0: examples and cosines, nearest first."""
        lists = np.where(self.row[texts.ids] < 0, self.starts[texts.ids + 1] - self.starts[texts.ids], 0)
        total, a = np.r_[0, np.cumsum(lists)][texts.ptr], 0
        while a < len(texts.ptr) - 1:
            b = max(a + 1, min(a + TEXTS, int(np.searchsorted(total, total[a] + ENTRIES, "right")) - 1))
            yield from self.some(texts.part(a, b), None if skip is None else skip[a:b], k)
            a = b

    def some(self, texts: Vectors, skip: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, width, own = len(texts.ptr) - 1, self.blocks * BLOCK, texts.own()
        row = self.row[texts.ids]
        q = np.zeros((n, self.dense.shape[1]))
        q[own[row >= 0], row[row >= 0]] = texts.w[row >= 0]
        # the lists of all texts, one behind the other
        ids, of, w = texts.ids[row < 0], own[row < 0], texts.w[row < 0]
        size = self.starts[ids + 1] - self.starts[ids]
        at = np.repeat(self.starts[ids] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(ids) else np.zeros(0, int)
        listed = np.bincount(np.repeat(of * width, size) + self.examples[at], weights=np.repeat(w, size) * self.weights[at], minlength=n * width).astype(float, copy=False).reshape(n, width)
        if skip is not None:
            listed[np.arange(n), skip] = -np.inf
        narrow = q.astype(np.float32)
        bound = narrow @ self.largest.T + listed.reshape(n, self.blocks, BLOCK).max(2) + 1e-5
        score = np.full((n, width), -np.inf)

        def visit(todo: np.ndarray) -> np.ndarray:
            if 2 * todo.sum() > todo.size:  # most blocks of most texts: all at once
                score[:] = narrow @ self.dense.T + listed
            for b in [] if 2 * todo.sum() > todo.size else np.flatnonzero(todo.any(0)).tolist():
                i, s = np.flatnonzero(todo[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                score[i, s] = narrow[i] @ self.dense[s].T + listed[i, s]
            return np.partition(score, -k, 1)[:, -k] if width >= k else np.full(n, -np.inf)

        first = np.zeros((n, self.blocks), bool)
        first[np.arange(n)[:, None], np.argsort(-bound, 1, kind="stable")[:, :FIRST]] = True
        least = visit(first)
        least = visit(~first & (bound >= least[:, None] - 1e-5))
        # what single precision can't tell from the K-th is computed again
        i, e = np.nonzero((score >= least[:, None] - 1e-5) & (score > 1e-9))
        exact = score[i, e]
        close = np.flatnonzero(exact <= least[i] + 1e-5)
        for a in range(0, len(close), 1024):
            x, y = i[close[a : a + 1024]], e[close[a : a + 1024]]
            exact[close[a : a + 1024]] = np.einsum("ij,ij->i", q[x], self.dense[y]) + listed[x, y]
        exact = np.round(exact, 7)
        cuts = np.searchsorted(i, np.arange(1, n))
        for d, s in zip(np.split(e, cuts), np.split(exact, cuts), strict=True):
            keep = s >= (np.partition(s, -k)[-k] if len(s) >= k else 0.0)
            order = np.lexsort((d[keep], -s[keep]))
            yield d[keep][order], s[keep][order]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: upper ends of the pools and their rising values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b * c
            pools[-1][1] += c
        else:
            pools.append([b * c, c, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    """The vocabulary with its weights, the index with its examples' keys and labels, and the calibration."""

    rate: float
    vocabulary: list[str]
    weight: np.ndarray
    index: Index | None = None
    keys: np.ndarray | None = None
    labels: np.ndarray | None = None
    share: np.ndarray | None = None  # of each class among all labels over its share in the sample
    x: np.ndarray | None = None
    y: np.ndarray | None = None

    def vote(self, d: np.ndarray, s: np.ndarray) -> float:
        y = self.labels[d]
        w = s * self.share[y]
        return float(((w * y).sum() + PRIOR * self.rate) / (w.sum() + PRIOR))

    def scores(self, bags: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[float, int, float]]:
        """Of each text the calibrated score; position and cosine of the nearest example, or -1 and 0. Votes that isotonic regression ties are told apart in the sixth decimal."""
        if self.index is None:
            return [(self.rate, -1, 0.0)] * (len(bags[0]) - 1)
        out = []
        for d, s in self.index.nearest(Vectors.of(bags, self.weight)):
            v = self.vote(d, s)
            p = float(np.interp(v, self.x, self.y))
            out.append((min(1.0, max(0.0, p * (1 - 1e-6) + 1e-6 * v)), int(d[0]) if len(d) else -1, float(s[0]) if len(d) else 0.0))
        return out


def identity(text: str, key: str) -> list[Column]:
    """128 bits that tell rows apart by key and text, nulls included."""
    return [F.xxhash64(key, text).alias("h1"), F.xxhash64(text, key, F.lit(1)).alias("h2")]


def frequencies(docs: DataFrame, shared: Broadcast, text: str = "text") -> tuple[np.ndarray, int]:
    """How many of all documents hold each term of the broadcast vocabulary, and how many there are. Every task counts in one array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag, seen, rows = Bag(shared.value), np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            rows += b.num_rows
            seen += bag.held(b.column(0))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[seen[at], rows])], ["i", "n"])
        release()

    found = docs.select(text).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df, i, n = np.zeros(len(shared.value)), found["i"].to_numpy(), found["n"].to_numpy()
    df[i[i >= 0]] = n[i >= 0]
    return df, int(n[i < 0].sum())


def learn(docs: DataFrame, labels: DataFrame, learns: Column, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """The model, from docs (document frequencies) and the labelled rows for which learns, an expression over key, holds."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & learns).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("__y"))
    known = written(known.join(docs.select(key).distinct(), key, "left_semi"))
    totals = {int(y): int(n) for y, n in known.groupBy("__y").count().collect() if y in (0, 1)}
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model(rate, [], np.zeros(0))
    chosen = known.filter("__y = 1").orderBy(F.xxhash64(key), key).limit(SAMPLE).unionByName(known.filter("__y = 0").orderBy(F.xxhash64(key), key).limit(SAMPLE))
    texts = docs.select(key, F.col(text).alias("__t")).join(F.broadcast(chosen), key).groupBy(key, "__y").agg(F.min("__t").alias("__t"))
    # at most SAMPLE rows of a class are left, so a window of each is bounded
    order = Window.partitionBy("__y").orderBy(F.xxhash64(key), key)
    texts = texts.withColumn("__n", F.row_number().over(order)).withColumn("__s", F.sum(F.coalesce(F.octet_length("__t"), F.lit(0))).over(order))
    sample = written(texts.filter((F.col("__s") <= SAMPLE_BYTES) | (F.col("__n") == 1)).select(key, "__y", "__t"))

    def make_terms() -> Callable[[pa.RecordBatch], dict]:
        return lambda b: {"y": b.column(0), "terms": [list({t for w in set(WORD.findall((x or "").lower())) for t in terms_of(w)}) for x in b.column(1).to_pylist()]}

    words = map_rows(sample.select("__y", "__t"), "y int, terms array<string>", make_terms).select("y", F.explode("terms").alias("term"))
    terms = words.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("c")).orderBy("term").toArrow()
    vocabulary, a, c = terms["term"].to_pylist(), terms["a"].to_numpy(), terms["c"].to_numpy()
    del terms
    shared = spark.sparkContext.broadcast(vocabulary)
    df, count = frequencies(docs, shared, text)

    def make_bags() -> Callable[[pa.RecordBatch], dict]:
        bag = Bag(shared.value)

        def f(b: pa.RecordBatch) -> dict:
            ptr, ids, tf = bag(b.column(2))
            return {"k": b.column(0), "y": b.column(1), **{c: [v[a:z].astype("<i4").tobytes() for a, z in zip(ptr[:-1], ptr[1:], strict=True)] for c, v in (("ids", ids), ("tf", tf))}}

        return f

    kind = docs.schema[key].dataType.simpleString()
    # examples stay packed on the driver: their number and their texts' bytes are bounded
    rows = map_rows(sample.select(key, "__y", "__t"), f"k {kind}, y int, ids binary, tf binary", make_bags).toArrow()
    keys, y = np.array(rows["k"].to_pylist()), rows["y"].to_numpy()
    ids, tf = ([np.frombuffer(x.as_py(), "<i4") for x in rows[c]] for c in ("ids", "tf"))
    del rows
    # alike examples share a block: those of one class that hold the same of the terms of the most examples
    held = a + c
    common = [tuple(sorted(i.tolist(), key=lambda t: (-held[t], t))[:8]) for i in ids]
    order = sorted(range(len(keys)), key=lambda i: (y[i], common[i], keys[i]))
    keys, y, ids, tf = keys[order], y[order], [ids[i] for i in order], [tf[i] for i in order]
    n0, n1 = np.bincount(y, minlength=2)
    weight = (np.log((1 + count) / (1 + df)) + 1) * np.log2(2 + a / np.maximum(1, c * n1 / n0))
    vectors = Vectors.of((np.r_[0, np.cumsum([len(x) for x in ids])], np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int32), *tf])), weight)
    model = Model(rate, vocabulary, weight, Index(vectors, len(vocabulary)), keys, y, np.array([totals[0] / n0, totals[1] / n1]))
    votes = np.array([model.vote(d, s) for d, s in model.index.nearest(vectors, np.arange(len(keys)))])
    model.x, model.y = isotonic(votes, y.astype(float), model.share[y])
    shared.destroy()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k, h1, h2, score, nearest (an example's key or null) and cosine of each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], dict]:
        m = shared.value
        bag = Bag(m.vocabulary)

        def f(b: pa.RecordBatch) -> dict:
            got = m.scores(bag(b.column(3)))
            return {"k": b.column(0), "h1": b.column(1), "h2": b.column(2), "score": [g[0] for g in got], "nearest": [None if g[1] < 0 else m.keys[g[1]].item() for g in got], "cosine": [g[2] for g in got]}

        return f

    rows = docs.select(F.col(key).alias("k"), *identity(text, key), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return map_rows(rows, f"k {kind}, h1 long, h2 long, score double, nearest {kind}, cosine double", make)


def held_out(key: str = "doc_id") -> Column:
    return crc_of_id(key) % 3 == 1
