"""N-gram Jaccard join (operator 5): PartEnum signatures over sets of word shingles.

A text's set holds the 64-bit hashes of its distinct five-word shingles. Sizes fall into overlapping bands, such that two
sets with a Jaccard similarity of 0.8 share a band. In a band of sizes up to R, such sets differ in k = 2 R / 9
shingles at most. Each band cuts the domain of shingles into n1 > k parts by a hash; as k differences spoil k parts at
most, two similar sets agree on n1 - k parts or more. A set's signatures are the hashes of its parts' contents (subsets
of one part each; more of several would only grow in number), so similar sets share signatures, and no link is lost.

n1 leaves some slack beyond k + 1, so that similar sets share at least `room` signatures: the slack less their empty
parts. A text with too many empty parts goes on to a second cut of the domain, and so on; a pair is found at the first
cut at which either is well off. Half of the room pays for leaving out signatures that many texts share (a passage, a
boilerplate line): each text leaves out those of the longest runs, as long as they are over HOT and few enough. Of two
texts the one with the lower bar leaves out what the other does, so they still share `need` signatures, the room less
what was left out; pairs that share fewer are no candidates.

Equal texts are reduced to one representative first. Signatures travel in packed columns and are sorted in each
partition; runs of equal ones name candidates. First each text is compared exactly with that first member of its runs
with which it shares most, and the links are joined to components. Then all pairs that share enough signatures and still
lie in different components are compared: those of short runs as rows, those of long runs (over LONG_RUN texts, cut into
chunks) as bit sets inside a task, which returns links only. A pair of several long runs is compared in the first. What is left out of comparison therefore lies within a component or shares
too few signatures: no link between texts is lost, and a group of copies costs its size, not its square.

Null texts and those without words have an empty set and link with nothing; with fewer than five words the whole
sequence is one shingle. Rows with a null key link with nothing either: they have their set's size and a null class. A key stands for
one document: rows that repeat it get the key's class, and of different texts under one key that with the least digest stands for it. An empty table gives
an empty table. Extra columns are ignored, whatever their names. Hashes of 64 bits are taken for shingles: two different ones in a pair of texts are mixed up less than once in 10^12 pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_rows, prepare, words
from larkspur.llm.components import components
from larkspur.session import sized_broadcast, written

WORDS, SIMILAR = 5, Fraction(4, 5)
#: Bands start at STEP^i and reach STEP / SIMILAR times as far: sizes a <= b with a >= 0.8 b share the last band that starts at a or below.
STEP = 1 / SIMILAR**2
#: Parts beyond k + 1, as a share of k; cuts of the domain; texts that may share a signature before it is left out.
SLACK, CUTS, HOT = 6, 4, 8
#: Runs of more texts are compared as bit sets, in chunks of CHUNK texts; pairs of a chunk are sent on in lots of LOT.
LONG_RUN, CHUNK, LOT = 32, 1024, 200_000
REMEMBERED = 300_000
#: Signatures to a partition; bytes of text to a signature.
TOGETHER, BYTES_EACH = 2_000_000, 10
SIZE_ROW = 65_535
#: Shingles whose signatures are made at once.
AT_ONCE = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[w] = h
        return h


class Shingles:
    """Sets of shingle hashes of texts."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def one(self, text: str | bytes | None) -> np.ndarray:
        found = words(text)
        if len(found) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64) if found else np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        n = len(h) - WORDS + 1
        total = h[:n] * POWERS[0]
        for i in range(1, WORDS):
            total = mix(total) + h[i : i + n] * POWERS[i]
        return np.unique(mix(total))


def bands(n: int) -> list[tuple[int, int]]:
    """(band, R) for each band that holds size n."""
    i = int(math.log(n) / math.log(STEP)) + 1
    out = []
    for j in range(max(0, i - 3), i + 1):
        low = STEP**j
        if low <= n <= low * STEP / SIMILAR:
            out.append((j, int(low * STEP / SIMILAR)))
    return out


def signatures(sets: list[np.ndarray], known: dict[int, list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature, position of its set, group (band and cut) and room (how many more signatures of the group may be left out) of all signatures."""
    todo = []
    for d, s in enumerate(sets):
        if n := len(s):
            if n not in known:
                known[n] = bands(n)
            todo += [(d, j, 2 * r // 9, n) for j, r in known[n]]
    out: list[tuple[np.ndarray, ...]] = []
    for cut in range(CUTS):
        if not todo:
            break
        docs, band, k, size = (np.array(x) for x in zip(*todo, strict=True))
        parts = k + 1 + -(-k // SLACK)
        first = np.r_[0, np.cumsum(parts)[:-1]]
        h = np.concatenate([sets[d] for d in docs])
        own = np.repeat(np.arange(len(docs)), size)
        # parts come from the band's and cut's own hash, contents from another
        seed = mix((band * CUTS + cut + 1).astype(np.uint64) * POWERS[1])
        part = (mix(h ^ seed[own]) % parts[own].astype(np.uint64)).astype(np.int64)
        at = first[own] + part
        content, held = np.zeros(int(parts.sum()), np.uint64), np.bincount(at, minlength=int(parts.sum()))
        np.add.at(content, at, mix(h + POWERS[2]))
        of = np.repeat(np.arange(len(docs)), parts)
        number = (np.arange(len(of)) - first[of]).astype(np.uint64)
        sig = mix(content + mix(number * POWERS[3] + seed[of]))
        empty = np.bincount(of, weights=held == 0, minlength=len(docs)).astype(np.int64)
        slack = parts - np.minimum(k, size // 4)
        well = empty < slack
        last = cut == CUTS - 1
        emit = (held > 0) | (last & ~well[of])
        room = np.where(well, slack - empty, 0)
        out.append((sig[emit], docs[of[emit]], (band * CUTS + cut)[of[emit]], np.minimum(room, 65_534)[of[emit]]))
        todo = [] if last else [t for t, w in zip(todo, well, strict=True) if not w]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ROW = np.dtype([("sig", "<u8"), ("rep", "<i8"), ("n", "<u4"), ("group", "<u2"), ("room", "<u2")])


def pack(rows: np.ndarray) -> bytes:
    """Columns one after the other: repeated values compress well."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in ROW.names)


def unpack(blob: bytes) -> np.ndarray:
    n, at = len(blob) // ROW.itemsize, 0
    rows = np.empty(n, ROW)
    for c in ROW.names:
        size = ROW[c].itemsize * n
        rows[c] = np.frombuffer(blob, ROW[c], n, at)
        at += size
    return rows


def members(reps: DataFrame, partitions: int) -> DataFrame:
    """Of the texts in reps (rep, text): a row with grp = SIZE_ROW for each (its size), and rows of the signatures that several share."""
    shards = 8 * partitions

    def make_packed() -> Callable[[pa.RecordBatch], dict]:
        shingles, known = Shingles(), {}

        def some(ids: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
            sig, doc, group, room = signatures(sets, known)
            size = np.array([len(s) for s in sets])
            rows = np.empty(len(sig) + len(ids), ROW)
            rows["sig"], rows["rep"] = np.r_[sig, mix(ids.astype(np.uint64))], np.r_[ids[doc], ids]
            rows["n"], rows["group"], rows["room"] = np.r_[size[doc], size], np.r_[group, np.full(len(ids), SIZE_ROW)], np.r_[room, np.zeros(len(ids))]
            return rows

        def f(b: pa.RecordBatch) -> dict:
            ids, made, sets, held, first = b.column(0).to_numpy(), [], [], 0, 0
            for i, text in enumerate(b.column(1)):
                sets.append(shingles.one(text.as_py()))
                held += len(sets[-1])
                if held >= AT_ONCE or i == b.num_rows - 1:
                    made.append(some(ids[first : i + 1], sets))
                    sets, held, first = [], 0, i + 1
            rows = np.concatenate(made)
            made.clear()
            shard = (rows["sig"] % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            shard = shard[order]
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            return {"shard": shard[starts], "rows": [pack(rows[x]) for x in np.split(order, starts[1:])]}

        return f

    packed = map_rows(reps, "shard int, rows binary", make_packed).repartition(partitions, "shard")
    names = ("sig", "rep", "n", "grp", "room", "run", "first", "n_first")

    def runs(batches):
        blobs = [unpack(x) for b in batches for x in b.column(1).to_pylist()]
        if not blobs:
            return
        rows = np.concatenate(blobs)
        del blobs
        rows = rows[np.lexsort((rows["rep"], rows["sig"]))]
        sizes = rows["group"] == SIZE_ROW
        kept, rows = rows[sizes], rows[~sizes]
        start = np.flatnonzero(np.r_[True, rows["sig"][1:] != rows["sig"][:-1]]) if len(rows) else np.zeros(0, int)
        length = np.diff(np.r_[start, len(rows)])
        run = np.repeat(length, length)
        lead = np.repeat(start, length)
        shared = run > 1
        for part, n, a, m in ((kept, np.ones(len(kept), int), kept["rep"], kept["n"]), (rows[shared], run[shared], rows["rep"][lead[shared]], rows["n"][lead[shared]])):
            for i in range(0, len(part), 100_000):
                x, s = part[i : i + 100_000], slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in (np.ascontiguousarray(x["sig"]).view(np.int64), x["rep"], x["n"], x["group"], x["room"], n[s], a[s], m[s])], names)

    return packed.mapInArrow(runs, ", ".join(f"{c} long" for c in names))


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar, compared exactly."""
    def make() -> Callable[[pa.RecordBatch], dict]:
        shingles = Shingles()
        return lambda b: {"rep": b.column(0), "s": [shingles.one(t).view(np.int64) for t in b.column(1).to_pylist()]}

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    sets = map_rows(texts.join(sized_broadcast(ids), "rep", "left_semi"), "rep long, s array<long>", make)
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(SIMILAR.denominator * common >= SIMILAR.numerator * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def incidence(lists: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Bit sets of the lists' members over those that at least two lists hold: rows of 64-bit words."""
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]
    own, number = own[number >= 0], number[number >= 0]
    bits = np.zeros((len(lists), int((count > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (own, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
    return bits, len(values)


def candidates(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one long run (or of two chunks of it) that are met here first, lie across components and share enough, packed."""
    rep, n, c, need, chunk = (group[x].to_numpy() for x in ("rep", "n", "c", "need", "chunk"))
    lo, hi, sig = int(group["lo"].iloc[0]), int(group["hi"].iloc[0]), int(group["sig"].iloc[0])
    hot = incidence([np.array([x for x in h if x < sig], np.int64) for h in group["hot"]])[0]
    own = incidence([np.asarray(x, np.int64) for x in group["sigs"]])[0]
    right = np.flatnonzero(chunk == hi)
    out, left_, right_ = [], [], []
    for i in np.flatnonzero(chunk == lo).tolist():
        j = right[right > i] if lo == hi else right
        j = j[(c[j] != c[i]) & (n[j] * SIMILAR.denominator >= n[i] * SIMILAR.numerator) & (n[i] * SIMILAR.denominator >= n[j] * SIMILAR.numerator)]
        j = j[~(hot[j] & hot[i]).any(1)]
        j = j[np.bitwise_count(own[j] & own[i]).sum(1) >= np.minimum(need[j], need[i])]
        left_.append(np.full(len(j), rep[i]))
        right_.append(rep[j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left_, right_))
    for k in range(0, len(a), LOT):
        x, y = a[k : k + LOT], b[k : k + LOT]
        out.append((f"{sig}/{lo}/{hi}/{k}", np.unique(np.r_[x, y]).tolist(), np.stack([x, y]).astype("<i8").tobytes()))
    return pd.DataFrame(out, columns=["id", "docs", "pairs"])


def compared(lots: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """The similar pairs of one lot: links that span them."""
    if not len(lots) or not len(sets):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    sets = sets.drop_duplicates("rep")
    rep, lists = sets["rep"].to_numpy(), [np.asarray(x, np.int64) for x in sets["s"]]
    order = np.argsort(rep)
    bits, size = incidence(lists)[0], np.array([len(x) for x in lists])
    a, b = np.frombuffer(lots["pairs"].iloc[0], "<i8").reshape(2, -1)
    i, j = order[np.searchsorted(rep[order], a)], order[np.searchsorted(rep[order], b)]
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 4096):
        x, y = i[k : k + 4096], j[k : k + 4096]
        common = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64)
        keep[k : k + 4096] = SIMILAR.denominator * common >= SIMILAR.numerator * (size[x] + size[y] - common)
    parent = np.arange(len(rep))
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((rep[x], rep[y]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def alike_in_runs(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components between texts that share a long run."""
    long_ = placed.filter(F.col("m") > LONG_RUN)
    lists = placed.join(long_.select("rep", "grp").distinct(), ["rep", "grp"], "left_semi").groupBy("rep", "grp").agg(F.collect_list("sig").alias("sigs"), F.collect_list(F.when(F.col("m") > LONG_RUN, F.col("sig"))).alias("hot"))
    rows = long_.withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("chunk"), o).alias("lo"), F.greatest(F.col("chunk"), o).alias("hi")))
    rows = rows.withColumn("p", F.explode(met)).select("sig", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), "chunk", "rep", "grp", "n", "c", "need")
    rows = rows.join(lists, ["rep", "grp"])
    lots = written(rows.groupBy("sig", "lo", "hi").applyInPandas(candidates, "id string, docs array<long>, pairs binary"))

    def make() -> Callable[[pa.RecordBatch], dict]:
        shingles = Shingles()
        return lambda b: {"rep": b.column(0), "s": [shingles.one(t).view(np.int64) for t in b.column(1).to_pylist()]}

    wanted = lots.select(F.col("id").alias("lot"), F.explode("docs").alias("rep"))
    sets = map_rows(texts.join(sized_broadcast(written(wanted.select("rep").distinct())), "rep", "left_semi"), "rep long, s array<long>", make)
    return lots.select("id", "pairs").groupBy("id").cogroup(wanted.join(sets, "rep").groupBy("lot")).applyInPandas(compared, "a long, b long").distinct()


def close(n: str, m: str) -> Column:
    return (F.col(n) * SIMILAR.denominator >= F.col(m) * SIMILAR.numerator) & (F.col(m) * SIMILAR.denominator >= F.col(n) * SIMILAR.numerator)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links, itself included) of each row; key is a long."""
    spark = docs.sparkSession
    prepare(spark)
    digest = F.coalesce(F.md5(F.encode(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "utf-8")), F.lit(""))
    missing = sizes_alone(docs.filter(F.col(key).isNull()).select(F.col(text).alias("t"))).select(F.lit(None).cast(docs.schema[key].dataType).alias(key), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    docs = docs.filter(F.col(key).isNotNull())
    all_ = written(docs.select(F.col(key).cast("long").alias("k"), digest.alias("d"), F.octet_length(text).alias("o")))
    # keys with several texts, of which there ought to be none
    torn = written(all_.groupBy("k").agg(F.min("d").alias("least"), F.max("d").alias("most")).filter("least <> most").select("k", "least"))
    rows = all_
    if torn.limit(1).count():
        rows = written(all_.join(sized_broadcast(torn), "k", "left").withColumn("d", F.coalesce("least", "d")).drop("least"))
        docs = docs.join(sized_broadcast(torn.select(F.col("k").alias("__k"), F.col("least").alias("__least"))), F.col(key).cast("long") == F.col("__k"), "left").filter(F.col("__least").isNull() | (F.col("__least") == digest)).select(F.col(key), F.col(text)).dropDuplicates([key])
    firsts = written(rows.groupBy("d").agg(F.min("k").alias("rep"), F.max("o").alias("o")))
    total = firsts.agg(F.sum("o")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (BYTES_EACH * TOGETHER)))
    copies = rows.join(firsts.select("d", "rep"), "d").filter("k <> rep").select("k").distinct()
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t"))
    copies = written(copies).withColumnRenamed("k", "rep")
    reps = texts.join(sized_broadcast(copies), "rep", "left_anti")
    found = written(members(reps, partitions))
    sizes = found.filter(F.col("grp") == SIZE_ROW).groupBy("rep").agg(F.max("n").alias("n_shingles"))
    found = found.filter(F.col("grp") != SIZE_ROW)
    # the bar over which a text leaves signatures out, and how many it then needs to share
    runs = found.groupBy("rep", "grp").agg(F.sort_array(F.collect_list("run"), asc=False).alias("runs"), F.max("room").alias("room"))
    bar = F.greatest(F.coalesce(F.get("runs", F.greatest(F.floor((F.col("room") - 1) / 2), F.lit(0)).cast("int")), F.lit(0)), F.lit(HOT))
    bar = F.when(F.col("room") > 0, bar).otherwise(F.lit(2**62))
    runs = runs.withColumn("bar", bar).withColumn("need", F.greatest(F.lit(1), F.col("room") - F.size(F.filter("runs", lambda r: r > F.col("bar")))))
    kept = written(found.join(runs.select("rep", "grp", "bar", "need"), ["rep", "grp"]).filter("run <= bar").select("sig", "rep", "n", "grp", "need", "first", "n_first"))
    star = kept.filter((F.col("rep") != F.col("first")) & close("n", "n_first")).groupBy("rep", "grp", "first").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    star = star.filter("2 * c >= need").groupBy("rep").agg(F.max_by("first", F.struct("c", -F.col("first"))).alias("first"))
    star = written(star.select(F.col("first").alias("a"), F.col("rep").alias("b")))
    links = written(alike(star, texts))
    # pairs across components that share enough
    now = written(components(links))
    placed = kept.select("sig", "rep", "n", "grp", "need").join(now, F.col("rep") == F.col("node"), "left").select("sig", "rep", "n", "grp", "need", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select("sig", "m")
    placed = written(placed.join(mixed, "sig"))
    cold = placed.filter(F.col("m") <= LONG_RUN)
    other = cold.select("sig", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("need").alias("need2"))
    across = cold.join(other, "sig").filter((F.col("c") < F.col("c2")) & close("n", "n2")).groupBy(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"), "grp").agg(F.count("*").alias("shared"), F.min(F.least("need", "need2")).alias("need"))
    across = written(across.filter("shared >= need").select("a", "b").distinct().join(star, ["a", "b"], "left_anti"))
    more = written(alike(across, texts).unionByName(alike_in_runs(placed, texts)))
    final = components(links.unionByName(more)) if more.limit(1).count() else now
    out = rows.join(firsts.select("d", "rep"), "d").join(sizes, "rep").join(final, F.col("rep") == F.col("node"), "left")
    found = out.select(F.col("k").cast(docs.schema[key].dataType).alias(key), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("k")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
    return found.unionByName(missing)


def sizes_alone(texts: DataFrame) -> DataFrame:
    """n_shingles of each text (column t)."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        shingles = Shingles()
        return lambda b: {"n_shingles": [len(shingles.one(t)) for t in b.column(0).to_pylist()]}

    return map_rows(texts, "n_shingles long", make)
