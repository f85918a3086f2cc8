"""LM scoring (operator 7): trigram probabilities from a log-frequency Bloom filter.

Counting. Every training text adds its words and one end mark to the unigrams, and each of them with the two tokens before it
(its history; end marks stand before the first word) to the trigrams. Tasks count by hash and send packed columns to shards of
the hash space: unigrams by their own hash, trigrams by that of their history. Each shard sums what it gets blob by blob in one
place: what is gathered grows with the corpus, and nothing of it passes through the driver but histograms. Histories that make
up much of a sample of the texts (HOT at most) are dealt out over PARTS parts by their next word, so no shard holds all of one;
the sample decides on places only, not on results.

The filter. A trigram's count c is stored as its quantised logarithm q = 1 + floor(log_BASE c): the filter gets the items
(trigram, 1) ... (trigram, q), HASHES bits each, and its history as an item of level 0 with HASHES_OF_HISTORY bits. A probe asks for level 1, 2, ... until
one is missing; the level reached is q, or more with a small probability. Each shard writes the filter of its own trigrams,
BITS_EACH bits to each bit set, with the sums of those histories that have more than a single trigram seen once. So the filter grows with the
corpus and is never in one place, and all trigrams are stored.

Asking. Texts are taken in chunks. A chunk sends the different trigrams it holds, and its words outside the head, to the shards
of the hash space, packed; a shard answers with levels, sums of histories and exact counts, which meet the chunk's tokens again. The
HEAD most frequent words (a count bound: all words of at least so many occurrences) are broadcast with their counts, which only
saves asking: a word outside the head has its exact count too.

Probability, by absolute discounting: p(w | h) = (max(c' - D, 0) + D n p(w)) / C, with c' = BASE^(q-1), the lower end of the
trigram's level, C the sum of c' and n the number of different trigrams of the history, so that the probabilities of all words, and
of one unseen word, sum to 1. D = n1 / (n1 + 2 n2) from the numbers of trigrams seen once and twice, within DISCOUNTS. p(w) =
(c(w) + ALPHA) / (N + ALPHA (V + 1)). After an unseen history p(w | h) = p(w).

Null and empty texts are the end mark alone. Repeated rows are scored, and counted, each. With no training text N = V = 0
and every token has p = 1. An empty table gives an empty table. What trains says is taken as it is: where it is null (a null key, under held_out),
a row isn't learned from but scored. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import crc_of_id, map_rows, prepare, release, words
from larkspur.llm.jaccard_join import POWERS, WordHashes, mix
from larkspur.session import written

ALPHA, BASE, DISCOUNTS = 0.1, 2.0, (0.1, 0.95)
#: Bits set for a trigram's level and for a history (of which a false one costs a token log10 D), bits of the filter to each.
HASHES, HASHES_OF_HISTORY, BITS_EACH, HEAD = 5, 3, 2.5, 1 << 21
#: Histories dealt out, if they are a share of 1 / HOT_SHARE of the sample at least; their parts; bytes of text in the sample, about.
HOT, HOT_SHARE, PARTS, SAMPLED = 256, 1000, 1024, 4_000_000
#: Bits of the filter to a stretch.
STRETCH = 1 << 19
END = np.uint64(0x5851F42D4C957F2D)
#: Tokens counted at once in a task; n-grams to a partition.
HELD, TOGETHER = 3_000_000, 4_000_000
#: Tokens of a chunk, at least; texts aren't split.
CHUNK = 2_000_000
#: A trigram's key: its history in 34 bits, inside a shard, and its last word in 20. The other bits are 0 and take no room.
HISTORY, LAST = np.uint64(0xFFFFFFFFC0000000), 20


class Tokens:
    """Hashes of a text's tokens: its words and the end mark."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        found = words(text)
        out = np.empty(len(found) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        out[-1] = END
        return out

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, and the number of tokens of each."""
        parts = [self(t) for t in texts]
        return np.concatenate(parts), np.array([len(p) for p in parts])


def before(tokens: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
    """The token before each; the end mark before the first of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.r_[0, np.cumsum(size)[:-1]]] = end
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two tokens."""
    return mix(mix(left + POWERS[0]) + right * POWERS[1])


def last_word(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens) >> np.uint64(64 - LAST)


def place(history: np.ndarray, last: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Where a trigram is kept: by its history, or by a part of it if that is hot (hot is sorted)."""
    if not len(hot):
        return history
    is_hot = hot[np.minimum(np.searchsorted(hot, history), len(hot) - 1)] == history
    return np.where(is_hot, part_of(history, last % np.uint64(PARTS)), history)


def part_of(history: np.ndarray, part: np.ndarray) -> np.ndarray:
    return mix(history + (part + np.uint64(1)) * POWERS[2])


def shard_of(places: np.ndarray, partitions: int) -> np.ndarray:
    return ((places >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.uint16 if partitions <= 1 << 16 else np.uint32)


def keyed(places: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(places) & HISTORY | last << np.uint64(30 - LAST)


def in_shards(shard: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard and key, and where in it another key begins."""
    order = np.argsort(keys)
    order = order[np.argsort(shard[order], kind="stable")]
    s, k = shard[order], keys[order]
    return order, np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, int)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class Sums:
    """Counts of keys that come in sorted parts, in memory bounded by twice the different keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.pending += len(keys)
        if self.pending > max(1_000_000, 2 * len(self.parts[0][0])):
            self.parts = [self.whole()]
            self.pending = len(self.parts[0][0])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])) if len(self.parts) > 1 else self.parts[0]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers and equal length, byte by byte: equal high bytes take no room."""
    n = len(columns[0])
    planes = np.concatenate([np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(n, 8).T.ravel() for c in columns]) if n else np.zeros(0, np.uint8)
    return np.uint32(n).tobytes() + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes, columns: int = 2) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[4:], n * 8 * columns, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in planes.reshape(columns, 8, n)]


def hot_histories(texts: DataFrame, size: int) -> np.ndarray:
    """Hashes of the histories that make up much of a sample of the texts, HOT at most, sorted."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        tokens = Tokens()

        def f(b: pa.RecordBatch) -> dict:
            t, n = tokens.many(b.column(0).to_pylist())
            left = before(t, n, END)
            h, c = np.unique(joined(before(left, n, END), left), return_counts=True)
            keep = c * 4 * HOT_SHARE >= len(t)
            return {"h": pa.array(np.r_[h[keep].view(np.int64), 0]), "n": pa.array(np.r_[c[keep], 0]), "t": pa.array(np.r_[np.zeros(int(keep.sum()), np.int64), len(t)])}

        return f

    found = map_rows(texts.sample(min(1.0, SAMPLED / max(1, size)), 1), "h long, n long, t long", make).groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rows = found.orderBy(F.desc("n"), "h").limit(HOT + 1).collect()
    total = found.agg(F.sum("t")).first()[0] or 0
    return np.sort(np.array([r.h for r in rows if r.n * HOT_SHARE >= total and r.n > 0][:HOT], np.int64).view(np.uint64))


def counted(texts: DataFrame, partitions: int, hot: np.ndarray) -> DataFrame:
    """ngram (1 or 3), shard, rows, seen, total, hist, once and twice: sums over all texts. rows are the words with their counts, packed and sorted, or the filter of the trigrams."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, size = Tokens(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            left = before(t, n, END)
            last = last_word(t)
            where = place(joined(before(left, n, END), left), last, hot)
            for ngram, shard, keys in ((1, shard_of(t, partitions), t), (3, shard_of(where, partitions), keyed(where, last))):
                order, starts = in_shards(shard, keys)
                counts = np.diff(np.r_[starts, len(order)]).astype(np.uint64)
                keys, own = keys[order[starts]], shard[order[starts]]
                cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                rows = [(int(own[a]), pack(keys[a:b], counts[a:b])) for a, b in zip(cuts, np.r_[cuts[1:], len(own)], strict=True)]
                for a in range(0, len(rows), 64):
                    part = rows[a : a + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([ngram] * len(part), pa.int32()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], ["ngram", "shard", "rows"])

        for b in batches:
            if b.num_rows:
                held.append(tokens.many(b.column(0).to_pylist()))
                size += len(held[-1][0])
                if size > HELD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, Sums()
        _, part_shard, part_keys = parts_of(hot, partitions)

        def done() -> Iterator[pa.RecordBatch]:
            (n, s), (keys, counts) = at, sums.whole()
            hist = [int((counts >= np.uint64(1 << i)).sum()) for i in range(min(int(counts.max(initial=1)).bit_length(), 63))]
            for a in range(0, max(1, len(keys)) if n == 1 else 1, 500_000):
                rows = pack(keys[a : a + 500_000], counts[a : a + 500_000]) if n == 1 else sealed(keys, counts, part_keys[part_shard == s])
                told = [0, 0, [], 0, 0] if a else [len(keys), int(counts.sum()), hist, int((counts == 1).sum()), int((counts == 2).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([s], pa.int64()), pa.array([rows], pa.binary()), *[pa.array([x], pa.list_(pa.int64()) if i == 2 else pa.int64()) for i, x in enumerate(told)]], ["ngram", "shard", "rows", "seen", "total", "hist", "once", "twice"])

        for b in batches:
            for n, s, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (n, s):
                    if at:
                        yield from done()
                    at, sums = (n, s), Sums()
                sums.add(*unpack(blob))
        if at:
            yield from done()
        del sums
        release()

    sent = texts.mapInArrow(local, "ngram int, shard long, rows binary").repartition(partitions, "ngram", "shard").sortWithinPartitions("ngram", "shard")
    return sent.mapInArrow(merge, "ngram int, shard long, rows binary, seen long, total long, hist array<long>, once long, twice long")


def hist_of(table: DataFrame) -> tuple[int, int, np.ndarray, float]:
    """Of the words: different ones, occurrences, how many occur 2^i times or more. Of the trigrams: the discount."""
    sums = {r.ngram: r for r in table.groupBy("ngram").agg(*[F.sum(c).alias(c) for c in ("seen", "total", "once", "twice")]).collect()}
    hist = np.zeros(64, np.int64)
    for i, v in table.filter("ngram = 1").select(F.posexplode("hist").alias("i", "v")).groupBy("i").agg(F.sum("v")).collect():
        hist[i] = v
    if 3 not in sums:
        return 0, 0, hist, DISCOUNTS[1]
    once, twice = sums[3].once, sums[3].twice
    return sums[1].seen, sums[1].total, hist, min(DISCOUNTS[1], max(DISCOUNTS[0], once / max(1, once + 2 * twice)))


class Filter:
    """The bits of a log-frequency Bloom filter, in stretches that share out the hashes by their high bits."""

    def __init__(self, stretches: int, bits: np.ndarray | None = None) -> None:
        self.stretches = stretches
        self.bits = np.zeros(stretches * STRETCH // 8, np.uint8) if bits is None else bits

    def places(self, keys: np.ndarray, level: int, h: int) -> np.ndarray:
        x = mix(keys + np.uint64((level * HASHES + h + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        return stretch_of(keys, self.stretches) * STRETCH + (x & np.uint64(STRETCH - 1)).astype(np.int64)

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Which keys the filter holds at a level."""
        left = np.arange(len(keys))
        for h in range(HASHES if level else HASHES_OF_HISTORY):
            at = self.places(keys[left], level, h)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key, 0 if unknown, by probes of rising levels."""
        out, left, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(left) and level < 64:
            left = left[self.has(keys[left], level)]
            out[left] = level
            level += 1
        return out


def stretch_of(keys: np.ndarray, stretches: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(stretches) >> np.uint64(32)).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts.astype(float)) / math.log(BASE) + 1e-9).astype(np.int64)


def lower_end(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, BASE ** (level - 1.0), 0.0)


class Shard:
    """What a shard knows of its trigrams: their filter and, of histories with more than one trigram seen once and of parts of hot ones, C and n."""

    def __init__(self, bits: Filter, histories: np.ndarray, sums: np.ndarray, kinds: np.ndarray) -> None:
        self.bits, self.histories, self.sums, self.kinds = bits, histories, sums, kinds

    def history(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """C and n of the histories of keys; both 0 if unseen."""
        h = keys & HISTORY
        one = self.bits.has(h, 0).astype(np.int64)
        if not len(self.histories):
            return one, one
        i = np.minimum(np.searchsorted(self.histories, h), len(self.histories) - 1)
        own = self.histories[i] == h
        return np.where(own, self.sums[i].astype(np.int64), one), np.where(own, self.kinds[i].astype(np.int64), one)

    def listed(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """C and n of histories that are in the table if they were seen."""
        if not len(self.histories):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        i = np.minimum(np.searchsorted(self.histories, keys), len(self.histories) - 1)
        own = self.histories[i] == keys
        return np.where(own, self.sums[i].astype(np.int64), 0), np.where(own, self.kinds[i].astype(np.int64), 0)


def sealed(keys: np.ndarray, counts: np.ndarray, always: np.ndarray) -> bytes:
    """A shard of trigrams, given by their sorted keys and counts. Histories in always have their sums in the table."""
    level, h = level_of(counts), keys & HISTORY
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    c, n = np.add.reduceat(lower_end(level), starts).astype(np.uint64), np.diff(np.r_[starts, len(h)])
    h = h[starts]
    more = (c > 1) | (n > 1) | np.isin(h, always)
    stretches, top = max(1, math.ceil((int(level.sum()) * HASHES + len(h) * HASHES_OF_HISTORY) * BITS_EACH / STRETCH)), int(level.max(initial=0))
    bits, f = np.zeros(stretches * STRETCH, bool), Filter(stretches, np.zeros(0, np.uint8))
    for q in range(top + 1):
        for k in range(HASHES if q else HASHES_OF_HISTORY):
            bits[f.places(keys[level >= q] if q else h, q, k)] = True
    table = pack(h[more], c[more], n[more])
    return np.array([stretches, len(table)], "<u4").tobytes() + table + np.packbits(bits, bitorder="little").tobytes()


def unsealed(blob: bytes | None) -> Shard:
    if blob is None:
        return Shard(Filter(1), *[np.zeros(0, np.uint64)] * 3)
    stretches, n = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    return Shard(Filter(stretches, np.frombuffer(blob, np.uint8, offset=8 + n)), *unpack(blob[8 : 8 + n], 3))


def parts_of(hot: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts of the hot histories: the number of their history, their shard and their key."""
    where = part_of(np.repeat(hot, PARTS), np.tile(np.arange(PARTS, dtype=np.uint64), len(hot)))
    return np.repeat(np.arange(len(hot)), PARTS), shard_of(where, partitions), keyed(where, np.uint64(0))


def sums_of(table: DataFrame, hot: np.ndarray, partitions: int) -> np.ndarray:
    """C and n of the hot histories, from their parts: a row each."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        own, shard, keys = parts_of(hot, partitions)

        def f(b: pa.RecordBatch) -> dict:
            out = np.zeros((2, len(hot)), np.int64)
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = np.flatnonzero(shard == s)
                for x, got in zip(out, unsealed(blob).listed(keys[mine]), strict=True):
                    np.add.at(x, own[mine], got)
            return {"h": list(range(len(hot))), "c": out[0], "n": out[1]}

        return f

    out = np.zeros((len(hot), 2))
    if len(hot):
        for r in map_rows(table.filter("ngram = 3").select("shard", "rows"), "h int, c long, n long", make).groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
            out[r.h] = r.c, r.n
    return out


class Chunk:
    """Texts as numbers of their words, which are ordered by falling frequency so that numbers are small."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, size: np.ndarray) -> None:
        self.vocabulary, self.tokens, self.size = vocabulary, tokens, size

    @classmethod
    def of(cls, tokens: np.ndarray, size: np.ndarray) -> Chunk:
        found, number, n = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return cls(found[order], rank[number], size)

    def pack(self, head: np.ndarray) -> bytes:
        """Words of the head go by their number in it."""
        v = self.vocabulary
        at = np.minimum(np.searchsorted(head, v), max(0, len(head) - 1))
        known = head[at] == v if len(head) else np.zeros(len(v), bool)
        parts = [pack(np.where(known, at + 1, 0)), pack(v[~known]), pack(self.tokens), pack(self.size)]
        return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)

    @classmethod
    def unpack(cls, blob: bytes, head: np.ndarray) -> Chunk:
        ends = np.cumsum(np.r_[32, np.frombuffer(blob, "<u8", 4).astype(np.int64)])
        at, rest, tokens, size = (unpack(blob[a:b], 1)[0] for a, b in zip(ends[:-1], ends[1:], strict=True))
        v = head[at.astype(np.int64) - 1] if len(head) else np.zeros(len(at), np.uint64)
        v[at == 0] = rest
        return cls(v, tokens.astype(np.uint32), size.astype(np.int64))

    def words(self, head: np.ndarray, counts: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """The count of each word, as far as the head tells, and the words to ask for. whole: words outside the head weren't seen."""
        v = self.vocabulary
        at = np.minimum(np.searchsorted(head, v), max(0, len(head) - 1))
        known = head[at] == v if len(head) else np.zeros(len(v), bool)
        missing = np.flatnonzero(~known) if not whole else np.zeros(0, int)
        return np.where(known, counts[at], 0.0) if len(head) else np.zeros(len(v)), missing

    def trigrams(self, seen: np.ndarray, hot: np.ndarray, partitions: int) -> tuple[np.ndarray, ...]:
        """The number of each token's trigram among the different ones; of these, in order of shard and key, the last word, the history's hash, and which are asked for with shard and key. Histories with a word that wasn't seen aren't asked for."""
        v, t = self.vocabulary, self.tokens
        end = np.uint32(np.flatnonzero(v == END)[0])
        left = before(t, self.size, end)
        left2 = before(left, self.size, end)
        history, last = joined(v[left2], v[left]), last_word(v)[t]
        where = place(history, last, hot)
        shard, keys = shard_of(where, partitions), keyed(where, last)
        order, starts = in_shards(shard, keys)
        number = np.empty(len(t), np.int64)
        number[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(t)]))
        first = order[starts]
        asked = np.flatnonzero(seen[left][first] & seen[left2][first])
        return number, t[first], history[first], asked, shard[first][asked], keys[first][asked]


def by_shard(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, int)
    for a, b in zip(starts.tolist(), np.r_[starts[1:], len(shard)].tolist() if len(starts) else [], strict=True):
        yield int(shard[a]), [c[a:b] for c in columns]


def score(docs: DataFrame, trains: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of each row; trains, over the columns of docs, tells which rows are learned from."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * TOGETHER)))
    learned = docs.filter(trains).select(text)
    hot = hot_histories(learned, size)
    table = written(counted(learned, partitions, hot))
    distinct, total, hist, discount = hist_of(table)
    # the least power of two with which the head keeps to its bound
    low = next(i for i in range(64) if hist[i] <= HEAD)
    tail, norm = 1 << low, math.log10(total + ALPHA * (distinct + 1)) if total else 0.0
    whole = tail == 1

    def common(b: pa.RecordBatch) -> dict:
        got = [unpack(x) for x in b.column(0).to_pylist()]
        keep = [(k[c >= tail], c[c >= tail]) for k, c in got]
        return {"rows": [pack(k, c) for k, c in keep if len(k)]}

    heads = [unpack(r.rows) for r in map_rows(table.filter("ngram = 1").select("rows"), "rows binary", lambda: common).toLocalIterator()]
    head, counts = (np.concatenate([h[i] for h in heads] or [np.zeros(0, np.uint64)]) for i in (0, 1))
    order = np.argsort(head)
    shared = spark.sparkContext.broadcast((head[order], counts[order].astype(np.float64), hot, sums_of(table, hot, partitions)))
    kind = docs.schema[key].dataType.simpleString()
    # ngram 0 are the chunks themselves, which pass through the shards
    schema = f"chunk long, ngram int, shard long, own int, ks array<{kind}>, rows binary"

    def wanted(chunk: Chunk) -> tuple[np.ndarray, ...]:
        head, counts, hot, _ = shared.value
        c, missing = chunk.words(head, counts, whole)
        own = shard_of(chunk.vocabulary[missing], partitions)
        order = np.argsort(own, kind="stable")
        missing, seen = missing[order], c > 0
        seen[missing] = True
        return c, missing, own[order], *chunk.trigrams(seen, hot, partitions)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number, held = Tokens(), TaskContext.get().partitionId() << 32, []

        def sent() -> Iterator[pa.RecordBatch]:
            chunk = Chunk.of(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            ks = pa.concat_arrays([h[0] for h in held])
            held.clear()
            _, missing, own, *_, shard, keys = wanted(chunk)
            rows = [(0, number, chunk.pack(shared.value[0])), *((1, s, pack(x)) for s, (x,) in by_shard(own, chunk.vocabulary[missing])), *((3, s, pack(x)) for s, (x,) in by_shard(shard, keys))]
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                mine = pa.ListArray.from_arrays(pa.array([0] + [len(ks) if not a else 0] * len(part), pa.int32()), ks if not a else ks[:0])
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(part), pa.int64()), pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), pa.array([1] * len(part), pa.int32()), mine, pa.array([r[2] for r in part], pa.binary())], ["chunk", "ngram", "shard", "own", "ks", "rows"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0), *tokens.many(b.column(1).to_pylist())))
            if sum(len(h[1]) for h in held) >= CHUNK:
                yield from sent()
                number += 1
        if held:
            yield from sent()
        release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, counts, known = None, [], None, None
        for b in batches:
            out = []
            for n, s, own, rows in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
                if n and (n, s) != at:
                    at, parts, counts, known = (n, s), [], None, None
                if n and not own:
                    parts.append(rows)
                    continue
                if n == 1:
                    if counts is None:
                        got = [unpack(x) for x in parts] or [(np.zeros(0, np.uint64),) * 2]
                        counts = summed(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
                    (asked,) = unpack(rows, 1)
                    i = np.minimum(np.searchsorted(counts[0], asked), max(0, len(counts[0]) - 1))
                    rows = pack(np.where(counts[0][i] == asked, counts[1][i], 0) if len(counts[0]) else np.zeros(len(asked)))
                elif n == 3:
                    known = known or unsealed(parts[0] if parts else None)
                    (asked,) = unpack(rows, 1)
                    rows = pack(known.bits.levels(asked), *known.history(asked))
                out.append(rows)
            keep = b.filter(pa.array([bool(own or not n) for n, own in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]))
            if keep.num_rows:
                yield pa.RecordBatch.from_arrays([*keep.columns[:5], pa.array(out, pa.binary())], names=b.schema.names)
        release()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ks, blob, got = None, None, None, {1: [], 3: []}

        def scored() -> pa.RecordBatch:
            chunk = Chunk.unpack(blob, shared.value[0])
            c, missing, _, number, last, history, asked, _, _ = wanted(chunk)
            told, (level, sums, kinds) = ([np.concatenate([x[i] for x in got[n]]) if got[n] else np.zeros(0, np.uint64) for i in range(n)] for n in (1, 3))
            if len(told[0]) != len(missing) or len(level) != len(asked):
                raise RuntimeError(f"answers to chunk {at} are incomplete: {len(told[0])} of {len(missing)} words, {len(level)} of {len(asked)} trigrams")
            c[missing] = told[0]
            base = np.log10(c + ALPHA) - norm if total else np.zeros(len(c))
            q, sum_, n = np.zeros((3, len(last)))
            q[asked], sum_[asked], n[asked] = level, sums, kinds
            _, _, hot, hot_sums = shared.value
            if len(hot):
                i = np.minimum(np.searchsorted(hot, history), len(hot) - 1)
                is_hot = hot[i] == history
                sum_[is_hot], n[is_hot] = hot_sums[i[is_hot]].T
            plain = 10.0 ** base[last]
            # a level that the filter reports too high must not exceed its history
            pair = np.minimum(lower_end(q), sum_)
            full = np.log10(np.where(sum_ > 0, np.minimum(1.0, (np.maximum(pair - discount, 0) + discount * n * plain) / np.maximum(sum_, 1)), plain))
            texts = len(chunk.size)
            own = np.repeat(np.arange(texts), chunk.size)
            known, based, scores = (np.bincount(own, weights=w, minlength=texts) for w in ((c > 0)[chunk.tokens], base[chunk.tokens], full[number]))
            return pa.RecordBatch.from_arrays([ks, pa.array(chunk.size), pa.array(known.astype(np.int64)), pa.array(based), pa.array(scores)], ["k", "n_tokens", "n_known", "base", "full"])

        for b in batches:
            for i, (chunk, n, rows) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 5)), strict=True)):
                if chunk != at:
                    if at is not None:
                        yield scored()
                    at, blob, got = chunk, None, {1: [], 3: []}
                if n == 0:
                    ks, blob = b.column(4)[i].values, rows
                else:
                    got[n].append(unpack(rows, n))
        if at is not None:
            yield scored()
        release()

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    own = table.select(F.lit(0).cast("long").alias("chunk"), "ngram", "shard", F.lit(0).alias("own"), F.lit(None).cast(f"array<{kind}>").alias("ks"), "rows")
    met = own.filter(F.lit(True) if not whole else F.col("ngram") == 3).unionByName(rows.mapInArrow(ask, schema)).repartition(partitions, "ngram", "shard")
    told = met.sortWithinPartitions("ngram", "shard", "own").mapInArrow(answer, schema).repartition(partitions, "chunk")
    part = told.sortWithinPartitions("chunk", "ngram", "shard").mapInArrow(finish, f"k {kind}, n_tokens long, n_known long, base double, full double")
    return part.select(F.col("k").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("full").alias("score"))


def held_out(key: str = "doc_id") -> Column:
    return crc_of_id(key) % 10 == 0
