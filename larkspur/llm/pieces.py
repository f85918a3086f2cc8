"""SentencePiece encoding and decoding (operator 6): unigram Viterbi over a double-array trie of pieces.

White space is marked inside pieces: a leading space is put before the text, and a piece's marker stands for a space.
Pieces carry log scores: -ln(rank + 2), as Zipf's law gives them, with the rank that the vocabulary file states. A
character that is no piece falls back to its UTF-8 bytes, a byte piece each, at FALLBACK below the worst score. Of equally
scored segmentations the one whose last piece starts earlier wins, and so on backwards.

No piece holds a space behind another character, or a line break (tested when the vocabulary is read), so the best
segmentation of a text joins those of its segments (spaces and the word behind them). Segments that a task hasn't met
are solved together: numpy walks the trie for all of them in lockstep. Long ones are solved alone, in time linear in
their length.

Null texts are encoded as null, the empty text as no pieces. decode(encode(t)) = t for every text, with line breaks,
runs of spaces and the marker character itself. Ids outside the vocabulary raise; null ids decode to null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import map_rows, prepare

MARKER, FALLBACK = "▁", 10.0
SEGMENT = re.compile(" *[^ \n]+|\n| +")
#: Segments of over LONG bytes are solved alone; so many segments and bytes of ids are remembered in a task.
LONG, REMEMBERED, TOGETHER = 40, 150_000, 10_000
FAR = -1e300


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with spaces for markers, their log scores, byte pieces by byte, and the double array."""

    pieces: list[bytes]
    scores: np.ndarray
    bytes_at: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int

    @property
    def fallback(self) -> float:
        return float(self.scores.min()) - FALLBACK


def double_array(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value: the child of state s by byte c is base[s] + c + 1 where check has s; value is the piece's id or -1."""
    nodes: list[dict[int, int]] = [{}]
    values = [-1]
    for p, k in pieces.items():
        n = 0
        for c in p:
            if c not in nodes[n]:
                nodes[n][c] = len(nodes)
                nodes.append({})
                values.append(-1)
            n = nodes[n][c]
        values[n] = k
    used = np.zeros(2 * len(nodes) + (1 << 16), bool)
    base, check, value = np.zeros(len(used), np.int32), np.full(len(used), -1, np.int32), np.full(len(used), -1, np.int32)
    used[:257], place, first = True, [0] * len(nodes), 257
    for n, children in enumerate(nodes):
        s = place[n]
        value[s] = values[n]
        if not children:
            continue
        keys = np.array(sorted(children)) + 1
        while used[first]:
            first += 1
        at = first
        while True:
            free = at + np.flatnonzero(~used[at : at + 1024])
            if at + 2048 > len(used):
                grow = len(used)
                used, base = np.r_[used, np.zeros(grow, bool)], np.r_[base, np.zeros(grow, np.int32)]
                check, value = np.r_[check, np.full(grow, -1, np.int32)], np.r_[value, np.full(grow, -1, np.int32)]
                continue
            fits = free[~used[(free - keys[0])[:, None] + keys].any(1)]
            if len(fits):
                b = int(fits[0] - keys[0])
                break
            at += 1024
        base[s] = b
        used[b + keys] = True
        check[b + keys] = s
        for c in children:
            place[children[c]] = b + c + 1
    end = int(np.flatnonzero(used)[-1]) + 260
    return base[:end], check[:end], value[:end]


def read_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    order = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
    pieces, scores, bytes_at = [b""] * n, np.full(n, -math.log(len(plain) + 2)), np.full(256, -1, np.int32)
    for i in range(n):
        if model.is_byte(i):
            c = int(model.id_to_piece(i)[3:5], 16)
            bytes_at[c], pieces[i] = i, bytes([c])
        elif i in order:
            text = model.id_to_piece(i).replace(MARKER, " ")
            if " " in text.lstrip(" ") or "\n" in text:
                raise ValueError("a piece crosses the bounds of segments")
            pieces[i], scores[i] = text.encode(), -math.log(order[i] + 2)
    if bytes_at.min() < 0:
        raise ValueError("the vocabulary has no byte pieces")
    base, check, value = double_array({pieces[i]: i for i in plain})
    scores[bytes_at] = scores.min() - FALLBACK
    return Vocabulary(pieces, scores, bytes_at, base, check, value, max(map(len, pieces)))


def char_lengths(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def solve(v: Vocabulary, segments: list[bytes]) -> list[bytes]:
    """The ids (int32 in bytes) of the best segmentation of each segment, all in lockstep."""
    n, lens = len(segments), np.array([len(s) for s in segments])
    width = int(lens.max()) + 4
    text = np.zeros((n, width), np.uint8)
    for i, s in enumerate(segments):
        text[i, : len(s)] = np.frombuffer(s, np.uint8)
    best, piece, start = np.full((n, width + 1), FAR), np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int32)
    best[:, 0] = 0
    unknown = v.fallback
    for i in range(int(lens.max())):
        rows = np.flatnonzero((lens > i) & (best[:, i] > FAR))
        if not len(rows):
            continue
        here, own = best[rows, i], np.zeros(len(rows), bool)
        size = char_lengths(text[rows, i])
        at, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for j in range(i, min(i + v.longest, int(lens.max()))):
            to = v.base[state] + text[rows[at], j] + 1
            ok = (v.check[to] == state) & (lens[rows[at]] > j)
            at, state = at[ok], to[ok].astype(np.int64)
            if not len(at):
                break
            ids = v.value[state]
            hit = ids >= 0
            a, k = at[hit], ids[hit]
            score, r = here[a] + v.scores[k], rows[a]
            better = score > best[r, j + 1]
            r, k = r[better], k[better]
            best[r, j + 1], piece[r, j + 1], start[r, j + 1] = score[better], k, i
            own[a[size[a] == j + 1 - i]] = True
        bare = np.flatnonzero(~own)
        r, end = rows[bare], i + size[bare]
        score = here[bare] + unknown
        better = score > best[r, end]
        r, end = r[better], end[better]
        best[r, end], piece[r, end], start[r, end] = score[better], -1, i
    out = []
    for s, m, p, b in zip(segments, lens.tolist(), piece.tolist(), start.tolist(), strict=True):
        ids: list[int] = []
        while m:
            k = b[m]
            ids += [p[m]] if p[m] >= 0 else v.bytes_at[list(s[k:m])][::-1].tolist()
            m = k
        out.append(np.array(ids[::-1], np.int32).tobytes())
    return out


def solve_alone(v: Vocabulary, s: bytes) -> bytes:
    """The same for one long segment."""
    base, check, value, scores, unknown = v.base, v.check, v.value, v.scores, v.fallback
    best, piece, start = [FAR] * (len(s) + 5), [-1] * (len(s) + 5), [0] * (len(s) + 5)
    best[0] = 0.0
    for i in range(len(s)):
        here = best[i]
        if here == FAR:
            continue
        size, own, state = int(char_lengths(np.uint8(s[i]))), False, 0
        for j in range(i, min(i + v.longest, len(s))):
            to = int(base[state]) + s[j] + 1
            if check[to] != state:
                break
            state = to
            k = int(value[state])
            if k >= 0:
                own |= size == j + 1 - i
                if (score := here + float(scores[k])) > best[j + 1]:
                    best[j + 1], piece[j + 1], start[j + 1] = score, k, i
        if not own and (score := here + unknown) > best[i + size]:
            best[i + size], piece[i + size], start[i + size] = score, -1, i
    ids, m = [], len(s)
    while m:
        k = start[m]
        ids += [piece[m]] if piece[m] >= 0 else v.bytes_at[list(s[k:m])][::-1].tolist()
        m = k
    return np.array(ids[::-1], np.int32).tobytes()


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known = v, {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        new = sorted({s for x in split for s in x} - self.known.keys(), key=len)
        coded = [(s, s.encode("utf-8")) for s in new]
        short, long = [x for x in coded if len(x[1]) <= LONG], [x for x in coded if len(x[1]) > LONG]
        for i in range(0, len(short), TOGETHER):
            part = short[i : i + TOGETHER]
            self.known.update(zip((s for s, _ in part), solve(self.v, [b for _, b in part]), strict=True))
        own = {s: solve_alone(self.v, b) for s, b in long}
        get = (self.known | own if own else self.known).__getitem__
        return [None if t is None else np.frombuffer(b"".join(map(get, s)), np.int32) for t, s in zip(texts, split, strict=True)]


def list_array(parts: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0 if p is None else len(p) for p in parts])
    at = pa.array(np.r_[0, ends].astype(np.int32), mask=np.array([p is None for p in parts] + [False]))
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([p for p in parts if p is not None] or [np.array([], np.int32)])))


def vocabulary_for(spark: SparkSession, path: str):
    """The vocabulary, broadcast: its size is the file's, whatever the data."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(docs: DataFrame, vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column ids (array of int) after its own; a column of that name is replaced."""
    prepare(docs.sparkSession)
    columns = [c for c in docs.columns if c != ids]
    rows = docs.select(*columns)

    def make() -> Callable[[pa.RecordBatch], dict]:
        encoder, at = Encoder(vocabulary.value), columns.index(text)
        return lambda b: dict(zip(columns, b.columns, strict=True)) | {ids: list_array(encoder(b.column(at).to_pylist()))}

    return map_rows(rows, T.StructType([*rows.schema, T.StructField(ids, T.ArrayType(T.IntegerType()))]), make)


def decoded_texts(v: Vocabulary, lists: pa.ListArray) -> list[str | None]:
    get, parts = v.pieces.__getitem__, []
    flat, ends, null = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_null().to_pylist()
    for k in range(len(lists)):
        parts.append(None if null[k] else b"".join(map(get, flat[ends[k] : ends[k + 1]].tolist()))[1:].decode("utf-8"))
    return parts


def decode(rows: DataFrame, vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with a column text after its own, decoded from ids."""
    prepare(rows.sparkSession)
    columns = [c for c in rows.columns if c != text]

    def make() -> Callable[[pa.RecordBatch], dict]:
        at = columns.index(ids)
        return lambda b: dict(zip(columns, b.columns, strict=True)) | {text: decoded_texts(vocabulary.value, b.column(at))}

    rows = rows.select(*columns)
    return map_rows(rows, T.StructType([*rows.schema, T.StructField(text, T.StringType())]), make)


def encode_checked(docs: DataFrame, vocabulary, text: str = "text", ids: str = "ids", checked: str = "round_trip") -> DataFrame:
    """docs with ids and whether decoding them gives the text back: encode and decode in one pass, so that a task has one Python worker."""
    prepare(docs.sparkSession)
    columns = [c for c in docs.columns if c not in (ids, checked)]
    rows = docs.select(*columns)

    def make() -> Callable[[pa.RecordBatch], dict]:
        encoder, at = Encoder(vocabulary.value), columns.index(text)

        def f(b: pa.RecordBatch) -> dict:
            texts = b.column(at).to_pylist()
            coded = list_array(encoder(texts))
            back = decoded_texts(vocabulary.value, coded)
            return dict(zip(columns, b.columns, strict=True)) | {ids: coded, checked: [x == y for x, y in zip(texts, back, strict=True)]}

        return f

    return map_rows(rows, T.StructType([*rows.schema, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(checked, T.BooleanType())]), make)
