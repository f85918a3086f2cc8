"""Media columns (operator 10): PNG images in binary columns, and low-frequency cosine-transform hashes.

A payload is stored as the samples of an 8-bit RGB image, WIDTH pixels to a row, as a PNG: signature, IHDR, IDAT
chunks of zlib data and IEND, each chunk with its CRC. Reading tests signature, chunk order, lengths and checksums and
undoes the row filters with numpy. The hash takes the low frequencies of a two-dimensional cosine transform of the
luminance, averaged to 32 x 32 cells: one bit for each of 64 coefficients, set where it exceeds their median.

Null and empty texts become one row of spaces. Equal payloads give equal images, hashes and digests. A corrupt image
raises ValueError. Very long payloads make tall images; a task holds one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_rows, prepare

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
STRIDE = WIDTH * CHANNELS
CHUNK = 1 << 16


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An RGB image (rows x STRIDE bytes) with filter Up, which numpy applies to all rows at once."""
    rows = samples.reshape(-1, STRIDE)
    lines = np.empty((len(rows), STRIDE + 1), np.uint8)
    lines[:, 0] = 2
    lines[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=lines[1:, 1:])
    data = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)) + chunk(b"IEND", b"")


def paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the five row filters. Runs of rows with filter None, Sub or Up are done with whole-array sums modulo 256."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    above = np.zeros(rows.shape[1], np.uint8)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(kinds) else np.array([], int)
    for lo, hi in zip(starts, np.r_[starts[1:], len(kinds)], strict=True):
        part, kind = rows[lo:hi], kinds[lo]
        if kind == 1:
            part[:] = np.cumsum(part.reshape(len(part), -1, bpp), axis=1, dtype=np.uint8).reshape(part.shape)
        elif kind == 2:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind > 2:
            for row in part:
                for i in range(len(row)):
                    left, up, corner = (int(row[i - bpp]) if i >= bpp else 0), int(above[i]), (int(above[i - bpp]) if i >= bpp else 0)
                    row[i] = (int(row[i]) + ((left + up) // 2 if kind == 3 else paeth(left, up, corner))) & 255
                above = row
        above = part[-1]
    return rows


def read_png(data: bytes) -> np.ndarray:
    """The samples (rows x bytes a row) of a PNG with 8-bit samples and no interlacing, after testing its checksums."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk is cut short or its checksum is wrong")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("IHDR must come first, once")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("unfinished, or of a kind that isn't read here")
    width, height, bpp = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(height, width * bpp + 1), bpp)


#: Rows 1 to 8 of the 32-point cosine transform.
COS = np.cos(np.pi * np.arange(1, 9)[:, None] * (np.arange(32)[None] + 0.5) / 32)


def cells(n: int) -> np.ndarray:
    """Bounds that cut n rows into 32 cells, none empty."""
    return np.linspace(0, n, 33).astype(int)


def dct_hash(samples: np.ndarray) -> str:
    """16 hex digits from the low frequencies of the luminance."""
    grey = samples.reshape(len(samples), WIDTH, CHANNELS).astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    grey = grey.reshape(len(grey), 32, WIDTH // 32).mean(2)
    if len(grey) < 32:
        grey = grey[np.arange(32) * len(grey) // 32]
    else:
        at = cells(len(grey))
        grey = np.add.reduceat(grey, at[:-1], axis=0) / np.diff(at)[:, None]
    low = np.round(COS @ grey @ COS.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    body = (text or "").encode("utf-8", "surrogatepass")
    return len(body), body.ljust(max(1, -(-len(body) // STRIDE)) * STRIDE)


def media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media: each text as a PNG in a binary column."""
    prepare(docs.sparkSession)

    def make() -> Callable[[pa.RecordBatch], dict]:
        def f(b: pa.RecordBatch) -> dict:
            n, images = [], []
            for t in b.column(1).to_pylist():
                size, body = payload_of(t)
                n.append(size)
                images.append(write_png(np.frombuffer(body, np.uint8)))
            return {"k": b.column(0), "n_bytes": n, "media": images}

        return f

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_rows(rows, f"k {rows.schema['k'].dataType.simpleString()}, n_bytes long, media binary", make).withColumnRenamed("k", key)


def features(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored images back: digests of payload and image, and the hash."""
    prepare(images.sparkSession)

    def make() -> Callable[[pa.RecordBatch], dict]:
        def f(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for image in b.column(2).to_pylist():
                samples = read_png(image)
                body = samples.tobytes()
                for c, v in zip(out, (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(image), hashlib.sha256(image).hexdigest(), dct_hash(samples)), strict=True):
                    out[c].append(v)
            return out | {"k": b.column(0), "n_bytes": b.column(1)}

        return f

    rows = images.select(F.col(key).alias("k"), "n_bytes", "media")
    return map_rows(rows, f"k {rows.schema['k'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make).withColumnRenamed("k", key)
