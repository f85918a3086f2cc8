"""Token counts (operator 4): batch encoding that returns lengths only.

The vocabulary's normaliser and splitter drop white space and no token spans it, so a text's count is the sum of
the counts of its pieces between white space. Each Arrow batch (bounded by rows and bytes) is cut at these safe
boundaries, pieces that the task has met before are looked up, and the rest are encoded in batches of bounded bytes.
A long text is therefore split into many small pieces and a batch never holds more than BATCH_BYTES of new ones.

Nulls and empty texts count 0 tokens and 0 bytes. Repeated rows are counted each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_rows, prepare

#: New pieces go to the encoder in batches of so many bytes at most (one longer piece makes a batch of its own).
BATCH_BYTES = 1 << 20
#: The counts of so many pieces are remembered in a task; pieces of over LONG characters never.
REMEMBERED, LONG = 1_000_000, 64
#: ASCII white space that the splitter of a vocabulary which drops white space is sure to drop.
GAPS = str.maketrans("\t\n\r", "   ")


def by_bytes(pieces: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of pieces balanced by bytes."""
    batch, held = [], 0
    for p in pieces:
        n = len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass"))
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(p)
        held += n
    if batch:
        yield batch


class Counter:
    """Counts of tokens, by piece."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.known: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.encode(pieces, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [t.translate(GAPS).split(" ") if t else [] for t in texts]
        new = {p for s in split for p in s} - self.known.keys()
        own = {"": 0}
        for batch in by_bytes(sorted(new, key=len)):
            own.update(zip(batch, self.lengths(batch), strict=True))
        self.known.update((p, n) for p, n in own.items() if len(p) <= LONG)
        get = (self.known | own if any(len(p) > LONG for p in own) else self.known).__getitem__
        return [sum(map(get, s)) for s in split]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row. path: a vocabulary of the tokenizers library whose splitter drops white space, present on every worker."""
    prepare(docs.sparkSession)

    def make() -> Callable[[pa.RecordBatch], dict]:
        count = Counter(path)
        return lambda b: {"k": b.column(0), "n_bytes": b.column(2), "n_tokens": np.array(count(b.column(1).to_pylist()), np.int64)}

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["k"].dataType.simpleString()
    return map_rows(rows, f"k {kind}, n_bytes long, n_tokens long", make).select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
