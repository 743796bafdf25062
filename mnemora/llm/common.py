"""Helpers shared by the text operators: code-point batches and typed Arrow maps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points handled at once inside a Python worker; bounds its memory whatever the batch holds.
CHUNK = 1 << 20


def chunks(lengths: Iterable[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `most` code points (one longer text stands alone)."""
    start = size = n = 0
    for n, k in enumerate(lengths):
        if size and size + k > most:
            yield start, n
            start, size = n, 0
        size += k
        n += 1
    if n > start:
        yield start, n


def codepoints(texts: list[str]) -> np.ndarray:
    """The code points of the joined texts."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def offsets(texts: list[str]) -> np.ndarray:
    """Start of every text within `codepoints(texts)`, and the end."""
    out = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that neighbouring inputs give unrelated hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    """A record batch of the given columns, in the schema's order and types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def plain_thread(col: Column) -> Column:
    """A thread id in its plain form: without padding and without the session URI around it; blank gives null."""
    bare = F.regexp_replace(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), r"^\w+://session/([^/]*).*$", "$1")
    return F.when(bare != "", bare)


def not_blank(col: Column) -> Column:
    """True where the text holds anything but Unicode white space; false for null."""
    return F.coalesce(col.rlike(r"(?U)\S"), F.lit(False))
