"""Splitting oversized items at natural boundaries.

Method: agglomerative merging. An item is first cut into atomic segments; the boundaries between them have
strengths (paragraph, line, sentence, word, none). Adjacent pairs lie in a heap and the weakest boundary is
merged first, while the combined segment plus the overlap still fits the limit. What remains are the cuts.
Only oversized items reach Python; each is independent, and they alone are shuffled, to drop redelivered copies.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import batch

#: Strengths of a boundary, and the pattern of the text that ends a segment there.
PARAGRAPH, LINE, SENTENCE, WORD, NONE = 4, 3, 2, 1, 0
_ENDS = re.compile(r"(?P<p>\n\s*\n\s*)|(?P<l>\n)|(?P<s>[.!?…][\"'”’)\]]*\s+|[。！？]+[」』”’）]*)|(?P<w>\s+)")
_STRENGTH = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "w": WORD}

_PIECES = pa.schema(
    [
        ("table_name", pa.string()),
        ("record_id", pa.string()),
        ("piece_no", pa.int64()),
        ("start_at", pa.int64()),
        ("end_at", pa.int64()),
        ("size", pa.int64()),
        ("piece", pa.string()),
    ]
)
_PIECES_DDL = "table_name string, record_id string, piece_no long, start_at long, end_at long, size long, piece string"


def _atoms(text: str, ends: list[int], most: int) -> tuple[list[int], list[int]]:
    """Atomic segments as their end positions (code points) with the strength of the boundary at each end.

    ends[i] is the size of the first i code points. A segment larger than `most` is cut hard.
    """
    at, strength = [], []
    begin = 0
    for m in _ENDS.finditer(text):
        _add(at, strength, begin, m.end(), _STRENGTH[m.lastgroup], ends, most)
        begin = m.end()
    if begin < len(text):
        _add(at, strength, begin, len(text), PARAGRAPH, ends, most)
    return at, strength


def _add(at: list[int], strength: list[int], begin: int, end: int, kind: int, ends: list[int], most: int) -> None:
    while ends[end] - ends[begin] > most:
        cut = begin + 1
        low, high = begin + 1, end
        while low <= high:
            mid = (low + high) // 2
            if ends[mid] - ends[begin] <= most:
                cut, low = mid, mid + 1
            else:
                high = mid - 1
        at.append(cut)
        strength.append(NONE)
        begin = cut
    at.append(end)
    strength.append(kind)


def split(text: str, max_size: int, overlap: int, unit: str = "chars") -> list[tuple[int, int]]:
    """Pieces of a text as ranges of code points, in order.

    Every piece is at most max_size in the unit (`chars` or `bytes`), the overlap with the piece before
    included. Consecutive pieces overlap by `overlap`; with bytes the overlap starts at the next whole
    character, so it is at most 3 bytes less. A text within the limit is one piece, an empty text none.
    """
    if overlap < 0 or max_size <= overlap + (3 if unit == "bytes" else 0):
        raise ValueError("max_size must exceed the overlap")
    if not text:
        return []
    if unit == "bytes":
        ends = [0]
        for ch in text:
            o = ord(ch)
            ends.append(ends[-1] + (1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4))
    else:
        ends = range(len(text) + 1)
    if ends[-1] <= max_size:
        return [(0, len(text))]
    room = max_size - overlap
    at, strength = _atoms(text, ends, room)
    n = len(at)
    begin = [0, *at[:-1]]
    end = list(at)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = [True] * n
    version = [0] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        """Put the pair (i, its right neighbour) into the heap if it fits."""
        j = right[i]
        if j < n:
            size = ends[end[j]] - ends[begin[i]]
            if size <= (max_size if begin[i] == 0 else room):
                heapq.heappush(heap, (strength[i], size, i, version[i], version[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, _, i, vi, vj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj:
            continue
        end[i], strength[i], right[i], alive[j] = end[j], strength[j], right[j], False
        if right[j] < n:
            left[right[j]] = i
        version[i] += 1
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out = []
    for i in range(n):
        if alive[i]:
            start = begin[i]
            if start:
                floor = ends[start] - overlap
                low, high = 0, start
                while low < high:  # the first whole character at or after the overlap's start
                    mid = (low + high) // 2
                    if ends[mid] >= floor:
                        high = mid
                    else:
                        low = mid + 1
                start = low
            out.append((start, end[i]))
    return out


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        rows: list[list[object]] = [[] for _ in _PIECES]
        for name, key, text, unit, most, overlap in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            for k, (a, b) in enumerate(split(text, most, overlap, unit)):
                piece = text[a:b]
                size = len(piece) if unit == "chars" else len(piece.encode("utf-8", "surrogatepass"))
                for column, value in zip(rows, (name, key, k + 1, a, b, size, piece), strict=True):
                    column.append(value)
            if len(rows[0]) >= 2000:
                yield batch(_PIECES, **dict(zip(_PIECES.names, rows, strict=True)))
                rows = [[] for _ in _PIECES]
        if rows[0]:
            yield batch(_PIECES, **dict(zip(_PIECES.names, rows, strict=True)))


def size_of(text: Column, unit: Column) -> Column:
    """Size in code points or UTF-8 bytes."""
    return F.when(unit == "bytes", F.octet_length(text)).otherwise(F.char_length(text))


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items larger than their limit: table_name, record_id, text, unit, max_size, overlap_size.

    items: table_name, record_id, field_name, text (further columns are ignored). Null text is no item.
    """
    l = limits.where(F.col("unit").isin("chars", "bytes")).select(
        F.col("table_name").alias("_t"), F.col("field_name").alias("_f"), "unit", F.col("max_size").cast("int"), F.col("overlap_size").cast("int")
    )
    return (
        items.join(F.broadcast(l), (F.col("table_name") == F.col("_t")) & (F.col("field_name") == F.col("_f")))  # the limits are a fixed, small table
        .where(size_of(F.col("text"), F.col("unit")) > F.col("max_size"))
        .select("table_name", "record_id", "text", "unit", "max_size", "overlap_size")
    )


def pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every oversized item: table_name, record_id, piece_no, start_at, end_at, size, piece.

    start_at and end_at are code points of the text. Redelivered records give the same pieces once.
    An empty table gives no rows; an item of exactly max_size is not cut.
    """
    big = oversized(items, limits).dropDuplicates(["table_name", "record_id", "text"])
    return big.mapInArrow(_split_batches, _PIECES_DDL)
