"""Filling fixed-capacity containers with texts.

Method: best-two-fit. A bin is filled greedily with the largest items that fit; then its smallest item is
replaced by two unpacked items if they fit the gap it leaves more tightly. Sizes are tokens of a public
tokenizer. An item is split only if it alone exceeds the capacity.

Items are hashed over the partitions (so no owner or source can make one large), and each partition packs
its own: beside the sizes nothing is moved, and only the last bin or so of a partition stays unfilled.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from mnemora.llm.common import batch

#: Vocabulary file of the tokenizer (ranks of a byte-level BPE).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ITEM = pa.schema([("doc_id", pa.int64()), ("part_no", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64())])
_ITEM_DDL = "doc_id long, part_no long, start_token long, n_tokens long"
_BIN = pa.schema([("bin_id", pa.string()), *_ITEM])
_BIN_DDL = "bin_id string, " + _ITEM_DDL
_ENCODINGS: dict[str, object] = {}


def tokenizer(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, made once in a process."""
    if vocabulary not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[vocabulary]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers. sizes: each from 0 to capacity. Empty input gives no bin.

    Deterministic: among equal sizes the earlier item goes first.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stacks.setdefault(sizes[i], []).append(i)
    empty = stacks.pop(0, [])[::-1]
    free = 0  # bit s is set while an item of size s is unpacked
    for s in stacks:
        free |= 1 << s
    bins: list[list[int]] = []

    def take(s: int) -> int:
        nonlocal free
        own = stacks[s]
        i = own.pop()
        if not own:
            free ^= 1 << s
        return i

    while free:
        gap, own = capacity, []
        while (s := (free & ((2 << gap) - 1)).bit_length() - 1) > 0:
            own.append((s, take(s)))
            gap -= s
        if gap and free and len(own) > 1:
            least, item = own[-1]
            pair = _two(free, stacks, gap + least, least)
            if pair:
                own[-1:] = [(s, take(s)) for s in pair]
                if not stacks.get(least):
                    free |= 1 << least
                stacks.setdefault(least, []).append(item)
        bins.append([i for _, i in own])
    if empty:
        bins[:1] = [(bins[0] if bins else []) + empty]
    return bins


def _two(free: int, stacks: dict[int, list[int]], room: int, more_than: int) -> tuple[int, int] | None:
    """Two unpacked sizes with the largest sum of at most room and above more_than."""
    best, found = more_than, None
    rest = free & ((1 << room) - 1)
    while rest and best < room:
        x = rest.bit_length() - 1
        if 2 * x <= best:  # x is the larger of the two
            break
        below = free & ((2 << min(x, room - x)) - 1)
        y = below.bit_length() - 1
        if y == x and len(stacks[x]) < 2:
            y = (below ^ (1 << x)).bit_length() - 1
        if y > 0 and x + y > best:
            best, found = x + y, (x, y)
        rest ^= 1 << x
    return found


def items(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """The items to pack: doc_id, part_no, start_token, n_tokens. A text above the capacity gives several parts.

    Null texts are no items, an empty text is one of size 0; a redelivered row counts once.
    """

    documents.sparkSession.sparkContext.addFile(vocabulary)  # executors fetch it, wherever the driver has it
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(name)).encode_ordinary
        for rb in batches:
            rows: list[tuple[int, int, int, int]] = []
            for key, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                n = len(encode(text))
                rows += [(key, k, a, min(capacity, n - a)) for k, a in enumerate(range(0, max(n, 1), capacity))]
            if rows:
                yield batch(_ITEM, **dict(zip(_ITEM.names, zip(*rows, strict=True), strict=True)))

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(count, _ITEM_DDL)


def bins(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text, or part of a text above the capacity, with its bin: bin_id, doc_id, part_no, start_token, n_tokens.

    A bin is named after its first item. An empty table gives no rows; extra columns are ignored.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in rb.columns]) for rb in batches if rb.num_rows]
        if not parts:
            return
        doc, part, start, size = np.concatenate(parts, axis=1)
        order = np.lexsort((part, doc))
        doc, part, start, size = doc[order], part[order], start[order], size[order]
        rows, names = [], []
        for own in pack(size.tolist(), capacity):
            rows += own
            names += [f"{doc[own[0]]}-{part[own[0]]}"] * len(own)
        for a in range(0, len(rows), 10_000):
            k = rows[a : a + 10_000]
            yield batch(_BIN, bin_id=names[a : a + 10_000], doc_id=doc[k], part_no=part[k], start_token=start[k], n_tokens=size[k])

    return items(documents, capacity, vocabulary).repartition("doc_id").dropDuplicates(["doc_id", "part_no"]).mapInArrow(fill, _BIN_DDL)
