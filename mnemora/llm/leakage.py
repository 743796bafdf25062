"""Evaluation texts leaking into training text.

Method: the normalised windows of the test items form a broadcast hash set; every document's windows are
looked up in it, and each hit is verified by extending it in both directions. A shared run of at least
`run` characters holds a whole window of run / 2 characters that starts at a multiple of run / 2 in the
document, so looking up only those windows finds every such run.

The hash set grows with the test items, never with the corpus; `MOST_CHARS` bounds it. Documents are
only mapped, never shuffled.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import batch, chunks, codepoints, mix64, offsets

#: Shared characters, after normalisation, that make a leak.
RUN = 50
#: Bound on the normalised characters of all test items, hence on what is broadcast (about 40 bytes each).
MOST_CHARS = 4_000_000

_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_at", pa.int64()), ("end_at", pa.int64())])
_FOUND_DDL = "doc_id long, item_id long, start_at long, end_at long"
_TABLE: np.ndarray | None = None


def _table() -> np.ndarray:
    """For each code point its lower-case letter or digit, or 0 for what is dropped (categories other than L and N)."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LN":
                kept = [x for x in ch.lower() if unicodedata.category(x)[0] in "LN"]
                t[c] = ord(kept[0]) if kept else 0
        _TABLE = t
    return _TABLE


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits in lower case of the joined texts, where each text starts, and each character's place in the joined texts."""
    raw = _table()[codepoints(texts)]
    kept = np.flatnonzero(raw)
    return raw[kept], np.searchsorted(kept, offsets(texts)), kept


class Probe:
    """The hash set of test windows with the places they come from."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run, self.block = run, run // 2
        texts = [t for _, t in items]
        self.chars, self.start, _ = normalise(texts)
        if len(self.chars) > MOST_CHARS:
            raise ValueError(f"the test items hold {len(self.chars)} characters; at most {MOST_CHARS} are broadcast")
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(items)), np.diff(self.start))
        self.power = np.cumprod(np.append(np.uint64(1), np.full(self.block - 1, 0x9E3779B97F4A7C15, dtype=np.uint64)), dtype=np.uint64)
        at = np.array(
            [p for a, b in zip(self.start[:-1], self.start[1:], strict=True) if b - a >= run for p in range(a, b - self.block + 1)], dtype=np.int64
        )
        windows = np.lib.stride_tricks.sliding_window_view(self.chars, self.block) if len(at) else None
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(self._hash(windows[at[a : a + 100_000]]) for a in range(0, len(at), 100_000))])  # a bounded number at once
        order = np.argsort(hashes, kind="stable")
        self.at, self.hashes = at[order], hashes[order]
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.hashes >> np.uint64(44)] = True

    def _hash(self, windows: np.ndarray) -> np.ndarray:
        return mix64((windows.astype(np.uint64) * self.power).sum(axis=1, dtype=np.uint64))

    def scan(self, texts: list[str]) -> set[tuple[int, int, int, int]]:
        """(text number, item number, start, end) of every longest shared run of at least `run` characters, its range in the joined texts."""
        out: set[tuple[int, int, int, int]] = set()
        if not len(self.at):
            return out
        chars, start, places = normalise(texts)
        first = start[:-1]
        blocks = np.diff(start) // self.block
        if not blocks.sum():
            return out
        text_of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = first[text_of] + nth * self.block
        windows = chars[at[:, None] + np.arange(self.block)]
        h = self._hash(windows)
        hit = np.flatnonzero(self.filter[h >> np.uint64(44)])
        low = np.searchsorted(self.hashes, h[hit], "left")
        high = np.searchsorted(self.hashes, h[hit], "right")
        done: dict[tuple[int, int, int], int] = defaultdict(lambda: -1)
        for k, a, b in zip(hit[high > low], low[high > low], high[high > low], strict=True):
            text, p = int(text_of[k]), int(at[k])
            for q in self.at[a:b]:
                item = int(self.owner[q])
                shift = p - int(q)
                if done[text, item, shift] > p:  # inside a run that is already verified
                    continue
                left = self._same(chars, p - 1, q - 1, start[text], self.start[item], -1)
                right = self._same(chars, p, q, start[text + 1] - 1, self.start[item + 1] - 1, 1)
                done[text, item, shift] = p + right
                if left + right >= self.run:
                    out.add((text, item, int(places[p - left]), int(places[p + right - 1]) + 1))
        return out

    def _same(self, chars: np.ndarray, p: int, q: int, p_end: int, q_end: int, step: int) -> int:
        """Number of equal characters from p and q on, up to and with the given ends."""
        n = min((p_end - p) * step, (q_end - q) * step) + 1
        if n <= 0:
            return 0
        a, b = (chars[p : p + n], self.chars[q : q + n]) if step > 0 else (chars[p - n + 1 : p + 1][::-1], self.chars[q - n + 1 : q + 1][::-1])
        differs = np.flatnonzero(a != b)
        return int(differs[0]) if len(differs) else n


def leaks(documents: DataFrame, eval_items: DataFrame, run: int = RUN) -> DataFrame:
    """Every leaked span: doc_id, item_id, start_at, end_at.

    A row for each run that a document shares with an item and that can't be longer, its range in code points.
    Null and empty texts, and test texts shorter than `run`, match nothing. Rows with the same doc_id and
    text give the same row once; further columns are ignored. The question, the answer and the evidence
    are matched each for itself.
    """
    shared = _probe(documents, eval_items, run)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            base = offsets(texts)
            rows = sorted({(keys[t], int(shared.value.ids[i]), x - int(base[t]), y - int(base[t])) for t, i, x, y in shared.value.scan(texts)})
            if rows:
                yield batch(_FOUND, **dict(zip(_FOUND.names, zip(*rows, strict=True), strict=True)))

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(scan, _FOUND_DDL).distinct()


def _probe(documents: DataFrame, eval_items: DataFrame, run: int) -> Broadcast[Probe]:
    """The probe over all test items, built once."""
    parts = eval_items.select("item_id", F.explode(F.array("question", "answer", "evidence")).alias("t")).where("item_id IS NOT NULL AND t IS NOT NULL")
    total = parts.agg(F.sum(F.char_length("t"))).first()[0] or 0  # checked before anything is collected
    if total > 2 * MOST_CHARS:
        raise ValueError(f"the test items hold {total} characters; at most {2 * MOST_CHARS} are gathered")
    return documents.sparkSession.sparkContext.broadcast(Probe([(r[0], r[1]) for r in parts.orderBy("item_id", "t").collect()], run))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Keys and texts, a bounded number of characters at once."""
    for rb in batches:
        keys, texts = rb.column(0).to_pylist(), rb.column(1).to_pylist()
        for a, b in chunks(map(len, texts)):
            yield keys[a:b], texts[a:b]


def without_spans(documents: DataFrame, eval_items: DataFrame, run: int = RUN) -> DataFrame:
    """The affected documents with every leaked span removed: doc_id, n_removed (characters), text.

    Removed where it is found, so neither texts nor spans are shuffled for it. Spans that overlap are removed
    together; equal rows give one row.
    """
    shared = _probe(documents, eval_items, run)
    schema = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            base = offsets(texts)
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for t, _, x, y in shared.value.scan(texts):
                spans[t].append((x - int(base[t]), y - int(base[t])))
            rows = []
            for t, own in sorted(spans.items()):
                kept, at = [], 0
                for x, y in sorted(own):
                    kept.append(texts[t][at : max(at, x)])
                    at = max(at, y)
                text = "".join([*kept, texts[t][at:]])
                rows.append((keys[t], len(texts[t]) - len(text), text))
            if rows:
                yield batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(clean, "doc_id long, n_removed long, text string").distinct()


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that give no test item away."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
