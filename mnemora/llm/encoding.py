"""Garbled text from wrong character encoding.

Method: a multinomial (naive Bayes) classifier over hashed byte bigrams is trained on lines that are
synthetically garbled by every encoding chain; it predicts the exact chain of each line. The chain is then
inverted, and only an inversion that decodes strictly, garbles back to the same line and reads more like
clean text counts. U+FFFD marks text that cannot be regained.

The classifier is fitted on a bounded sample of lines (`SAMPLE_DOCUMENTS` documents per language label);
every line of every document is classified. Documents are only mapped, never shuffled.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.common import batch, chunks

#: Bounds of the training sample: documents and lines for each language label, lines of a document, characters of a line.
SAMPLE_DOCUMENTS, SAMPLE_LINES, DOCUMENT_LINES, SAMPLE_CHARS = 400, 600, 40, 300
#: Size of the hashed feature space.
FEATURES = 1 << 13
#: Least gain of a repair, in nats: for each bigram, and over the whole text.
GAIN, TOTAL_GAIN = 0.5, 8.0
#: Odds in nats, for each bigram and in all, from which a line that no chain inverts counts as garbled and lost.
CERTAIN = (1.5, 40.0)

_SINGLE = ("latin-1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "iso8859-15", "iso8859-2")
_MULTI = ("gbk", "big5", "cp932", "euc_jp", "euc_kr")


def _chains() -> list[tuple[str, ...]]:
    """Chains as (written as, read as, ...) pairs in the order they happened."""
    out: list[tuple[str, ...]] = [("utf-8", w) for w in (*_SINGLE, *_MULTI)]
    out += [(s, w) for s in ("gbk", "big5", "cp932", "euc_jp", "euc_kr") for w in ("latin-1", "cp1252")]
    out += [(s, w) for s in ("gbk", "big5", "cp932", "euc_jp") for w in ("gbk", "big5", "cp932", "euc_kr") if s != w]
    cyrillic = ("cp1251", "koi8-r", "cp866")
    out += [(s, w) for s in cyrillic for w in (*cyrillic, "cp1252", "latin-1") if s != w]
    out += [("cp1252", w) for w in ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r", "cp866", "gbk", "cp932", "big5")]
    out += [(s, "cp1252") for s in ("mac_roman", "cp437", "cp850")]
    out += [("utf-8", a, "utf-8", b) for a in ("latin-1", "cp1252") for b in ("latin-1", "cp1252")]
    out += [("utf-8", w, "utf-8", w) for w in ("mac_roman", "cp437", "cp1251")]
    return out


CHAINS = _chains()
_TABLES: dict[str, tuple[str, object]] = {}


def _table(name: str) -> tuple[str, object] | None:
    """Decoding table and encoding map of a single-byte encoding; bytes that it leaves undefined stand for themselves."""
    if name in _MULTI or name == "utf-8":
        return None
    if name not in _TABLES:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        table = "".join(chars)
        _TABLES[name] = (table, codecs.charmap_build(table))
    return _TABLES[name]


def _decode(data: bytes, name: str) -> str:
    t = _table(name)
    return codecs.charmap_decode(data, "strict", t[0])[0] if t else data.decode(name)


def _encode(text: str, name: str) -> bytes:
    t = _table(name)
    return codecs.charmap_encode(text, "strict", t[1])[0] if t else text.encode(name)


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """The text as it looks after the chain; None where the chain can't happen to it."""
    try:
        for written, read in zip(chain[::2], chain[1::2], strict=True):
            text = _decode(_encode(text, written), read)
        return text
    except (UnicodeError, ValueError):
        return None


def ungarble(text: str, chain: tuple[str, ...]) -> str | None:
    """The text before the chain, by strict inversion; None where it can't be undone."""
    pairs = list(zip(chain[::2], chain[1::2], strict=True))
    out = text
    try:
        for written, read in reversed(pairs):
            out = _decode(_encode(out, read), written)
    except (UnicodeError, ValueError):
        return None
    return out if out != text and garble(out, chain) == text else None


_HASH: np.ndarray | None = None


def _hash() -> np.ndarray:
    """Hashed feature of each byte bigram."""
    global _HASH
    if _HASH is None:
        x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _HASH = (x >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
    return _HASH


def _features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the bigrams that touch a non-ASCII byte, and their features; newlines take part in none."""
    a, b = data[:-1], data[1:]
    at = np.flatnonzero(((a | b) >= 0x80) & (a != 10) & (b != 10))
    return at, _hash()[(a[at].astype(np.int64) << 8) | b[at]]


@dataclass
class Model:
    """weights: log probabilities, features by classes; prior: by class.

    The first n_clean classes are clean text, one for each language label and one of all; the classes
    n_clean + 2 k and n_clean + 2 k + 1 are CHAINS[k] on text in Latin and in other letters.
    """

    weights: np.ndarray
    prior: np.ndarray
    n_clean: int

    def gain(self, old: str, new: str) -> tuple[float, float]:
        """By how much the new text reads more like clean text: for each bigram, and in all."""
        (n, before), (_, after) = (self._clean(x) for x in (old, new))
        return after - before, (after - before) * n

    def _clean(self, text: str) -> tuple[int, float]:
        _, f = _features(np.frombuffer(b"\n" + text.encode("utf-8", "replace") + b"\n", dtype=np.uint8))
        return len(f), float(self.weights[f, : self.n_clean].mean(axis=0).max()) if len(f) else 0.0

    def suspects(self, scores: np.ndarray) -> np.ndarray:
        """Where a chain is likelier than clean text."""
        return scores[:, self.n_clean :].max(axis=1) > scores[:, : self.n_clean].max(axis=1)

    def certain(self, line: str, scores: np.ndarray) -> bool:
        """Whether the line is garbled beyond doubt, even if no chain can be inverted: by CERTAIN nats for each bigram, and in all."""
        n = len(_features(_bytes([line]))[0])
        odds = float(scores[self.n_clean :].max() - scores[: self.n_clean].max())
        return odds > CERTAIN[1] and odds > CERTAIN[0] * n

    def score_lines(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the lines with non-ASCII bytes, and their scores by class."""
        at, f = _features(data)
        if not len(at):
            return np.zeros(0, dtype=np.int64), np.zeros((0, len(self.prior)), dtype=np.float32)
        newline = np.flatnonzero(data == 10)
        line = np.searchsorted(newline, at)
        start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        scores = np.empty((len(start), len(self.prior)), dtype=np.float32)
        step = 1 << 15  # rows of weights gathered at once
        bounds = np.append(start, len(f))
        k = 0
        while k < len(start):
            j = max(k + 1, int(np.searchsorted(bounds, bounds[k] + step, "right")) - 1)
            own = f[bounds[k] : bounds[j]]
            if len(own) > step:  # one very long line
                scores[k] = np.bincount(own, minlength=FEATURES).astype(np.float32) @ self.weights
            else:
                scores[k:j] = np.add.reduceat(self.weights[own], bounds[k:j] - bounds[k], axis=0)
            k = j
        return line[start], scores + self.prior


def _bytes(lines: list[str]) -> np.ndarray:
    return np.frombuffer(("\n" + "\n".join(x.replace("\n", " ") for x in lines) + "\n").encode("utf-8", "replace"), dtype=np.uint8)


def fit(lines: list[tuple[str, str]]) -> Model:
    """Fit on clean (label, line) pairs; lines that prove garbled under a first fit are left out of the second."""
    lines = [(label, x) for label, x in lines if not x.isascii() and "\ufffd" not in x and not _proven(x)]
    model = _fit(lines)
    numbers, scores = model.score_lines(_bytes([x for _, x in lines]))
    suspect = model.suspects(scores)
    bad = {int(n) - 1 for n, s in zip(numbers[suspect], scores[suspect], strict=True) if repaired(lines[int(n) - 1][1], model, s)}
    return _fit([x for n, x in enumerate(lines) if n not in bad]) if bad else model


def _proven(line: str) -> bool:
    """Whether the line is valid UTF-8 under a single-byte reading, which clean text hardly ever is."""
    return any(ungarble(line, ("utf-8", w)) is not None for w in _SINGLE)


def _latin(line: str) -> bool:
    return 2 * sum(c < "\u0250" for c in line if c.isalpha()) > sum(c.isalpha() for c in line)


def _fit(lines: list[tuple[str, str]]) -> Model:
    # Capitals, no-break spaces and typographic marks are as right in clean text as what they stand for.
    clean = lines + [(label, x.upper()) for label, x in lines[::6]] + [(label, x.replace(" ", "\xa0", n)) for n in (3, -1) for label, x in lines[::6]]
    labels = sorted({label for label, _ in lines if label})  # text without a label counts in the class of all only
    scripts = [[x for _, x in lines if _latin(x) == own] for own in (True, False)]
    groups = [[x for label, x in clean if label == own] for own in labels] + [[x for _, x in clean]]
    groups += [[g for x in own if (g := garble(x, chain)) is not None and g != x] for chain in CHAINS for own in scripts]
    counts = np.full((FEATURES, len(groups)), 0.05, dtype=np.float64)
    for k, own in enumerate(groups):
        counts[:, k] += np.bincount(_features(_bytes(own))[1], minlength=FEATURES)
    prior = np.full(len(groups), np.log(0.05 / len(CHAINS) / 2))
    prior[: len(labels) + 1] = np.log(0.95 / (len(labels) + 1))
    prior[[not own for own in groups]] = -1e9
    return Model(np.log(counts / counts.sum(axis=0)).astype(np.float32), prior.astype(np.float32), len(labels) + 1)


_RUN = re.compile(r"[^\x00-\x7f]+(?:[\x40-\x7e]?[^\x00-\x7f]+)*[\x40-\x7e]?")


def _better(old: str, new: str, model: Model, total: float = TOTAL_GAIN) -> bool:
    if "\ufffd" in new or any(("\x7f" <= c <= "\x9f" or c < " ") and c not in old for c in new):
        return False
    # Drawings and marks that stand apart from words are no garbled letters.
    if not any(c.isalpha() or "\x80" <= c <= "\x9f" or old[max(0, i - 1) : i].isalpha() or old[i + 1 : i + 2].isalpha() for i, c in enumerate(old) if not c.isascii()):
        return False
    each, whole = model.gain(old, new)
    return each > GAIN and whole > total


def repaired(line: str, model: Model, scores: np.ndarray, tries: int = 5) -> tuple[str, str] | None:
    """(restored line, chain) if the line is garbled and can be restored, else None.

    The classifier's best chains are tried in order. Where the whole line can't be inverted, its
    non-ASCII runs are inverted each for itself, and those that can't stay as they are.
    """
    clean = scores[: model.n_clean].max()
    order = list(dict.fromkeys(int(k) // 2 for k in np.argsort(-scores[model.n_clean :])[: 2 * tries] if scores[model.n_clean + k] > clean))[:tries]
    for k in order:
        new = ungarble(line, CHAINS[k])
        if new is not None and _better(line, new, model):
            return new, " > ".join(CHAINS[k])
    for k in order:
        new = _RUN.sub(lambda m, c=CHAINS[k]: x if (x := ungarble(m.group(), c)) is not None and _better(m.group(), x, model, 0) else m.group(), line)
        if new != line and _better(line, new, model):
            return new, " > ".join(CHAINS[k])
    return None


_FOUND = pa.schema([("doc_id", pa.int64()), ("chains", pa.list_(pa.string())), ("n_lines", pa.int64()), ("n_lost", pa.int64()), ("text", pa.string())])
_FOUND_DDL = "doc_id long, chains array<string>, n_lines long, n_lost long, text string"


def training_lines(documents: DataFrame) -> list[tuple[str, str]]:
    """(language label, line) pairs of a bounded sample: the documents with the smallest hashes, as many of each language label."""
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    rows = (
        documents.where("text IS NOT NULL")
        .select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("doc_id", F.lit(9)).alias("h"))
        .withColumn("n", ranked)
        .where(F.col("n") <= SAMPLE_DOCUMENTS)
        .select("doc_id", "lang")
    )
    # At most SAMPLE_DOCUMENTS ids a label are broadcast, so no other document's text is shuffled.
    picked = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(rows), "doc_id").select(
        "lang", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x00-\x7f]")).alias("x")
    )
    found: dict[str, list[str]] = {}
    for lang, x in picked.select("lang", F.slice(F.transform("x", lambda v: F.left(v, F.lit(SAMPLE_CHARS))), 1, DOCUMENT_LINES)).sort("lang", F.xxhash64("x")).toLocalIterator():
        own = found.setdefault(lang, [])
        own += x[: max(0, SAMPLE_LINES - len(own))]
    return [(lang, x) for lang, own in found.items() for x in own]


def garbled(documents: DataFrame) -> DataFrame:
    """Affected documents: doc_id, chains, n_lines, n_lost, text.

    chains are those found in the document, n_lines the affected lines, n_lost those that can't be wholly
    regained: with replacement characters, or garbled beyond doubt while no chain inverts them; text has all that can be restored. Null and ASCII-only
    texts are never affected; equal rows give equal results once; further columns are ignored; without a
    document to learn from there is no result.
    """
    lines = training_lines(documents)
    if not lines:
        return documents.sparkSession.createDataFrame([], _FOUND_DDL)
    shared = documents.sparkSession.sparkContext.broadcast(fit(lines))  # FEATURES x chains, whatever the corpus

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for rb in batches:
            keys, texts = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            rows = []
            for a, b in chunks(map(len, texts)):
                rows += [(keys[a + k], *x) for k, x in _affected(texts[a:b], model)]
            if rows:
                yield batch(_FOUND, **dict(zip(_FOUND.names, zip(*rows, strict=True), strict=True)))

    some = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))
    return some.select("doc_id", "text").mapInArrow(find, _FOUND_DDL).distinct()


def _affected(texts: list[str], model: Model) -> Iterator[tuple[int, tuple[list[str], int, int, str]]]:
    split = [t.split("\n") for t in texts]
    first = np.cumsum([0, *map(len, split)])
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), dtype=np.uint8)
    lines, scores = model.score_lines(data)
    suspect = model.suspects(scores) if len(lines) else np.zeros(0, dtype=bool)
    lost_bytes = np.flatnonzero((data[:-2] == 0xEF) & (data[1:-1] == 0xBF) & (data[2:] == 0xBD)) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    lost = set(np.unique(np.searchsorted(np.flatnonzero(data == 10), lost_bytes)).tolist())
    todo = {int(n): s for n, s in zip(lines[suspect], scores[suspect], strict=True)} | {n: None for n in lost}
    by_text: dict[int, list[int]] = {}
    for n in sorted(todo):
        by_text.setdefault(int(np.searchsorted(first, n, "right")) - 1, []).append(n)
    for k, numbers in by_text.items():
        own, chains, n_lines, n_lost = list(split[k]), [], 0, 0
        for n in numbers:
            i = n - int(first[k])
            if n in lost:  # what stands between the replacement characters may still be regained
                pieces = own[i].split("\ufffd")
                for j, piece in enumerate(pieces):
                    at, odds = model.score_lines(_bytes([piece]))
                    fixed = repaired(piece, model, odds[0]) if len(at) else None
                    if fixed:
                        pieces[j] = fixed[0]
                        chains.append(fixed[1])
                own[i] = "\ufffd".join(pieces)
                n_lost += 1
            elif fixed := repaired(own[i], model, todo[n]):
                own[i] = fixed[0]
                chains.append(fixed[1])
            elif model.certain(own[i], todo[n]):
                n_lost += 1
            else:
                continue
            n_lines += 1
        if n_lines:
            yield k, (sorted(set(chains)), n_lines, n_lost, "\n".join(own))
