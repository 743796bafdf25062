"""Missing or wrong language labels.

Method: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, then calibrated by a temperature on held-out
sentences. Every text is cut into sentences, each sentence is classified, and a sentence keeps a language other
than its record's main one only where the odds are clear.

The model is fitted on a bounded sample of labelled documents (`SAMPLE_DOCUMENTS` of each language,
`SAMPLE_SENTENCES` sentences), its document frequencies included; every record is classified over its whole
text. Records are only mapped; the results, not the texts, are shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.common import batch, chunks, codepoints, mix64

#: Bounds of the training sample: documents and sentences of each language, characters of a document.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES, SAMPLE_CHARS = 400, 3000, 6000
#: Hashed features; n-grams of one to three characters.
FEATURES, ORDERS = 1 << 15, 3
#: FTRL-proximal: learning rate, its smoothing, and the elastic-net penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.001, 0.0005
#: Log odds that a sentence needs to stand against its record's main language.
CLEAR = 1.5

OTHER, SPACE, NEWLINE, DOT, STOP, CJK_STOP, OPEN, CLOSE, LATIN, IDEOGRAPH, KANA, CYRILLIC = range(12)
_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; the last entry stands for all others."""
    global _CLASSES
    if _CLASSES is None:
        t = np.zeros(0x10001, dtype=np.uint8)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isspace():
                t[c] = SPACE
            elif unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Mn":
                t[c] = LATIN
        t[0x3400:0xA000] = IDEOGRAPH
        t[0xF900:0xFB00] = IDEOGRAPH
        t[0x3041:0x3100] = KANA
        t[0x0400:0x0530] = CYRILLIC
        t[[10, 13, 0x2028, 0x2029]] = NEWLINE
        t[ord(".")] = DOT
        for chars, k in (("!?…", STOP), ("。！？", CJK_STOP), ("“«„¿¡([{「『（【", OPEN), ("”»)]}」』）】", CLOSE)):
            t[[ord(x) for x in chars]] = k
        _CLASSES = t
    return _CLASSES


@dataclass
class Cut:
    """Sentences of a batch of texts: their range in the joined texts, record number, and whether they are whole."""

    cp: np.ndarray
    start: np.ndarray
    end: np.ndarray
    record: np.ndarray
    whole: np.ndarray
    letters: np.ndarray


def cut_sentences(texts: list[str]) -> Cut:
    """Cut lower-cased texts at line ends, stops, and before opening and after closing brackets and quotes.

    A whole sentence ends with a stop and has at least five ideographs or kana, or three words of twelve
    letters in all. In a record without one, a piece of four words or of eight ideographs that lacks the
    stop but is little else than letters and blanks counts as whole.
    """
    cp = codepoints([x + "\n" for x in texts])
    k = _classes()[np.minimum(cp, 0x10000)]
    after = np.append(k[1:], NEWLINE)
    stop = ((k == DOT) | (k == STOP)) & ((after != LATIN) & (after != OTHER) & (after != DOT) & (after != STOP)) | (k == CJK_STOP)
    ends = stop | (k == NEWLINE) | (k == CLOSE) | (after == OPEN)
    end = np.flatnonzero(ends) + 1
    start = np.append(0, end[:-1])
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    record = np.searchsorted(np.cumsum(size), start, "right")
    word = (k == LATIN) | (k == CYRILLIC)
    east = (k == IDEOGRAPH) | (k == KANA)
    apart = np.isin(k, (SPACE, NEWLINE, OPEN, CLOSE, CJK_STOP, IDEOGRAPH, KANA))  # so a link or an address is at most one word
    begins = word & np.append(True, apart[:-1])

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[end] - total[start]

    words, letters, wide = count(begins), count(word), count(east)
    enough = (wide >= 5) | ((words >= 3) & (letters >= 12))
    whole = enough & stop[end - 1]
    has = np.zeros(len(texts), dtype=bool)
    has[record[whole]] = True
    prose = count(word | east | (k == SPACE) | (k == NEWLINE)) >= 0.85 * (end - start)
    whole |= ((wide >= 8) | ((words >= 4) & (letters >= 16))) & prose & ~has[record]
    return Cut(cp, start, end, record, whole, letters + 3 * wide)


def _grams(cut: Cut, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the chosen sentences in order, and where each sentence's begin. Non-letters count as blanks."""
    size = cut.end[which] - cut.start[which]
    first = np.append(0, np.cumsum(size))
    at = np.repeat(cut.start[which] - first[:-1], size) + np.arange(first[-1])
    c = cut.cp[at]
    k = _classes()[np.minimum(c, 0x10000)]
    c = np.where(k >= LATIN, c, 32).astype(np.uint64)
    c[first[:-1]] = 32  # so that n-grams that cross into the sentence before look alike
    one = c
    two = np.append(np.uint64(32), c[:-1])
    three = np.append(np.uint64(32), two[:-1])
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    hashed = [mix64(one + np.uint64(1 << 62)) >> shift, mix64(one + (two << np.uint64(21)) + np.uint64(1 << 61)) >> shift, mix64(one + (two << np.uint64(21)) + (three << np.uint64(42))) >> shift]
    return np.stack(hashed[:ORDERS], axis=1).astype(np.int32).ravel(), first * ORDERS


@dataclass
class Model:
    """weights: IDF-weighted weights by feature and language, then the squared IDF; temperature divides the scores."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def log_odds(self, cut: Cut, which: np.ndarray) -> np.ndarray:
        """Calibrated log probabilities of the chosen sentences by language."""
        out = np.empty((len(which), len(self.languages)))
        size = cut.end[which] - cut.start[which]
        k = 0
        total = np.append(0, np.cumsum(size))
        while k < len(which):  # a bounded number of characters at once
            j = max(k + 1, int(np.searchsorted(total, total[k] + (1 << 16), "right")) - 1)
            f, first = _grams(cut, which[k:j])
            sums = np.add.reduceat(self.weights[f], first[:-1], axis=0)
            out[k:j] = sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1e-9)) + self.bias
            k = j
        out /= self.temperature
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def _plain(text: str) -> str:
    """Without accents, unless that changes what is written (ideographs, kana, Cyrillic)."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn") if all(ord(c) < 0x370 or ord(c) > 0x1FFF and ord(c) < 0x3000 for c in text) else text


def fit(sentences: list[tuple[str, str]]) -> Model:
    """Fit on (language, sentence) pairs; every sixth is held out for the temperature.

    Sentences are also learned without their accents.
    """
    languages = sorted({lang for lang, _ in sentences})
    rows = list(dict.fromkeys(sentences))
    drawn = np.random.default_rng(3).permutation(len(rows))
    apart = {int(i) for i in drawn[::6]}  # held out before the plain forms are added, so that these follow their sentence
    every = [(*row, i in apart) for i, row in enumerate(rows)]
    every += [(lang, y, out) for lang, x, out in every if (y := _plain(x)) != x]
    order = np.random.default_rng(3).permutation(len(every))
    held = np.array([every[i][2] for i in order])
    rows = [row[:2] for row in every]
    texts = [rows[i][1] for i in order]
    label = np.array([languages.index(rows[i][0]) for i in order])
    cut = cut_sentences([x.replace("\n", " ") for x in texts])
    # One row of features for each text, whatever the cutting makes of it.
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    ends = np.cumsum(size)
    cut.start, cut.end = ends - size, ends
    f, first = _grams(cut, np.arange(len(texts)))
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(first))
    seen = np.unique(owner * FEATURES + f) % FEATURES
    idf = np.log((1 + n) / (1 + np.bincount(seen, minlength=FEATURES))) + 1
    norm = np.sqrt(np.add.reduceat(idf[f] ** 2, first[:-1]))
    z, g2 = np.zeros((FEATURES, len(languages))), np.zeros((FEATURES, len(languages)))
    bias = np.zeros(len(languages))

    def solve(k: np.ndarray | slice) -> np.ndarray:
        w = -(z[k] - np.sign(z[k]) * L1) / ((BETA + np.sqrt(g2[k])) / ALPHA + L2)
        return np.where(np.abs(z[k]) <= L1, 0, w)

    train = np.flatnonzero(~held)
    for _ in range(3):
        for a in range(0, len(train), 128):
            own = train[a : a + 128]
            length = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
            feature, row = f[at], np.repeat(np.arange(len(own)), length)
            value = idf[feature] / norm[own][row]
            keys, place = np.unique(feature, return_inverse=True)
            x = np.bincount(row * len(keys) + place, value, len(own) * len(keys)).reshape(len(own), len(keys))
            w = solve(keys)
            p = x @ w + bias
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), label[own]] -= 1
            g = x.T @ p
            sigma = (np.sqrt(g2[keys] + g * g) - np.sqrt(g2[keys])) / ALPHA
            z[keys] += g - sigma * w
            g2[keys] += g * g
            bias -= 0.02 * p.mean(axis=0)
    weights = np.concatenate([solve(slice(None)) * idf[:, None], idf[:, None] ** 2], axis=1).astype(np.float32)
    model = Model(languages, weights, bias, 1.0)
    scores = model.log_odds(cut, np.flatnonzero(held))
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 5, 40):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), label[held]]).mean()
        best = min(best, (float(loss), float(t)))
    model.temperature = best[1]
    return model


def training_sentences(documents: DataFrame) -> list[tuple[str, str]]:
    """Whole sentences of a bounded sample: of each language the documents with the smallest hashes."""
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = (
        documents.where("lang IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", "lang", F.xxhash64("doc_id", F.lit(1)).alias("h"))
        .withColumn("n", ranked)
        .where(F.col("n") <= SAMPLE_DOCUMENTS)
        .select("doc_id")
    )
    # At most SAMPLE_DOCUMENTS ids a language are broadcast, so no other document's text is shuffled.
    rows = documents.join(F.broadcast(picked), "doc_id").select("lang", F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).sort("lang", F.xxhash64("text"))
    found: dict[str, dict[str, None]] = {}
    for row in rows.toLocalIterator():
        own = found.setdefault(row["lang"], {})
        if len(own) < SAMPLE_SENTENCES:
            cut = cut_sentences([row["text"].lower()])
            for a, b in zip(cut.start[cut.whole], cut.end[cut.whole], strict=True):
                own["".join(map(chr, cut.cp[a:b])).strip()] = None
    return [(lang, x) for lang, own in found.items() for x in list(own)[:SAMPLE_SENTENCES]]


_OUT = pa.schema(
    [
        ("table_name", pa.string()),
        ("record_id", pa.string()),
        ("label", pa.string()),
        ("langs", pa.list_(pa.string())),
        ("segments", pa.list_(pa.struct([("start_at", pa.int64()), ("end_at", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))),
    ]
)
_OUT_DDL = "table_name string, record_id string, label string, langs array<string>, segments array<struct<start_at: long, end_at: long, lang: string, confidence: double>>"


def assign(texts: list[str], model: Model) -> Iterator[tuple[int, bool, list[tuple[int, int, str, float]]]]:
    """(record number, whether it holds whole sentences, pieces as (start, end, language, confidence)) of each record with letters.

    The pieces are the whole sentences; of a record without one they are whatever holds letters, at half the confidence.
    """
    cut = cut_sentences([x if len(low := x.lower()) != len(x) else low for x in texts])
    has = np.zeros(len(texts) + 1, dtype=bool)
    has[cut.record[cut.whole]] = True
    which = np.flatnonzero(cut.whole | ((cut.letters > 0) & ~has[np.minimum(cut.record, len(texts))]))
    if not len(which):
        return
    log = model.log_odds(cut, which)
    record = cut.record[which]
    edge = np.flatnonzero(np.append(True, record[1:] != record[:-1]))
    weight = np.sqrt(cut.letters[which])[:, None]
    main = np.add.reduceat(log * weight, edge, axis=0).argmax(axis=1)
    main = np.repeat(main, np.diff(np.append(edge, len(record))))
    rows = np.arange(len(which))
    best = log.argmax(axis=1)
    lang = np.where(log[rows, best] - log[rows, main] > CLEAR, best, main)
    confidence = np.exp(log[rows, lang]) * np.where(has[record], 1.0, 0.5)
    base = np.append(0, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1))
    for a, b in zip(edge, np.append(edge[1:], len(which)), strict=True):
        r = int(record[a])
        yield r, bool(has[r]), [
            (int(cut.start[which[i]] - base[r]), int(cut.end[which[i]] - base[r]), model.languages[lang[i]], round(float(confidence[i]), 6)) for i in range(a, b)
        ]


def detect(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Languages of every record: table_name, record_id, label, langs (with at least one whole sentence), segments.

    records: table_name, record_id, content, label (further columns are ignored); documents: doc_id, text,
    lang, to learn from. segments are neighbouring sentences of one language with their lowest confidence; a text
    without a whole sentence has segments at half the model's confidence, but no langs. Null, empty and language-free texts have empty arrays; equal rows give equal results. Without labelled
    documents to learn from every record counts as language-free.
    """
    spark = records.sparkSession
    sentences = training_sentences(documents)
    shared = spark.sparkContext.broadcast(fit(sentences) if len({x for x, _ in sentences}) > 1 else None)  # FEATURES x languages

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = [x or "" for x in rb.column(2).to_pylist()]
            langs: list[list[str]] = [[] for _ in texts]
            segments: list[list[dict[str, object]]] = [[] for _ in texts]
            for a, b in chunks(map(len, texts), 1 << 19) if shared.value else ():
                for k, whole, found in assign(texts[a:b], shared.value):
                    langs[a + k] = sorted({x[2] for x in found}) if whole else []
                    merged: list[dict[str, object]] = []
                    for start, end, lang, sure in found:
                        if merged and merged[-1]["lang"] == lang:
                            merged[-1]["end_at"] = end
                            merged[-1]["confidence"] = min(merged[-1]["confidence"], sure)
                        else:
                            merged.append({"start_at": start, "end_at": end, "lang": lang, "confidence": sure})
                    segments[a + k] = merged
            yield batch(_OUT, table_name=rb.column(0), record_id=rb.column(1), label=rb.column(3), langs=langs, segments=segments)

    return records.where("record_id IS NOT NULL").select("table_name", "record_id", "content", "label").mapInArrow(find, _OUT_DDL)


def mislabelled(detected: DataFrame, lang_aliases: DataFrame) -> DataFrame:
    """Records whose label is missing or wrong, or whose text mixes languages: table_name, record_id, lang (a row each)."""
    known = F.broadcast(lang_aliases.select(F.col("alias").alias("label"), F.col("lang").alias("_said")).dropna().dropDuplicates(["label"]))  # fixed and small
    wrong = F.col("_said").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("_said"))
    return detected.where(F.size("langs") > 0).join(known, "label", "left").where(wrong).select("table_name", "record_id", F.explode("langs").alias("lang")).distinct()
