"""Near-duplicate records with small edits.

Method: many universal hash minima with banding. Every distinct text gets HASHES minima over its set of
four-character runs; texts that agree on a whole band of ROWS are candidates. A 192-bit sketch of the minima travels
with each band row, so that a candidate is verified by signature where it arises; what remains is verified
exactly on the texts. Groups are the connected components of the links, by alternating large-star and
small-star.

Exact copies are one text: they share a fingerprint, so a text that a third of all rows repeat is one row in
each bucket. A bucket of more than HOT texts is cut into blocks, and pairs of blocks are spread over tasks.
At similarity 0.7 a pair is missed with probability (1 - 0.7^4)^20 = 0.004, at 0.75 with 0.0005.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import batch, chunks, codepoints, mix64, offsets
from mnemora.session import cut

RUN, THRESHOLD = 4, 0.7
ROWS, BANDS, HASHES = 4, 20, 96
#: Two bits of each of so many minima are the sketch.
SKETCHED = 96
#: Least signature similarity of a candidate: THRESHOLD less 3.5 standard deviations of the sketch's estimate.
SIGNATURE = THRESHOLD - 3.5 * (THRESHOLD * (1 - THRESHOLD) / SKETCHED + (1 - THRESHOLD) / (2 * SKETCHED)) ** 0.5
#: Texts of a bucket that one task compares at once.
HOT = 4096
#: Copies of one text that are expanded into all their pairs; of more, each is paired with the smallest id only, and
#: `groups` names everyone's class, from which the other pairs follow.
COPIES = 200
#: Texts of a bucket from which it is spread over tasks, and the share of the texts that tell which buckets are that large.
SPREAD, DRAWN = 4 * HOT, 64

_BAND = pa.schema([("band", pa.int64()), ("fp", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("side", pa.int8())])
_BAND_DDL = "band long, fp long, s0 long, s1 long, s2 long, side byte"
_CANDIDATE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_CANDIDATE_DDL = "a long, b long"


def _constants() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the universal hash functions, from a fixed seed."""
    rng = np.random.default_rng(20240229)
    n = HASHES
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _minima(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts with at least one run, and their minima (functions by texts)."""
    at = offsets(texts)
    cp = codepoints(texts).astype(np.uint64)
    n = np.diff(at)
    own = np.flatnonzero(n >= RUN)
    if not len(own):
        return own, np.zeros((HASHES, 0), dtype=np.uint32)
    gram = mix64(cp[:-3] * np.uint64(0x9E3779B97F4A7C15) + cp[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + cp[2:-1] * np.uint64(0x165667B19E3779F9) + cp[3:] * np.uint64(0x27D4EB2F165667C5))
    gram = (gram >> np.uint64(32)).astype(np.uint32)
    inside = np.ones(len(gram), dtype=bool)  # runs that cross into the next text don't count
    for back in (1, 2, 3):
        cross = at[1:-1] - back
        inside[cross[(cross >= 0) & (cross < len(gram))]] = False
    gram = gram[inside]
    start = np.zeros(len(own), dtype=np.int64)
    np.cumsum(n[own][:-1] - (RUN - 1), out=start[1:])
    a, b = _constants()
    out = np.empty((HASHES, len(own)), dtype=np.uint32)
    buffer = np.empty(len(gram), dtype=np.uint32)
    for k in range(HASHES):
        np.multiply(gram, a[k], out=buffer)
        np.add(buffer, b[k], out=buffer)
        out[k] = np.minimum.reduceat(buffer, start)
    return own, out


def _spread(band: np.ndarray, fp: np.ndarray, large: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, side) with large buckets cut into blocks: a text goes to every pair of blocks that its own takes part in."""
    hot = np.flatnonzero(np.isin(band, np.fromiter(large, dtype=np.int64, count=len(large)))) if large else np.zeros(0, dtype=np.int64)
    rest = np.setdiff1d(np.arange(len(band)), hot, assume_unique=True)
    rows, keys, sides = [rest], [band[rest]], [np.zeros(len(rest), dtype=np.int8)]
    for i in hot.tolist():
        n = large[int(band[i])]
        own = int(mix64(fp[i : i + 1].view(np.uint64))[0] % np.uint64(n))
        other = np.arange(n)
        low, high = np.minimum(own, other), np.maximum(own, other)
        keys.append(mix64(band[i : i + 1].view(np.uint64) ^ (low * 1_000_003 + high + 1).astype(np.uint64)).view(np.int64))
        rows.append(np.full(n, i))
        sides.append(np.where(other == own, 0, np.where(own < other, 1, 2)).astype(np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def _bands(batches: Iterator[pa.RecordBatch], large: dict[int, int]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for rb in batches:
        fps = rb.column(0).to_numpy()
        fresh = []
        for i, fp in enumerate(fps.tolist()):
            if fp not in seen:
                seen.add(fp)
                fresh.append(i)
        if len(seen) > 500_000:  # bounds the memory; what is forgotten is told apart later
            seen.clear()
        texts = rb.column(1).take(pa.array(fresh, type=pa.int64())).to_pylist()
        fps, tables = fps[fresh], rb.column(2).to_numpy().view(np.uint64)[fresh]
        for x, y in chunks(map(len, texts), 1 << 18):
            own, minima = _minima(texts[x:y])
            if not len(own):
                continue
            bits = np.concatenate([minima[:SKETCHED] >> np.uint32(7), minima[:SKETCHED] >> np.uint32(13)]) & np.uint32(1)
            place = np.arange(64, dtype=np.uint64)[:, None]
            s0, s1, s2 = ((bits[k : k + 64].astype(np.uint64) << place).sum(axis=0, dtype=np.uint64).view(np.int64) for k in (0, 64, 128))
            band = np.empty((BANDS, len(own)), dtype=np.uint64)
            for k in range(BANDS):
                h = tables[x:y][own] + np.uint64(k + 1)  # texts of different tables never meet
                for r in range(ROWS):
                    h = mix64(h ^ minima[k * ROWS + r])
                band[k] = h
            ids = fps[x:y][own]
            rows, key, side = _spread(band.ravel().view(np.int64), np.tile(ids, BANDS), large)
            own = rows % len(ids)
            for a in range(0, len(rows), 200_000):
                k = own[a : a + 200_000]
                yield batch(_BAND, band=key[a : a + 200_000], fp=ids[k], s0=s0[k], s1=s1[k], s2=s2[k], side=side[a : a + 200_000])


def _similar(sketch: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two sketches agree well enough."""
    differ = np.bitwise_count((sketch ^ other).view(np.uint64)).sum(axis=-1, dtype=np.int64)  # of signed numbers it counts the absolute value
    return 1 - differ / SKETCHED >= SIGNATURE


def _pairs_of(fp: np.ndarray, sketch: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs within runs of rows, by distance between the two rows: step d pairs row i with row i + d."""
    at, left = start, size
    d = 1
    rows = np.concatenate([np.arange(s, s + n) for s, n in zip(at, left, strict=True)]) if len(at) else at
    ends = np.repeat(at + left, left)
    while len(rows):
        keep = rows + d < ends
        rows, ends = rows[keep], ends[keep]
        if not len(rows):
            return
        ok = _similar(sketch[rows], sketch[rows + d])
        if ok.any():
            yield fp[rows[ok]], fp[rows[ok] + d]
        d += 1


def _candidate_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return batch(_CANDIDATE, a=np.minimum(a, b), b=np.maximum(a, b))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs, verified by sketch, of rows sorted by (band, side, fp). Sides 1 and 2 are two blocks of a large bucket, side 0 is a whole one."""
    rest = [np.zeros(0, dtype=np.int64)] * 6
    for rb in _with_end(batches):
        last = rb is None
        columns = rest if last else [np.concatenate([r, c.to_numpy().astype(np.int64)]) for r, c in zip(rest, rb.columns, strict=True)]
        if not len(columns[0]):
            continue
        band, fp, s0, s1, s2, side = columns
        first = np.append(True, (band[1:] != band[:-1]) | (fp[1:] != fp[:-1]))
        band, fp, s0, s1, s2, side = (x[first] for x in columns)
        upto = len(band) if last else int(np.searchsorted(band, band[-1], "left"))
        rest = [x[upto:] for x in (band, fp, s0, s1, s2, side)]
        band, fp, side, sketch = band[:upto], fp[:upto], side[:upto], np.stack([s0[:upto], s1[:upto], s2[:upto]], axis=1)
        if not len(band):
            continue
        start = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        size = np.diff(np.append(start, len(band)))
        whole = side[start] == 0
        usual = whole & (size > 1) & (size <= HOT)
        for a, b in _pairs_of(fp, sketch, start[usual], size[usual]):
            yield _candidate_rows(a, b)
        for s, n in zip(start[~usual & (size > 1)], size[~usual & (size > 1)], strict=True):
            one = int(np.searchsorted(side[s : s + n], 2)) if side[s] == 1 else 0  # of two blocks, where the second begins
            for i in range(one or n):
                other = np.arange(s + (one or i + 1), s + n)
                ok = _similar(sketch[other], sketch[s + i]) if len(other) else np.zeros(0, dtype=bool)
                if ok.any():
                    yield _candidate_rows(np.full(ok.sum(), fp[s + i]), fp[other[ok]])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _large_buckets(texts: DataFrame) -> dict[int, int]:
    """Buckets that a random sample of the texts (one in DRAWN, whatever the collection) shows to hold over SPREAD, and their blocks."""
    some = texts.where(F.pmod("fp", F.lit(DRAWN)) == 0)
    sizes = some.mapInArrow(lambda batches: _bands(batches, {}), _BAND_DDL).dropDuplicates(["band", "fp"]).groupBy("band").count().where(F.col("count") * DRAWN > SPREAD)
    return {r["band"]: -(-r["count"] * DRAWN // HOT) for r in sizes.collect()}  # at most 20 * texts / SPREAD, and as a rule none


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("fp_a", pa.int64()), ("fp_b", pa.int64()), ("similarity", pa.float64())])
    for rb in batches:
        sets: dict[int, set[str]] = {}
        out: tuple[list, list, list] = ([], [], [])
        size = 0
        for a, b, x, y in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if size > 2_000_000:
                sets, size = {}, 0
            for key, t in ((a, x), (b, y)):
                if key not in sets:
                    sets[key] = {t[i : i + RUN] for i in range(len(t) - RUN + 1)}
                    size += len(sets[key])
            shared = len(sets[a] & sets[b])
            similarity = shared / (len(sets[a]) + len(sets[b]) - shared)
            if similarity >= THRESHOLD:
                for column, value in zip(out, (a, b, similarity), strict=True):
                    column.append(value)
        yield batch(schema, fp_a=out[0], fp_b=out[1], similarity=out[2])


def prepared(records: DataFrame) -> DataFrame:
    """Records with their normalised text and its fingerprint: table_name, record_id, norm, fp.

    records: table_name, record_id, content (further columns are ignored). Lower case, runs of white space
    as one blank, trimmed. Null, blank and texts of under four characters, which have no run, take no part.
    """
    norm = F.trim(F.regexp_replace(F.lower("content"), r"(?U)\s+", " "))
    return (
        records.where("record_id IS NOT NULL AND content IS NOT NULL")
        .select("table_name", "record_id", norm.alias("norm"))
        .where(F.char_length("norm") >= RUN)
        .select("table_name", "record_id", "norm", F.xxhash64("table_name", "norm").alias("fp"))
    )


def text_links(base: DataFrame) -> DataFrame:
    """Links between different texts: fp_a < fp_b, similarity (exact, at least THRESHOLD). base: of `prepared`."""
    keyed = base.select("fp", "norm", F.xxhash64("table_name"))
    large = _large_buckets(keyed)
    buckets = keyed.mapInArrow(lambda batches: _bands(batches, large), _BAND_DDL).repartition("band").sortWithinPartitions("band", "side", "fp")
    pairs = buckets.mapInArrow(_buckets, _CANDIDATE_DDL).dropDuplicates(["a", "b"])
    texts = base.select("fp", "norm").dropDuplicates(["fp"])  # copies go before the shuffle, and the second join reuses it
    first = pairs.join(texts.select(F.col("fp").alias("a"), F.col("norm").alias("x")), "a").dropDuplicates(["a", "b"])
    both = first.join(texts.select(F.col("fp").alias("b"), F.col("norm").alias("y")), "b").dropDuplicates(["a", "b"])
    return both.select("a", "b", "x", "y").mapInArrow(_verify, "fp_a long, fp_b long, similarity double")


def members(base: DataFrame) -> DataFrame:
    """Which record has which text: table_name, record_id, fp, copies, representative (the smallest id)."""
    own = base.select("table_name", "fp", "record_id").distinct()
    sizes = own.groupBy("fp").agg(F.count("*").alias("copies"), F.min("record_id").alias("representative"))
    return own.join(sizes, "fp")


def record_pairs(records: DataFrame) -> DataFrame:
    """Pairs of different records of a table whose contents are alike: table_name, a_id < b_id, similarity.

    All pairs, exact copies included. Of a text with more than COPIES copies only the smallest id is paired
    with other texts, and each copy with it; `groups` holds them all.
    """
    base = prepared(records)
    who = members(base)
    rep = who.where((F.col("copies") <= COPIES) | (F.col("record_id") == F.col("representative"))).select("table_name", "fp", "record_id", "copies")
    a = rep.select(F.col("fp").alias("fp_a"), F.col("record_id").alias("x"), "table_name")
    b = rep.select(F.col("fp").alias("fp_b"), F.col("record_id").alias("y"))
    different = text_links(base).join(a, "fp_a").join(b, "fp_b").where("x <> y").select("table_name", "x", "y", "similarity")
    few = rep.where(F.col("copies").between(2, COPIES))
    copies = few.select("table_name", "fp", F.col("record_id").alias("x")).join(few.select("fp", F.col("record_id").alias("y")), "fp").where("x < y")
    star = who.where((F.col("copies") > COPIES) & (F.col("record_id") != F.col("representative")))
    same = copies.select("table_name", "x", "y").unionByName(star.select("table_name", F.col("representative").alias("x"), F.col("record_id").alias("y")))
    return (
        different.unionByName(same.withColumn("similarity", F.lit(1.0)))
        .groupBy("table_name", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
        .agg(F.max("similarity").alias("similarity"))
    )


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of edges (u, v): node, component (the smallest node). Alternating large-star and small-star.

    Every round is two aggregations by node, cut by a checkpoint; the edges end as one star per component.
    """
    now = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(lowest, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()


def groups(records: DataFrame) -> DataFrame:
    """One row per record that takes part: table_name, record_id, class_id, group_id (the group's smallest text fingerprint), n_links.

    class_id is the text's fingerprint, the same for exact copies. n_links is the number of other texts it is linked with. A record alike to none is its own group.
    """
    base = prepared(records)
    links = cut(text_links(base))
    label = components(links.select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v")))
    degree = links.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).groupBy("fp").count()
    own = base.select("table_name", "fp", "record_id").distinct()
    return (
        own.join(label.withColumnRenamed("node", "fp"), "fp", "left")
        .join(degree, "fp", "left")
        .select("table_name", "record_id", F.col("fp").alias("class_id"), F.coalesce("component", "fp").alias("group_id"), F.coalesce("count", F.lit(0)).alias("n_links"))
    )
