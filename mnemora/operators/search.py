"""Vector search: exact top-k of a query set, layered retrieval, re-ranking and fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import uri as u
from mnemora.session import cut

#: Weights of the layers and the threshold of the first layer by intent (fixed values).
INTENT_RULES = (
    ("entity_lookup", 0.10, 0.20, 0.70, 0.28),
    ("factual", 0.15, 0.25, 0.60, 0.32),
    ("temporal", 0.20, 0.35, 0.45, 0.38),
    ("relational", 0.20, 0.50, 0.30, 0.35),
    ("search", 0.35, 0.35, 0.30, 0.35),
    ("general", 0.20, 0.30, 0.50, 0.45),
)
#: Rows of the two sides that one task compares.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 16_384
#: Queries of one keyword scan; more take several scans.
ASKED_BLOCK = 20_000
#: Keyword hits that count for the score.
HITS = 6
#: Of the search by whole words: queries whose words are broadcast at once; words of files and queries that one task
#: compares; tasks, where blocks of files alone would give fewer.
ASKED_WORDS, CELL_WORDS, CELL_ASKED, CELLS = 1_000_000, 8_000_000, 131_072, 12
#: A word in more than one of so many files gets a bitmap; bytes of a task's bitmaps; files counted at once.
SPARSE, BITMAP_BYTES, COUNTED = 128, 64 << 20, 2_000_000

def top_k(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
    """The k nearest vectors of every query by cosine: query_id, vec_id, score (rounded to six decimals).

    queries: query_id, embedding; vectors: vec_id, embedding (ids are longs or strings). Exact: both sides are cut
    into blocks by hash and length, every pair of blocks is one task's matrix product, and only its best k of each
    query are shuffled. A query meets vectors of its own length only; null vectors and elements and those without
    length match nothing; ties go to the smaller id. Neither side is broadcast, so neither has a size limit.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["vec_id"]
    q = queries.where(whole).select(F.col("query_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("e"), F.size("embedding").alias("len"))
    v = vectors.where(whole).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("e"), F.size("embedding").alias("len"))
    n_q, n_v = (max(1, -(-df.count() // size)) for df, size in ((q, QUERY_BLOCK), (v, VECTOR_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    left = q.select(block(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"), F.lit(True).alias("query"), "id", "e", "len")
    right = v.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("qb"), block(n_v).cast("int").alias("vb"), F.lit(False).alias("query"), "id", "e", "len")

    def best(t: pa.Table) -> pa.Table:
        is_query = t.column("query").to_numpy()
        ids = t.column("id")
        x = t.column("e").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        x[norm > 0] /= norm[norm > 0, None]
        a, b = np.flatnonzero(is_query & (norm > 0)), np.flatnonzero(~is_query & (norm > 0))
        known = ids.take(pa.array(b)).to_pylist()
        b = b[sorted(range(len(b)), key=(known if kinds[1] == "string" else list(map(int, known))).__getitem__)]
        out: list[list[np.ndarray]] = [[], [], []]
        if len(b):
            for i in range(0, len(a), 256):
                s = np.round(x[a[i : i + 256]] @ x[b].T, 6)
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, order, axis=1)
                keep = score >= threshold
                r = np.repeat(a[i : i + 256], keep.sum(axis=1))
                for column, value in zip(out, (r, b[order[keep]], score[keep]), strict=True):
                    column.append(value)
        r, c, score = (np.concatenate([np.zeros(0, dtype=kind), *column]) for kind, column in zip((np.int64, np.int64, np.float64), out, strict=True))
        return pa.table({"q": ids.take(pa.array(r)), "v": ids.take(pa.array(c)), "score": score})

    found = left.unionByName(right).groupBy("qb", "vb", "len").applyInArrow(best, "q string, v string, score double").select(F.col("q").cast(kinds[0]), F.col("v").cast(kinds[1]), "score")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
    return found.withColumn("r", rank).where(F.col("r") <= k).select(F.col("q").alias("query_id"), F.col("v").alias("vec_id"), "score")


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of every directory: dir, embedding. vectors: dir, embedding."""
    parts = vectors.select("dir", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("dir", "i").agg(F.avg("x").alias("x"))
    return parts.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def intent_rules(df: DataFrame) -> DataFrame:
    """The rules as a table: intent, w0, w1, w2, threshold."""
    return df.sparkSession.createDataFrame(list(INTENT_RULES), "intent string, w0 double, w1 double, w2 double, threshold double")


def normalised(rules: DataFrame) -> DataFrame:
    """Rules whose weights sum to one; weights without a positive sum become those of the general intent."""
    total = F.col("w0") + F.col("w1") + F.col("w2")
    general = dict(zip(("w0", "w1", "w2"), INTENT_RULES[-1][1:4], strict=True))
    return rules.select("intent", *[F.when(total > 0, F.col(w) / total).otherwise(v).alias(w) for w, v in general.items()], "threshold")


def semantic(queries: DataFrame, vectors: DataFrame, index: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Search over all layers: query_id, uri (canonical), score.

    queries: query_id, embedding; vectors: vec_id (once), embedding, uri, layer, content; index as in `without_archived`.
    Three times the limit are searched; details gain and summaries lose by their layer, then each result by its path;
    the best of each canonical URI is kept and the list cut; archived memories are dropped after the cut, so a list
    can be shorter than the limit. A vector without URI goes by its id.
    """
    if limit < 1 or not -1 <= threshold <= 1:
        raise ValueError("the limit must be positive and the threshold a cosine")
    layer = F.coalesce("layer", F.lit("L2"))
    placed = F.when(layer == "L2", 0.08).when(layer == "L1", -0.04).when(layer == "L0", -0.08).otherwise(0.0)
    near = top_k(queries, vectors, 3 * limit, threshold).join(vectors.drop("embedding"), "vec_id")
    uri = F.coalesce("uri", "vec_id")
    none = F.array().cast("array<string>")
    bonus = rerank_bonus(u.canonical(uri), F.lit(""), none, none)
    scored = near.select("query_id", uri.alias("uri"), F.round(F.col("score") + placed + bonus, 6).alias("score"), F.left("content", F.lit(200)).alias("snippet"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uri"))
    best = dedup_canonical(scored, ["query_id"]).withColumn("r", rank).where(F.col("r") <= limit)
    return without_archived(best, index).select("query_id", "uri", "score")


def layered(l0: DataFrame, l1: DataFrame, members: DataFrame, w: tuple[float, float, float], l0_threshold: float, threshold: float, limit: int) -> DataFrame:
    """Staged retrieval: query_id, vec_id, score.

    l0: query_id, dir, score0 (hits of the first layer); l1: query_id, dir, score1; members: query_id, dir,
    vec_id, score2. A directory without a second-layer vector counts 0.8 of its first score. Directories
    under half the threshold in both layers are left; a member's score is the weighted sum of the three.
    """
    near = l0.where(F.col("score0") >= l0_threshold).join(l1, ["query_id", "dir"], "left").withColumn("score1", F.coalesce("score1", F.col("score0") * 0.8))
    kept = near.where((F.col("score0") >= threshold * 0.5) | (F.col("score1") >= threshold * 0.5))
    scored = kept.join(members, ["query_id", "dir"]).withColumn("score", F.round(F.col("score0") * w[0] + F.col("score1") * w[1] + F.col("score2") * w[2], 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.where(F.col("score") >= threshold).withColumn("r", rank).where(F.col("r") <= limit).select("query_id", "vec_id", "score")


def first_tier(hits: DataFrame, thresholds: tuple[float, ...], limit: int) -> DataFrame:
    """Each query's results of the strictest threshold that any of them reaches: query_id, vec_id, score, tier.

    hits: query_id, vec_id, score. Tier k holds scores of at least thresholds[k]; the last tier all the rest.
    """
    tier = F.lit(len(thresholds))
    for k in range(len(thresholds) - 1, -1, -1):
        tier = F.when(F.col("score") >= thresholds[k], k).otherwise(tier)
    w = Window.partitionBy("query_id")
    first = hits.withColumn("tier", tier).withColumn("best", F.min("tier").over(w)).where(F.col("tier") <= F.col("best"))
    rank = F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))
    return first.withColumn("r", rank).where(F.col("r") <= limit).select("query_id", "vec_id", "score", "tier")


#: What a result gains or loses (fixed values): by being a file, for each keyword and entity and how many count, by its collection.
LEAF, KEYWORD, KEYWORDS, ENTITY, ENTITIES, COLLECTION, IN_COLLECTION = 0.12, 0.03, 4, 0.05, 3, -0.14, -0.08


def rerank_bonus(uri: Column, snippet: Column, keywords: Column, entities: Column) -> Column:
    """What a result gains by its path and text: files over directories, up to four keywords and three entities."""
    return F.round(place_bonus(uri) + match_bonus(F.lower(snippet), keywords, F.transform(entities, F.lower)), 6)


def place_bonus(uri: Column) -> Column:
    """The part of a result's path, not rounded."""
    path = F.lower(uri)
    whole = F.when(path.rlike("/(entities|events|goals|relationships)$"), COLLECTION).when(path.contains("/entities/"), IN_COLLECTION).otherwise(0.0)
    return F.when(u.is_leaf(uri), LEAF).otherwise(-LEAF) + whole


def match_bonus(low: Column, keywords: Column, entities: Column) -> Column:
    """The part of a result's text, not rounded; all in lower case. The text is looked at once a word, so it should be a stored column."""
    hits = F.size(F.filter(keywords, lambda k: low.contains(k)))
    named = F.size(F.filter(entities, lambda e: low.contains(e)))
    return F.least(hits, F.lit(KEYWORDS)) * KEYWORD + F.least(named, F.lit(ENTITIES)) * ENTITY


def dedup_canonical(results: DataFrame, keys: list[str]) -> DataFrame:
    """The best result of each canonical URI (within keys); equal scores go to the smaller URI, a null snippet is filled.

    results: keys..., uri, score, snippet.
    """
    w = Window.partitionBy(*keys, "canonical").orderBy(F.desc("score"), "uri")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        results.withColumn("canonical", u.canonical(F.col("uri")))
        .withColumn("snippet", F.coalesce("snippet", F.first("snippet", ignorenulls=True).over(whole)))
        .withColumn("n", F.row_number().over(w))
        .where("n = 1")
        .select(*keys, F.col("canonical").alias("uri"), "score", "snippet")
    )


def merge_sources(results: DataFrame, keys: list[str]) -> DataFrame:
    """Fuse result lists: the best score of each URI with its snippet; of several sources the source is `hybrid`.

    results: keys..., uri, score, snippet, source, ordinal (the list's place, which decides between equal scores).
    """
    best = F.max_by(F.struct("snippet"), F.struct("score", -F.col("ordinal")))
    return (
        results.groupBy(*keys, "uri")
        .agg(F.max("score").alias("score"), best["snippet"].alias("snippet"), F.min("source").alias("lo"), F.max("source").alias("hi"))
        .select(*keys, "uri", "score", "snippet", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("hybrid").alias("source"))
    )


def fill_from(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Supplement: extra rows only fill blank snippets of base, unless base has no row at all for the keys."""
    e = extra.select(*keys, "uri", F.col("score").alias("s2"), F.col("snippet").alias("t2"))
    filled = base.join(e, [*keys, "uri"], "left").select(*keys, "uri", "score", F.when(F.coalesce(F.col("snippet"), F.lit("")) == "", F.col("t2")).otherwise(F.col("snippet")).alias("snippet"))
    alone = extra.join(base.select(*keys).distinct(), keys, "left_anti").select(*keys, "uri", "score", "snippet")
    return filled.unionByName(alone)


def without_archived(results: DataFrame, index: DataFrame) -> DataFrame:
    """Drop results whose index row is archived; URIs that name no memory and unknown memories stay.

    results: uri, ...; index: owner_id, id, archived.
    """
    o = u.owner(F.col("uri"))
    gone = index.where("archived").select(F.col("owner_id").alias("_o"), F.col("id").alias("_m")).distinct()
    return results.withColumn("_k", o).join(gone, (F.col("_k.owner_id") == F.col("_o")) & (F.col("_k.memory_id") == F.col("_m")), "left_anti").drop("_k")


def _numbered(shared: Broadcast[pa.Array]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over (name, words) that puts words' places in the vocabulary for them; other words go, and rows left without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            words = rb.column(1)
            places = pc.index_in(words.flatten(), value_set=shared.value)
            known = places.is_valid().to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(words).to_numpy()[known]
            n = np.bincount(row, minlength=rb.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), places.drop_null())
            yield pa.RecordBatch.from_arrays([rb.column(0).cast(pa.string()), lists], names=["name", "words"]).filter(pa.array(n > 0))

    return run


def _first(rows: np.ndarray, limit: int) -> np.ndarray:
    """Places of the first `limit` files by how many of the bitmaps (at most HITS count) hold them, then by place."""
    least = np.zeros((HITS + 2, rows.shape[1]), dtype=np.uint64)  # those that at least so many hold
    for n, bits in enumerate(rows):
        for k in range(min(n + 1, HITS), 1, -1):
            least[k] |= least[k - 1] & bits
        least[1] |= bits
    out, left = [], limit
    for k in range(HITS, 0, -1):
        just = least[k] & ~least[k + 1]
        lanes = np.flatnonzero(just)[:left]
        lane, bit = np.nonzero(np.unpackbits(just[lanes].view(np.uint8).reshape(len(lanes), 8), axis=1, bitorder="little"))
        out.append((lanes[lane] * 64 + bit)[:left])
        left -= len(out[-1])
        if not left:
            break
    return np.concatenate(out)


def _by_number(x: np.ndarray) -> np.ndarray:
    """Places of numbers from 0 up in stable order, 16 bits at a time, for which numpy needs no comparison."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")] if len(x) and x.max() > 0xFFFF else order


def _matching(limit: int) -> Callable[[pa.Table], pa.Table]:
    """The best files of every query of one cell; rows are queries and files (query, name, words), words numbers."""

    def lists(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        words = t.column("words").combine_chunks()
        return words.flatten().to_numpy(), pc.list_value_length(words).to_numpy()

    def best(t: pa.Table) -> pa.Table:
        asked, held = t.filter(pc.field("query")), t.filter(~pc.field("query")).sort_by("name")
        n_q, n_f = len(asked), len(held)
        empty = np.zeros(0, dtype=np.int64)
        q, file, hits = [empty], [empty], [empty]
        if n_q and n_f:
            q_words, q_len = lists(asked)
            f_words, f_len = lists(held)
            q_of = np.repeat(np.arange(n_q), q_len)
            n_words = int(max(q_words.max(), f_words.max())) + 1
            n_held = np.bincount(f_words, minlength=n_words)
            at = np.cumsum(n_held) - n_held
            files = np.repeat(np.arange(n_f), f_len)[_by_number(f_words)]  # of each word, in order
            # Words that many files hold get bitmaps, as many as there is room for.
            lanes = -(-n_f // 64)
            common = np.unique(q_words[n_held[q_words] > n_f / SPARSE])
            common = common[np.argsort(-n_held[common], kind="stable")][: BITMAP_BYTES // (8 * lanes)]
            slot = np.zeros(n_words, dtype=np.int64)
            slot[common] = np.arange(1, len(common) + 1)
            bitmap = np.zeros((len(common) + 1, lanes), dtype=np.uint64)
            for i, w in enumerate(common.tolist(), 1):
                bits = np.zeros(lanes * 64, dtype=bool)
                bits[files[at[w] : at[w] + n_held[w]]] = True
                bitmap[i] = np.packbits(bits, bitorder="little").view(np.uint64)
            octets = bitmap.view(np.uint8)
            # Of files that hold only common words, the best few; many queries have the same common words.
            by = np.lexsort((slot[q_words], q_of))
            q_words, q_slot = q_words[by], slot[q_words[by]]
            known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            own_q, own_slot = q_of[q_slot > 0], q_slot[q_slot > 0]
            n_own = np.bincount(own_q, minlength=n_q)
            ends = np.cumsum(n_own)
            firsts = []
            for lo, hi in zip((ends - n_own).tolist(), ends.tolist(), strict=True):
                key = own_slot[lo:hi].tobytes()
                if key not in known:
                    own = own_slot[lo:hi]
                    some = _first(bitmap[own], limit) if hi > lo else empty
                    known[key] = some, ((octets[own[:, None], some >> 3] >> (some & 7).astype(np.uint8)) & 1).sum(axis=0, dtype=np.int64)
                firsts.append(known[key])
            slots = np.zeros((n_q, max(1, n_own.max())), dtype=np.int64)
            slots[own_q, np.arange(len(own_q)) - np.repeat(ends - n_own, n_own)] = own_slot
            # Files that hold a rare word are all counted, some queries at a time.
            rare_q, rare = q_of[q_slot == 0], q_words[q_slot == 0]
            work = np.cumsum(np.bincount(rare_q, weights=n_held[rare], minlength=n_q) + limit)
            lo = 0
            while lo < n_q:
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + COUNTED, side="right")))
                part = slice(*np.searchsorted(rare_q, [lo, hi]))
                n = n_held[rare[part]]
                places = np.arange(n.sum()) + np.repeat(at[rare[part]] - (np.cumsum(n) - n), n)
                pairs = np.concatenate([np.repeat(rare_q[part], n) * n_f + files[places], *(i * n_f + x for i, (x, _) in enumerate(firsts[lo:hi], lo))])
                if not len(pairs):
                    lo = hi
                    continue
                order = np.argsort(pairs, kind="stable")
                pairs, count = pairs[order], np.concatenate([np.ones(len(places), dtype=np.int64), *(x for _, x in firsts[lo:hi])])[order]
                start = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                count = np.add.reduceat(count, start)
                a, b = np.divmod(pairs[start], n_f)
                # Common words of the first files are counted already, those of the others aren't; a first file comes last of its pair.
                rest = np.flatnonzero(order[np.append(start[1:], len(pairs)) - 1] < len(places))
                of, octet, bit = a[rest], b[rest] >> 3, (b[rest] & 7).astype(np.uint8)
                for k in range(n_own[lo:hi].max()):
                    some = np.flatnonzero(n_own[of] > k)
                    rest, of, octet, bit = rest[some], of[some], octet[some], bit[some]
                    count[rest] += (octets[slots[of, k], octet] >> bit) & 1
                order = np.argsort(a * (HITS + 1) - np.minimum(count, HITS), kind="stable")  # pairs are in the files' order
                a, b, count = a[order], b[order], count[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < limit
                q.append(a[keep])
                file.append(b[keep])
                hits.append(count[keep])
                lo = hi
        return pa.table({"query_id": asked.column("name").take(pa.array(np.concatenate(q))), "uri": held.column("name").take(pa.array(np.concatenate(file))), "hits": pa.array(np.concatenate(hits), pa.int64())})

    return best


def lexical(files: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Keyword search: query_id, uri, hits, score; files: uri (each once), text; queries: query_id, keywords (array).

    Score .10 + .05 for each of up to six distinct hits + .03; ties go to the smaller URI.
    Exact, but pairs of a query and a file are not listed: words become numbers, both sides are cut into blocks, and every
    pair of blocks is one task, which gives the best of each query. In a task a file with a rare word of the query is
    counted; of the files with common words only, which would be most pairs, the best are read off bitmaps of those words.
    The words asked for are broadcast, those of ASKED_WORDS queries at a time, so a larger set takes more scans.
    """
    kind = dict(queries.dtypes)["query_id"]
    asked = cut(queries.groupBy(F.col("query_id").cast("string").alias("name")).agg(F.flatten(F.collect_list(F.array_distinct("keywords"))).alias("words")).where(F.size("words") > 0))
    texts = files.where("text IS NOT NULL").select(F.col("uri").alias("name"), F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}+#]+")).alias("words"))
    n_asked = asked.count()
    scans = max(1, -(-n_asked // ASKED_WORDS))
    found = None
    for scan in range(scans):
        some = asked.where(F.pmod(F.xxhash64("name"), F.lit(scans)) == scan)
        vocabulary = some.select(F.explode("words").alias("word")).where("word IS NOT NULL").distinct().toArrow().column("word").combine_chunks()
        shared = files.sparkSession.sparkContext.broadcast(vocabulary)
        held = cut(texts.mapInArrow(_numbered(shared), "name string, words array<int>"))
        n_words = held.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
        n_f = max(1, -(-n_words // CELL_WORDS))
        n_q = max(1, -(-n_asked // scans // CELL_ASKED), min(-(-CELLS // n_f), n_asked // 256))
        block = lambda n: F.pmod(F.xxhash64("name"), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        cell = (F.col("qb") * n_f + F.col("fb")).cast("int").alias("cell")
        left = some.mapInArrow(_numbered(shared), "name string, words array<int>").select(block(n_q).alias("qb"), every(n_f).alias("fb"), "name", "words").select(cell, F.lit(True).alias("query"), "name", "words")
        right = held.select(every(n_q).alias("qb"), block(n_f).alias("fb"), "name", "words").select(cell, F.lit(False).alias("query"), "name", "words")
        # A partition for each cell: by their hash some partitions got several and most none.
        cells = left.unionByName(right).repartitionById(n_q * n_f, "cell").groupBy("cell").applyInArrow(_matching(limit), "query_id string, uri string, hits long")
        found = cells if found is None else found.unionByName(cells)
    scored = found.select(F.col("query_id").cast(kind), "uri", "hits", F.round(F.lit(0.13) + F.least("hits", F.lit(HITS)) * 0.05, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uri"))
    return scored.withColumn("r", rank).where(F.col("r") <= limit).select("query_id", "uri", "hits", "score")


_HITS_DDL = "query_id string, uri string, hits long, snippet string"
#: Characters of a match snippet, and those before the match.
SNIPPET, BEFORE = 220, 80


def _holding(shared: Broadcast[list[tuple[str, list[str]]]], limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over (uri, lower-cased text, text) that counts each query's keywords in every text.

    With a limit a batch gives only the best of each query; without one every hit, with the text around its first keyword.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        asking: dict[str, list[int]] = {}
        for i, (_, words) in enumerate(shared.value):
            for w in words or ():
                asking.setdefault(w, []).append(i)
        words = ahocorasick.Automaton()
        for w, some in asking.items():
            words.add_word(w, (w, np.array(some)))
        words.make_automaton()
        ids = pa.array([i for i, _ in shared.value], pa.string())
        # Where every hit is given, a few texts at a time, as each may be one of every query.
        size = 10_000 if limit is not None else max(1, 50_000 // max(len(ids), 1))
        for rb in (x.slice(at, size) for x in batches for at in range(0, x.num_rows, size)):
            q, file, hits = ([np.zeros(0, dtype=np.int64)] for _ in range(3))
            snippets: list[str] = []
            for n, (low, text) in enumerate(zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True)):
                found: dict[str, tuple[int, np.ndarray]] = {}
                for last, (w, some) in words.iter(low) if len(words) else ():
                    if w not in found:
                        found[w] = (last - len(w) + 1, some)
                if not found:
                    continue
                count = np.bincount(np.concatenate([some for _, some in found.values()]))
                q.append(np.flatnonzero(count))
                file.append(np.full(len(q[-1]), n))
                hits.append(count[q[-1]])
                if limit is None:
                    first = np.full(len(count), len(text))
                    for at, some in found.values():
                        first[some] = np.minimum(first[some], at)
                    starts, which = np.unique(np.maximum(first[q[-1]] - BEFORE, 0), return_inverse=True)
                    parts = [("..." if a else "") + text[a : a + SNIPPET].strip() for a in starts.tolist()]
                    snippets += [parts[i] for i in which]
            q, file, hits = np.concatenate(q), np.concatenate(file), np.concatenate(hits)
            if limit is not None:
                uris = rb.column(0).to_pylist()
                place = np.empty(len(uris), dtype=np.int64)
                place[sorted(range(len(uris)), key=uris.__getitem__)] = np.arange(len(uris))
                order = np.lexsort((place[file], -np.minimum(hits, 6), q))
                q, file, hits = q[order], file[order], hits[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < limit
                q, file, hits = q[best], file[best], hits[best]
            around = pa.array(snippets, pa.string()) if limit is None else pa.nulls(len(q), pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), rb.column(0).take(pa.array(file)).cast(pa.string()), pa.array(hits, pa.int64()), around], names=["query_id", "uri", "hits", "snippet"])

    return run


def lexical_substrings(files: DataFrame, queries: DataFrame, limit: int | None = 10) -> DataFrame:
    """Keyword search as `lexical`, but a keyword counts wherever it stands, also within a word; without a limit every hit, and its snippet.

    files hold each uri once. Whole texts are scanned for the keywords of all queries at once, and only the best of each
    query leave a batch. The stated query set is broadcast, ASKED_BLOCK queries at a time, so a larger set takes more
    scans and none is left out.
    """
    asked = [(r["query_id"], r["words"]) for r in queries.select("query_id", F.array_distinct(F.filter("keywords", lambda w: w != "")).alias("words")).orderBy("query_id").collect()]
    low = files.where("text IS NOT NULL").select("uri", F.lower("text").alias("low"), F.lit("").alias("text") if limit is not None else F.col("text"))
    hits = None
    for at in range(0, max(len(asked), 1), ASKED_BLOCK):
        found = low.mapInArrow(_holding(files.sparkSession.sparkContext.broadcast(asked[at : at + ASKED_BLOCK]), limit), _HITS_DDL)
        hits = found if hits is None else hits.unionByName(found)
    scored = hits.withColumn("score", F.round(F.lit(0.13) + F.least("hits", F.lit(6)) * 0.05, 6))
    if limit is None:
        return scored
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uri"))
    return scored.withColumn("r", rank).where(F.col("r") <= limit).select("query_id", "uri", "hits", "score")


def hybrid(vector: DataFrame, lexical: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Vector and keyword lists merged, every candidate re-ranked, then cut: query_id, uri, score.

    vector: query_id, uri, score, snippet, source, ordinal (the layered, semantic and expansion lists); lexical: query_id,
    uri, score, snippet (uncut); queries: query_id, keywords, entities (the stated set, broadcast). Ties go to the smaller URI.
    """

    def best(df: DataFrame) -> DataFrame:
        bonus = rerank_bonus(F.col("uri"), F.coalesce("snippet", F.lit("")), F.col("keywords"), F.col("entities"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "uri"))
        return df.join(F.broadcast(queries), "query_id").withColumn("final", F.round(F.col("score") + bonus, 6)).withColumn("r", rank).where(F.col("r") <= limit)

    # A keyword hit that isn't among the best re-ranked ones of its own list can't be among those of both.
    own = best(lexical).select("query_id", "uri", "score", "snippet", F.lit("lexical").alias("source"), F.lit(3).alias("ordinal"))
    return best(merge_sources(vector.unionByName(own), ["query_id"])).select("query_id", "uri", F.col("final").alias("score"))


def access_events(results: DataFrame) -> DataFrame:
    """One access per final result whose URI names a memory: scope, owner_id, memory_id."""
    return results.select(u.owner(F.col("uri")).alias("o")).where("o IS NOT NULL").select("o.*")

