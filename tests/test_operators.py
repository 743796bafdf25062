import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from mnemora.operators import decay, evaluate, merge, search, sessions, tree
from mnemora.operators.filters import MemoryFilter
from mnemora.streaming import windows

T = dt.datetime(2025, 1, 1)


def test_top_k_is_exact_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 50)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 16)).astype(np.float32)
    x[7] = x[3]
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)] + [(900, None), (901, [0.0] * 16)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in search.top_k(q, v, 5).orderBy("query_id", F.desc("score"), "vec_id").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(y @ y.T, 6)
    assert got == {i: sorted(range(200), key=lambda j: (-s[i, j], j))[:5] for i in range(0, 200, 4)}
    assert search.top_k(q.limit(0), v, 5).count() == 0


def test_top_k_of_mixed_lengths(spark):
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(20)]
    v = spark.createDataFrame(rows + [(99, [1.0] * 9), (98, [1.0] * 7 + [None])], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 3 OR vec_id = 99").select(F.col("vec_id").alias("query_id"), "embedding")
    got = search.top_k(q, v, 5).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {0: 5, 1: 5, 2: 5, 99: 1}
    named = search.top_k(q, v.withColumn("vec_id", F.concat(F.lit("v"), "vec_id")), 1)
    assert {(r["query_id"], r["vec_id"]) for r in named.collect()} == {(0, "v0"), (1, "v1"), (2, "v2"), (99, "v99")}


def test_filters(spark):
    rows = [("a", ["t1", "t2"], 0.5, "L2", "mem://user/x", {"k": "value"}), ("b", ["t1"], 0.8, "L2", None, None), ("c", None, None, None, "mem://agent/y", {"k": "other"})]
    df = spark.createDataFrame(rows, "id string, topics array<string>, importance_score double, layer string, uri string, custom map<string,string>")
    ids = lambda f: sorted(r["id"] for r in df.where(f.column()).collect())
    assert ids(MemoryFilter()) == ["a", "b", "c"]
    assert ids(MemoryFilter(topics=("t1", "t2"))) == ["a"]
    assert ids(MemoryFilter(min_importance=0.5, max_importance=0.8)) == ["a"]
    assert ids(MemoryFilter(uri_prefix="mem://user")) == ["a"] and ids(MemoryFilter(uri_prefix="mem://user", keep_null_uri=True)) == ["a", "b"]
    assert ids(MemoryFilter(custom={"k": ("alu", "zzz")})) == ["a"]


def test_merge(spark):
    index = spark.createDataFrame([("o", "fact", "k1", "h1", "same words here", 0.5), ("o", "fact", "k2", "h2", "", 0.5), ("o", "fact", "k3", "h3", "kept as it is", 0.5)], "owner_id string, memory_type string, key_name string, content_hash string, content_summary string, confidence double")
    items = [("o", "fact", "k1", "h1", "same words here", 0.7, "s1", 1), ("o", "fact", "k2", "h2", "", 0.5, "s1", 2), ("o", "fact", "k3", "h3", "kept as it is", 0.55, "s2", 3), ("o", "fact", "k4", "h4", "x", 0.1, "s1", 4), ("o", "fact", "k4", "h5", "y", 0.9, "s2", 5)]
    x = spark.createDataFrame(items, "owner_id string, memory_type string, key_name string, content_hash string, summary string, confidence double, session string, ordinal long")
    got = {r["key_name"]: r for r in merge.merge_actions(index, x).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"k1": "update", "k2": "update", "k3": "keep", "k4": "create"}
    assert got["k4"]["confidence"] == 0.9 and got["k4"]["n_items"] == 2 and got["k4"]["n_sessions"] == 2
    assert merge.links(x).count() == 5
    assert merge.merge_actions(index, x.limit(0)).count() == 0


def test_record_access_matches_event_by_event(spark):
    rnd = random.Random(0)
    index = [(str(i), T, rnd.randrange(12), rnd.randrange(3)) for i in range(20)]
    hits = [(str(rnd.randrange(20)), T + dt.timedelta(days=k)) for k in range(150)]
    want = {i: [c, k] for i, _, c, k in index}
    for i, _ in hits:
        want[i][0] += 1
        want[i][1] += want[i][0] % 5 == 0
    df = spark.createDataFrame(index, "id string, last_accessed timestamp, access_count long, consolidation_count long")
    seen = spark.createDataFrame([(i, 1, at) for i, at in hits], "id string, n long, at timestamp")
    got = merge.record_access(df, seen).collect()
    assert got == merge.record_access(df, seen.groupBy("id").agg(F.sum("n").alias("n"), F.max("at").alias("at"))).collect()
    assert {r["id"]: [r["access_count"], r["consolidation_count"]] for r in got} == want


def test_upsert_and_delete(spark):
    a = spark.createDataFrame([("1", "old", 1), ("2", "old", 5)], "id string, v string, seq long")
    b = spark.createDataFrame([("1", "new", 2), ("2", "stale", 3), ("3", "new", 1)], "id string, v string, seq long")
    once = merge.upsert(a, b, "id", "seq")
    rows = lambda df: {r["id"]: r["v"] for r in df.collect()}
    assert rows(once) == {"1": "new", "2": "old", "3": "new"} == rows(merge.upsert(once, b, "id", "seq"))
    assert rows(merge.delete(once, b.where("id = '3'"), "id")) == {"1": "new", "2": "old"}


def test_decay(spark):
    rows = [("fresh", 0.9, T, 0, False), ("old", 0.9, T - dt.timedelta(days=40), 0, False), ("firm", 0.9, T - dt.timedelta(days=40), 10, False), ("gone", 0.5, T - dt.timedelta(days=90), 0, True), ("never", None, None, None, None)]
    df = spark.createDataFrame([(i, "o", c, at, k, a) for i, c, at, k, a in rows], "id string, owner_id string, confidence double, last_accessed timestamp, consolidation_count long, archived boolean")
    got = {r["id"]: (r["action"], r["strength"]) for r in decay.actions(df, "2025-01-01 00:00:00").collect()}
    assert {k: a for k, (a, _) in got.items()} == {"fresh": "keep", "old": "archive", "firm": "keep", "gone": "delete", "never": "archive"}
    assert got["firm"][1] > got["old"][1]


def test_tree(spark):
    files = [("mem://user/u/a/x.md", "one"), ("mem://user/u/a/y.md", "**Added**: now\ntwo"), ("mem://user/u/a/.hidden.md", "no"), ("mem://user/u/b/z.txt", "three"), ("mem://user/u/b/bin.dat", "no")]
    df = spark.createDataFrame([(a, b, len(b)) for a, b in files], "uri string, text string, size long")
    assert {r["dir"]: r["n_files"] for r in tree.stats(df).collect()} == {"mem://user": 5, "mem://user/u": 5, "mem://user/u/a": 3, "mem://user/u/b": 2}
    c = {r["dir"]: r["content"] for r in tree.combined(df.select("uri", "text")).collect()}
    assert c == {"mem://user/u/a": "\n\n=== x.md ===\n\none\n\n=== y.md ===\n\ntwo", "mem://user/u/b": "\n\n=== z.txt ===\n\nthree"}
    assert tree.combined(df.select("uri", "text"), most=10).where(F.char_length("content") != 17).count() == 0
    names = {(r["child"], r["child_count"]) for r in tree.listing(df.select("uri")).where("dir = 'mem://user/u'").collect()}
    assert names == {("mem://user/u/a", 2), ("mem://user/u/b", 2)}  # visible children, as in the listing itself
    assert not any("hidden" in r["child"] for r in tree.listing(df.select("uri")).collect())


def test_message_round_trip(spark):
    df = spark.createDataFrame([("user", "id-1", T, "hello\n\nworld"), ("alien", "id-2", T, "x"), ("system", None, T, "x")], "role string, id string, at timestamp, content string")
    got = df.select(sessions.parsed(sessions.rendered(F.col("role"), F.col("id"), F.col("at"), F.col("content"))).alias("p")).collect()
    assert got[0]["p"].asDict() == {"role": "user", "id": "id-1", "timestamp": T, "content": "hello\nworld"}
    assert got[1]["p"] is None and got[2]["p"] is None


def test_fusion(spark):
    r = spark.createDataFrame([(1, "u1", 0.5, "a", "x", 0), (1, "u1", 0.7, "b", "y", 1), (1, "u2", 0.7, None, "x", 0)], "q long, uri string, score double, snippet string, source string, ordinal int")
    got = {x["uri"]: (x["score"], x["snippet"], x["source"]) for x in search.merge_sources(r, ["q"]).collect()}
    assert got == {"u1": (0.7, "b", "hybrid"), "u2": (0.7, None, "x")}
    base = spark.createDataFrame([(1, "u1", 0.5, "")], "q long, uri string, score double, snippet string")
    extra = spark.createDataFrame([(1, "u1", 0.9, "filled"), (1, "u9", 0.9, "no"), (2, "u5", 0.1, "alone")], base.schema)
    assert {(x["q"], x["uri"], x["score"], x["snippet"]) for x in search.fill_from(base, extra, ["q"]).collect()} == {(1, "u1", 0.5, "filled"), (2, "u5", 0.1, "alone")}


def test_keywords_within_words(spark, monkeypatch):
    files = spark.createDataFrame([("u1", "Gardening at noon"), ("u2", "我们在杭州的花园里"), ("u3", "garden"), ("u4", "nothing"), ("u5", "")], "uri string, text string")
    q = spark.createDataFrame([("a", ["garden", "noon", "arden"]), ("b", ["杭州的"]), ("c", []), ("d", ["absent"])], "query_id string, keywords array<string>")
    want = {("a", "u1", 3, 0.28), ("a", "u3", 2, 0.23), ("b", "u2", 1, 0.18)}
    assert {tuple(r) for r in search.lexical_substrings(files, q).collect()} == want
    monkeypatch.setattr(search, "ASKED_BLOCK", 1)  # several scans
    assert {tuple(r) for r in search.lexical_substrings(files, q, None).select("query_id", "uri", "hits", "score").collect()} == want
    assert {tuple(r) for r in search.lexical_substrings(files, q, 1).collect()} == want - {("a", "u3", 2, 0.23)}
    assert search.lexical_substrings(files, q.limit(0)).count() == 0


def _by_words(files, queries, limit):
    """Brute force of the keyword search."""
    words = {u: set(t.lower().split()) for u, t in files if t is not None}
    asked = {}
    for i, k in queries:
        asked.setdefault(i, []).extend(set(k or []) - {None})
    out = set()
    for i, k in asked.items():
        hits = sorted(((-min(n, 6), u, n) for u, w in words.items() if (n := sum(x in w for x in k))))
        out |= {(i, u, n, round(0.13 + 0.05 * min(n, 6), 6)) for _, u, n in hits[:limit]}
    return out


def test_lexical_is_exact(spark, monkeypatch):
    rnd = random.Random(5)
    text = lambda: " ".join({rnd.choice(["the", "and", "for", "was"]) for _ in range(4)} | {f"w{int(60 * rnd.random() ** 3)}" for _ in range(rnd.randrange(14))})
    files = [*((f"mem://user/{rnd.random()}.md", text()) for _ in range(400)), ("null", None), ("empty", ""), ("large", " ".join(f"w{i}" for i in range(60)))]
    queries = [*((f"q{n}", text().split()) for n in range(150)), ("q7", ["the", "w1"]), ("q7", ["the", "w2"]), (None, ["and"]), ("none", []), ("null", None), ("holes", [None, "was", "was"]), ("absent", ["xyz"]), ("many", [f"w{i}" for i in range(60)])]
    f, q = spark.createDataFrame(files, "uri string, text string"), spark.createDataFrame(queries, "query_id string, keywords array<string>")
    got = lambda n, q=q, f=f: sorted(map(str, search.lexical(f, q, n).collect()))
    rows = lambda n: sorted(f"Row(query_id={i!r}, uri={u!r}, hits={h}, score={s})" for i, u, h, s in _by_words(files, queries, n))
    assert got(10) == rows(10)
    assert got(10, q.limit(0)) == got(10, q, f.limit(0)) == []
    for small in ({"SPARSE": 1}, {"SPARSE": 10**9, "COUNTED": 50}, {"BITMAP_BYTES": 8 * 7 * 3}, {"CELL_WORDS": 500, "CELL_ASKED": 40}, {"ASKED_WORDS": 60}):
        with monkeypatch.context() as m:
            for k, v in small.items():
                m.setattr(search, k, v)
            assert got(3) == rows(3), small


def test_lexical_lists_no_pairs(spark):
    # Ten words that all share: 250 million matches, of which the joins that were here once list every one.
    common = [f"common{i}" for i in range(10)]
    files = spark.range(5000).select(F.format_string("u%05d", "id").alias("uri"), F.lit(" ".join(common)).alias("text"))
    queries = spark.range(5000).select(F.col("id").cast("string").alias("query_id"), F.array(*map(F.lit, common)).alias("keywords"))
    found = search.lexical(files, queries, 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.groupBy("uri", "hits", "score").count().orderBy("uri").collect()] == [("u00000", 10, 0.43, 5000), ("u00001", 10, 0.43, 5000)]


def test_places_by_number():
    rng = np.random.default_rng(2)
    for most in (1, 50, 1 << 16, 1 << 20, 1 << 31):
        x = rng.integers(0, most, 3000).astype(np.int32)
        assert (search._by_number(x) == np.argsort(x, kind="stable")).all()
    assert len(search._by_number(x[:0])) == 0


def test_lexical_gives_every_cell_a_partition(spark):
    # By the hash of their cell several of them met in one partition, which took as long as all of them.
    files = spark.range(50).select(F.format_string("u%02d", "id").alias("uri"), F.lit("one two").alias("text"))
    queries = spark.range(1100).select(F.col("id").cast("string").alias("query_id"), F.array(F.lit("one")).alias("keywords"))
    plan = search.lexical(files, queries, 2)._jdf.queryExecution().executedPlan().toString()
    assert "direct_shuffle_partition_id(cell" in plan and "hashpartitioning(cell" not in plan and "hashpartitioning(qb" not in plan


def test_hybrid_cuts_after_the_rerank(spark):
    q = spark.createDataFrame([("q", ["garden"], ["Ada"])], "query_id string, keywords array<string>, entities array<string>")
    tied = [("q", f"mem://user/u/a{i:02d}", 0.18, "a garden") for i in range(12)]
    lex = spark.createDataFrame([*tied, ("q", "mem://user/u/z.md", 0.18, "Ada's garden")], "query_id string, uri string, score double, snippet string")
    vec = spark.createDataFrame([("q", "mem://user/u/v.md", 0.9, None, "layered", 0), ("q", "mem://user/u/z.md", 0.1, None, "semantic", 1)], "query_id string, uri string, score double, snippet string, source string, ordinal int")
    got = [tuple(r)[1:] for r in search.hybrid(vec, lex, q, 3).orderBy(F.desc("score"), "uri").collect()]
    assert got == [("mem://user/u/v.md", 1.02), ("mem://user/u/z.md", 0.38), ("mem://user/u/a00", 0.09)]
    files = spark.createDataFrame([("u", "x" * 300 + " Garden " + "y" * 300)], "uri string, text string")
    assert [r["snippet"] for r in search.lexical_substrings(files, q, None).collect()] == ["..." + "x" * 79 + " Garden " + "y" * 133]


def test_evaluation(spark):
    r = spark.createDataFrame([(1, True, 1.0, 10), (1, False, 3.0, 10), (2, None, 2.0, 5)], "category int, correct boolean, seconds double, tokens long")
    s = {x["category"]: (x["total"], x["correct"], x["score"]) for x in evaluate.judge_summary(r).collect()}
    assert s == {1: (2, 1, 50.0), 2: (1, 0, 0.0), None: (3, 1, 33.33)}
    a = {x["category"]: (x["accuracy"], x["n_none"]) for x in evaluate.answer_stats(r).collect()}
    assert a == {1: (0.5, 0), 2: (0.0, 1)}


def _bursts(times, gap, cap):
    out, first, last, n = [], None, None, 0
    for t in sorted(times):
        if first is not None and (t - last >= gap or t - first >= cap):
            out.append((first, min(last + gap, first + cap), n))
            first, n = None, 0
        first, last, n = (t if first is None else first), t, n + 1
    return [*out, (first, min(last + gap, first + cap), n)]


def test_runs_over_many_batches_equal_session_windows(spark):
    rnd = random.Random(8)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), T + dt.timedelta(seconds=3 * rnd.randrange(7000))) for _ in range(3000)] + [("x", None), (None, T), (None, T + dt.timedelta(seconds=5))]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(small)
    spark.conf.set(small, "50")
    try:
        got = sorted(map(repr, (tuple(r) for r in windows.debounce(df, "20 seconds").collect())))
    finally:
        spark.conf.set(small, old)
    session = df.groupBy("key", F.session_window("ts", "20 seconds").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    assert got == sorted(map(repr, (tuple(r) for r in session.where("w IS NOT NULL").select("key", "first", "w.end", "n").collect())))
    assert windows.debounce(df.limit(0), "20 seconds").count() == 0


def test_debounce_capped_against_brute_force(spark):
    rnd = random.Random(3)
    times = {k: [rnd.randrange(0, 4000) for _ in range(120)] for k in "abc"}
    df = spark.createDataFrame([(k, T + dt.timedelta(seconds=t)) for k, ts in times.items() for t in ts], "key string, ts timestamp")
    got = sorted((r["key"], (r["first_at"] - T).total_seconds(), (r["due_at"] - T).total_seconds(), r["n_events"]) for r in windows.debounce_capped(df, 40, 100).collect())
    assert got == sorted((k, *map(float, b[:2]), b[2]) for k, ts in times.items() for b in _bursts(ts, 40, 100))
    assert windows.debounce_capped(df.limit(0), 40, 100).count() == 0


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(k, T + dt.timedelta(seconds=s)) for k in "ab" for s in (0, 10, 100, 105, 400)]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", T + dt.timedelta(days=1))], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.debounce_stream(stream, "60 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("bursts").collect() if r["key"] != "z"}
    want = {tuple(r) for r in windows.debounce(spark.createDataFrame(rows, "key string, ts timestamp"), "60 seconds").collect()}
    assert got == want
