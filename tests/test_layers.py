import datetime as dt

from pyspark.sql import functions as F

from mnemora.operators import layers, maintenance, search

T = dt.datetime(2025, 1, 1)


def test_rebuild_from_the_leaves(spark):
    rows = [("mem://user/u/a/x.md", "First one. Second one. Third."), ("mem://user/u/b/y.md", "Only this."), ("mem://user/u/z.md", "Own text."), ("mem://agent/k/c/n.md", None)]
    df = spark.createDataFrame(rows, "uri string, text string")
    got = {r["dir"]: r["abstract"] for r in layers.rebuilt(df).collect()}
    assert set(got) == {"mem://user", "mem://user/u", "mem://user/u/a", "mem://user/u/b", "mem://agent", "mem://agent/k", "mem://agent/k/c"}
    assert "First one." in got["mem://user/u/a"] and "Only this." in got["mem://user/u/b"]
    assert "Own text." in got["mem://user/u"]  # own files come before the children
    assert "Own text." in got["mem://user"]  # from the child's abstract
    assert layers.rebuilt(df.limit(0)).count() == 0


def test_bundle_and_stale(spark):
    m = spark.createDataFrame([("mem://u/a/.abstract.md", "L0", "abs"), ("mem://u/a/.overview.md", "L1", "over"), ("mem://u/a/x.md", None, "x"), ("mem://u/b/y.md", "L2", "y"), (None, "L0", "lost")], "uri string, layer string, content string")
    got = {r["dir"]: (r["abstract"], r["overview"], r["n_files"]) for r in layers.bundle(m).collect()}
    assert got == {"mem://u/a": ("abs", "over", 1), "mem://u/b": (None, None, 1)}
    f = spark.createDataFrame([("mem://u/a/x", T), ("mem://u/b/x", T), ("mem://u/c/x", T)], "uri string, at timestamp")
    l = spark.createDataFrame([("mem://u/a", T), ("mem://u/b", T - dt.timedelta(1))], "dir string, at timestamp")
    assert {r["dir"] for r in layers.stale(f, l).collect()} == {"mem://u/b", "mem://u/c"}
    assert layers.without_subtree(f, "mem://u/a").count() == 2


def test_sync_and_rates(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), (None, "x")], "uri string, content_hash string")
    v = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "uri string, content_hash string")
    assert {(r["uri"], r["action"]) for r in maintenance.sync_actions(f, v).collect()} == {("a", "add"), ("b", "skip"), ("c", "update"), ("d", "delete")}
    df = spark.createDataFrame([(0, 0), (1, 3)], "a long, b long")
    assert [r[0] for r in df.select(maintenance.rate(F.col("a"), F.col("b"))).collect()] == [0.0, 0.25]


def test_readiness(spark):
    s = spark.createDataFrame([("t1", "closed"), ("t2", "active"), ("t3", "closed"), ("t4", "closed")], "thread_id string, status string")
    i = spark.createDataFrame([("m1", "p1", ["t1", "t2"]), ("m2", "p2", ["t3"])], "id string, file_path string, source_sessions array<string>")
    v = spark.createDataFrame([("p1",)], "file_path string")
    assert {r["thread_id"] for r in maintenance.ready_sessions(s, i, v).where("ready").collect()} == {"t1"}


def test_first_tier(spark):
    h = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.35), (2, 12, 0.35), (2, 13, 0.1), (3, 14, 0.1)], "query_id long, vec_id long, score double")
    assert {(r["query_id"], r["vec_id"], r["tier"]) for r in search.first_tier(h, (0.45, 0.3), 5).collect()} == {(1, 10, 0), (2, 12, 1), (3, 14, 2)}
