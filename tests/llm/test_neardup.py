import random

import pytest

from mnemora.llm import neardup as nd

RECORDS = "table_name string, record_id string, content string, fp long"


def _pairs(rows):
    def runs(t):
        n = " ".join(t.lower().split())
        return {n[i : i + 4] for i in range(len(n) - 3)}

    sets = {(t, i): runs(c) for t, i, c in rows if c and len(" ".join(c.split())) >= 4}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for k, a in enumerate(keys) for b in keys[k + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}


def _rows(n=150):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(30)]
        rows.append(("t", f"{i:04d}", " ".join(w)))
        if i % 3 == 0:
            for k in range(rnd.randint(1, 4)):
                w[rnd.randrange(30)] = rnd.choice(words)
            rows.append(("t", f"{i:04d}e", "  ".join(w).upper()))
    return rows


def test_pairs_against_brute_force(spark):
    rows = _rows() + [("t", "c1", "same text here"), ("t", "c2", "Same  text here "), ("u", "c3", "same text here"), ("t", "n", None), ("t", "b", " 　"), ("t", "s", "abc")]
    df = spark.createDataFrame([(*r, 7) for r in rows + rows[:5]], RECORDS)
    got = {(r["table_name"], r["a_id"], r["b_id"]) for r in nd.record_pairs(df).collect()}
    want = _pairs(rows)
    assert got <= want and len(got) >= 0.98 * len(want) and ("t", "c1", "c2") in got


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(0)
    fp = np.sort(rnd.choice(10_000, 50, replace=False)).astype(np.int64)
    s = np.repeat(rnd.integers(-(1 << 62), 1 << 62, 2), 25)
    want = {(min(fp[i], fp[j]), max(fp[i], fp[j])) for i in range(50) for j in range(i) if s[i] == s[j]}
    for hot, large in ((8, {}), (4096, {5: 6}), (3, {5: 4})):
        monkeypatch.setattr(nd, "HOT", hot)
        row, key, side = nd._spread(np.full(50, 5), fp, large)
        rb = nd.batch(nd._BAND, band=key, fp=fp[row], s0=s[row], s1=s[row], s2=s[row], side=side)
        rb = pa.Table.from_batches([rb]).sort_by([(c, "ascending") for c in ("band", "side", "fp")]).combine_chunks().to_batches()
        out = pa.Table.from_batches(list(nd._buckets(iter(rb)))).to_pandas()
        assert set(zip(out["a"], out["b"])) == want


def test_large_buckets_are_found_in_a_sample_and_spread(spark, monkeypatch):
    monkeypatch.setattr(nd, "SPREAD", 40)
    monkeypatch.setattr(nd, "DRAWN", 2)
    base = " ".join(f"boilerplate number {i} of the long common text" for i in range(40))
    rows = [("t", f"{i:03d}", f"{base} {i:05d}") for i in range(120)]
    df = spark.createDataFrame(rows, "table_name string, record_id string, content string")
    keyed = nd.prepared(df).selectExpr("fp", "norm", "xxhash64(table_name)")
    assert nd._large_buckets(keyed)
    assert nd.text_links(nd.prepared(df)).count() == 120 * 119 // 2


def test_many_copies_are_one_group(spark):
    df = spark.createDataFrame([("t", f"{i:05d}", "the very same text") for i in range(600)] + [("t", "x", "quite another one")], "table_name string, record_id string, content string")
    assert nd.record_pairs(df).count() == 599  # each copy with the smallest id
    assert nd.groups(df).select("class_id").distinct().count() == 2
    g = nd.groups(df).groupBy("group_id").count().collect()
    assert sorted(r["count"] for r in g) == [1, 600]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in nd.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        nd.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), most_rounds=1)


def test_empty(spark):
    df = spark.createDataFrame([], "table_name string, record_id string, content string")
    assert nd.record_pairs(df).count() == 0 and nd.groups(df).count() == 0
