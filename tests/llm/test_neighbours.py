import numpy as np

from mnemora.llm import neighbours as nb

SCHEMA = "id string, embedding array<float>, vec long"


def _exact(ids, x, k=10):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = {}
    for i, a in enumerate(ids):
        out[a] = [b for _, b in sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]]
    return out


def _found(spark, ids, x, **how):
    df = spark.createDataFrame(list(zip(ids, x.tolist(), [1] * len(ids))), SCHEMA)
    got = {}
    for r in nb.nearest(df, **how).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour_id"])
    return got


def _recall(got, want):
    return sum(len(set(got.get(a, [])) & set(bs)) for a, bs in want.items()) / sum(map(len, want.values()))


def test_few_vectors_with_ties_and_bad_ones(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 64)).astype(np.float32)
    x[1], x[2] = x[0], x[0] * 2  # equal, and parallel
    ids = [f"m{i:03d}" for i in range(120)]
    rows = [(i, [float(v) for v in e], 1) for i, e in zip(ids, x)]
    rows += [rows[5], ("null", None, 1), ("short", [1.0] * 3, 1), ("zero", [0.0] * 64, 1), ("hole", [None] + [1.0] * 63, 1), ("nan", [float("nan")] * 64, 1)]
    got = {}
    for r in nb.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour_id"])
    assert got == _exact(ids, x.astype(np.float64))


def test_one_and_two_vectors(spark):
    assert _found(spark, ["a"], np.ones((1, 64), dtype=np.float32)) == {}
    x = np.eye(64, dtype=np.float32)[:3]
    assert _found(spark, list("abc"), x) == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}


def test_many_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 64)).astype(np.float32)
    got = _found(spark, [f"a{i:03d}" for i in range(60)] + [f"b{i:03d}" for i in range(39)], np.concatenate([np.repeat(x[:1], 60, axis=0), x[1:]]))
    assert got["a050"] == [f"a{i:03d}" for i in range(10)]
    assert got["a003"] == [f"a{i:03d}" for i in range(11) if i != 3]


def test_parallel_vectors_tie_and_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 64)).astype(np.float32)
    x[:40] = x[0] * rng.uniform(0.3, 3, size=(40, 1)).astype(np.float32)
    ids = [f"m{i:03d}" for i in rng.permutation(90)]
    got, want = _found(spark, ids, x), _exact(ids, x.astype(np.float64))
    same = set(ids[:40])
    assert all(got[a] == want[a] for a in same)


def _clustered(rng, n, centres=40, noise=0.7):
    centre = rng.normal(size=(centres, 64))
    return (centre[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, 64))).astype(np.float32)


def test_recall_over_learned_parts(spark):
    x = _clustered(np.random.default_rng(2), 3000)
    ids = [f"m{i:04d}" for i in range(3000)]
    got = _found(spark, ids, x, sample=1500, part_size=100)
    assert {len(v) for v in got.values()} == {10}
    assert _recall(got, _exact(ids, x.astype(np.float64))) >= 0.9


def test_recall_over_a_deep_tree(spark):
    x = _clustered(np.random.default_rng(3), 2000)
    ids = [f"m{i:04d}" for i in range(2000)]
    for sample in (1000, 10_000):  # the routers below the first are learned by tasks, or here
        got = _found(spark, ids, x, sample=sample, part_size=40, branch=8)
        assert _recall(got, _exact(ids, x.astype(np.float64))) >= 0.9


def test_a_dense_cluster_is_cut_into_blocks(spark):
    rng = np.random.default_rng(5)
    x = _clustered(rng, 3000)
    x[:1000] = x[0] + 1e-3 * rng.normal(size=(1000, 64))  # a third of all vectors in one direction
    ids = [f"m{i:04d}" for i in range(3000)]
    got = _found(spark, ids, x, sample=1500, part_size=20)
    want = _exact(ids, x.astype(np.float64))
    assert _recall(got, want) >= 0.85
    assert _recall({a: got[a] for a in ids[:1000]}, {a: want[a] for a in ids[:1000]}) >= 0.85


def test_blocks_and_crowds_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 1)
    monkeypatch.setattr(nb, "ENOUGH", 1000)  # every part is asked, so the result is exact
    monkeypatch.setattr(nb, "DEPTH", 1)
    x = _clustered(np.random.default_rng(6), 800)
    ids = [f"m{i:04d}" for i in range(800)]
    assert _found(spark, ids, x, part_size=12) == _exact(ids, x.astype(np.float64))


def test_empty(spark):
    assert nb.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
