"""Most similar vectors for every vector.

Method: learned partitions. On a bounded sample the exact neighbour graph is cut into balanced parts, and a
small classifier learns which parts hold a vector's neighbours. Every vector lives in its most probable part
and is compared with the members of its few most probable parts; the candidates are ranked exactly.

The partition is a tree: a part that holds far more than PART_SIZE vectors, because the collection is large or
because a cluster is dense, is cut again by a classifier of its own, learned where the part's sample is. So a
part's size, and with it the work for a vector, doesn't grow with the collection. What can't be told apart even
so is cut into blocks, and so is the crowd of a part that very many vectors ask.

Equal vectors are one: a vector that a third of all rows repeat is indexed once, and its copies are expanded at
the end to the few that can be among anyone's nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.common import batch, mix64

DIMENSION = 64
#: Vectors of the sample that a classifier is learned from, and neighbours in its graph.
SAMPLE, GRAPH = 16_000, 10
#: Vectors of a part on average, least and most parts of one classifier, levels of the tree.
PART_SIZE, LEAST_PARTS, BRANCH, DEPTH = 1024, 16, 256, 4
#: A part of so many times PART_SIZE is cut again; one of so many times is cut into blocks.
SPLIT, BLOCK = 3, 6
#: Parts are asked until they hold this share of the probability and this many times k vectors, at most PROBES beyond that.
MASS, ENOUGH, PROBES = 0.8, 20, 32
#: Bound of the broadcast tree in bytes; parts grow beyond some 500 million vectors, so that it holds.
TREE_BYTES = 256 << 20
HIDDEN = 128

_VECTOR = pa.schema([("id", pa.string()), ("vh", pa.int64()), ("vec", pa.binary())])
_VECTOR_DDL = "id string, vh long, vec binary"
#: A member of a part (kind 0) or a vector that asks it (kind 1).
_PLACED = pa.schema([("leaf", pa.int64()), ("block", pa.int32()), ("crowd", pa.int32()), ("kind", pa.int8()), ("vh", pa.int64()), ("id", pa.string()), ("vec", pa.binary())])
_PLACED_DDL = "leaf long, block int, crowd int, kind byte, vh long, id string, vec binary"
#: What a vector found in one place: the others' hashes, and the similarities in units of 1e-9.
_LISTED = pa.schema([("vh", pa.int64()), ("others", pa.list_(pa.int64())), ("sims", pa.list_(pa.int32()))])
_LISTED_DDL = "vh long, others array<long>, sims array<int>"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of every row of unit vectors, in blocks."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for each row, sizes within slack of equal, few graph edges between parts.

    Starts from balanced spherical k-means and moves rows to the part that most of their neighbours are in,
    the largest gains first, while there is room.
    """
    n, room = len(x), int(np.ceil(len(x) / parts * slack))
    rng = np.random.default_rng(7)
    centre = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, dtype=np.int64)
    for _ in range(8):
        label = _fill(x @ centre.T, room)
        centre = np.stack([x[label == p].sum(axis=0) if (label == p).any() else centre[p] for p in range(parts)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    source = np.repeat(np.arange(n), graph.shape[1])
    target = graph.ravel()
    for _ in range(rounds):
        votes = np.bincount(source * parts + label[target], minlength=n * parts) + np.bincount(target * parts + label[source], minlength=n * parts)
        votes = votes.reshape(n, parts).astype(np.float64)
        gain = votes - votes[np.arange(n), label][:, None]
        best = gain.argmax(axis=1)
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain[np.arange(n), best]):
            if gain[i, best[i]] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 500:
            break
    return label


def _fill(score: np.ndarray, room: int) -> np.ndarray:
    """Each row's best part with room left, rows with the clearest choice first."""
    order = np.argsort(-score, axis=1)
    label = np.empty(len(score), dtype=np.int64)
    size = np.zeros(score.shape[1], dtype=np.int64)
    for i in np.argsort(-score.max(axis=1)):
        for p in order[i]:
            if size[p] < room:
                label[i] = p
                size[p] += 1
                break
    return label


class Router:
    """A classifier with one hidden layer: unit vector -> probability of each part to hold its neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray, epochs: int = 25, rate: float = 2e-3):
        rng = np.random.default_rng(11)
        m = target.shape[1]
        w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, m)), np.zeros(m)]
        self.w = [a.astype(np.float32) for a in w]
        first, second = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                k = order[a : a + 256]
                h = np.maximum(x[k] @ self.w[0] + self.w[1], 0)
                d = (np.exp(_log_softmax(h @ self.w[2] + self.w[3])) - target[k]) / len(k)
                dh = (d @ self.w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((x[k].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    first[j] += 0.1 * (g - first[j])
                    second[j] += 0.001 * (g * g - second[j])
                    self.w[j] -= rate * (1 - epoch / epochs) * (first[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return _log_softmax(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def learn(x: np.ndarray, parts: int) -> Router:
    """Partition the sample's neighbour graph and train the router on it."""
    graph = neighbour_graph(x, GRAPH)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts), dtype=np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
    target[np.arange(len(x)), label] += 2
    return Router(x, target / target.sum(axis=1, keepdims=True))


class Tree:
    """Routers by node, and the expected vectors of every leaf. The children of node u are u * BRANCH + 1 and on."""

    def __init__(self) -> None:
        self.routers: dict[int, Router] = {}
        self.size: dict[int, float] = {}

    def split(self, node: int, router: Router, x: np.ndarray, scale: float) -> None:
        """Put a router at a leaf; x: unit vectors of a sample of the leaf, each standing for `scale` vectors."""
        self.routers[node] = router
        self.size.pop(node, None)
        home = np.bincount(router.log_odds(x).argmax(axis=1), minlength=router.w[3].shape[0])
        self.size |= {node * BRANCH + 1 + c: float(n) * scale for c, n in enumerate(home)}

    def route(self, x: np.ndarray, enough: float = 0.0, mass: float = MASS, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves each row asks, by row, the most probable first: that is its home."""
        row, node, odds = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.float32)
        if not self.routers:
            return row, node
        wide = max(probes, int(np.ceil(enough / max(np.mean(list(self.size.values())), 1.0))))
        while True:
            inner = np.isin(node, list(self.routers))
            if not inner.any():
                break
            parts = [(row[~inner], node[~inner], odds[~inner])]
            for u in np.unique(node[inner]):
                own = np.flatnonzero(node == u)
                z = self.routers[int(u)].log_odds(x[row[own]]) + odds[own, None]
                best = np.argsort(-z, axis=1, kind="stable")[:, :wide]
                parts.append((np.repeat(row[own], best.shape[1]), (u * BRANCH + 1 + best).ravel(), np.take_along_axis(z, best, axis=1).ravel()))
            row, node, odds = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((node, -odds, row))
            row, node, odds = row[order], node[order], odds[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, node, odds = row[place < wide], node[place < wide], odds[place < wide]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        p = np.exp(odds.astype(np.float64))
        held = np.array([self.size.get(int(u), 0.0) for u in node])
        before_p, before_n = (np.cumsum(v) - v for v in (p, held))
        before_p, before_n = before_p - before_p[first], before_n - before_n[first]
        ask = (place == 0) | (before_n < enough) | ((before_p < mass) & (place < probes))
        return row[ask], node[ask]

    def bytes(self) -> int:
        return sum(sum(a.nbytes for a in r.w) for r in self.routers.values())


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double."""
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, DIMENSION)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors with a hash that equal ones share."""
    for rb in batches:
        lists = rb.column(1)
        if not rb.num_rows:
            continue
        raw = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIMENSION)
        good = np.isfinite(raw).all(axis=1) & raw.any(axis=1)
        raw, ids = np.ascontiguousarray(raw[good]), rb.column(0).filter(pa.array(good))
        whole = np.rint(_unit(raw) * 1e7).astype(np.int64).view(np.uint64)
        h = np.zeros(len(raw), dtype=np.uint64)
        for d in range(DIMENSION):
            h = mix64(h ^ whole[:, d]) + np.uint64(d)
        vec = pa.Array.from_buffers(pa.binary(4 * DIMENSION), len(raw), [None, pa.py_buffer(raw.tobytes())])
        yield batch(_VECTOR, id=ids, vh=h.view(np.int64), vec=vec.cast(pa.binary()))


def usable(memories: DataFrame) -> DataFrame:
    """id, vh, vec of every record whose embedding has 64 finite elements and is not all zero; redelivered rows once."""
    fit = (F.size("embedding") == DIMENSION) & ~F.exists("embedding", lambda e: e.isNull())
    return memories.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & fit).select(F.col("id").cast("string"), F.col("embedding").cast("array<float>")).mapInArrow(_read, _VECTOR_DDL)


def _once(rb: pa.RecordBatch, seen: dict[int, str]) -> pa.RecordBatch:
    """The rows whose vector has not been seen in this task with a smaller id; of equal ones in the batch that with the smallest id."""
    least: dict[int, tuple[str, int]] = {}
    for i, (h, ident) in enumerate(zip(rb.column("vh").to_pylist(), rb.column("id").to_pylist(), strict=True)):
        if h not in least or ident < least[h][0]:
            least[h] = (ident, i)
    fresh = sorted(i for h, (ident, i) in least.items() if h not in seen or ident < seen[h])
    if len(seen) > 500_000:  # bounds the memory; further copies are dropped where the part is
        seen.clear()
    seen.update({h: ident for h, (ident, _) in least.items() if h not in seen or ident < seen[h]})
    return rb.take(pa.array(fresh, type=pa.int64()))


def grown(vectors: DataFrame, rows: int, sample: int, part_size: int, branch: int = BRANCH) -> tuple[Tree, np.ndarray, float]:
    """The tree for id, vh, vec of at most `rows` rows, the sample's unit vectors, and the share of the different vectors that they are.

    vh is a hash, so those below a threshold are a random sample. Deeper routers are learned by a task each and
    gathered: HIDDEN floats a leaf, within TREE_BYTES.
    """
    spark = vectors.sparkSession
    share = min(1.0, sample / max(rows, 1))
    limit = int(-(2**63) + share * 2**64) - 1
    drawn = vectors.where(F.col("vh") <= F.lit(min(limit, 2**63 - 1))).select("vh", "vec").dropDuplicates(["vh"]).orderBy("vh").toPandas()
    tree = Tree()
    x = _unit(np.frombuffer(b"".join(drawn["vec"]), dtype=np.float32).reshape(-1, DIMENSION)).astype(np.float32)
    n = int(len(x) / share)
    part_size = max(part_size, int(n * (HIDDEN + 1) * 4 / TREE_BYTES))
    parts = min(branch, max(LEAST_PARTS, round(n / part_size)), len(x) // 2)
    if parts < 2:
        tree.size[0] = float(n)
        return tree, x, share
    tree.split(0, learn(x, parts), x, 1 / share)
    for _ in range(DEPTH - 1):
        big = {u: min(branch, max(2, round(s / part_size))) for u, s in tree.size.items() if s > SPLIT * part_size}
        if not big:
            break
        want = {u: min(1.0, 64 * b / tree.size[u]) for u, b in big.items()}
        if share == 1.0:  # the sample is the whole collection already
            row, leaf = tree.route(x, mass=0.0)
            for u, b in big.items():
                own = x[row[leaf == u]]
                if (b := min(b, len(own) // 4)) >= 2:
                    tree.split(u, learn(own, b), own, 1.0)
            continue
        shared = spark.sparkContext.broadcast((tree, big, want))
        drawn_of = vectors.select("vh", "vec").mapInArrow(_sampler(shared), "leaf long, vh long, vec binary").dropDuplicates(["leaf", "vh"])
        learned = drawn_of.groupBy("leaf").applyInArrow(_learner(shared), "leaf long, router binary, homes array<long>").collect()
        for r in learned:
            router = Router.__new__(Router)
            m = len(r["homes"])
            flat = np.frombuffer(r["router"], dtype=np.float32)
            ends = np.cumsum([DIMENSION * HIDDEN, HIDDEN, HIDDEN * m])
            router.w = [flat[: ends[0]].reshape(DIMENSION, HIDDEN), flat[ends[0] : ends[1]], flat[ends[1] : ends[2]].reshape(HIDDEN, m), flat[ends[2] :]]
            u = r["leaf"]
            tree.routers[u] = router
            tree.size.pop(u)
            tree.size |= {u * BRANCH + 1 + c: h / want[u] for c, h in enumerate(r["homes"])}
    return tree, x, share


def _sampler(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map that draws each big leaf's sample: those of its vectors whose second hash is under the leaf's share."""
    schema = pa.schema([("leaf", pa.int64()), ("vh", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, big, want = shared.value
        for rb in batches:
            if not rb.num_rows:
                continue
            row, leaf = tree.route(_unit(_matrix(rb.column(1))).astype(np.float32), mass=0.0)
            second = mix64(rb.column(0).to_numpy().view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) / 2.0**64
            keep = np.flatnonzero(second[row] < np.array([want.get(int(u), 0.0) for u in leaf]))
            take = pa.array(row[keep])
            yield batch(schema, leaf=leaf[keep], vh=rb.column(0).take(take), vec=rb.column(1).take(take))

    return run


def _learner(shared: object) -> Callable[[pa.Table], pa.Table]:
    """Learns the router of one leaf from its sample; no row where the vectors are too few to tell apart."""

    def run(t: pa.Table) -> pa.Table:
        _, big, _ = shared.value
        leaf = t.column("leaf")[0].as_py()
        t = t.take(np.argsort(t.column("vh").to_numpy(), kind="stable"))  # the same model whatever the order of arrival
        x = _unit(_matrix(t.column("vec"))).astype(np.float32)
        parts = min(big[leaf], len(x) // 4)
        rows = []
        if parts >= 2:
            router = learn(x, parts)
            homes = np.bincount(router.log_odds(x).argmax(axis=1), minlength=parts)
            rows.append((leaf, b"".join(a.astype(np.float32).tobytes() for a in router.w), homes.tolist()))
        return pa.table({"leaf": pa.array([r[0] for r in rows], pa.int64()), "router": pa.array([r[1] for r in rows], pa.binary()), "homes": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

    return run


def _near(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every row's k greatest, and of whatever float32 can't tell from the k-th."""
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - np.float32(1e-6)
        return np.nonzero(s >= least[:, None])
    return np.nonzero(s > -2)


def _exact(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the pairs in units of 1e-9."""
    out = np.empty(len(r), dtype=np.int32)
    for a in range(0, len(r), 1 << 16):
        b = slice(a, a + (1 << 16))
        out[b] = np.rint(np.einsum("ij,ij->i", x[r[b]], y[c[b]]) * 1e9)
    return out


def _best(r: np.ndarray, c: np.ndarray, sim: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar of each r, ties to the smaller `tie`, sorted by r."""
    order = np.lexsort((tie, -sim, r))
    r, c, sim = r[order], c[order], sim[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], sim[keep]


def compared(t: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vh, other vh, similarity) that one part's members find among themselves, and its askers among them and they among the askers.

    A pair of a member and an asker counts for both, for the member only if it beats its k-th at home.
    """
    kind = t.column("kind").to_numpy()
    vh = t.column("vh").to_numpy()
    member, query = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    ids = t.column("id").take(pa.array(member)).to_pylist()
    rank = np.empty(len(member), dtype=np.int64)
    rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    order = np.lexsort((rank, vh[member]))
    first = order[np.append(True, vh[member][order][1:] != vh[member][order][:-1])] if len(order) else order
    member, rank = member[first], rank[first]
    query = query[np.unique(vh[query], return_index=True)[1]]
    if not len(member):
        return
    x = _unit(_matrix(t.column("vec").take(pa.array(member))))
    x32, own = x.astype(np.float32), vh[member]
    least = np.full(len(own), -2, dtype=np.float32)
    home = t.column("crowd")[0].as_py() == 0  # of several crowds only one says what members find among themselves
    for a in range(0, len(own), 512):
        s = x32[a : a + 512] @ x32.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        if len(own) > k:
            least[a : a + 512] = np.partition(s, len(own) - k, axis=1)[:, len(own) - k] - np.float32(1e-6)
        if home:
            r, c = _near(s, k)
            r, c, sim = _best(r + a, c, _exact(x, x, r + a, c), rank[c], k)
            yield own[r], own[c], sim
    if not len(query):
        return
    asker = vh[query]
    back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for a in range(0, len(query), 512):
        y = _unit(_matrix(t.column("vec").take(pa.array(query[a : a + 512]))))
        s = y.astype(np.float32) @ x32.T
        r, c = _near(s, k)
        r, c, sim = _best(r, c, _exact(y, x, r, c), rank[c], k)
        yield asker[r + a], own[c], sim
        r, c = np.nonzero(s >= least)
        back.append((c, r + a, _exact(y, x, r, c)))
        held += len(c)
        if held > 500_000 or a + 512 >= len(query):
            c, r, sim = (np.concatenate(z) for z in zip(*back, strict=True))
            c, r, sim = _best(c, r, sim, asker[r], k)
            back, held = [(c, r, sim)], len(c)
    c, r, sim = back[0]
    yield own[c], asker[r], sim


def _lists(vh: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.Table:
    """One row for each vh with all that it found here."""
    keep = vh != other
    vh, other, sim = vh[keep], other[keep], sim[keep]
    order = np.argsort(vh, kind="stable")
    vh, other, sim = vh[order], other[order], sim[order]
    start = np.flatnonzero(np.append(True, vh[1:] != vh[:-1])) if len(vh) else np.zeros(0, dtype=np.int64)
    ends = pa.array(np.append(start, len(vh)).astype(np.int32))
    return pa.table([pa.array(vh[start]), pa.ListArray.from_arrays(ends, pa.array(other)), pa.ListArray.from_arrays(ends, pa.array(sim.astype(np.int32)))], schema=_LISTED)


_NEAR = pa.schema([("vh", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])


def _merger(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists sorted by vh to the k nearest others of each, with whatever ties with the k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))

        def cut(vh: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((other, -sim, vh))
            vh, other, sim = vh[order], other[order], sim[order]
            new = np.append(True, (vh[1:] != vh[:-1]) | (other[1:] != other[:-1]) | (sim[1:] != sim[:-1]))  # a pair found twice has one similarity
            vh, other, sim = vh[new], other[new], sim[new]
            first = np.searchsorted(vh, vh)
            kth = sim[np.minimum(first + k, np.searchsorted(vh, vh, "right")) - 1]
            keep = sim >= kth
            return batch(_NEAR, vh=vh[keep], other=other[keep], similarity=sim[keep] / 1e9)

        for rb in batches:
            if not rb.num_rows:
                continue
            lists = rb.column(1)
            vh = np.repeat(rb.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            own = (vh, lists.flatten().to_numpy(), rb.column(2).flatten().to_numpy())
            rows = tuple(np.concatenate(c) for c in zip(rest, own, strict=True))
            if not len(rows[0]):
                continue
            upto = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            rest = tuple(c[upto:] for c in rows)
            if upto:
                yield cut(*(c[:upto] for c in rows))
        if len(rest[0]):
            yield cut(*rest)

    return run


def nearest(memories: DataFrame, k: int = 10, sample: int = SAMPLE, part_size: int = PART_SIZE, mass: float = MASS, branch: int = BRANCH) -> DataFrame:
    """The k most similar other records of every usable record: id, neighbour_id, rank, similarity.

    Similarity is the cosine in double, rounded to nine decimals; ties go to the smaller id. Unusable embeddings
    (null, of another length, all zero, with null or non-finite elements) take no part. An empty table gives no
    rows. A collection of at most ENOUGH * k vectors is compared whole, since every part is asked.
    """
    spark = memories.sparkSession
    every = usable(memories)
    tree, drawn, share = grown(every, memories.count(), sample, part_size, branch)
    n, enough = int(len(drawn) / share), ENOUGH * k
    shared = spark.sparkContext.broadcast(tree)  # within TREE_BYTES
    row, leaf = tree.route(drawn, enough, mass)
    asked = dict(zip(*(v.tolist() for v in np.unique(leaf[np.append(False, row[1:] == row[:-1])][: len(leaf)], return_counts=True)), strict=True)) if len(drawn) else {}
    asked = {u: c / share for u, c in asked.items()}  # expected askers of each part beside its members
    blocks = {u: int(np.ceil(s / (BLOCK * part_size))) for u, s in tree.size.items() if s > BLOCK * part_size}
    crowds = {u: int(np.ceil(s / (4 * BLOCK * part_size))) for u, s in asked.items() if s > 4 * BLOCK * part_size}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, str] = {}
        for rb in batches:
            rb = _once(rb, seen)
            if not rb.num_rows:
                continue
            vh = rb.column("vh").to_numpy()
            row, leaf = shared.value.route(_unit(_matrix(rb.column("vec"))).astype(np.float32), enough, mass)
            home = np.append(True, row[1:] != row[:-1])
            spread = mix64(vh.view(np.uint64))
            out: list[list[np.ndarray]] = [[] for _ in range(5)]

            def add(rows: np.ndarray, leaves: np.ndarray, block: object, crowd: object, kind: int) -> None:
                for column, v in zip(out, (rows, leaves, block, crowd, kind), strict=True):
                    column.append(np.broadcast_to(np.asarray(v), rows.shape))

            special = np.isin(leaf, list(blocks.keys() | crowds.keys()))
            usual = ~special
            add(row[usual & home], leaf[usual & home], 0, 0, 0)
            add(row[usual & ~home], leaf[usual & ~home], 0, 0, 1)
            for u in np.unique(leaf[special]):
                b, c = blocks.get(int(u), 1), crowds.get(int(u), 1)
                m, q = row[(leaf == u) & home], row[(leaf == u) & ~home]
                mine = (spread[m] % np.uint64(b)).astype(np.int64)
                for j in range(c):
                    add(m, np.full(len(m), u), mine, j, 0)
                for i in range(b):  # members of earlier blocks ask the later ones, so each pair meets once
                    early = m[mine < i]
                    add(early, np.full(len(early), u), i, (spread[early] >> np.uint64(32)) % np.uint64(c), 1)
                    add(q, np.full(len(q), u), i, (spread[q] >> np.uint64(32)) % np.uint64(c), 1)
            rows, leaves, block, crowd, kind = (np.concatenate(c) for c in out)
            for a in range(0, len(rows), 10_000):
                at = pa.array(rows[a : a + 10_000])
                kinds = kind[a : a + 10_000].astype(np.int8)
                ids = pc.if_else(pa.array(kinds == 0), rb.column("id").take(at), pa.scalar(None, pa.string()))
                yield batch(_PLACED, leaf=leaves[a : a + 10_000], block=block[a : a + 10_000].astype(np.int32), crowd=crowd[a : a + 10_000].astype(np.int32), kind=kinds, vh=rb.column("vh").take(at), id=ids, vec=rb.column("vec").take(at))

    def search(t: pa.Table) -> pa.Table:
        found = list(compared(t, k))
        none = np.zeros(0, dtype=np.int64)
        return _lists(*(np.concatenate([none, *c]) for c in (zip(*found, strict=True) if found else ([], [], []))))

    copies = (sum(asked.values()) + n) / max(n, 1)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(n * copies * 300 / (32 << 20)) + 1)
    found = every.mapInArrow(place, _PLACED_DDL).repartition(tasks, "leaf", "block", "crowd").groupBy("leaf", "block", "crowd").applyInArrow(search, _LISTED_DDL)
    near = found.repartition(max(spark.sparkContext.defaultParallelism, int(n * 1000 / (32 << 20)) + 1), "vh").sortWithinPartitions("vh").mapInArrow(_merger(k), "vh long, other long, similarity double")
    ids = every.select("vh", "id").distinct()
    # Of equal vectors only the k + 1 smallest ids can be anyone's nearest.
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("vh").orderBy("id"))).where(F.col("n") <= k + 1)
    itself = few.select("vh", F.col("id").alias("neighbour_id"), F.lit(1.0).alias("similarity"))
    others = near.join(few.select(F.col("vh").alias("other"), F.col("id").alias("neighbour_id")), "other").select("vh", "neighbour_id", "similarity")
    best = others.unionByName(itself).withColumn("r", F.row_number().over(Window.partitionBy("vh").orderBy(F.desc("similarity"), "neighbour_id"))).where(F.col("r") <= k + 1)
    ranked = best.groupBy("vh").agg(F.sort_array(F.collect_list(F.struct("r", "neighbour_id", "similarity"))).alias("found"))  # at most k + 1
    own = F.slice(F.filter("found", lambda x: x["neighbour_id"] != F.col("id")), 1, k)
    return ids.join(ranked, "vh").select("id", F.posexplode(own).alias("at", "x")).select("id", F.col("x.neighbour_id").alias("neighbour_id"), (F.col("at") + 1).alias("rank"), F.col("x.similarity").alias("similarity"))


def pairs(nearest_rows: DataFrame) -> DataFrame:
    """Unordered pairs (a_id < b_id) of which one is among the nearest of the other."""
    return nearest_rows.select(F.least("id", "neighbour_id").alias("a_id"), F.greatest("id", "neighbour_id").alias("b_id")).distinct()
