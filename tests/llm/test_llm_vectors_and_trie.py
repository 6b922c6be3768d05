"""Sharded clustering, projection forests and the prefix trie: brute force, edges, and the parts they are made of."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.llm import prefix_trie, projection_forest, sharded_lloyd
from scoutframe.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")
CLASHES = ("key", "vector", "chunk", "block", "size", "packed", "cluster", "distance", "conv", "depth", "a", "b", "part", "row", "place", "n_convs")


def clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def lloyd(rows, plan):
    """Plain rounds in whole numbers over (id, components)."""
    kept = [(i, [math.floor(plan.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == plan.dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{plan.seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[: plan.clusters]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(plan.rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(x) // len(members[k]) for x in zip(*members[k])] if members[k] else c for k, c in enumerate(centroids)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = defaultdict(int)
    for _, k, far in last:
        inertia[k] += far
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, far, inertia[k], sum(inertia.values()), digest[k]) for i, k, far in last), key=str)


SMALL = sharded_lloyd.Lloyd(clusters=3, rounds=4, dimensions=5, block_columns=2, chunk_rows=4)
VECTORS = [
    (1, [0.1, 0.2, -0.3, 1.0, 2.0]), (2, [0.1, 0.2, -0.3, 1.0, 2.0]), (2, [0.1, 0.2, -0.3, 1.0, 2.0]), (2, [9.0, -8.5, 0.0, 0.0, 1e-9]), (3, None), (4, []), (5, [1.0, 2.0]),
    (6, [1.0, None, 0.0, 0.0, 0.0]), (7, [1.0, NAN, 0.0, 0.0, 0.0]), (8, [INF, 0.0, 0.0, 0.0, 0.0]), (None, [5.0, 5.0, 5.0, 5.0, 5.0]), (9, [0.0, 0.0, 0.0, 0.0, 0.0]),
    (10, [-0.0005, 0.0005, 70.0, -70.0, 3.0]), (11, [5.0, 5.0, 5.0, 5.0, 5.1]), (12, [-9.0, 8.5, 0.0, 0.0, -1e-9]),
]


@pytest.fixture(scope="module")
def vectors(spark):
    return clashing(spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")).repartition(3)


def test_lloyd_edges(vectors):
    got = sorted((tuple(r) for r in sharded_lloyd.cluster_vectors(vectors, plan=SMALL).collect()), key=str)
    assert got == lloyd(VECTORS, SMALL)
    many = sharded_lloyd.Lloyd(clusters=50, rounds=2, dimensions=5, block_columns=5)
    assert sorted((tuple(r) for r in sharded_lloyd.cluster_vectors(vectors, plan=many).collect()), key=str) == lloyd(VECTORS, many)
    assert sharded_lloyd.cluster_vectors(vectors.limit(0), plan=SMALL).collect() == []


def test_lloyd_ties_and_empty_clusters(spark):
    # all vectors equal but one: all starting centroids may be equal, the smaller number takes every tie, others stay empty
    rows = [(i, [1.0] * 5) for i in range(20)] + [(20, [2.0] * 5)]
    got = sharded_lloyd.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), plan=SMALL)
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows, SMALL)


def test_lloyd_refuses_what_overflows(spark):
    rows = [(1, [1e30] * 5)]
    with pytest.raises(Exception, match="squared distances"):
        sharded_lloyd.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), plan=SMALL).collect()


def product(v, w):
    total = v[0] * w[0]
    for x, y in zip(v[1:], w[1:]):  # in order; the built-in sum would compensate its rounding
        total += x * y
    return total


def brute_neighbours(rows, is_query, k):
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    asked = {}
    for i, v in kept:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v, key=lambda x: np.array(x, "<f8").tobytes())
    out = {}
    for q, v in asked.items():
        scores = {(-product(v, w), i) for i, w in kept if i != q and len(w) == len(v)}
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def neighbours(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours_edges(vectors):
    got = neighbours(projection_forest.nearest_neighbours(vectors, "key >= 0", k=4))
    want = brute_neighbours(VECTORS, lambda i: i >= 0, 4)
    assert set(got) == {q for q, found in want.items() if found}
    assert all(got[q] == want[q] for q in got)
    assert projection_forest.nearest_neighbours(vectors.limit(0), "key >= 0").collect() == []


def test_neighbours_of_copies(spark):
    # a third of all rows is one vector: the smallest ids of its copies are found, and the queue ends early
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(400)] + [(i, [3.0, 3.0, 3.0, 0.0, 0.0, 0.0]) for i in range(400, 600)]
    plan = projection_forest.Forest(shard_rows=64, block_queries=16, least_met=1, share=0.9, leaf=4)
    got = neighbours(projection_forest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "key % 25 = 0", k=5, plan=plan))
    want = brute_neighbours(rows, lambda i: i % 25 == 0, 5)
    assert set(got) == set(want)
    share = [len(set(got[q]) & set(want[q])) / 5 for q in want]
    assert np.mean(share) > 0.9 and got[400] == want[400] == [(i, 27.0) for i in range(401, 406)]


def test_queue_stops_by_its_bound():
    """Two far groups: a query meets its own and leaves the other unread, and loses nothing by that."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.standard_normal((500, 4)) * 0.01 + [5, 0, 0, 0], rng.standard_normal((500, 4)) * 0.01 - [5, 0, 0, 0]])
    plan = projection_forest.Forest(least_met=1_000, leaf=8)
    orders, directions, thresholds = projection_forest.build_forest(points, plan, 0)
    depth = int(np.log2(thresholds.shape[1] + 1))
    keys = projection_forest.leaf_keys((np.einsum("tid,d->ti", directions[:, :, :4], points[0]) - thresholds)[None])[0]
    places = projection_forest.leaf_places(orders, projection_forest.node_bounds(len(points), depth), depth)
    longest = float(np.einsum("ij,ij->i", points, points).max())
    found, products = projection_forest.drain(points[0], keys, places, points, longest, 5, plan, 0, np.empty_like(points))
    met = np.isin(np.arange(len(points)), found)
    assert sorted(set(found.tolist())) == sorted(found.tolist()) and np.allclose(products, points[found] @ points[0])
    assert met.sum() < len(points) / 2 + 8
    best = [i for i in np.argsort(-(points @ points[0])) if i][:5]
    assert met[best].all()


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_neighbours_recall_and_scores(spark, size):
    folder = f"/root/testdata/{size}"
    rows = dict(duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchall())
    got = neighbours(QUERIES["op12_projection_forest"](spark, folder))
    ids = np.array(sorted(rows))
    points = np.array([rows[i] for i in ids.tolist()], dtype=np.float64)
    recall = []
    for q in ids[ids % 20 == 0].tolist():
        scores = points @ points[ids == q][0]
        scores[ids == q] = -INF
        best = {int(i) for i in ids[np.lexsort((ids, -scores))[:20]]}
        assert len(got[q]) == 20 and all(s == pytest.approx(math.sumprod(rows[q], rows[i]), abs=1e-12) for i, s in got[q])
        recall.append(len(best & {i for i, _ in got[q]}) / 20)
    assert np.mean(recall) > 0.9


def test_forest_recall_without_structure():
    """Isotropic points, which no split separates: the share that is met still holds nine of ten neighbours."""
    rng = np.random.default_rng(3)
    points = rng.standard_normal((8_192, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    plan = projection_forest.Forest()
    forest = projection_forest.build_forest(points, plan, 0)
    recall = []
    for q, (places, scores) in enumerate(projection_forest.search(points[:40], np.arange(40), points, *forest, 20, plan)):
        best = set(np.argsort(-(points @ points[q]))[:21].tolist())
        recall.append(len(best & set(places.tolist())) / 21)
    assert np.mean(recall) > 0.9


def trie(rows, group=100, longest=5):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (longest + 1)
        whole = own.get(c - c % group, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    out = {}

    def total(node):
        below = [total(x) for x in children[node]]
        saved = (len(nodes[node]) - 1) * len(node[-1][1]) if node else 0
        saved, leaves = saved + sum(s for s, _ in below), sum(n for _, n in below) or 1
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out[node] = (min(nodes[node]), len(node), min(nodes[node[:-1]]) if node else None, len(nodes[node]), len(children[node]), leaves, saved, digest)
        return saved, leaves

    if nodes:
        total(())
    return sorted(out.values(), key=str)


def tries(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


_TURN = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("plan", [prefix_trie.Trie(), prefix_trie.Trie(band=2, shard_nodes=3)])
def test_trie_edges(spark, plan):
    rows = [
        (100, 1, "user", "hi"), (100, 0, "system", None), (100, None, None, "first"), (100, 7, "user", "x" * 5), (101, 0, "user", "hi"), (101, 1, None, None),
        (102, 0, "user", "hi"), (102, 1, "assistant", "\U0001f600 é"), (103, 4, "user", "hi"), (None, 0, "user", "nobody"), (104, 0, "", ""), (205, 0, "user", "alone"),
        (206, 0, "user", "a"), (206, 0, "user", "a"), (206, 1, "user", "b"), (307, 0, "u", "hi"), (307, 1, "uh", "i"), (308, 0, "uh", "i"),
    ] + [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(7)] + [(500, t, "user", "long " + "y" * 10_000 * (t == 3)) for t in range(60)]
    frame = clashing(spark.createDataFrame(rows, _TURN)).repartition(7)
    assert tries(prefix_trie.prefix_trie(frame, plan=plan)) == trie(rows)
    assert prefix_trie.prefix_trie(frame.limit(0), plan=plan).collect() == []


def test_trie_without_turns(spark):
    # a conversation whose own turns all fall in its head, and whose group has no first one
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    assert tries(prefix_trie.prefix_trie(spark.createDataFrame(rows, _TURN))) == trie(rows)
    assert trie(rows)[0][1:4] == (0, None, 1)


def test_trie_of_one_long_conversation(spark):
    """One conversation holds nearly all rows: its turns lie in many parts and bands."""
    rows = [(700, t, "user", f"turn {t % 5}") for t in range(900)] + [(c, t, "user", f"turn {t % 5}") for c in (701, 799) for t in range(20)]
    frame = spark.createDataFrame(rows, _TURN).repartition(8)
    assert tries(prefix_trie.prefix_trie(frame, plan=prefix_trie.Trie(band=64, shard_nodes=100))) == trie(rows)


def test_node_table_is_minimal_and_verified():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1_000):
        depth, a, b = rng.integers(0, 9, n), rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**63), 2**63 - 1, n)
        table = prefix_trie.NodeTable(depth, a, b)
        slots = table.slots(depth, a, b)
        assert sorted(slots.tolist()) == list(range(n))
        assert (table.slots(depth + 1, a, b) == -1).all() and (table.slots(depth, a, b ^ 1) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(np.zeros(2, np.int64), np.ones(2, np.int64), np.ones(2, np.int64))
