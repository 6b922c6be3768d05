"""Approximate nearest neighbours by inner product: forests of random-projection trees.

Rows are dealt into shards of bounded size, and every shard has a forest over all of its vectors. A tree splits its points
at the median of their products with a random direction down to small leaves. For inner products a vector gets one more
component that brings all vectors of the shard to one length; then the nearest point is the one with the largest product.

The leaves of all trees of a forest share one priority queue. A leaf's key is the largest distance between the query and a
split that lies between them, which no point of the leaf can undercut. The queue is drained in order of keys, many leaves at
a time, until a share of the shard's vectors has been met, or until its keys show that no better vector is left. What
was met is ranked by exact products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .vectors import numbered_vectors, packed, whole_vectors


@dataclass(frozen=True)
class Forest:
    """``share`` of a shard's vectors, and at least ``least_met`` of them, are met before the queue may stop early.

    Measured on unit vectors without any structure in 64 dimensions, the hardest case: see the README. Vectors in
    clusters need a fraction of it, as the queue's key then ends the search.
    """

    trees: int = 32
    leaf: int = 32
    share: float = 0.45
    least_met: int = 2_048
    shard_rows: int = 8_192
    block_queries: int = 1_024
    seed: int = 5


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added from the first component to the last."""
    if not left.shape[1]:
        return np.zeros(len(left))
    return np.add.accumulate(left * right, axis=1)[:, -1]


def build_forest(points: np.ndarray, plan: Forest, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders: trees x n, directions: trees x inner nodes x (d + 1), thresholds: trees x inner nodes).

    Every tree is complete; node i has children 2i + 1 and 2i + 2 and splits its points in halves by count, so equal
    points split like any others and all leaves have one size, give or take a point.
    """
    rng = np.random.default_rng([plan.seed, seed])
    n = len(points)
    lifted = _lifted(points)
    depth = max(0, int(np.ceil(np.log2(max(1, n / plan.leaf)))))
    inner = (1 << depth) - 1
    orders = np.empty((plan.trees, n), dtype=np.int32)
    directions = rng.standard_normal((plan.trees, inner, lifted.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-300)
    thresholds = np.zeros((plan.trees, inner))
    bounds = node_bounds(n, depth)
    for t in range(plan.trees):
        order = np.arange(n)
        for i in range(inner):
            a, b = bounds[i]
            product = lifted[order[a:b]] @ directions[t, i]
            middle = (b - a) // 2
            split = np.argpartition(product, middle)
            order[a:b] = order[a:b][split]
            # half way between the halves, so that a gap between them counts for queries on either side
            thresholds[t, i] = (product[split[:middle]].max() + product[split[middle]]) / 2
        orders[t] = order
    return orders, directions, thresholds


def node_bounds(n: int, depth: int) -> list[tuple[int, int]]:
    """The range of places that each node of a complete tree covers."""
    nodes = [(0, n)]
    for i in range((1 << depth) - 1):
        a, b = nodes[i]
        nodes += [(a, a + (b - a) // 2), (a + (b - a) // 2, b)]
    return nodes


def _lifted(points: np.ndarray) -> np.ndarray:
    """One more component, which gives all points the length of the longest."""
    squares = np.einsum("ij,ij->i", points, points)
    return np.column_stack([points, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))])


def leaf_places(orders: np.ndarray, bounds, depth: int) -> np.ndarray:
    """(all leaves of all trees) x (places of a leaf); shorter leaves repeat their last place."""
    begin, end = np.array(bounds[(1 << depth) - 1 :]).T
    at = begin[:, None] + np.minimum(np.arange((end - begin).max()), (end - begin - 1)[:, None])
    return orders[:, at].reshape(-1, at.shape[1])


def leaf_keys(margins: np.ndarray) -> np.ndarray:
    """Keys of all leaves of all trees, queries x leaves: the largest distance to a split that lies between.

    ``margins`` are the signed distances of queries to the splits, queries x trees x inner nodes.
    """
    queries, trees, inner = margins.shape
    keys, first = np.zeros((queries, trees, 1)), 0
    while first < inner:
        level = margins[:, :, first : 2 * first + 1]
        keys = np.stack([np.maximum(keys, level), np.maximum(keys, -level)], axis=3).reshape(queries, trees, -1)
        first = 2 * first + 1
    return keys.reshape(queries, -1)


def drain(query: np.ndarray, keys: np.ndarray, places: np.ndarray, points: np.ndarray, longest: float, k: int, plan: Forest, own: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, products) of the vectors that the shared queue meets for one query.

    The queue holds the leaves of all trees. Its least keys are taken out many at a time: first as many as there are
    trees, later what the vectors that are still wanted need. Leaves that the k-th best product rules out leave it.
    ``room`` is memory for as many vectors as there are points; ``own`` is the query's own place or -1.
    """
    n = len(points)
    enough = min(n, max(plan.least_met, int(np.ceil(plan.share * n))))
    reach = float(query @ query) + longest  # a product is (reach - squared distance) / 2
    met = np.zeros(n, dtype=bool)
    queue, take = np.arange(len(keys)), plan.trees
    found, products, best = [], [], np.empty(0)
    count = 0
    while len(queue) and count < enough:
        if take < len(queue):
            split = np.argpartition(keys[queue], take)
            taken, queue = queue[split[:take]], queue[split[take:]]
        else:
            taken, queue = queue, queue[:0]
        here = np.zeros(n, dtype=bool)
        here[places[taken]] = True
        fresh = np.flatnonzero(here & ~met)
        met |= here
        count += len(fresh)
        found.append(fresh)
        products.append(np.take(points, fresh, axis=0, out=room[: len(fresh)], mode="clip") @ query)
        best = np.concatenate([best, products[-1][fresh != own]])
        if len(best) > k:
            best = np.partition(best, len(best) - k)[-k:]
        if len(best) == k:
            queue = queue[keys[queue] ** 2 <= reach - 2 * best.min()]
        take = max(plan.trees, 2 * (enough - count) // places.shape[1])
    return np.concatenate(found), np.concatenate(products)


def search(queries: np.ndarray, homes: np.ndarray, points: np.ndarray, orders: np.ndarray, directions: np.ndarray, thresholds: np.ndarray, k: int, plan: Forest, at_once: int = 64):
    """Per query (places, exact products) of the at least k best vectors met, ties at the end included.

    ``homes`` has each query's own place in this shard, or -1: its copies under other ids are found with it, so one place
    more is kept and the query's id is left out afterwards.
    """
    n, width = points.shape
    trees, inner = thresholds.shape
    depth = int(np.log2(inner + 1))
    places = leaf_places(orders, node_bounds(n, depth), depth)
    longest = float(np.einsum("ij,ij->i", points, points).max(initial=0.0))
    size = np.abs(points).max(initial=0.0) * np.abs(queries).max(axis=1, initial=0.0) * width
    flat, room = directions[:, :, :width].reshape(-1, width), np.empty_like(points)
    for first in range(0, len(queries), at_once):
        some = queries[first : first + at_once]
        keys = leaf_keys((some @ flat.T).reshape(len(some), trees, inner) - thresholds)
        for q in range(first, first + len(some)):
            met, rough = drain(queries[q], keys[q - first], places, points, longest, k, plan, int(homes[q]), room)
            if len(met) > k + 1:
                slack = size[q] * width * 1e-15  # more than the rounding of a sum in any order
                met = met[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - slack]
            yield met, exact_products(points[met], np.broadcast_to(queries[q], (len(met), width)))


_PACKED = "key long, packed binary, size int"


def _pack(source):
    """mapInArrow step: usable vectors that are not zero, 8-byte floats."""
    for batch in source:
        for keys, sizes, values in whole_vectors(batch):
            held = np.add.reduceat(values != 0, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
            keep = (held > 0) & np.asarray(keys.is_valid())
            values = values[np.repeat(keep, sizes)] + 0.0  # of two zeros with signs one is kept
            yield pa.RecordBatch.from_arrays(
                [keys.filter(pa.array(keep)), packed(values.astype("<f8"), sizes[keep]), pa.array(sizes[keep].astype(np.int32))], names=["key", "packed", "size"]
            )


_SHARD = "size int, shard int, ids binary, id_ends binary, points binary, orders binary, directions binary, thresholds binary"


def _shard(plan: Forest):
    """applyInPandas step: the distinct vectors of a shard, each with its ids -> the shard's forest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("packed", ignore_index=True)
        size, shard = int(rows["size"].iloc[0]), int(rows["shard"].iloc[0])
        points = np.frombuffer(b"".join(rows["packed"]), "<f8").reshape(-1, size)
        orders, directions, thresholds = build_forest(points, plan, shard)
        ids = [np.sort(np.asarray(x, dtype=np.int64)) for x in rows["ids"]]
        parts = {
            "ids": np.concatenate(ids), "id_ends": np.cumsum([len(x) for x in ids]).astype(np.int64), "points": points,
            "orders": orders, "directions": directions, "thresholds": thresholds,
        }
        return pd.DataFrame([{"size": size, "shard": shard} | {k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()}])

    return run


_BLOCK = "size int, block int, query_ids binary, queries binary"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["key", "packed"], ignore_index=True)
    return pd.DataFrame([{"size": int(rows["size"].iloc[0]), "block": int(rows["block"].iloc[0]), "query_ids": rows["key"].to_numpy(np.int64).tobytes(), "queries": b"".join(rows["packed"])}])


_FOUND = "query_id long, vec_id long, score double"


def _visit(k: int, plan: Forest):
    """mapInArrow step: (block of queries, forest) pairs -> the best k of each query in that shard."""

    def run(source):
        for batch in source:
            for row in batch.to_pylist():
                size = row["size"]
                ids, ends, query_ids = (np.frombuffer(row[c], np.int64) for c in ("ids", "id_ends", "query_ids"))
                points, queries = (np.frombuffer(row[c], "<f8").reshape(-1, size) for c in ("points", "queries"))
                orders = np.frombuffer(row["orders"], np.int32).reshape(plan.trees, -1)
                directions = np.frombuffer(row["directions"]).reshape(plan.trees, -1, size + 1)
                thresholds = np.frombuffer(row["thresholds"]).reshape(plan.trees, -1)
                starts = np.append(0, ends[:-1])
                of = np.repeat(np.arange(len(ends)), ends - starts)
                by_id = np.argsort(ids, kind="stable")
                at = np.searchsorted(ids[by_id], query_ids)
                here = (at < len(ids)) & (ids[by_id[np.minimum(at, len(ids) - 1)]] == query_ids)
                homes = np.where(here, of[by_id[np.minimum(at, len(ids) - 1)]], -1)
                out_query, out_ids, out_scores = [], [], []
                for q, (places, scores) in enumerate(search(queries, homes, points, orders, directions, thresholds, k, plan)):
                    many = ends[places] - starts[places]
                    begin = np.repeat(starts[places] - np.cumsum(many) + many, many)
                    found, score = ids[begin + np.arange(many.sum())], np.repeat(scores, many)
                    other = found != query_ids[q]
                    found, score = found[other], score[other]
                    top = np.lexsort((found, -score))[:k]
                    out_query.append(np.full(len(top), query_ids[q]))
                    out_ids.append(found[top])
                    out_scores.append(score[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_query, out_ids, out_scores)], names=["query_id", "vec_id", "score"])

    return run


def _rounded_up(n: int, by: int) -> int:
    return max(1, -(-n // by))


def nearest_neighbours(vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, plan: Forest = Forest()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the largest inner products that its search met.

    ``is_query`` is a condition on the column ``key`` (the id). The score is exact: the products of the original
    components in double precision, added in order. Ties go to the smaller id; a query's own id is no candidate. Every
    row is indexed; of rows with the same vector the k + 1 with the smallest ids stand for all, since no other can be
    among the k best of any query. Vectors of different lengths are not compared with each other.

    Defined results: rows with a NULL id, with NULL, empty or zero vectors, or with NULL or non-finite components take
    no part; fewer than k candidates give all of them; rows that repeat an id and a vector count once, with
    different vectors each is a candidate and the smallest in bytes is the query; an empty table gives no rows; other
    columns are ignored.
    """
    usable = durable(numbered_vectors(vectors, id_column, vector_column).mapInArrow(_pack, _PACKED).dropDuplicates(["key", "packed"]))
    first = F.row_number().over(Window.partitionBy("size", "packed").orderBy("key"))
    points = usable.withColumn("place", first).where(F.col("place") <= k + 1).groupBy("size", "packed").agg(F.collect_list("key").alias("ids"))  # k + 1 at most
    points = durable(points)
    shards = _rounded_up(points.count(), plan.shard_rows)
    placed = points.withColumn("shard", F.pmod(F.xxhash64("packed"), F.lit(shards)).cast("int"))
    forests = durable(placed.groupBy("size", "shard").applyInPandas(_shard(plan), _SHARD))
    asked = durable(usable.where(is_query).groupBy("key", "size").agg(F.min("packed").alias("packed")))
    blocks = _rounded_up(asked.count(), plan.block_queries)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    visits = asked.groupBy("size", "block").applyInPandas(_block, _BLOCK).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = visits.join(forests, ["size", "shard"]).mapInArrow(_visit(k, plan), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
