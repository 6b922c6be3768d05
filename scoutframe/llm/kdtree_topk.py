"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt into shards of bounded size; each shard is split at medians of its widest dimension down to small
leaves, with tight bounding boxes at all nodes. The bound of a box is the sum over dimensions of the larger product with
its two sides, and a box below the query's k-th score is left out. Queries travel in blocks. A block visits the leaves by
falling bound, ever more of them at a time, and a leaf meets all queries that want it in one product. Queries visit one
shard each first; the k-th score found there goes with them to all others. A shard's tree comes to its task once, and the
blocks that visit it stream past.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, narrow
from .vectors import packed, whole_vectors

EXACT = float(1 << 53)  # sums of products below this are exact in double precision
PENDING = 1 << 16  # candidates of a block that may wait before only the best are kept


def build_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of points, node bounds [begin, end), low corners, high corners); node i has children 2i + 1 and 2i + 2.

    Every node is split in halves by count, so the tree is complete and equal points split like any others.
    """
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    order = np.arange(n)
    nodes = [(0, n)]
    low, high = [], []
    for i in range((1 << (depth + 1)) - 1):
        a, b = nodes[i]
        inside = points[order[a:b]]
        low.append(inside.min(axis=0))
        high.append(inside.max(axis=0))
        if i < (1 << depth) - 1:
            axis, middle = int(np.argmax(high[-1] - low[-1])), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(inside[:, axis], middle)]
            nodes += [(a, a + middle), (a + middle, b)]
    return order, np.array(nodes, dtype=np.int64), np.array(low), np.array(high)


def _best(found: list[tuple], k: int, enough: np.ndarray) -> list[tuple]:
    """The k best of each query among (query, score, id) arrays; ``enough`` rises to the k-th score where there are k."""
    q, score, key = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((key, -score, q))
    q, score, key = q[order], score[order], key[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    last = place == k - 1
    enough[q[last]] = np.maximum(enough[q[last]], score[last])
    kept = place < k
    return [(q[kept], score[kept], key[kept])]


def _search_wide(queries, ids_of_queries, least, ids, points, k: int):
    """Beyond double precision: integers of any size, and no box is left out."""
    wide = np.array([[int(x) for x in row] for row in points], dtype=object)
    for q, vector in enumerate(queries):
        scores = wide @ np.array([int(x) for x in vector], dtype=object)
        yield q, sorted((-int(scores[at]), int(ids[at])) for at in np.flatnonzero((scores >= least[q]) & (ids != ids_of_queries[q])).tolist())[:k]


def search(queries, ids_of_queries, least, ids, points, nodes, low, high, k: int):
    """Per query its best (score, id) by larger score, then smaller id, at most k, each at least as good as ``least``."""
    if np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * points.shape[1] >= EXACT:
        yield from _search_wide(queries, ids_of_queries, least, ids, points, k)
        return

    def bounds(of: np.ndarray, boxes: slice) -> np.ndarray:
        return np.maximum(of, 0) @ high[boxes].T + np.minimum(of, 0) @ low[boxes].T

    enough = np.array(least, dtype=np.float64)
    inside = np.flatnonzero(bounds(queries, slice(0, 1))[:, 0] >= enough)  # the others need nothing of this tree
    first_leaf = len(nodes) // 2
    ceilings = bounds(queries[inside], slice(first_leaf, None))
    falling = np.argsort(-ceilings, axis=1, kind="stable")
    found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
    at, width, pending = 0, 1, 0
    while at < falling.shape[1]:
        leaves = falling[:, at : at + width]
        row, column = np.nonzero(np.take_along_axis(ceilings, leaves, axis=1) >= enough[inside, None])
        if not len(row):
            break  # all other boxes are lower still
        leaf, asking = leaves[row, column], inside[row]
        order = np.argsort(leaf, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            a, b = nodes[first_leaf + leaf[group[0]]]
            who = asking[group]
            scores = queries[who] @ points[a:b].T
            i, j = np.nonzero(scores >= enough[who, None])
            others = ids[a + j] != ids_of_queries[who[i]]
            i, j = i[others], j[others]
            found.append((who[i], scores[i, j], ids[a + j]))
            pending += len(i)
            if pending > PENDING:
                found, pending = _best(found, k, enough), 0
        found, pending = _best(found, k, enough), 0
        at, width = at + width, 2 * width
    q, score, key = found[0]
    ends = np.searchsorted(q, np.arange(len(queries) + 1))
    for i in range(len(queries)):
        own = slice(ends[i], ends[i + 1])
        yield i, [(-int(s), int(x)) for s, x in zip(score[own], key[own])]


def _integers(source):
    """mapInArrow step: usable vectors as floor(256 * x), in 8-byte floats (whole numbers up to 2**53 are exact)."""
    for batch in source:
        known = batch.filter(batch.column("key").is_valid())
        for keys, sizes, values in whole_vectors(known):
            with np.errstate(over="ignore"):
                scaled = np.floor(256.0 * values)
            stop = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(scaled))])
            good = bad[stop] == bad[stop - sizes]
            whole = scaled[np.repeat(good, sizes)].astype("<f8")
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(good)).cast(pa.int64()), packed(whole, sizes[good]), pa.array(sizes[good], pa.int32())], names=["key", "packed", "size"])


def _shard(leaf: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        size = int(rows["size"].iloc[0])
        points = np.frombuffer(b"".join(rows["packed"]), "<f8").reshape(-1, size)
        order, nodes, low, high = build_tree(points, leaf)
        ids = rows["key"].to_numpy()[order]
        packed = {"ids": ids, "points": points[order], "nodes": nodes, "low": low, "high": high}
        return pd.DataFrame([{"size": size, "shard": int(rows["shard"].iloc[0])} | {k: np.ascontiguousarray(v).tobytes() for k, v in packed.items()}])

    return run


_TREE = "size int, shard int, ids binary, points binary, nodes binary, low binary, high binary"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key", ignore_index=True)
    return pd.DataFrame([{
        "size": int(rows["size"].iloc[0]), "block": int(rows["block"].iloc[0]), "home": int(rows["home"].iloc[0]),
        "query_ids": rows["key"].to_numpy(np.int64).tobytes(), "queries": b"".join(rows["packed"]), "least": rows["least"].to_numpy(np.float64).tobytes(),
    }])


_BLOCK = "size int, block int, home int, query_ids binary, queries binary, least binary"


def _visit(k: int):
    """mapInArrow step: trees, each followed by the blocks that visit it -> the best of each query in that tree."""

    def run(source):
        at, numbers, floats = None, {}, {}
        for batch in source:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                size, place = row["size"].as_py(), (row["size"].as_py(), row["shard"].as_py())

                def read(columns, kind, width=1):
                    return {c: np.frombuffer(row[c].as_buffer(), kind).reshape(-1, width) for c in columns}

                if row["points"].is_valid:  # copied, as the batch goes
                    at = place
                    numbers = {"ids": np.frombuffer(row["ids"].as_py(), np.int64), "nodes": np.frombuffer(row["nodes"].as_py(), np.int64).reshape(-1, 2)}
                    floats = {c: np.frombuffer(row[c].as_py(), "<f8").reshape(-1, size) for c in ("points", "low", "high")}
                    continue
                if place != at:
                    continue  # no vector of this length in the shard
                queries = read(["queries"], "<f8", size)["queries"]
                query_ids, least = read(["query_ids"], np.int64)["query_ids"][:, 0], read(["least"], "<f8")["least"][:, 0]
                out = [
                    (int(query_ids[q]), key, -score)
                    for q, best in search(queries, query_ids, least, numbers["ids"], floats["points"], numbers["nodes"], floats["low"], floats["high"], k)
                    for score, key in best
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

    return run


def _rounded_up(n: int, by: int) -> int:
    return max(1, -(-n // by))


def top_inner_products(
    vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, shard_rows: int = 8_192, block_rows: int = 256, leaf: int = 128
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the largest integer inner products.

    ``is_query`` is a condition on the column ``key`` (the id). Scores are of floor(256 * x); ties go to the smaller id;
    a query's own id is no candidate. Vectors of other lengths are not compared with each other.

    Defined results: rows with a NULL id, with NULL or empty vectors, or with NULL or non-finite components take no part;
    fewer than k candidates give all of them; rows that repeat an id are candidates each, but one query (the
    smallest vector); an empty table gives no rows; other columns are ignored.
    """
    usable = durable(narrow(vectors, key=id_column, vector=vector_column).mapInArrow(_integers, "key long, packed binary, size int"))
    shards = _rounded_up(usable.count(), shard_rows)
    placed = usable.withColumn("shard", F.pmod(F.xxhash64("key", "packed"), F.lit(shards)).cast("int"))
    trees = durable(placed.groupBy("size", "shard").applyInPandas(_shard(leaf), _TREE))
    asked = durable(usable.where(is_query).groupBy("key", "size").agg(F.min("packed").alias("packed")))
    blocks = _rounded_up(asked.count(), block_rows)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("home", F.col("block") % shards)

    def visits(rows: DataFrame, shard_of) -> DataFrame:
        # met by partition, not by a join: Spark would judge the blocks by their size before they are copied to the
        # shards, take them for few and collect all copies in the driver for a broadcast
        asking = rows.groupBy("size", "block").applyInPandas(_block, _BLOCK).withColumn("shard", shard_of)
        met = trees.unionByName(asking.drop("home"), allowMissingColumns=True).repartition(shards, "size", "shard")
        return met.sortWithinPartitions("size", "shard", F.col("block").asc_nulls_first()).mapInArrow(_visit(k), "query_id long, vec_id long, score long")

    near = durable(visits(asked.withColumn("least", F.lit(float("-inf"))), F.col("home")))
    least = near.groupBy(F.col("query_id").alias("key")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("found"))
    informed = asked.join(least, "key", "left").withColumn("least", F.coalesce("found", F.lit(float("-inf")))).drop("found")
    others = F.explode(F.expr(f"filter(sequence(0, {shards - 1}), s -> s <> home)"))
    everything = near.unionByName(visits(informed, others))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return everything.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH whole AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) AS ranked WHERE rank <= 5
"""
