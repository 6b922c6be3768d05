"""Centroid clustering by Lloyd's rounds that are sharded over dimensions.

Vectors are stored as blocks: a chunk of rows times a range of columns. A task on a block knows that range of the
centroids only and gives exact partial distances; the partial distances of a chunk are added by its key and their argmin
is the assignment. The assignment goes back to the blocks of the chunk, each column range sums its members, and the sums of
a range update that range of the centroids and no other. No task and no row holds whole vectors of more than one chunk,
and no key has more rows than there are column ranges, whatever the clusters look like.

All arithmetic is on whole numbers, so the result does not depend on the order of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .vectors import numbered_vectors, whole_vectors

#: Components beyond this could give a squared distance that a long does not hold.
LARGEST = 1 << 28
IDS = -1  # the block that holds a chunk's ids


@dataclass(frozen=True)
class Lloyd:
    clusters: int = 8
    rounds: int = 10
    seed: int = 3
    scale: int = 1024
    dimensions: int = 64
    block_columns: int = 16
    chunk_rows: int = 4_096

    @property
    def blocks(self) -> int:
        return -(-self.dimensions // self.block_columns)


def _least_type(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the shortest type that holds them all."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for kind in ("<i2", "<i4"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype("<i8")


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").astype(np.int64)


def _whole_numbers(values: np.ndarray, plan: Lloyd) -> np.ndarray:
    scaled = np.floor(plan.scale * values)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ArithmeticError(f"components beyond {LARGEST // plan.scale} have no squared distances of 64 bits")
    return scaled.astype(np.int64)


_BLOCK = "chunk long, block int, n int, width int, data binary"
_BLOCK_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def _to_blocks(plan: Lloyd):
    """mapInArrow step: rows -> the blocks of each chunk, and one block with its ids."""

    def run(source):
        part = TaskContext.get().partitionId() << 33
        held_ids, held, rows, number = [], [], 0, 0

        def emit():
            nonlocal number
            points = np.concatenate(held).reshape(-1, plan.dimensions)
            ids = pa.concat_arrays(held_ids)
            known = np.asarray(ids.is_valid())
            out = [(part + number, IDS, len(points), 8, ids.fill_null(0).to_numpy().astype("<i8").tobytes() + known.astype(np.uint8).tobytes())]
            for b in range(plan.blocks):
                data = _least_type(points[:, b * plan.block_columns : (b + 1) * plan.block_columns])
                out.append((part + number, b, len(points), data.itemsize, np.ascontiguousarray(data).tobytes()))
            number += 1
            return _batch(out, ("chunk", "block", "n", "width", "data"), _BLOCK_TYPES)

        for batch in source:
            for keys, sizes, values in whole_vectors(batch):
                right = sizes == plan.dimensions
                points = _whole_numbers(values[np.repeat(right, sizes)], plan).reshape(-1, plan.dimensions)
                keys = keys.filter(pa.array(right))
                for at in range(0, len(points), plan.chunk_rows):
                    held_ids.append(keys.slice(at, plan.chunk_rows))
                    held.append(points[at : at + plan.chunk_rows])
                    rows += len(held[-1])
                    if rows >= plan.chunk_rows:
                        yield emit()
                        held_ids, held, rows = [], [], 0
        if rows:
            yield emit()

    return run


_SLICE = "block int, clusters int, centroids binary"


def _first_slices(plan: Lloyd):
    """mapInArrow step over the few starting vectors, which lie in one partition."""

    def run(source):
        rows = [row for batch in source for row in batch.to_pylist()]
        rows.sort(key=lambda r: (r["hash"] is None, r["hash"], r["vector"]))
        points = _whole_numbers(np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), plan.dimensions), plan)
        out = []
        for b in range(plan.blocks if rows else 0):
            mine = np.ascontiguousarray(points[:, b * plan.block_columns : (b + 1) * plan.block_columns], dtype="<i8")
            out.append((b, len(rows), mine.tobytes()))
        yield _batch(out, ("block", "clusters", "centroids"), (pa.int32(), pa.int32(), pa.binary()))

    return run


def _partial_distances(source):
    """mapInArrow step: a block and its range of the centroids -> exact partial squared distances, rows x clusters."""
    for batch in source:
        out = []
        for row in batch.to_pylist():
            k = row["clusters"]
            points = _unpacked(row["data"], row["width"]).reshape(row["n"], -1)
            centroids = np.frombuffer(row["centroids"], "<i8").reshape(k, -1)
            far = np.empty((row["n"], k), dtype=np.int64)
            for c in range(k):
                apart = points - centroids[c]
                far[:, c] = np.einsum("ij,ij->i", apart, apart)
            data = _least_type(far)
            out.append((row["chunk"], row["n"], k, data.itemsize, data.tobytes()))
        yield _batch(out, ("chunk", "n", "clusters", "width", "data"), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))


_PARTIAL = "chunk long, n int, clusters int, width int, data binary"
_NEAR = "chunk long, nearest binary, distances binary"


def _nearest(rows: pd.DataFrame) -> pd.DataFrame:
    """The partial distances of one chunk added; the smaller number wins a tie."""
    n, k = int(rows["n"].iloc[0]), int(rows["clusters"].iloc[0])
    far = sum(_unpacked(data, width) for data, width in zip(rows["data"], rows["width"])).reshape(n, k)
    nearest = far.argmin(axis=1)
    return pd.DataFrame([{"chunk": rows["chunk"].iloc[0], "nearest": nearest.astype("<i4").tobytes(), "distances": far[np.arange(n), nearest].astype("<i8").tobytes()}])


_SUMS = f"{_SLICE}, sums binary, counts binary"


def _sums(source):
    """mapInArrow step: per column range the sums and counts of each cluster, one row a task and range."""
    held: dict[int, list] = {}
    for batch in source:
        for row in batch.to_pylist():
            k = row["clusters"]
            points = _unpacked(row["data"], row["width"]).reshape(row["n"], -1)
            nearest = np.frombuffer(row["nearest"], "<i4")
            mine = held.setdefault(row["block"], [k, row["centroids"], np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)])
            mine[2] += (np.arange(k)[:, None] == nearest).astype(np.int64) @ points
            mine[3] += np.bincount(nearest, minlength=k)
    out = [(b, k, centroids, sums.tobytes(), counts.tobytes()) for b, (k, centroids, sums, counts) in held.items()]
    yield _batch(out, ("block", "clusters", "centroids", "sums", "counts"), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))


def _updated(rows: pd.DataFrame) -> pd.DataFrame:
    """One range of the centroids after a round: exact floors of means; an empty cluster keeps its place."""
    k = int(rows["clusters"].iloc[0])
    centroids = np.frombuffer(rows["centroids"].iloc[0], "<i8").reshape(k, -1).copy()
    counts = sum(np.frombuffer(x, "<i8") for x in rows["counts"])
    sums = sum(np.frombuffer(x, "<i8").astype(object) for x in rows["sums"]).reshape(k, -1)
    for c in np.flatnonzero(counts).tolist():
        centroids[c] = [int(x) // int(counts[c]) for x in sums[c]]
    return pd.DataFrame([{"block": rows["block"].iloc[0], "clusters": k, "centroids": centroids.tobytes()}])


def _members(source):
    """mapInArrow step: a chunk's ids, assignment and distances -> one row per vector."""
    for batch in source:
        for row in batch.to_pylist():
            n = row["n"]
            ids, known = np.frombuffer(row["data"], "<i8", n), np.frombuffer(row["data"], np.uint8, n, 8 * n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=known == 0), pa.array(np.frombuffer(row["nearest"], "<i4")), pa.array(np.frombuffer(row["distances"], "<i8"))],
                names=["key", "cluster", "distance"],
            )


def _centroid_text(source):
    """mapInArrow step: (block, centroids) -> per cluster its components of this range as text."""
    for batch in source:
        out = []
        for row in batch.to_pylist():
            points = np.frombuffer(row["centroids"], "<i8").reshape(row["clusters"], -1)
            out.extend((c, row["block"], ",".join(map(str, x.tolist()))) for c, x in enumerate(points))
        yield _batch(out, ("cluster", "block", "numbers"), (pa.int32(), pa.int32(), pa.string()))


def cluster_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", plan: Lloyd = Lloyd()) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``plan.dimensions`` components.

    Components are floor(scale * x). The centroids start as the vectors with the least SHA-256 of ``seed:id``; ``rounds``
    rounds follow and one last assignment. Ties go to the smaller number of a cluster.

    Defined results: NULL vectors, vectors of another length, and vectors with NULL or non-finite components are left
    out; a row with a NULL id is clustered like any other and starts a centroid only if there are too few ids; rows that
    repeat an id are vectors each, in order of their components where they tie for a start; fewer vectors than
    ``clusters`` give as many clusters as vectors; an empty table gives no rows; other columns are ignored. Components so
    large that a squared distance could exceed 64 bits raise an ArithmeticError.
    """
    own = numbered_vectors(vectors, id_column, vector_column)
    blocks = durable(own.mapInArrow(_to_blocks(plan), _BLOCK).repartition("chunk"))
    named, blocks = blocks.where(F.col("block") == IDS), blocks.where(F.col("block") != IDS)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    start = own.where((F.size("vector") == plan.dimensions) & finite).select("vector", F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("key").cast("string")), 256).alias("hash"))
    slices = durable(start.orderBy(F.col("hash").asc_nulls_last(), "vector").limit(plan.clusters).mapInArrow(_first_slices(plan), _SLICE))

    def assigned(slices: DataFrame) -> DataFrame:
        # a range of the centroids has clusters x block_columns numbers, all of them clusters x dimensions
        partial = blocks.join(F.broadcast(slices), "block").mapInArrow(_partial_distances, _PARTIAL)
        return partial.groupBy("chunk").applyInPandas(_nearest, _NEAR)

    for _ in range(plan.rounds):
        members = blocks.join(assigned(slices).select("chunk", "nearest"), "chunk").join(F.broadcast(slices), "block")
        slices = durable(members.mapInArrow(_sums, _SUMS).groupBy("block").applyInPandas(_updated, _SLICE))
    rows = durable(named.join(assigned(slices), "chunk").mapInArrow(_members, "key long, cluster int, distance long"))
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    # one row a cluster from here on
    inertia = inertia.select("cluster", F.col("own").cast("long").alias("cluster_inertia"), F.sum("own").over(Window.partitionBy(F.lit(0))).cast("long").alias("inertia"))
    texts = slices.mapInArrow(_centroid_text, "cluster int, block int, numbers string").groupBy("cluster")
    texts = texts.agg(F.array_sort(F.collect_list(F.struct("block", "numbers"))).alias("parts"))
    digests = texts.select("cluster", F.sha2(F.array_join("parts.numbers", ","), 256).alias("centroid_sha256"))
    facts = inertia.join(digests, "cluster")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("key").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(plan: Lloyd = Lloyd()) -> str:
    """DuckDB text of the same rounds, one pair of tables a round."""
    text = [
        "WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS r, "
        f"[CAST(floor({plan.scale} * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings "
        f"WHERE len(embedding) = {plan.dimensions} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"points AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({plan.dimensions})) AS d FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{plan.seed}:' || vec_id), v) - 1 AS c, v FROM kept "
        f"QUALIFY row_number() OVER (ORDER BY sha256('{plan.seed}:' || vec_id), v) <= {plan.clusters})",
    ]
    for i in range(plan.rounds + 1):
        text.append(
            f"a{i} AS MATERIALIZED (SELECT r, c, far FROM (SELECT r, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(kept.v, c{i}.v)])::BIGINT AS far FROM kept, c{i}) "
            "QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1)"
        )
        if i < plan.rounds:
            text.append(
                f"s{i} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS v FROM "
                f"(SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM points JOIN a{i} USING (r) GROUP BY c, d) GROUP BY c), "
                f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(s{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN s{i} USING (c))"
            )
    last = plan.rounds
    return ", ".join(text) + (
        f" SELECT vec_id, c::INTEGER AS cluster, far AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} USING (c) JOIN kept USING (r)"
    )
