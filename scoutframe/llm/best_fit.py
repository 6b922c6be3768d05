"""Best-fit packing with certified bin counts.

Texts become pieces of at most ``capacity`` tokens; full pieces are sequences of their own. The others are dealt
into groups of bounded size, and each group is packed by best-fit decreasing. A lower bound from dual-feasible
functions certifies a group: where its bins exceed the bound there is a gap, and its emptiest bins give up their
pieces. These, and the emptiest bin of every other group, form a smaller pool that is dealt out and packed again, until
one group is left or nothing is gained.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, narrow
from .segment_memo import token_ids
from .textbytes import slices


def pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of all texts; each text's ids end with end_id."""
    own = narrow(docs, key=id_column, text=text_column)

    def run(source):
        for batch in source:
            for i, j, s in slices(batch.column("text")):
                ids, first = token_ids(s, path, end_id)
                ids = ids.astype("<u4")
                sizes = np.diff(first)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(s.n), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = first[:-1][row] + start
                crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), length.tolist())]
                keys = batch.column("key").take(pa.array(row + i))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["key", "piece", "start", "length", "ids_crc32"],
                )

    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins by dual-feasible functions: the sizes themselves, cut at each level, and rounded down to k + 1 parts.

    Every function maps sizes so that what fits one bin maps to a sum of at most 1; so the sum over all pieces, rounded
    up, bounds the number of bins from below.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * size)
    level = np.arange(0, capacity // 2 + 1)
    # below the level 0, above capacity - level 1, between them the size itself
    large = n[-1] - n[capacity - level]
    middle = total[capacity - level] - np.where(level > 0, total[np.maximum(level - 1, 0)], 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 33):  # size * (k + 1) / capacity rounded down, over k; exact multiples keep their size
        exact = (size * (k + 1)) % capacity == 0
        scaled = np.where(exact, size * k, (size * (k + 1)) // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin, and each bin's fill. Bins are held by free space, so a piece costs one look-up."""
    order = np.argsort(-lengths, kind="stable")
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f: some bin has f free
    bin_of, fill = np.empty(len(lengths), dtype=np.int64), []
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = bins_with[free].pop()
            if not bins_with[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bin_of[i] = b
        fill[b] += size
        bins_with[free - size].append(b)
        mask |= 1 << (free - size)
    return bin_of, np.array(fill, dtype=np.int64)


def _pack_group(capacity: int, release: bool):
    def run(rows):
        rows = rows.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bin_of, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        given_up = np.zeros(len(fill), dtype=bool)
        if release:
            free = capacity - fill
            emptiest = np.argsort(-free, kind="stable")
            # enough free room for the gap to close elsewhere; one bin where there is no gap
            n = int(np.searchsorted(np.cumsum(free[emptiest]), capacity * (gap + 1))) + 1 if gap else 1
            given_up[emptiest[:n]] = True
        rows["bin"] = bin_of
        rows["gap"] = gap
        rows["released"] = given_up[bin_of]
        order = np.lexsort((np.arange(len(rows)), bin_of))
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.append(True, bin_of[order][1:] != bin_of[order][:-1])
        rows.loc[order, "offset"] = before - np.maximum.accumulate(np.where(first, before, 0))
        rows["offset"] = rows["offset"].astype("int64")
        return rows[["row", "group", "bin", "gap", "released", "offset", "length"]]

    return run


_PACKED = "row long, group long, bin long, gap long, released boolean, offset long, length long"


def pack(items: DataFrame, capacity: int = 2048, group_rows: int = 50_000) -> DataFrame:
    """(row, length) with lengths 1 to capacity -> (row, sequence_id, offset); ``row`` is unique.

    A group holds about group_rows pieces whatever their number, so no task grows with the input.
    """
    whole = items.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool, settled, n, depth = items.where(F.col("length") < capacity).select("row", "length"), [], None, 0
    while True:
        left = pool.count()
        gained = n is None or left <= n // 2
        groups = -(-left // group_rows) if gained else 1 if left <= 4 * group_rows else -(-left // group_rows)
        final = groups <= 1 or not gained
        n = left
        # the offset of numbers keeps ids of different rounds apart
        dealt = pool.withColumn("group", F.pmod(F.xxhash64("row", F.lit(depth)), F.lit(max(groups, 1))) + F.lit(depth * (1 << 20)))
        packed = durable(dealt.groupBy("group").applyInPandas(_pack_group(capacity, not final), _PACKED))
        settled.append(packed.where("not released").select("row", (F.col("group") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"), "offset"))
        if final:
            break
        pool, depth = packed.where("released").select("row", "length"), depth + 1
    out = whole
    for part in settled:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined results: NULL and empty text give one piece that holds only end_id; a NULL id stays NULL; repeated rows
    are packed one by one; ties go by row; an empty table gives no rows; other columns are ignored.
    """
    cut = durable(pieces(docs, path, id_column, text_column, capacity, end_id)).withColumn("row", F.monotonically_increasing_id())
    placed = pack(cut.select("row", "length"), capacity)
    return cut.join(placed, "row").select(F.col("key").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
