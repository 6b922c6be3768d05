"""Usable vectors of a table as packed rows, whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import narrow

SLICE_VALUES = 1 << 22  # components that are handled at once


def numbered_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(key long, vector array of doubles); columns of other names are left behind."""
    own = narrow(vectors, key=id_column, vector=vector_column)
    return own.select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))


def whole_vectors(batch: pa.RecordBatch):
    """(keys, sizes, values) of the rows whose vector is not empty and holds neither NULL nor a non-finite number.

    ``keys`` is an Arrow array, as ids may be NULL; ``values`` is flat, in order of rows. One vector longer than
    ``SLICE_VALUES`` makes a slice of its own.
    """
    column, at = batch.column("vector"), 0
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_VALUES, side="right")))
        flat = column.slice(at, to - at).flatten()
        values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
        n = sizes[at:to]
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        stop = np.cumsum(n)
        good = (n > 0) & (bad[stop] == bad[stop - n])
        yield batch.column("key").slice(at, to - at).filter(pa.array(good)), n[good], values[np.repeat(good, n)]
        at = to


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Flat numbers as one binary value per row."""
    raw = np.ascontiguousarray(values)
    offsets = np.concatenate([[0], np.cumsum(sizes * raw.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
