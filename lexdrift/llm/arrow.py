"""Small helpers between Arrow batches and numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: ASCII white space that parts words; `bytes.split()` parts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def give_back() -> None:
    """Memory that a task has freed goes back to the system: its process lives on and serves others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def per_batch(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """`mapInArrow` with a function from one batch to one batch (or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def byte_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of a string column, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            yield batch.slice(low, high - low)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 texts of a string column, one at a time; null is empty."""
    for item in column.cast(pa.large_binary()):
        yield item.as_py() or b""


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column without nulls as a matrix; short rows are padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return values.reshape(len(lengths), dim).astype(dtype)
    out = np.zeros((len(lengths), dim), dtype)
    out[np.arange(dim) < lengths[:, None]] = values
    return out
