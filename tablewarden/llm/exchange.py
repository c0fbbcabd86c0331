"""Which 64-bit values occur in more than one place of a corpus, asked by packed arrays.

A task groups its values by bucket and sends one row of arrays per bucket, so that billions of values take
few rows. A value that the task itself has seen in two places is sent once, without its places: a value that a
third of all documents share costs one entry per batch and never gathers those documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes whose values meet in one bucket (a task holds some hundred MB of arrays for them).
BUCKET_BYTES = 12_000_000
#: Text bytes that are looked at together before values are sent.
CHUNK_BYTES = 4_000_000


def buckets_for(docs: DataFrame, text: str) -> int:
    """The number of buckets grows with the corpus."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(1, -(-total // BUCKET_BYTES))


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row ``i`` has the values from ``ends[i]`` to ``ends[i + 1]``."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and the length of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten()), np.asarray(column.value_lengths().fill_null(0))


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the values, and where groups of equal ones begin in it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(values) else order
