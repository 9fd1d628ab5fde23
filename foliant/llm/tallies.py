"""Tables of counts of a fixed size, gathered over any number of tasks.

A task's table travels as one compressed row. The rows are first added up in as many tasks as there are cores, each of which streams
its part of them, and then in levels of ``FAN`` to a task. Counts are 64-bit; what travels or is kept is narrowed to the
least width that holds its largest count.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Array = np.ndarray

#: Tables that one task adds up after the first level, and tasks of the first level at least.
FAN, FIRST = 64, 8
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def narrowed(total: Array) -> Array:
    """The same whole numbers in the least width that holds them."""
    most = int(total.max(initial=0))
    return total.astype(next(w for w in _WIDTHS if most <= np.iinfo(w).max), copy=False)


def packed(total: Array) -> pa.RecordBatch:
    """One row that holds the table, narrowed and compressed, after a byte that tells the width."""
    held = narrowed(total)
    return pa.RecordBatch.from_arrays([pa.array([bytes([held.itemsize]) + zlib.compress(held.tobytes(), 1)], pa.binary())], ["blob"])


def unpacked(blob: bytes) -> Array:
    kind = next(w for w in _WIDTHS if np.dtype(w).itemsize == blob[0])
    return np.frombuffer(zlib.decompress(blob[1:]), kind)


def merged(blobs: DataFrame, join: Callable[[Array, Array], Array], dtype: type, size: int) -> Array:
    """The tables of all rows of ``blob`` joined into one; without any, a table of zeros. ``join`` works in ``dtype``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size, dtype), False
        for batch in batches:
            for blob in batch.column(0):
                total, some = join(total, unpacked(blob.as_py()).astype(dtype, copy=False)), True
        if some:
            yield packed(total)

    level, tasks = blobs.select("blob"), max(FIRST, blobs.sparkSession.sparkContext.defaultParallelism)
    while True:
        level = level.repartition(tasks).mapInArrow(fold, "blob binary")
        if tasks == 1:
            break
        tasks = math.ceil(tasks / FAN)
    row = level.first()
    return unpacked(bytes(row.blob)).astype(dtype) if row else np.zeros(size, dtype)
