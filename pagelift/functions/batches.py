"""Parts of bounded size of the Arrow batches that Python tasks get."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Runs in Python workers: ship this module's code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_BYTES = 1 << 19


def parts_of(batch: pa.RecordBatch, column: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose values in ``column`` hold about ``limit`` bytes, one row at least: what is made of a part stays small,
    however many rows Spark sends at once."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size.astype(np.int64)), 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
