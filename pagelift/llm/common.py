"""Helpers shared by the training-data operators.

Python runs inside ``mapInArrow`` tasks only: Spark splits, shuffles and
retries the work.  ``slices`` cuts Arrow batches by text size, so what a task
holds at once is bounded by bytes and not by a row count.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SLICE_BYTES = 4 << 20
#: For stages that run one after the other in the same workers.
SMALL_SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """A broadcast value whose classes travel with it; each worker process unpacks it once."""

    def __init__(self, spark: SparkSession, value):
        self._packed, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"_packed": self._packed, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._packed.value)
        return self._value


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = run_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)  # an empty table may have no files


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose values in ``column`` hold about ``limit`` bytes, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(size.astype(np.int64)), 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def trim() -> None:
    """Gives this process's unused memory back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run):
    """``run`` over a task's batches, with the worker's unused memory given back before and after: a worker that is used
    again doesn't add what earlier tasks held to what the next ones need."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()
    return work


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, each text followed by a line feed, and where each text starts."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return points, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of ``key`` (all of them if there are no more)."""
    n = max(1, df.count())
    if n <= bound:
        return df
    cut = int(bound / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < cut).limit(bound)


def id_crc(column: str):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
