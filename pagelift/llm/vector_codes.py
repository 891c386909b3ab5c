"""Vector code compression: product codes whose codebooks are fitted over a lexicographic trie of distinct parts.

A vector's components become the integers ``floor(4096 x)`` and are cut into
``PARTS`` equal parts; a part is coded by the nearest of ``ENTRIES`` entries.

1. *Distinct parts.*  Spark counts the equal parts of each position (combined
   before the shuffle, so a vector that a third of all rows hold is one row with
   a weight) and sorts them by range: every task then reads a stretch of the
   trie over all distinct parts, in depth-first order.
2. *Traversal.*  ``nearest`` walks that trie.  A node holds the vector of squared
   distances from its prefix to all entries; a child adds one component to it,
   so what parts share at the front is computed once.  Subtrees of up to
   ``BLOCK`` leaves are walked in one go with numpy, larger ones child by child,
   so memory is bounded by ``BLOCK``.  A leaf takes the argmin and adds its
   weighted components to the sums of that entry.
3. *Rounds.*  A round is a scan of the sorted parts and a sum per entry; the
   codebooks (``PARTS`` x ``ENTRIES`` x width integers) are all that meets in the
   driver.  The last pass codes the vectors themselves, batch by batch, by the
   same traversal, without a join.

Defined cases: vectors that are null, or hold a null or non-finite component,
are dropped, and so are those of another length than the first one by vec_id,
or of a length that ``PARTS`` doesn't divide.  The first entries are those of
the smallest vec_ids (ties by components, null ids last); with fewer vectors
there are fewer entries.  Rows that share a vec_id each count.  Null labels form
one group.  Components of 2^28 and more after scaling raise an error, as their
squares would not fit.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_dimension
from .common import Shared, written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK = 4096
LIMIT = 1 << 28


# ---------------------------------------------------------------- the trie
def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equal ones) and the squared distance, for each of the
    lexicographically sorted ``parts``."""
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    if not parts.shape[1] or not len(parts):
        return index, error
    differs = parts[1:] != parts[:-1]
    depth = np.where(differs.any(axis=1), differs.argmax(axis=1), parts.shape[1] - 1)
    branch = np.concatenate([[0], depth])  # the depth at which a row leaves the path of the row before
    todo = [(0, len(parts), 0, np.zeros(len(book), np.int64))]
    while todo:
        low, high, at, shared = todo.pop()
        if high - low <= BLOCK or at == parts.shape[1] - 1:
            for start in range(low, high, BLOCK):
                _leaves(parts, branch, book, start, min(high, start + BLOCK), at, shared, index, error)
            continue
        child = low + np.flatnonzero(np.append(True, branch[low + 1:high] <= at))
        ends = np.append(child[1:], high)
        grown = shared + (parts[child, at, None] - book[:, at]) ** 2
        large = np.flatnonzero(ends - child > BLOCK)
        todo.extend((int(child[k]), int(ends[k]), at + 1, grown[k]) for k in large[::-1])
        for first, last in _stretches(child, ends, large):  # small children side by side
            _leaves(parts, branch, book, first, last, at, shared, index, error)
    return index, error


def _stretches(child: np.ndarray, ends: np.ndarray, large: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of neighbouring children that are not large, up to ``BLOCK`` rows at a time."""
    borders = np.concatenate([[-1], large, [len(child)]])
    for before, after in zip(borders[:-1], borders[1:]):
        k = before + 1
        while k < after:
            stop = max(k + 1, int(np.searchsorted(ends[:after], child[k] + BLOCK, side="right")))
            yield int(child[k]), int(ends[stop - 1])
            k = stop


def _leaves(parts, branch, book, low, high, at, shared, index, error) -> None:
    """Rows low..high from depth ``at``, below a path whose distances are ``shared``, one depth after the other."""
    grown, starts = shared[None, :], np.zeros(1, np.int64)
    own = branch[low:high].copy()
    own[0] = 0
    for k in range(at, parts.shape[1]):
        nodes = np.flatnonzero(own <= k) if k < parts.shape[1] - 1 else np.arange(high - low)
        parent = np.searchsorted(starts, nodes, side="right") - 1
        grown, starts = grown[parent] + (parts[low + nodes, k, None] - book[:, k]) ** 2, nodes
    index[low:high] = grown.argmin(axis=1)
    error[low:high] = grown.min(axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    if len(found) and max(abs(int(found.max(initial=0))), abs(int(found.min(initial=0)))) >= LIMIT:
        raise ValueError(f"a component of {LIMIT} or more after scaling: squared distances would not fit")
    return found


# ---------------------------------------------------------------- Spark
def _integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer components of the vectors that count."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    vector = F.col("embedding").cast("array<double>")
    own = F.when(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), vector)
    return (vectors.select("vec_id", "label", own.alias("v")).filter("v is not null")
            .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v")))


def _first(found: DataFrame, entries: int, parts: int) -> tuple[np.ndarray, int]:
    """The first codebooks and the length of the vectors."""
    rows = found.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(1).collect()
    length = len(rows[0].v) if rows else 0
    if length % parts:
        return np.zeros((parts, 0, 0), np.int64), -1
    rows = found.filter(F.size("v") == length).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, length // parts)
    return np.ascontiguousarray(start.transpose(1, 0, 2)), length


def _distinct_parts(found: DataFrame, length: int, parts: int) -> DataFrame:
    width = length // parts
    cut = F.array(*(F.slice("v", k * width + 1, width) for k in range(parts)))
    counted = (found.select(F.posexplode(cut).alias("part", "x")).groupBy("part", "x").agg(F.count("*").alias("weight")))
    return written(counted.repartitionByRange("part", "x").sortWithinPartitions("part", "x"), "codes-parts")


def _sums(books: Shared, width: int):
    """For each part and entry, how many vectors it has and the sums of their components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        count = np.zeros(book.shape[:2], np.int64)
        total = np.zeros(book.shape, np.int64)
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            rows, weight = _matrix(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                own, much = rows[at], weight[at]
                index, _ = nearest(own, book[k])
                np.add.at(count[k], index, much)
                np.add.at(total[k], index, own * much[:, None])
        used = np.argwhere(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(count[tuple(used.T)]),
             pa.array([total[p, e].tolist() for p, e in used], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])
    return run


def train(found: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> tuple[np.ndarray, int]:
    """Codebooks, an array by part, entry and component, and the length of the vectors, fitted to all rows of ``found``."""
    book, length = _first(found, entries, parts)
    if length <= 0:
        return book, length
    width = length // parts
    distinct = _distinct_parts(found.filter(F.size("v") == length), length, parts)
    for _ in range(rounds):
        sums = distinct.select("part", "x", "weight").mapInArrow(
            _sums(Shared(found.sparkSession, book), width), "part int, entry int, n long, sums array<long>")
        total = (sums.select("part", "entry", "n", F.posexplode("sums").alias("k", "s")).groupBy("part", "entry", "k")
                 .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        book = book.copy()
        for r in total:
            book[r.part, r.entry, r.k] = int(Decimal(r.s)) // r.n
    return book, length


def encode(found: DataFrame, book: np.ndarray, length: int) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    parts, width, shared = len(book), length // len(book), Shared(found.sparkSession, book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            rows = _matrix(batch.column(2), length).reshape(-1, parts, width)
            code, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
            for k in range(parts) if width else ():
                order = np.lexsort(rows[:, k, ::-1].T)
                own = rows[order, k]
                new = np.append(True, (own[1:] != own[:-1]).any(axis=1))[:len(own)]
                index, far = nearest(own[new], book[k])
                back = np.cumsum(new) - 1
                code[order, k] = index[back]
                error[order] += far[back]
            text = ["".join(f"{x:02x}" for x in r) for r in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    kinds = dict(found.dtypes)
    return (found.filter(F.size("v") == length).select("vec_id", "label", "v")
            .mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that counts."""
    found = _integers(vectors)
    book, length = train(found)
    key = F.when(F.col("label").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = written(encode(found, book, length).withColumn("_label", key).drop("label"), "codes")
    summed = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return (join_dimension(coded, summed, "_label", salt_cols=("vec_id", "code"))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256")))
