"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.
Every window of ``WINDOW`` words of a benchmark item is indexed (an item of
fewer words is one window).  Each document's words become ids of the
benchmark's vocabulary; only stretches without a foreign word can hold a
window, their hashes are looked up in the set and every hash hit is verified
word by word.

The index is broadcast only while the benchmark's texts, whose size is summed
first, stay below ``max_index_bytes``; a larger benchmark is joined by window
through a shuffle instead (:func:`scan_joined`), by row number, with equal results.

Defined cases: a null or empty text has no words and is not contaminated; an
item without words occurs nowhere; items with a null id mark words but are not
listed; repeated rows and repeated item ids give equal results per row; an
empty benchmark contaminates nothing; other columns of the input are ignored
by ``scan`` and kept by ``drop_contaminated`` and ``cut_spans``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE, Shared, runs, slices, texts_of, trimmed, written

WINDOW = 10
#: Benchmark text that is indexed; the index is about 65 times as large (measured), 130 MB in the driver and a worker.
MAX_INDEX_BYTES = 2 << 20
#: What separates words, for SQL expressions (after lower-casing).
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_MIX = np.random.default_rng(8).integers(1, 2 ** 63, 64, dtype=np.uint64) | np.uint64(1)

SCAN_SCHEMA = ("doc_id long, n_words long, n_hit long, items array<string>, "
               "spans array<struct<start:int,stop:int>>")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


class WindowIndex:
    """Windows of all items: sorted hashes by window length, and the exact windows with their items."""

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                found = self.items.setdefault(tuple(ids[i:i + size]), set())
                if item is not None:
                    found.add(item)
        self.hashes = {}
        for size in {len(w) for w in self.items}:
            grams = np.array([w for w in self.items if len(w) == size], np.uint64)
            self.hashes[size] = np.unique(_hashed(grams))

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(start, length, items) of every window in ``ids``, where -1 is a foreign word."""
        begin, end = runs(ids >= 0)
        for size, hashes in self.hashes.items():
            fits = end - begin >= size
            if not fits.any():
                continue
            starts = np.concatenate([np.arange(b, e - size + 1) for b, e in zip(begin[fits], end[fits])])
            grams = ids[starts[:, None] + np.arange(size)]
            hashed = _hashed(grams.astype(np.uint64))
            near = hashes[np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)] == hashed
            for at in np.flatnonzero(near):
                if (found := self.items.get(tuple(grams[at].tolist()))) is not None:
                    yield int(starts[at]), size, found


def _hashed(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (grams + np.uint64(1)) * _MIX[np.arange(grams.shape[1]) % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
        return (mixed * _MIX[::-1][np.arange(grams.shape[1]) % len(_MIX)]).sum(axis=1, dtype=np.uint64)


def _scanned(index: WindowIndex, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: number of words, merged spans of hit words, items found."""
    known, parts, counts = index.vocabulary.get, [], []
    for text in texts:
        own = words(text)
        counts.append(len(own))
        parts += map(known, own, repeat(-1))
        parts.append(-1)  # no window crosses texts
    ids = np.array(parts, np.int64)
    first = np.concatenate([[0], np.cumsum(np.array(counts) + 1)[:-1]]).astype(np.int64)
    change, found = np.zeros(len(ids) + 1, np.int32), {}
    for start, size, items in index.occurrences(ids):
        change[start] += 1
        change[start + size] -= 1
        found.setdefault(int(np.searchsorted(first, start, side="right")) - 1, set()).update(items)
    begin, end = runs(np.cumsum(change[:-1]) > 0)
    spans: dict[int, list[tuple[int, int]]] = {}
    for k, b, e in zip(np.searchsorted(first, begin, side="right") - 1, begin, end):
        spans.setdefault(int(k), []).append((int(b - first[k]), int(e - first[k])))
    return [(n, spans.get(k, []), sorted(found.get(k, ()))) for k, n in enumerate(counts)]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def benchmark_bytes(benchmark: DataFrame) -> int:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _broadcast_index(benchmark: DataFrame, window: int):
    rows = [(r.item_id, r.text) for r in _items(benchmark).collect()]  # below max_index_bytes, see the caller
    return Shared(benchmark.sparkSession, WindowIndex(rows, window))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """One row per document: its number of words, of hit words, the items found and the spans of hit words."""
    if benchmark_bytes(benchmark) > max_index_bytes:
        return scan_joined(docs, benchmark, window)
    index = _broadcast_index(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = _scanned(index.value, texts_of(part, 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([sum(e - b for b, e in r[1]) for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.string())),
                 pa.array([[{"start": b, "stop": e} for b, e in r[1]] for r in rows],
                          pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN_SCHEMA)


def _word_array(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, NO_WORD), "")


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents as a written table with row numbers."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")


def scan_joined(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same rows for a benchmark of any size: windows of both sides meet in a join on the window itself."""
    return _scan_numbered(_numbered(docs.select("doc_id", "text")), benchmark, window).drop("row")


def _scan_numbered(numbered: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Rows of ``scan_joined`` with the number of each row."""
    items = (_items(benchmark).withColumn("w", _word_array("text"))
             .withColumn("size", F.least(F.size("w"), F.lit(window))).filter("size > 0")
             .select("item_id", "size", F.explode(F.expr(
                 "transform(sequence(0, size(w) - size), i -> concat_ws(' ', slice(w, i + 1, size)))")).alias("gram"))
             .distinct())
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # window lengths: WINDOW values at most
    numbered = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_row").alias("row"))
    worded = numbered.withColumn("w", _word_array("text"))
    hits = None
    for size in sizes:
        grams = worded.filter(F.size("w") >= size).select("row", F.posexplode(F.expr(
            f"transform(sequence(0, size(w) - {size}), i -> concat_ws(' ', slice(w, i + 1, {size})))")).alias("start", "gram"))
        found = grams.join(items.filter(F.col("size") == size), "gram").select("row", "start", "size", "item_id")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = numbered.select("row", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("item_id")).filter("false")
    hits = written(hits, "decontaminate-hits")
    names = hits.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = (hits.select("row", F.explode(F.expr("sequence(start, start + size - 1)")).alias("at")).distinct()
             .selectExpr("row", "at", "at - row_number() over (partition by row order by at) as island")
             .groupBy("row", "island").agg(F.min("at").cast("int").alias("start"), (F.max("at") + 1).cast("int").alias("stop"))
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")))
    empty = "cast(array() as array<struct<start:int,stop:int>>)"
    return (worded.select("row", "doc_id", F.size("w").cast("long").alias("n_words"))
            .join(names, "row", "left").join(spans, "row", "left")
            .withColumn("spans", F.coalesce("spans", F.expr(empty)))
            .withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.stop - s.start)"))
            .withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
            .select("row", "doc_id", "n_words", "n_hit", "items", "spans"))


def _kept(docs: DataFrame, benchmark: DataFrame, window: int, max_index_bytes: int, mend) -> DataFrame:
    """The input's rows and columns after ``mend(text, spans)``, which gives a text or drops the row by None.

    The spans come from the broadcast index, or for a larger benchmark from the joined scan, by row number: the result
    is the same."""
    schema, at = docs.schema, docs.columns.index("text")

    def mended(part: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        texts = part.column(at).to_pylist()
        found = [mend(t, s) if s else t for t, s in zip(texts, spans)]
        keep = pa.array([not s or f is not None for f, s in zip(found, spans)])
        columns = [pa.array(found, c.type) if i == at else c for i, c in enumerate(part.columns)]
        return pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(keep)

    if benchmark_bytes(benchmark) > max_index_bytes:
        numbered, names = _numbered(docs), list(docs.columns)
        hit = _scan_numbered(numbered, benchmark, window).filter("n_hit > 0").select(F.col("row").alias("_row"), F.col("spans").alias("_spans"))
        joined = numbered.join(hit, "_row", "left").select(*names, "_spans")

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, at, SMALL_SLICE):
                spans = [[(x["start"], x["stop"]) for x in s or ()] for s in part.column(len(names)).to_pylist()]
                yield mended(part.select(names), spans)
        return joined.mapInArrow(run_joined, schema)
    index = _broadcast_index(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, SMALL_SLICE):
            spans = [r[1] for r in _scanned(index.value, texts_of(part, at))]
            yield mended(part, spans) if any(spans) else part

    return docs.mapInArrow(trimmed(run), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """Documents without any hit, with all their columns."""
    return _kept(docs, benchmark, window, max_index_bytes, lambda text, spans: None)


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
              max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """All documents; hit words and what stands between them are cut out of their texts."""
    import re
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def mend(text: str, spans: list[tuple[int, int]]) -> str:
        at = [m.span() for m in word.finditer(text)]
        out, last = [], 0
        for b, e in spans:
            out.append(text[last:at[b][0]])
            last = at[e - 1][1]
        return "".join([*out, text[last:]])

    return _kept(docs, benchmark, window, max_index_bytes, mend)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest rows of ``scan``: counts, the items' digest and the verdict."""
    return scan(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
