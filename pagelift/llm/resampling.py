"""Target-distribution importance resampling: documents drawn by how much their word runs look like the benchmark's.

Features are all runs of one to three words; a feature's bucket is the crc32 of
its bytes modulo ``BUCKETS``.  A bucket's gain compares how often it stands in
the target and in the corpus; a document weighs the sum of its features' gains,
and Gumbel noise from its id turns weights into a draw without replacement.

1. *Dictionary.*  Spark counts the distinct words of both tables (each task adds
   up its slices first).  The most frequent ones, ``DICTIONARY`` at most and each
   between two blanks, become the keys of an Aho-Corasick automaton whose payload is the
   word's number; two small arrays give its checksum and its length in bytes.
   The automaton is bounded by ``DICTIONARY`` words of ``WORD_BYTES`` bytes.
2. *Scan.*  A slice of texts is one byte string with every other character as a
   blank.  The automaton emits the payloads of its words; a word that is not in
   the dictionary stands where no match ends, and gets its payload directly.  So
   the bound decides who computes a checksum, never which words count.
3. *Composition.*  Neighbouring payloads make the checksum of a run without its
   text: the first one's register moved on by the second one's length, xor the
   second's.  Moving on is a linear map, tabulated per length.
4. *Counting and scoring.*  Counts by bucket are summed in each task and by Spark
   (``BUCKETS`` rows at most); the gains are one array; a second scan sums them.
5. *Draw.*  The score that more rows than the draw needs lie above is found from
   a quantile sketch and verified by a count.  Only rows above it are sorted, by
   range, and numbered from the counts of the ranges.

Defined cases: null and empty texts have no features, weight 0 and no rank; a
null doc_id counts as an empty text in the noise and comes last among equal
scores; rows that share a doc_id each count, and each may be drawn (equal rows
in any order); empty tables give counts of 0.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, slices, written

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
DICTIONARY, WORD_BYTES = 1 << 17, 64
SLICE = 2 << 20
#: Lengths up to this have tables of their own; longer moves are made of several.
STEP = 64

_WORD_BYTES_OF_TEXT = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in range(256))
#: Lower case, and a blank for each byte that is in no word.
PLAIN = bytes(range(256)).lower().translate(_WORD_BYTES_OF_TEXT)


# ---------------------------------------------------------------- checksums of composed runs
def _moved_tables() -> np.ndarray:
    """``[n, byte place, byte value]``: a checksum's byte after n zero bytes, n up to ``STEP``."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    tables = np.zeros((STEP + 1, 4, 256), np.uint32)
    tables[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for n in range(1, STEP + 1):
        tables[n] = one[tables[n - 1] & 255] ^ tables[n - 1] >> 8
    return tables


_MOVED = _moved_tables()


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums moved on by ``by`` bytes: ``moved(crc(a), len(b)) ^ crc(b)`` is ``crc(a + b)``."""
    while True:
        step = np.minimum(by, STEP)
        crc = (_MOVED[step, 0, crc & 255] ^ _MOVED[step, 1, crc >> 8 & 255]
               ^ _MOVED[step, 2, crc >> 16 & 255] ^ _MOVED[step, 3, crc >> 24])
        by = by - step
        if not by.any():
            return crc


def buckets(crc: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of one to three neighbouring words of one text, and the text of each."""
    blank = moved(crc, np.ones_like(size)) ^ np.uint32(zlib.crc32(b" "))
    two = moved(blank[:-1], size[1:]) ^ crc[1:]
    three = moved((moved(blank[:-1], size[1:] + 1) ^ blank[1:])[:-1], size[2:]) ^ crc[2:]
    same_two, same_three = text[1:] == text[:-1], text[2:] == text[:-2]
    found = np.concatenate([crc, two[same_two], three[same_three]]) % np.uint32(BUCKETS)
    return found.astype(np.int64), np.concatenate([text, text[1:][same_two], text[2:][same_three]])


# ---------------------------------------------------------------- the dictionary
class Dictionary:
    """The automaton over words between blanks; it is built where it is used."""

    def __init__(self, words: list[bytes]):
        self.words, self._automaton = words, None

    def __getstate__(self):
        return {"words": self.words, "_automaton": None}

    def _built(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for number, word in enumerate(self.words):
                self._automaton.add_word(f" {word.decode('latin-1')} ", number)
            self._automaton.make_automaton()
            self._crc = np.fromiter(map(zlib.crc32, self.words), np.uint32, len(self.words))
            self._size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        return self._automaton

    def scanned(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Checksum, length and text of each word of the texts, in order."""
        automaton = self._built()
        plain = (b" " + b" ".join(texts) + b" ").translate(PLAIN)
        inside = np.frombuffer(plain, np.uint8) != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        crc, size = np.zeros(len(starts), np.uint32), ends - starts
        if self.words:
            flat = np.fromiter(chain.from_iterable(automaton.iter(plain.decode("latin-1"))), np.int64)
            at, number = np.searchsorted(ends, flat[::2]), flat[1::2]  # a match ends at the blank behind its word
            known = np.zeros(len(starts), bool)
            known[at], crc[at] = True, self._crc[number]
        else:
            known = np.zeros(len(starts), bool)
        for k in np.flatnonzero(~known).tolist():
            crc[k] = zlib.crc32(plain[starts[k]:ends[k]])
        first = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        return crc, size, np.searchsorted(first, starts, side="right") - 1


def _raw(part: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in part.column(column).to_pylist()]


def dictionary(texts: DataFrame, bound: int = DICTIONARY) -> Dictionary:
    """The most frequent distinct words of ``texts(text binary)``: those of the highest levels of frequency (eighths of a
    doubling) that hold ``bound`` words or fewer together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, SLICE):
            count = Counter(b" ".join(_raw(part, 0)).translate(PLAIN).split())
            count = {w: n for w, n in count.items() if len(w) <= WORD_BYTES}
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    counted = written(texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "resampling-words")
    level = F.floor(F.log2("n") * 8).cast("int")
    room, least = bound, None
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):  # some hundred rows
        if r.n > room:
            break
        room, least = room - r.n, r.level
    if least is None:
        return Dictionary([])
    return Dictionary(sorted(bytes(r.word) for r in counted.filter(level >= least).select("word").collect()))


# ---------------------------------------------------------------- counting, scoring, drawing
def bucket_counts(texts: DataFrame, shared: Shared) -> np.ndarray:
    """How many features of ``texts(text binary)`` each bucket holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, 0, SLICE):
            total += np.bincount(buckets(*shared.value.scanned(_raw(part, 0)))[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket from its counts in the corpus and in the target."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((t + 1) * all_s) / ((s + 1) * all_t)))
                     for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(doc_id) -> int:
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, shared: Shared, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs(doc_id, text binary)``."""
    held = Shared(docs.sparkSession, gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            crc, size, text = shared.value.scanned(_raw(part, 1))
            found, owner = buckets(crc, size, text)
            n = np.bincount(text, minlength=part.num_rows)
            weight = np.zeros(part.num_rows, np.int64)
            np.add.at(weight, owner, held.value[found])
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            score = weight + np.fromiter(map(noise, part.column(0).to_pylist()), np.int64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (n, features, weight, score))],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long, score long")


def drawn(scored: DataFrame) -> DataFrame:
    """``scored`` (a written table) with the rank of the rows that are drawn."""
    fits = F.col("n_words") >= MIN_WORDS
    able = scored.filter(fits)
    draw = PERCENT * able.count() // 100
    line = None
    if draw:
        sketch, share = able.agg(F.percentile_approx("score", [0.94, 0.9, 0.5, 0.0], 10_000)).first()[0], None
        for line in sketch:  # the highest mark with enough rows at or above it; the last one holds all
            share = able.filter(F.col("score") >= line).count()
            if share >= draw:
                break
    above = F.coalesce(fits & (F.col("score") >= F.lit(line).cast("long")), F.lit(False))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    top = (scored.filter(above).withColumn("_row", F.monotonically_increasing_id())
           .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    top = written(top, "resampling-top")
    start = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range: as many as there are tasks
    before = top.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(start), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    top = (top.join(F.broadcast(before), "_range").withColumn("rank", number.cast("long"))
           .withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))))
    rest = scored.filter(~above).withColumn("rank", F.lit(None).cast("long"))
    return top.select(rest.columns).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; ``target`` holds the texts to resemble."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    aim = target.select(F.col("text").cast("binary").alias("text"))
    shared = Shared(docs.sparkSession, dictionary(texts.select("text").unionByName(aim)))
    gain = gains(bucket_counts(texts.select("text"), shared), bucket_counts(aim, shared))
    return drawn(written(weights(texts, shared, gain), "resampling")).select("doc_id", "n_features", "weight", "score", "rank")
