"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams (``SIZES``) of the
lower-cased text.  On the training rows each n-gram gets the ratio
``r = log((p + a) / |p + a|) - log((q + a) / |q + a|)`` of its document counts
in both classes; the ``FEATURES`` n-grams whose ratio is surest to be large stay,
and a logistic regression with an L2 penalty is fitted on presence times ``r``.
Scoring is one table lookup per n-gram and a matrix product per slice.

The training sample is bounded by ``max_rows`` rows and ``max_chars``
characters, chosen by a hash of the id; a text that does not fit is passed over,
and too few rows of a class give a warning. A longer sample is never needed on the
driver.  Rows whose ``crc32(doc_id) mod 4`` is 2 are held out.

Defined cases: a null or empty text has no n-grams and gets the score of the
intercept; rows without a label are only scored; repeated rows get equal
scores; without labels of both classes every score is the share of class 1
(0 if there are none); other columns of the input are ignored by ``score`` and
kept by ``drop_toxic``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, code_points, id_crc, slices, texts_of, trim, trimmed
from .textgrams import hashed, lower_all

SIZES = (3, 4, 5)
BITS = 20
FEATURES = 3000
MIN_TEXTS = 5
THRESHOLD = 0.3
MAX_ROWS, MAX_CHARS = 4000, 16_000_000
SCORE_BYTES = 1 << 20
#: Training texts whose n-grams the driver holds at once.
PART_TEXTS, PART_CHARS = 64, 1 << 18
DOUBLE_ROWS = 128


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: (text number, hash) of all n-grams."""
    points, first = code_points(texts)
    points = lower_all(points)
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(points))))
    stop = np.append(first[1:], len(points)) - 1  # each text's end, before its line feed
    for size in SIZES:
        inside = np.arange(len(points)) + size <= stop[text_of]
        yield text_of[inside], hashed(points, size, BITS)[inside]


class Classifier:
    def __init__(self, intercept: float):
        self.slot = np.full(1 << BITS, -1, np.int16)
        self.weights, self.intercept = np.zeros(0, np.float32), intercept

    def presence(self, texts: list[str]) -> np.ndarray:
        """Texts by features: is the n-gram in the text?"""
        found = np.zeros((len(texts), max(1, len(self.weights))), np.float32)
        for text_of, keys in _grams(texts):
            slot = self.slot[keys]
            used = slot >= 0
            found[text_of[used], slot[used]] = 1
        return found[:, :len(self.weights)]

    def scores(self, texts: list[str]) -> np.ndarray:
        margin = self.presence(texts) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -35, 35)))


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of ``PART_TEXTS`` texts or fewer that hold about ``PART_CHARS`` characters, one text at least."""
    at = size = 0
    for k, text in enumerate(texts):
        if k > at and (k - at == PART_TEXTS or size + len(text) > PART_CHARS):
            yield at, k
            at, size = k, 0
        size += len(text)
    if texts:
        yield at, len(texts)


def fit(texts: list[str], labels: np.ndarray, alpha: float = 1.0, penalty: float = 5.0, steps: int = 300) -> Classifier:
    labels = np.asarray(labels, np.float64)
    share = labels.mean() if len(labels) else 0.0
    model = Classifier(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not 0 < share < 1:
        return model
    counts = np.zeros((2, 1 << BITS), np.int32)
    for at, stop in _parts(texts):
        for text_of, keys in _grams(texts[at:stop]):
            each = np.unique(text_of.astype(np.int64) << BITS | keys.astype(np.int64))
            for c in (0, 1):
                own = labels[at + (each >> BITS)] == c
                counts[c] += np.bincount(each[own] & ((1 << BITS) - 1), minlength=1 << BITS)
    total = counts.sum(axis=1, dtype=np.float64) + alpha * (1 << BITS)
    seen = np.flatnonzero(counts.sum(axis=0) >= MIN_TEXTS)
    smooth = counts[:, seen] + alpha
    del counts
    ratio = np.log(smooth[1] / total[1]) - np.log(smooth[0] / total[0])
    # what is left of a ratio after twice its standard error
    strength = np.abs(ratio) - 2 * np.sqrt(1 / smooth[0] + 1 / smooth[1])
    best = np.argsort(-strength, kind="stable")[:FEATURES]
    kept, ratio = seen[best], ratio[best]
    model.slot[kept] = np.arange(len(kept))
    model.weights = np.zeros(len(kept), np.float32)
    x = np.empty((len(texts), len(kept)), np.float32)  # the largest table here: it is filled in place
    for at, stop in _parts(texts):
        np.multiply(model.presence(texts[at:stop]), ratio.astype(np.float32), out=x[at:stop])
    w, b = _logistic(x, labels.astype(np.float32), model.intercept, penalty, steps)
    model.weights, model.intercept = (w * ratio).astype(np.float32), b
    return model


def _logistic(x: np.ndarray, y: np.ndarray, b: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the penalised mean log loss."""
    n = len(y)
    rate = 1 / (0.25 * _largest(x) / n + penalty / n)
    w = look = np.zeros(x.shape[1], np.float32)
    c = look_c = np.float32(b)
    for k in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ look + look_c, -35, 35))) - y
        new = look - rate * (x.T @ error + penalty * look) / n
        new_c = look_c - min(rate, 1.0) * error.mean()
        beta = k / (k + 3)
        look, look_c = new + beta * (new - w), new_c + beta * (new_c - c)
        w, c = new, new_c
    return w, float(c)


def _largest(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x, by the power method, in doubles; some rows at a time, as a double copy of x would be
    the most that the driver holds."""
    v = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(20):
        v = sum(part.T @ (part @ v) for part in (x[at:at + DOUBLE_ROWS].astype(np.float64) for at in range(0, len(x), DOUBLE_ROWS)))
        size = float(np.linalg.norm(v))
        if not size:
            return 1.0
        v /= size
    return 1.1 * size


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Classifier:
    """Fitted on a bounded sample of the labelled rows that are not held out."""
    # the sample is drawn from the narrow label table; its ids, max_rows at most, are then sent to the documents
    own = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_crc("doc_id") % 4 != 2))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(own), "doc_id"))
    sized: dict[tuple[int, int], int] = {}
    for key, doc, size in rows.select(F.xxhash64("doc_id"), "doc_id", F.coalesce(F.length("text"), F.lit(0))).collect():
        sized[key, doc] = sized.get((key, doc), 0) + size
    fits, used = [], 0
    for (_, doc), size in sorted(sized.items()):  # what doesn't fit is passed over; what comes after it may fit
        if used + size <= max_chars:
            fits.append((doc,))
            used += size
    fits = docs.sparkSession.createDataFrame(fits, "doc_id long")
    chosen = sorted(rows.join(F.broadcast(fits), "doc_id").collect(), key=lambda r: (r.doc_id, r.text or ""))
    few = [c for c in (0, 1) if sum(r.toxic == c for r in chosen) < MIN_TEXTS]
    if few:
        warnings.warn(f"toxicity sample: fewer than {MIN_TEXTS} rows of class {few} among {len(chosen)}", stacklevel=2)
    model = fit([r.text or "" for r in chosen], np.array([r.toxic for r in chosen]))
    del chosen
    trim()  # the driver's later work is not added to what the fit has held
    return model


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted class of every document."""
    shared = Shared(docs.sparkSession, model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SCORE_BYTES):
            found = shared.value.scores(texts_of(part, 1))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double, predicted int"))


def drop_toxic(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored below the threshold, with all their columns.  Null texts, and those without a character that is
    not white space, say nothing and stay, whatever the share of toxic labels makes of their score."""
    shared = Shared(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, SCORE_BYTES):
            texts = texts_of(part, at)
            said = np.fromiter((bool(t.strip()) for t in texts), bool, len(texts))
            yield part.filter(pa.array((shared.value.scores(texts) < threshold) | ~said))

    return docs.mapInArrow(trimmed(run), docs.schema)
