"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams of length 1 to 4
(blended spectrum) that both hold, divided by the geometric mean of their own
counts.  ``LANDMARKS`` training windows span the kernel's space (Nystroem);
one-versus-rest kernel ridge regression is solved there.  Texts are cut into
windows of ``WINDOW`` characters, so that a long text does not hold every
n-gram; each slice of windows is scored by two matrix products, and a text's
score is the mean over its windows, weighted by their letters.

N-grams are hashed to ``2^BITS`` columns; letters are lower-cased and all else
is a blank.  The training sample holds ``max_docs`` documents at most, chosen
by a hash of the id, of the rows whose ``crc32(doc_id) mod 3`` is not 1.

Defined cases: a text that is null, empty or without a letter is ``und`` with
score 0; without any training row every text is ``und``; rows without a lang
are predicted but not learned from; repeated rows get equal results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, bounded_sample, code_points, id_crc, slices, texts_of
from .textgrams import hashed, lower_letters

SIZES = (1, 2, 3, 4)
BITS = 13
WINDOW = 1500
LANDMARKS = 128
RIDGE = 1e-3
MAX_DOCS, DOC_WINDOWS = 1600, 2
UNKNOWN = "und"
SCORE_BYTES = 1 << 20


def windows(texts: list[str], each: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence of n-grams by window, the text of each window and its letters.  ``each``: so many windows of a text at most."""
    points, first = code_points(texts)
    points = lower_letters(points)
    size = np.diff(np.append(first, len(points)))
    n = -(-size // WINDOW) if each is None else np.minimum(each, -(-size // WINDOW))
    text_of_window = np.repeat(np.arange(len(texts)), n)
    before = np.cumsum(n) - n
    text_of = np.repeat(np.arange(len(texts)), size)
    within = np.arange(len(points)) - first[text_of]
    window = within // WINDOW
    used = window < n[text_of]
    window = before[text_of] + window
    present = np.zeros((int(n.sum()), 1 << BITS), np.float32)
    for k in SIZES:
        inside = used & (within + k < size[text_of])  # the line feed after the text isn't its own
        present[window[inside], hashed(points, k, BITS)[inside]] = 1
    letters = np.bincount(window[used], points[used] != 32, int(n.sum()))
    return present, text_of_window, letters


class StringKernelRidge:
    def __init__(self, names: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.names, self.weights = names, weights.astype(np.float32)
        self.columns = np.ascontiguousarray((landmarks / _norms(landmarks)[:, None]).T)  # n-grams by landmarks

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        present, text_of, letters = windows(texts)
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, best
        scores = (present @ self.columns / _norms(present)[:, None]) @ self.weights
        total = np.bincount(text_of, letters, len(texts))
        mean = np.stack([np.bincount(text_of, scores[:, c] * letters, len(texts)) for c in range(len(self.names))], axis=1)
        mean /= np.maximum(total, 1)[:, None]
        for k in np.flatnonzero(total > 0):
            top = int(mean[k].argmax())
            names[k], best[k] = self.names[top], min(1.0, max(0.0, float(mean[k, top])))
        return names, best


def _norms(present: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1, present.sum(axis=1)))


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> StringKernelRidge:
    names = sorted(set(langs))
    parts, owners = [], []
    for at in range(0, len(texts), 64):
        present, text_of, letters = windows(texts[at:at + 64], DOC_WINDOWS)
        full = letters > 0
        parts.append(present[full].astype(bool))
        owners += [names.index(langs[at + t]) for t in text_of[full]]
    if not owners:
        return StringKernelRidge([], np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0)))
    present, owner = np.concatenate(parts), np.array(owners)
    rank = np.zeros(len(owner), np.int64)  # landmarks are dealt to the languages in turn
    for c in range(len(names)):
        rank[owner == c] = np.arange((owner == c).sum())
    chosen = np.argsort(rank, kind="stable")[:landmarks]
    marks = present[chosen].astype(np.float32)
    marks_by_norm = (marks / _norms(marks)[:, None]).T
    kernel = np.concatenate([present[at:at + 256].astype(np.float32) @ marks_by_norm / _norms(present[at:at + 256])[:, None]
                             for at in range(0, len(present), 256)])
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.eye(len(names))[owner]
    weight = 1 / np.bincount(owner, minlength=len(names))[owner]  # each language counts the same
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(root.shape[1])
    return StringKernelRidge(names, marks, root @ np.linalg.solve(gram, features.T @ (target * weight[:, None])))


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> StringKernelRidge:
    """Fitted on a bounded sample of the rows with a lang that are not held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.col("lang").cast("string").alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_crc("doc_id") % 3 != 1))
    # a text's first windows are enough to learn from
    rows = bounded_sample(own, "doc_id", max_docs).withColumn("text", F.substring("text", 1, WINDOW * DOC_WINDOWS)).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: StringKernelRidge) -> DataFrame:
    """doc_id, predicted language and score of every document."""
    shared = Shared(docs.sparkSession, model)  # landmarks: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SCORE_BYTES):
            names, best = shared.value.predict(texts_of(part, 1))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(best)],
                                             ["doc_id", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double"))
