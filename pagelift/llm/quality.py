"""Quality rules by repetition coverage, from rolling hashes of several n-gram lengths in numpy.

Words are runs without ASCII white space.  Word ids of a slice of texts feed a
polynomial rolling hash (prefix sums modulo 2^64), so n-grams of every length
come from one pass.  Equal n-grams within a text are neighbours after a sort of
their hashes and are compared word by word at their ends.  A character is
covered at length n if it lies in an n-gram that stood earlier in the text, and
by lines if its line stood earlier.  A document fails the method when the
share of its word characters that is covered passes ``LIMITS`` at any length.

Defined cases: a null text and a text of white space have no words, fail the
base rule and are not kept; equal rows give equal rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, slices, texts_of

# The base rules of the contract.
SYMBOLS = "#*$%&|<>"
BASE_GRAM, MIN_WORDS, MAX_REPEAT_PERCENT = 3, 50, 50
#: Share of word characters inside n-grams, by n, and inside lines (0) that stood earlier in the text, above which a
#: text is rejected.  Longer runs are less likely by chance, so their limits fall; all lie far below the base rule's half.
LIMITS = {5: 0.20, 7: 0.18, 10: 0.16, 0: 0.25}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = " \t\n\r\x0b\x0c"

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, " + ", ".join(f"cover_{n or 'lines'} double" for n in LIMITS))


class Grams:
    """Rolling hashes over the concatenated word ids of several texts."""

    def __init__(self, ids: np.ndarray, text_of: np.ndarray):
        self.ids, self.text_of = ids, text_of
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        down = np.cumprod(np.full(len(ids), _INVERSE)) if len(ids) else np.zeros(0, np.uint64)
        self.up = np.cumprod(np.full(len(ids), _BASE)) if len(ids) else down
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * down)])

    def repeated(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the n-grams that stand more than once in their text, and which of them stood there before."""
        last = len(self.ids) - n + 1
        starts = np.flatnonzero(self.text_of[:max(0, last)] == self.text_of[n - 1:])
        hashed = (self.sums[starts + n] - self.sums[starts]) * self.up[starts]
        hashed ^= (self.text_of[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
        order = np.argsort(hashed)
        equal = np.diff(hashed[order]) == 0
        first, stop = runs(equal)  # a run of k equal neighbours is a group of k + 1 n-grams
        sizes = stop - first + 1
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        members, group = starts[order[at]], np.repeat(np.arange(len(sizes)), sizes)
        lead = np.minimum.reduceat(members, np.cumsum(sizes) - sizes) if len(sizes) else members
        exact = self.text_of[members] == self.text_of[lead[group]]
        for k in range(n):
            exact &= self.ids[members + k] == self.ids[lead[group] + k]
        if not exact.all():  # different n-grams of one hash: group them by their words
            return self._repeated_exactly(members, n)
        return members, members != lead[group]

    def _repeated_exactly(self, members: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        groups: dict[tuple, list[int]] = {}
        for m in np.sort(members).tolist():
            groups.setdefault((self.text_of[m], *self.ids[m:m + n].tolist()), []).append(m)
        found = [(m, k > 0) for g in groups.values() if len(g) > 1 for k, m in enumerate(g)]
        return np.array([m for m, _ in found], np.int64), np.array([x for _, x in found], bool)

    def covered(self, n: int, first_too: bool) -> np.ndarray:
        """Words inside an n-gram found earlier in its text (``first_too``: or later)."""
        members, again = self.repeated(n)
        starts = members if first_too else members[again]
        change = np.bincount(starts, minlength=len(self.ids) + 1) - np.bincount(starts + n, minlength=len(self.ids) + 1)
        return np.cumsum(change[:-1]) > 0


def measured(texts: list[str]) -> dict[str, list]:
    """The columns of ``SCHEMA`` after doc_id for the texts."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__  # a new word gets the next id
    parts, counts, lines_repeated, chars_repeated = [], [], [], []
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").split()
        counts.append(len(own))
        parts += map(known.__getitem__, own)
        seen, again, chars = set(), 0, 0
        for line in text.split("\n"):
            if line in seen:
                again += 1
                chars += len(line) - sum(map(line.count, _WHITE))
            elif line.strip(_WHITE):
                seen.add(line)
        lines_repeated.append(again)
        chars_repeated.append(chars)
    n_texts, n_words = len(texts), np.array(counts, np.int64)
    ids = np.array(parts, np.int64)
    text_of = np.repeat(np.arange(n_texts), n_words)
    sizes = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in known), np.int64, len(known))
    chars = sizes[ids] if len(ids) else np.zeros(0, np.int64)
    total = lambda values: np.bincount(text_of, values, n_texts)
    word_chars = total(chars).astype(np.int64)
    grams = Grams(ids, text_of)
    repeats = total(grams.covered(BASE_GRAM, first_too=True)).astype(np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    cover = {n: (total(np.where(grams.covered(n, first_too=False), chars, 0)) if n else np.array(chars_repeated))
             / np.maximum(1, word_chars) for n in LIMITS}
    kept = ~failed
    for n, limit in LIMITS.items():
        kept &= cover[n] <= limit
    return {"n_words": n_words, "word_chars": word_chars,
            "n_symbols": np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64),
            "n_dup_lines": np.array(lines_repeated, np.int64), "n_repeat_words": repeats,
            "base_failed": failed, "kept": kept} | {f"cover_{n or 'lines'}": c for n, c in cover.items()}


def rules(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts, the coverages and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            with np.errstate(over="ignore"):
                found = measured(texts_of(part, 1))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *map(pa.array, found.values())],
                                             ["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
