"""Secret scan: base patterns plus character Markov models compared by log-likelihood ratio.

Two order-2 Markov models over a small alphabet, one of random strings (keys,
tokens, digests) and one of ordinary identifiers and words, are trained from
labelled samples.  Every maximal run of ``[A-Za-z0-9+/_=-]`` of ``MIN_RUN`` or
more characters is scored by the difference of both log-likelihoods per
character; a run above the threshold that no base span touches is a span of
kind ``markov``.  Scores are sums over lookup tables, in numpy over whole
slices of texts.

Base kinds (``assign``, ``access``, ``hex``) are leftmost, non-overlapping
matches per kind of the patterns below; their spans are whole matches in code
points.

Defined cases: a null or empty text has no spans (the digest of the empty
string); repeated rows give equal rows; other columns are ignored by ``scan``
and kept by ``redacted``, where a null text stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_SLICE, Shared, bounded_sample, code_points, runs, slices, texts_of, trimmed

# The base patterns and lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

MIN_RUN = 20
THRESHOLD = 2.0  # nats per character
TRAIN_DOCS = 1000
_RUN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_STATES = len(_RUN_CHARS) + 1  # the last: start of a run
_STATE = np.full(128, _STATES - 1, np.int64)
_STATE[list(_RUN_CHARS)] = np.arange(len(_RUN_CHARS))
_HEX = np.zeros(128, bool)
_HEX[list(b"0123456789abcdef")] = True

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_markov long")


def _transitions(samples: Iterable[str]) -> np.ndarray:
    """Counts of (two characters, next character) in the samples, 1/2 added to each."""
    joined = np.frombuffer("".join(f" {s} " if " " not in s else " " for s in samples).encode("ascii", "replace"), np.uint8)
    state = _STATE[joined]  # the blanks are the state before a run
    keys = (state[:-2] * _STATES + state[1:-1]) * _STATES + state[2:]
    keys = keys[state[2:] < _STATES - 1]
    return (np.bincount(keys, minlength=_STATES ** 3) + 0.5).reshape(_STATES * _STATES, _STATES)


class MarkovRatio:
    """log P(character | two before it) under random strings minus that under ordinary ones."""

    def __init__(self, random: Iterable[str], ordinary: Iterable[str]):
        tables = []
        for samples in (random, ordinary):
            second = _transitions(samples)
            first = second.reshape(_STATES, _STATES, _STATES).sum(axis=0) - 0.5 * (_STATES - 1)
            first /= first.sum(axis=1, keepdims=True)
            # the order-1 model is the prior of the order-2 model: weight 8
            mixed = (second - 0.5).reshape(_STATES, _STATES, _STATES) + 8 * first[None]
            tables.append(np.log(mixed / mixed.sum(axis=2, keepdims=True)))
        self.ratio = (tables[0] - tables[1]).astype(np.float32).reshape(-1)

    def scores(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mean ratio per character of the runs [begin, end) of ``points``."""
        if not len(begin):
            return np.zeros(0)
        size = end - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        s = _STATE[points[at]]
        start = np.zeros(len(s), bool)
        start[np.concatenate([[0], np.cumsum(size)[:-1]])] = True
        one = np.where(start, _STATES - 1, np.roll(s, 1))
        two = np.where(start | np.roll(start, 1), _STATES - 1, np.roll(s, 2))
        terms = self.ratio[(two * _STATES + one) * _STATES + s].astype(np.float64)
        return np.add.reduceat(terms, np.flatnonzero(start)) / size

    def score(self, text: str) -> float:
        points = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint32)
        return float(self.scores(points, np.array([0]), np.array([len(points)]))[0])


def random_samples(n: int = 3000, seed: int = 1) -> list[str]:
    """Labelled samples of random strings: hex, base64, upper-case and mixed alphabets."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"]
    return ["".join(rng.choice(list(alphabets[k % len(alphabets)]), int(rng.integers(16, 64)))) for k in range(n)]


def identifier_samples(words: list[str], n: int = 3000, seed: int = 2) -> list[str]:
    """Labelled samples of ordinary identifiers: words joined as programs join them."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n if words else 0):
        parts = [words[i] for i in rng.integers(0, len(words), int(rng.integers(2, 5)))]
        out.append(("_".join(parts), "-".join(parts), "".join(p.capitalize() for p in parts), "/".join(parts),
                    "_".join(parts).upper(), parts[0] + str(rng.integers(0, 2030)))[k % 6])
    for mark in _RUN_CHARS.decode():  # rulers and fillers
        out += [mark * int(k) for k in rng.integers(20, 80, n // 200 if words else 0)]
    return out


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> MarkovRatio:
    """Models from labelled samples: seeded random strings and the base matches of at most ``max_docs``
    documents on one side, words outside base spans and identifiers made of them on the other."""
    rows = bounded_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", max_docs).collect()
    random, ordinary = random_samples(), []
    for row in sorted((r.text or "" for r in rows)):
        at, last, clean = base_spans(row), 0, []
        for b, e, _ in sorted(at):
            random.append(row[max(b, last):e][-64:])
            clean.append(row[last:b])
            last = max(last, e)
        ordinary += re.findall(r"[A-Za-z0-9+/_=-]+", " ".join([*clean, row[last:]]))
    words = [w for w in dict.fromkeys(ordinary) if w.isalpha()]
    return MarkovRatio(random, [*ordinary, *identifier_samples(words)])


def _worded_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, in no order."""
    hexes = re.finditer(rf"[0-9a-f]{{{MIN_HEX},}}", text)  # a maximal run: a shorter one can't be part of a match
    return [*_worded_spans(text), *((*m.span(), "hex") for m in hexes)]


def found_spans(model: MarkovRatio, texts: list[str], threshold: float = THRESHOLD) -> list[list[tuple[int, int, str]]]:
    """Per text: all spans by start, then kind as listed."""
    points, first = code_points(texts)
    low = np.minimum(points, 127)
    ascii_ = points < 127
    result = [_worded_spans(text) for text in texts]
    begin, end = runs(_HEX[low] & ascii_)
    for b, e in zip(*(x[end - begin >= MIN_HEX] for x in (begin, end))):
        k = int(np.searchsorted(first, b, side="right")) - 1
        result[k].append((int(b - first[k]), int(e - first[k]), "hex"))
    begin, end = runs((_STATE[low] < _STATES - 1) & ascii_)
    begin, end = (x[end - begin >= MIN_RUN] for x in (begin, end))
    high = model.scores(low, begin, end) > threshold
    for b, e in zip(begin[high], end[high]):
        k = int(np.searchsorted(first, b, side="right")) - 1
        b, e = int(b - first[k]), int(e - first[k])
        if not any(b < stop and start < e for start, stop, _ in result[k]):
            result[k].append((b, e, "markov"))
    return [sorted(own, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for own in result]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{b}:{e}" for b, e, kind in spans)


def scan(docs: DataFrame, model: MarkovRatio, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans, all spans."""
    shared = Shared(docs.sparkSession, model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = found_spans(shared.value, texts_of(part, 1), threshold)
            count = lambda kind: pa.array([sum(s[2] == kind for s in r) for r in rows], pa.int64())
            base = [_joined([s for s in r if s[2] != "markov"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), count("assign"), count("access"), count("hex"),
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([_joined(r) for r in rows], pa.string()),
                 count("markov")],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame, model: MarkovRatio, threshold: float = THRESHOLD, mark: str = "[secret]") -> DataFrame:
    """All documents and columns; every span in their texts is replaced by ``mark`` (overlapping ones by one)."""
    shared = Shared(docs.sparkSession, model)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, SMALL_SLICE):
            rows = found_spans(shared.value, texts_of(part, at), threshold)
            if any(rows):
                texts = part.column(at).to_pylist()
                texts = [cut(t, r, mark) if r else t for t, r in zip(texts, rows)]
                part = pa.RecordBatch.from_arrays(
                    [pa.array(texts, c.type) if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)
            yield part

    return docs.mapInArrow(trimmed(run), schema)


def cut(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, last = [], 0
    for b, e, _ in sorted(spans):
        if b >= last:
            out += [text[last:b], mark]
        last = max(last, e)
    return "".join([*out, text[last:]])
