"""Personal data: base patterns plus a character-level bidirectional LSTM with CRF transitions, in numpy.

The tagger reads windows of ``WINDOW`` characters and gives each a tag (outside,
or begin/inside of a kind).  It is trained on labelled spans by
back-propagation through both LSTMs and the CRF's log likelihood.  A span must
hold an *anchor*, a digit or ``@``: a hard rule of the decoder, as every kind
is written with one.  Windows therefore overlap by half along the stretches
around anchors; a window elsewhere could give no span.  Windows of a whole
slice of texts run through the network as one batch, each is decoded by
Viterbi, and the tags are reconciled over the text: every character takes its
tag from the window in which it is most central, and neighbouring tags of one
kind make one span, whichever windows they come from.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are leftmost,
non-overlapping matches per kind; base spans always stay.  Spans of the tagger
are added where no base span touches them.

Defined cases: a null or empty text has no spans (the digest of the empty
string); without any labelled span the tagger adds none; repeated rows give
equal rows; other columns are ignored by ``scan`` and kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, bounded_sample, code_points, slices, texts_of

# The base patterns and rules of the contract.
KINDS = ("email", "ip", "card", "phone")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can't start inside a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_ANCHOR = re.compile("[0-9@]")

WINDOW = 96
HIDDEN, EMBED = 16, 12
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 2k + 1, 2k + 2: begin and inside of kind k
TRAIN_DOCS, TRAIN_WINDOWS, STEPS, BATCH = 4000, 2400, 220, 48
MIN_SPAN = 7
#: What a span of a kind may look like; ``_fitting`` adds what numbers must satisfy.
SHAPES = {"email": re.compile(r"[^\s@]+ ?@ ?[^\s@.]+(\.[^\s@.]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+){3}"), "card": re.compile(r"[0-9 .-]+"),
          "phone": re.compile(r"(?=.*[+() .-])[0-9+() .-]+")}
#: Texts of more characters are passed over in the training sample.
MAX_TEXT = 1 << 14
BATCH_WINDOWS = 512

SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_tagged long")


# ---------------------------------------------------------------- base patterns
def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (host := EMAIL_HOST.match(text, at)):
            yield start, (last := host.end())
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by kind as listed, then start."""
    found = [(b, e, "email") for b, e in _emails(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((*m.span(), "phone"))
    return found


# ---------------------------------------------------------------- the tagger
def _symbols(points: np.ndarray) -> np.ndarray:
    """Character classes: printable ASCII one by one, other letters, other."""
    return np.where((points >= 32) & (points < 127), points - 31, np.where(points >= 160, 96, 0)).astype(np.int64)


SYMBOLS = 97


class Tagger:
    """Embedding, one LSTM each way, emission scores, and CRF transitions."""

    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": scale(SYMBOLS, EMBED) * 3}
        for way in "fb":
            self.p[f"w{way}"] = scale(EMBED + HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # forget gate
            self.p[f"c{way}"] = bias
        self.p["out"], self.p["out_c"] = scale(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32)
        self.p["move"] = np.zeros((TAGS, TAGS), np.float32)
        self.p["first"] = np.zeros(TAGS, np.float32)
        self.trained = False

    # An inside tag must follow the begin or inside tag of its kind.
    ALLOWED = np.array([[not (b and b % 2 == 0) or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])

    def _moves(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.arange(TAGS) % 2 == 0
        inside[0] = False
        return np.where(self.ALLOWED, self.p["move"], -1e4).astype(np.float32), self.p["first"]

    def _lstm(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: steps by rows by EMBED; outputs in the same order of steps."""
        w, c = self.p[f"w{way}"], self.p[f"c{way}"]
        steps, rows = x.shape[:2]
        given = x.reshape(-1, EMBED) @ w[:EMBED] + c
        given = given.reshape(steps, rows, -1)
        state = np.zeros((rows, HIDDEN), np.float32)
        cell, out, saved = state, np.empty((steps, rows, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            gates = given[t] + state @ w[EMBED:]
            ifo = 1 / (1 + np.exp(-gates[:, :3 * HIDDEN]))
            new = np.tanh(gates[:, 3 * HIDDEN:])
            before, old = cell, state
            cell = ifo[:, HIDDEN:2 * HIDDEN] * before + ifo[:, :HIDDEN] * new
            squashed = np.tanh(cell)
            state = ifo[:, 2 * HIDDEN:] * squashed
            out[t] = state
            if keep:
                saved.append((t, ifo, new, before, squashed, old))
        return out, saved

    def emissions(self, symbols: np.ndarray, keep: bool = False):
        """symbols: rows by steps; scores: steps by rows by tags."""
        x = self.p["embed"][symbols.T]
        ahead, back = self._lstm(x, "f", keep), self._lstm(x, "b", keep)
        joined = np.concatenate([ahead[0], back[0]], axis=2)
        scores = joined @ self.p["out"] + self.p["out_c"]
        return (scores, x, joined, ahead[1], back[1]) if keep else scores

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags, rows by steps."""
        move, first = self._moves()
        steps, rows = scores.shape[:2]
        best, back = scores[0] + first, np.empty((steps, rows, TAGS), np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + move
            back[t] = options.argmax(axis=1)
            best = options.max(axis=1) + scores[t]
        tags = np.empty((rows, steps), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        every = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][every, tags[:, t]]
        return tags

    # -------------------------------------------------- training
    def gradients(self, symbols: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold tags per row, and its gradients."""
        scores, x, joined, ahead, back = self.emissions(symbols, keep=True)
        steps, rows = scores.shape[:2]
        move, first = self._moves()
        loss, to_scores, to_move, to_first = _crf(scores, move, first, gold.T)
        g = {"move": np.where(self.ALLOWED, to_move, 0), "first": to_first}
        flat = to_scores.reshape(-1, TAGS)
        g["out"], g["out_c"] = joined.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        to_joined = (flat @ self.p["out"].T).reshape(steps, rows, -1)
        to_x = np.zeros_like(x)
        for way, saved, part in (("f", ahead, to_joined[:, :, :HIDDEN]), ("b", back, to_joined[:, :, HIDDEN:])):
            w = self.p[f"w{way}"]
            to_w, to_c = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            to_state = to_cell = np.zeros((rows, HIDDEN), np.float32)
            for t, ifo, new, before, squashed, old in reversed(saved):
                i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN:2 * HIDDEN], ifo[:, 2 * HIDDEN:]
                dh = part[t] + to_state
                dc = to_cell + dh * o * (1 - squashed ** 2)
                gates = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new ** 2)], axis=1)
                to_w[:EMBED] += x[t].T @ gates
                to_w[EMBED:] += old.T @ gates
                to_c += gates.sum(axis=0)
                to_x[t] += gates @ w[:EMBED].T
                to_state, to_cell = gates @ w[EMBED:].T, dc * f
            g[f"w{way}"], g[f"c{way}"] = to_w, to_c
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], symbols.T.reshape(-1), to_x.reshape(-1, EMBED))
        return loss / rows, {k: v / rows for k, v in g.items()}

    def fit(self, symbols: np.ndarray, gold: np.ndarray, steps: int = STEPS, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on random batches, with clipped gradients."""
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(symbols), BATCH)
            _, g = self.gradients(symbols[rows], gold[rows])
            norm = float(np.sqrt(sum((v ** 2).sum() for v in g.values())))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / max(norm, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v ** 2
                change = mean[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)
                self.p[k] = (self.p[k] - rate * min(1.0, 2 * (1 - step / (steps + 1))) * change).astype(np.float32)
        self.trained = True


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + np.squeeze(top, axis)


def _crf(scores: np.ndarray, move: np.ndarray, first: np.ndarray, gold: np.ndarray):
    """Summed negative log likelihood and its gradients, by the forward-backward sums."""
    steps, rows = scores.shape[:2]
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = first + scores[0]
    for t in range(1, steps):
        ahead[t] = _logsum(ahead[t - 1][:, :, None] + move, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        back[t] = _logsum(move + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    total = _logsum(ahead[-1], 1)
    seen = np.exp(ahead + back - total[:, None])
    every = np.arange(rows)
    to_scores, to_move = seen.copy(), np.zeros_like(move)
    value = first[gold[0]].sum()
    for t in range(steps):
        to_scores[t, every, gold[t]] -= 1
        value += scores[t, every, gold[t]].sum()
        if t:
            pair = ahead[t - 1][:, :, None] + move + (scores[t] + back[t])[:, None, :] - total[:, None, None]
            to_move += np.exp(pair).sum(axis=0)
            np.add.at(to_move, (gold[t - 1], gold[t]), -1)
            value += move[gold[t - 1], gold[t]].sum()
    to_first = seen[0].sum(axis=0)
    np.add.at(to_first, gold[0], -1)
    return float(total.sum() - value), to_scores, to_move, to_first


# ---------------------------------------------------------------- labelled windows
def _variants(text: str, kind: str, rng: np.random.Generator) -> str:
    """Another way to write the same kind of value."""
    digits = re.sub(r"[^0-9]", "", text)
    pick = int(rng.integers(0, 4))
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", text)[pick]
    if kind == "card" and len(digits) == 16:
        parts = [digits[i:i + 4] for i in range(0, 16, 4)]
        return (" ".join(parts), "-".join(parts), text, ".".join(parts))[pick]
    if kind == "email":
        return (text, text.upper(), text.replace("@", " @ "), text)[pick]
    return text


def labelled_windows(texts: list[str], limit: int = TRAIN_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows with gold tags from labelled texts: base spans, some written another way, and stretches without a span."""
    rng = np.random.default_rng(seed)
    symbols, gold = [], []
    for text in texts:
        spans = sorted(base_spans(text))
        spans = [s for k, s in enumerate(spans) if not k or s[0] >= spans[k - 1][1]]
        for b, e, kind in spans:
            value = _variants(text[b:e], kind, rng)[:WINDOW - 16] if e - b <= WINDOW - 16 else text[b:e][:WINDOW]
            lead = int(rng.integers(0, max(1, WINDOW - len(value) + 1)))
            before, after = text[max(0, b - lead):b], text[e:e + WINDOW]
            line = (before + value + after)[:WINDOW].ljust(WINDOW)
            tags = np.zeros(WINDOW, np.int64)
            k = KINDS.index(kind)
            start, stop = len(before), min(WINDOW, len(before) + len(value))
            others = [(b2 - b + start, e2 - b + start, k2) for b2, e2, k2 in spans if e2 <= b] + \
                     [(b2 - e + len(before) + len(value), e2 - e + len(before) + len(value), k2) for b2, e2, k2 in spans if b2 >= e]
            for b2, e2, k2 in [(start, stop, kind), *others]:
                if b2 < WINDOW and e2 > 0 and e2 > b2:
                    tags[max(0, b2):e2] = 2 * KINDS.index(k2) + 2
                    if b2 >= 0:
                        tags[b2] = 2 * KINDS.index(k2) + 1
            if tags[0] and tags[0] % 2 == 0:  # cut by the window's edge
                tags[0] -= 1
            symbols.append(line)
            gold.append(tags)
            if len(symbols) % 3 == 0:  # ordinary numbers: dates, years, amounts, codes
                at = int(rng.integers(0, max(1, len(text) - WINDOW)))
                plain = text[at:at + WINDOW]
                if not any(s < at + WINDOW and at < e2 for s, e2, _ in spans):
                    number = (f"{rng.integers(1900, 2030)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1990, 2030)}",
                              f"{rng.integers(1, 10 ** 6)}", f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
                              f"{rng.integers(0, 9)}.{rng.integers(0, 99)}", f"{rng.integers(10, 24)}:{rng.integers(10, 60)}",
                              rng.bytes(int(rng.integers(8, 24))).hex(), f"{rng.bytes(4).hex()}-{rng.bytes(2).hex()}-{rng.bytes(6).hex()}")[int(rng.integers(0, 8))]
                    cut = int(rng.integers(0, len(plain) + 1))
                    symbols.append((plain[:cut] + " " + number + " " + plain[cut:])[:WINDOW].ljust(WINDOW))
                    gold.append(np.zeros(WINDOW, np.int64))
        if len(symbols) >= limit:
            break
    if not symbols:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    points = np.frombuffer("".join(symbols).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WINDOW)
    return _symbols(points), np.array(gold)


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> Tagger:
    """Trained on the labelled spans of a bounded sample: at most ``max_docs`` documents of up to ``MAX_TEXT`` characters
    that hold a digit or ``@``."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9]{4}|@") & (F.length("text") <= MAX_TEXT))
    rows = bounded_sample(own, "doc_id", max_docs).collect()
    tagger = Tagger()
    symbols, gold = labelled_windows(sorted({r.text for r in rows}, key=lambda t: (hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest())))
    if gold.any():
        tagger.fit(symbols, gold)
    return tagger


# ---------------------------------------------------------------- scan
def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _fitting(value: str, kind: str) -> Iterator[tuple[int, int]]:
    """The parts of a tagged stretch that satisfy the hard rules of its kind: the shape, four numbers up to 255, 9 to 15
    digits, or 13 to 19 that pass the check sum.  Numbers that were tagged as one card are told apart at their blanks."""
    if kind != "card":
        fits = SHAPES[kind].fullmatch(value)
        if kind == "ip":
            fits = fits and all(len(p) < 4 and int(p) < 256 for p in value.split("."))
        elif kind == "phone":
            fits = fits and 9 <= len(_digits(value)) <= 15
        if fits:
            yield 0, len(value)
        return
    words = [m.span() for m in re.finditer(r"[^ ]+", value)] if SHAPES[kind].fullmatch(value) else []
    k = 0
    while k < len(words):
        for j in range(k, len(words)):
            digits = _digits(value[words[k][0]:words[j][1]])
            if len(digits) > 19:
                break
            if len(digits) >= 13 and _luhn(digits):
                yield words[k][0], words[j][1]
                k = j
                break
        k += 1


def _stretches(points: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows and, in parallel, the text that each lies in."""
    anchor = np.flatnonzero(((points >= 48) & (points < 58)) | (points == 64))
    if not len(anchor):
        return anchor, anchor
    owner = np.searchsorted(first, anchor, side="right") - 1
    half = WINDOW // 2
    new = np.append(True, (np.diff(anchor) > half) | (np.diff(owner) > 0))
    group = np.cumsum(new) - 1
    begin = anchor[new]
    end = anchor[np.append(np.flatnonzero(new)[1:] - 1, len(anchor) - 1)]
    owner = owner[new]
    starts, owners = [], []
    for b, e, k in zip(begin.tolist(), end.tolist(), owner.tolist()):
        low = max(int(first[k]), b - half)
        high = min(int(stop[k]), e + half)
        own = list(range(low, max(low, high - WINDOW) + 1, half))
        if own[-1] + WINDOW < high:
            own.append(high - WINDOW)
        starts += own
        owners += [k] * len(own)
    return np.array(starts), np.array(owners)


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of the tagger per text, from overlapping windows reconciled over each text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not tagger.trained:
        return out
    points, first = code_points(texts)
    stop = np.append(first[1:], len(points)) - 1
    starts, owners = _stretches(points, first, stop)
    if not len(starts):
        return out
    tag = np.zeros(len(points), np.int8)
    central = np.full(len(points), -1, np.int16)
    centre = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)).astype(np.int16)
    for at in range(0, len(starts), BATCH_WINDOWS):
        own, of = starts[at:at + BATCH_WINDOWS], owners[at:at + BATCH_WINDOWS]
        where = own[:, None] + np.arange(WINDOW)
        inside = where < stop[of][:, None]
        where = np.minimum(where, len(points) - 1)
        scores = tagger.emissions(np.where(inside, _symbols(points[where]), 1))  # a blank after the text's end
        best = tagger.viterbi(scores)
        edge = np.where(own[:, None] == first[of][:, None], WINDOW, centre) + np.zeros_like(where)  # a text's start is no edge
        for row in range(len(own)):
            ok = inside[row] & (edge[row] > central[where[row]])
            to = where[row][ok]
            tag[to], central[to] = best[row][ok], edge[row][ok]
    kind = np.where(tag > 0, (tag + 1) // 2, 0)
    text_of = np.zeros(len(points), np.int64)
    text_of[first] = 1
    text_of = np.cumsum(text_of) - 1
    change = np.flatnonzero((kind[1:] != kind[:-1]) | ((tag[1:] % 2 == 1) & (kind[1:] > 0)) | (text_of[1:] != text_of[:-1])) + 1
    edges = np.concatenate([[0], change, [len(kind)]])
    for b, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if kind[b] and e - b >= MIN_SPAN:
            k, name = int(text_of[b]), KINDS[kind[b] - 1]
            start, stop_ = int(b - first[k]), int(e - first[k])
            out[k].extend((start + x, start + y, name) for x, y in _fitting(texts[k][start:stop_], name))
    return out


def found_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Per text: base spans, and the tagger's spans that touch none of them."""
    pairs = []
    for text, extra in zip(texts, tagged(tagger, texts)):
        base = base_spans(text) if _ANCHOR.search(text) else []
        pairs.append((base, [s for s in extra if not any(s[0] < e and b < s[1] for b, e, _ in base)]))
    return pairs


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{b}:{e}" for b, e, kind in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0], s[1])))


def scan(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans, all spans."""
    shared = Shared(docs.sparkSession, tagger)  # weights: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = found_spans(shared.value, texts_of(part, 1))
            counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), *counts,
                 pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows]),
                 pa.array([_joined(base + extra) for base, extra in rows], pa.string()),
                 pa.array([len(extra) for _, extra in rows], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_tagged"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def masked(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """All documents and columns; every span in their texts is replaced by its kind in brackets."""
    shared = Shared(docs.sparkSession, tagger)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            rows = found_spans(shared.value, texts_of(part, at))
            texts = [_masked(t, sorted(base + extra)) for t, (base, extra) in zip(part.column(at).to_pylist(), rows)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    out, last = [], 0
    for b, e, kind in spans:
        if b >= last:
            out += [text[last:b], f"[{kind}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])
