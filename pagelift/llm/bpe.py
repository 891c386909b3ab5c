"""Byte-level BPE over a global shuffle of distinct words.

Documents are cut into pre-tokens (the matches of the split pattern).  Each
task deals its documents into batches of about ``BATCH_CHARS`` characters; in a
batch every distinct pre-token gets a number, and each document becomes the
sequence of its pre-tokens' numbers, in order of position.  The distinct words
of all batches are shuffled by a hash bucket, where each distinct word is
encoded once by the rank table; the ids go back to the batches that asked for
them, in the order of the batch's numbers, and the sequences are put together
again by position.

Only distinct words per batch and packed sequences are shuffled, not a row per
position.  Memory in a task is bounded by a batch, or by the distinct words of
a bucket (``buckets`` grows with the session's shuffle partitions).  Both
branches scan the same splits in the same order, so batches are the same in
each, also when Spark runs a task again.

Decoding joins ids with the token-byte table, which has a fixed size.

Defined cases: a null or empty text has no tokens and decodes to no bytes;
repeated rows are encoded alike; an empty table gives no rows; one very long
pre-token is merged with a heap in O(n log n); other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE, Shared, slices

BATCH_CHARS = 8_000_000
LONG_WORD = 64
#: White space for the split pattern, and a superset of it for safe cuts.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class Ranks:
    """A rank file: one base64 token and its rank a line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = pattern
        self.tokens = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        if len(word) > LONG_WORD:
            return self._encode_long(word)
        parts = [word[i:i + 1] for i in range(len(word))]
        pairs = [ranks.get(word[i:i + 2], 1 << 30) for i in range(len(word) - 1)]
        while pairs and (low := min(pairs)) < 1 << 30:
            at = pairs.index(low)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 30)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], 1 << 30)
        return [ranks[p] for p in parts]

    def _encode_long(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each place
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            if not alive[at] or stop[at] == n or stop[stop[at]] != end:
                continue  # one of its parts has changed
            gone = stop[at]
            alive[gone], stop[at] = False, end
            if end < n:
                before[end] = at
                if (r := ranks.get(word[at:stop[end]])) is not None:
                    heapq.heappush(heap, (r, at, stop[end]))
            if before[at] >= 0 and (r := ranks.get(word[before[at]:end])) is not None:
                heapq.heappush(heap, (r, before[at], end))
        return [ranks[word[i:stop[i]]] for i in range(n) if alive[i]]


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


class Words:
    """Numbers of a batch's pre-tokens, by first appearance, and the pre-tokens of what stands between single blanks.

    Nothing in it refers back to it: the tables of a batch go with their last reference. In a cycle they would wait for
    the collector, which counts few of their objects and so lets those of many batches pile up.
    """

    def __init__(self, pattern: str):
        import regex
        self._split = regex.compile(pattern).findall
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self._by_chunk = _Chunks(self._split, self.numbers)

    def _numbered(self, piece: str) -> list[int]:
        return [self.numbers[w] for w in self._split(piece)]

    def _chunks(self, text: str) -> list[str]:
        # A single blank between two characters that are no white space always starts a pre-token, so texts can be
        # cut there, and what stands between two cuts splits alike wherever it stands.
        if "  " in text or text[:1] == " " or text[-1:] == " " or any(
                c in text and (f" {c}" in text or f"{c} " in text) for c in _SPACES if c != " "):
            return _SAFE_CUT.split(text)
        return text.split(" ")

    def add(self, text: str) -> None:
        """Numbers the pre-tokens of a text as :meth:`sequence` does, each distinct chunk once."""
        chunks, known = self._chunks(text), self._by_chunk
        self._numbered(chunks[0])
        del chunks[0]
        for chunk in dict.fromkeys(chunks):
            known[chunk]

    def sequence(self, text: str) -> np.ndarray:
        chunks = self._chunks(text)
        first = self._numbered(chunks[0])
        return np.fromiter(chain(first, chain.from_iterable(map(self._by_chunk.__getitem__, chunks[1:]))), np.int32)


class _Chunks(dict):
    """Numbers of the pre-tokens of a blank and a chunk."""

    def __init__(self, split, numbers):
        super().__init__()
        self._split, self._numbers = split, numbers

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        # letters, and letters before one mark, are what the pattern makes of them without a look
        if _plain(chunk):
            found = (self._numbers[" " + chunk],)
        elif chunk[-1:] in _MARKS and _plain(chunk[:-1]):
            found = (self._numbers[" " + chunk[:-1]], self._numbers[chunk[-1]])
        else:
            found = tuple([self._numbers[w] for w in self._split(" " + chunk)])
        self[chunk] = found
        return found


_MARKS = frozenset(".,;:!?")


def _plain(text: str) -> bool:
    """Latin letters only."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def _batches(parts: Iterator[pa.RecordBatch], pattern: str, limit: int, ordered: bool) -> Iterator[tuple[int, list, list[np.ndarray], Words]]:
    """(batch, ids of documents, sequences, words) of each batch of this task; sequences only where ``ordered`` asks for them."""
    number, size = TaskContext.get().partitionId() << 24, 0
    ids, sequences, words = [], [], Words(pattern)
    for part in slices(parts, 1, SMALL_SLICE):
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            text = text or ""
            ids.append(doc)
            if ordered:
                sequences.append(words.sequence(text) if text else np.zeros(0, np.int32))
            elif text:
                words.add(text)
            size += len(text)
            if size >= limit:
                yield number, ids, sequences, words
                number, size = number + 1, 0
                ids, sequences, words = [], [], Words(pattern)
    if ids:
        yield number, ids, sequences, words


def _asked(pattern: str, buckets: int, limit: int):
    """Rows (bucket, batch, sizes, words): the distinct words of a batch that fall into a bucket, in order of their numbers."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, words in _batches(parts, pattern, limit, False):
            by_bucket: list[list[bytes]] = [[] for _ in range(buckets)]
            for word in words.numbers:
                data = word.encode("utf-8", "surrogatepass")
                by_bucket[_bucket(data, buckets)].append(data)
            used = [b for b in range(buckets) if by_bucket[b]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([batch] * len(used), pa.int64()),
                 pa.array([_pack(np.array([len(w) for w in by_bucket[b]])) for b in used], pa.binary()),
                 pa.array([zlib.compress(b"".join(by_bucket[b]), 1) for b in used], pa.binary())],
                ["bucket", "batch", "sizes", "words"])
    return run


STREAM_DOCS = 2000


def _streams(pattern: str, buckets: int, limit: int):
    """Rows (batch, part, docs, sizes, sequence, buckets): packed sequences; the first of a batch has its words' buckets."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, sequences, words in _batches(parts, pattern, limit, True):
            owner = np.fromiter((_bucket(w.encode("utf-8", "surrogatepass"), buckets) for w in words.numbers), np.int64, len(words.numbers))
            for at in range(0, len(ids), STREAM_DOCS):
                own = sequences[at:at + STREAM_DOCS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch], pa.int64()), pa.array([at], pa.int32()), pa.array([ids[at:at + STREAM_DOCS]], pa.list_(pa.int64())),
                     pa.array([_pack(np.array([len(s) for s in own]))], pa.binary()), pa.array([_pack(np.concatenate(own))], pa.binary()),
                     pa.array([_pack(owner) if at == 0 else None], pa.binary())],
                    ["batch", "part", "docs", "sizes", "sequence", "owner"])
    return run


def _encoded(table):
    """Each distinct word of a bucket is encoded once; its ids go to all batches that asked."""
    def run(group: pa.Table) -> pa.Table:
        encode, known = table.value.encode, {}
        out_sizes, out_ids = [], []
        for sizes, words in zip(group["sizes"].to_pylist(), group["words"].to_pylist()):
            data, stop = zlib.decompress(words), np.cumsum(_unpack(sizes)).tolist()
            found = []
            for b, e in zip([0, *stop], stop):
                word = data[b:e]
                if (ids := known.get(word)) is None:
                    known[word] = ids = encode(word)
                found.append(ids)
            out_sizes.append(_pack(np.array([len(f) for f in found])))
            out_ids.append(_pack(np.fromiter(chain.from_iterable(found), np.int64)))
        return pa.table({"batch": group["batch"].cast(pa.int64()), "bucket": group["bucket"].cast(pa.int32()),
                         "sizes": pa.array(out_sizes, pa.binary()), "ids": pa.array(out_ids, pa.binary())})
    return run


def _reassembled(streams: pa.Table, answers: pa.Table) -> pa.Table:
    rows = sorted(streams.to_pylist(), key=lambda r: r["part"])
    if not rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    owner = _unpack(rows[0]["owner"])
    size, slots = np.zeros(len(owner), np.int64), {}
    by_bucket = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by_bucket], np.arange(owner.max() + 2)) if len(owner) else [0]
    for row in answers.to_pylist():
        own = by_bucket[cuts[row["bucket"]]:cuts[row["bucket"] + 1]]
        size[own] = _unpack(row["sizes"])
        slots[row["bucket"]] = (own, _unpack(row["ids"]).astype(np.int32))
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int32)
    for own, ids in slots.values():
        n = size[own]
        flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
    doc_ids, lists = [], []
    for row in rows:
        sequence, lengths = _unpack(row["sequence"]), _unpack(row["sizes"])
        n = size[sequence]
        ids = flat[np.repeat(start[sequence] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.concatenate([[0], np.cumsum(lengths)])]
        doc_ids.append(pa.array(row["docs"], pa.int64()))
        lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
    return pa.table({"doc_id": pa.chunked_array(doc_ids), "ids": pa.chunked_array(lists)})


def encode(docs: DataFrame, ranks: Ranks, buckets: int | None = None, batch_chars: int = BATCH_CHARS, hold=lambda run: run) -> DataFrame:
    """doc_id and the token ids of every document; ``hold`` may wrap what tasks do with the texts."""
    return _put_together(docs, ranks, buckets, batch_chars, hold, _reassembled, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: Ranks, buckets: int | None = None, batch_chars: int = BATCH_CHARS, hold=lambda run: run) -> DataFrame:
    """The rows of ``decode(encode(docs))``; a batch is decoded in the worker that put its ids together, as a second one
    for each task would add to an executor's memory."""
    table = Shared(docs.sparkSession, ranks.tokens)

    def run(streams: pa.Table, answers: pa.Table) -> pa.Table:
        found = _reassembled(streams, answers)
        return found.append_column("bytes", pa.chunked_array([_bytes(c, table.value) for c in found["ids"].chunks], pa.binary()))

    return _put_together(docs, ranks, buckets, batch_chars, hold, run, "doc_id long, ids array<int>, bytes binary")


def _put_together(docs: DataFrame, ranks: Ranks, buckets: int | None, batch_chars: int, hold, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = Shared(spark, ranks)  # a vocabulary: a fixed size
    asked = own.mapInArrow(hold(_asked(ranks.pattern, buckets, batch_chars)), "bucket int, batch long, sizes binary, words binary")
    answers = asked.groupBy("bucket").applyInArrow(_encoded(table), "batch long, bucket int, sizes binary, ids binary")
    streams = own.mapInArrow(hold(_streams(ranks.pattern, buckets, batch_chars)),
                             "batch long, part int, docs array<long>, sizes binary, sequence binary, owner binary")
    return streams.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, schema)


def decode(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """The rows of ``encoded`` with the bytes that their ids stand for."""
    table = Shared(encoded.sparkSession, ranks.tokens)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, _bytes(part.column(1), table.value)], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def _bytes(column: pa.ListArray, tokens: list[bytes]) -> pa.Array:
    find = tokens.__getitem__
    return pa.array([b"".join(map(find, ids.tolist())) for ids in _lists(column)], pa.binary())


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield flat[ends[k]:ends[k + 1]]


def digests(docs: DataFrame, ranks: Ranks, batch_chars: int = BATCH_CHARS, hold=lambda run: run) -> DataFrame:
    """Round trip: number of tokens, digest of the ids, digest of the decoded bytes."""
    return round_trip(docs, ranks, batch_chars=batch_chars, hold=hold).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
