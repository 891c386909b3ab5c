"""Near-duplicate classes by HyperMinHash sketches: banded registers propose, estimates sieve, full sets confirm.

A document's set holds the distinct 3-word shingles of its lower-cased words; two
documents link when ``100 * intersection >= 85 * union``.

1. *Sketches.*  One pass over the texts.  A 64-bit shingle hash gives a bucket (7
   bits) and a value; a bucket keeps its least value as a register of 16 bits: the
   number of leading zeros and the 10 bits behind the first one.  An empty register
   takes that of the first filled one in a fixed order of its own, so short texts
   have full sketches.  Equal sets are one class by a 128-bit digest; only classes
   go on.  Two different sets that link have 6 shingles or more.
2. *Bands.*  ``BANDS`` keys of ``ROWS`` registers each, drawn by a fixed rule.  Two
   sets of Jaccard 0.85 share a key with a probability above 1 - 10^-6.  Keys that
   one class alone has go.
3. *Leaders.*  In ``LEADER_ROUNDS`` rounds each key proposes one of its classes, the same one in
   all keys as far as possible; a class takes the leader that most of its keys
   propose.  So a group of near copies takes one check per class and round, and
   classes that link share a label; keys within one label go.
4. *Rest.*  Classes that share a key with more than ``HOT`` classes form clusters,
   cut into blocks of bounded rows and bytes.  Each task gets two blocks, compares
   their sketches, and checks there what the sieve leaves and no link has joined:
   only links come out, one per pair of labels at most, no pairs.  Outside the clusters all pairs of different labels with ``MATCHES`` keys
   or more are candidates.  Nothing is left out, so a component is found whole.
5. *Sieve and check.*  A candidate's Jaccard is estimated from equal registers, less
   the share that would be equal by chance (``chance``, from both sizes).  Below
   ``SIEVE``, six standard errors under 0.85, it goes.  The others are
   decided on their full shingle sets.

Defined cases: a null or empty text has an empty set and links with nothing (its
component is its own id); a text of one or two words is one shingle; rows that
share a doc_id count as one document in components; a null doc_id keeps its row,
takes the component of equal sets that have an id, and never links by itself;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import may_match
from .blocks import hot_clusters, in_blocks
from .common import slices, written
from .components import components
from .textgrams import mixed, word_hashes

SHINGLE, PERCENT = 3, 85
#: Sets with fewer shingles link with equal ones only: 5 of 6 are less than 85 of 100.
LEAST = 6
BUCKET_BITS, MANTISSA = 7, 10
REGISTERS = 1 << BUCKET_BITS
BANDS, ROWS, MATCHES = 48, 6, 2
SIEVE = PERCENT / 100 - 6 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
LEADER_ROUNDS = 1
#: Keys of more classes than this are hot; the classes and bytes (of compressed text) of a block.
HOT, BLOCK_ROWS, BLOCK_BYTES = 64, 512, 1 << 20
SLICE = 2 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


# ---------------------------------------------------------------- 1: sets and sketches
def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each text, and where each text's begin (one more at the end)."""
    flat, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    with np.errstate(over="ignore"):
        total = flat * _MIX[0]
        for k in range(1, SHINGLE):  # shorter texts stop at their end
            same = owner[k:] == owner[:-k] if len(flat) > k else np.zeros(0, bool)
            total[:len(same)] = np.where(same, mixed(total[:len(same)]) + flat[k:k + len(same)] * _MIX[k], total[:len(same)])
        total = mixed(total + np.uint64(1))
    used = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    first = np.cumsum(n) - n
    sets = [np.sort(total[a:a + m]) for a, m in zip(first.tolist(), used.tolist())]
    sets = [s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s for s in sets]
    cut = np.concatenate([[0], np.cumsum(list(map(len, sets)))]).astype(np.int64)
    return np.concatenate(sets) if sets else flat[:0], cut


def _raw(part: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in part.column(column).to_pylist()]


def _order_of_filling() -> np.ndarray:
    """For each register the other ones in a fixed pseudo-random order."""
    rank = mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, REGISTERS)
    return np.argsort(rank, axis=1, kind="stable").T


def sketches(flat: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Registers of each non-empty set (an empty one has zeros): leading zeros and mantissa of each bucket's least value."""
    n_sets = len(cut) - 1
    found = np.zeros((n_sets, REGISTERS), np.uint16)
    if not len(flat):
        return found
    owner = np.repeat(np.arange(n_sets), np.diff(cut))
    bucket = (flat >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key = owner * REGISTERS + bucket
    least = np.append(True, key[1:] != key[:-1])  # hashes are sorted within a set
    value = (flat[least] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits: exact as a float
    part, exponent = np.frexp(value.astype(np.float64))
    zeros = 53 - exponent
    found.reshape(-1)[key[least]] = ((np.minimum(zeros, 62) + 1) << MANTISSA) | np.floor(np.maximum(2 * part - 1, 0) * (1 << MANTISSA)).astype(np.int64)
    filled = found > 0
    row, column = np.nonzero(~filled & (np.diff(cut) > 0)[:, None])
    for others in _order_of_filling():
        if not len(row):
            break
        from_ = others[column]
        hit = filled[row, from_]
        found[row[hit], column[hit]] = found[row[hit], from_[hit]]
        row, column = row[~hit], column[~hit]
    return found


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that the registers of unrelated sets of these sizes are equal: both least values in one cell."""
    zeros = np.arange(63)
    high, low = 2.0 ** -zeros, 2.0 ** -(zeros + 1.0)
    high[-1], low[-1] = 2.0 ** -62, 0.0

    def level(n):  # where the least of n / REGISTERS values lies
        per = np.maximum(n / REGISTERS, 1.0)[:, None]
        return np.exp(-per * low) - np.exp(-per * high)
    return (level(a) * level(b)).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two arrays of sketches, corrected for chance."""
    by_chance = chance(a_n, b_n)
    return ((a == b).mean(axis=1) - by_chance) / (1 - by_chance)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1, SLICE):
        flat, cut = shingle_sets(_raw(part, 1))
        found = sketches(flat, cut)
        digests = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(cut).astype(np.int64)), pa.array(digests, pa.binary()),
             pa.array([r.tobytes() for r in found], pa.binary())], ["doc_id", "n", "digest", "sketch"])


# ---------------------------------------------------------------- 2: bands
def _bands() -> np.ndarray:
    """The registers of each band."""
    rank = mixed(np.arange(BANDS * REGISTERS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(BANDS, REGISTERS)
    return np.argsort(rank, axis=1, kind="stable")[:, :ROWS]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    taken = _bands()
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(found), BANDS))
        with np.errstate(over="ignore"):
            for k in range(ROWS):
                key = mixed(key * _MIX[0] + found[:, taken[:, k]].astype(np.uint64))
        rows = np.repeat(np.arange(len(found)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(rows)),
                                          batch.column(1).take(pa.array(rows))], ["key", "id", "n"])


def _split(bands: DataFrame) -> DataFrame:
    """Rows of the keys that classes of several labels have."""
    ends = bands.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return bands.join(ends, "key", "left_semi")


# ---------------------------------------------------------------- 3, 4: candidates
_SIZES_FIT = f"100 * least(a_n, b_n) >= {PERCENT} * greatest(a_n, b_n)"


def _leaders(bands: DataFrame, number: int) -> DataFrame:
    lead = (bands.groupBy("key").agg(F.min_by(F.struct("id", "n", "label"), F.xxhash64("id", F.lit(number))).alias("lead"))
            .selectExpr("key", "lead.id as b", "lead.n as b_n", "lead.label as b_label"))
    met = (bands.withColumnsRenamed({"id": "a", "n": "a_n", "label": "a_label"}).join(lead, "key")
           .filter(f"a_label != b_label and {_SIZES_FIT}"))
    return (met.groupBy("a", "b", "a_label", "b_label").agg(F.count("*").alias("c"))
            .groupBy("a", "a_label").agg(F.max_by(F.struct("b", "b_label"), F.struct("c", "b")).alias("lead"))
            .selectExpr("a", "lead.b as b", "a_label", "lead.b_label as b_label"))


def _rest(bands: DataFrame, clusters: DataFrame) -> DataFrame:
    bands = bands.join(clusters, "id", "left")
    a, b = (bands.withColumnsRenamed({x: f"{s}_{x}" if x != "id" else s for x in ("id", "n", "label", "cluster")}) for s in "ab")
    apart = "(a_cluster is null or b_cluster is null or a_cluster != b_cluster)"
    return (a.join(b, "key").filter(f"a < b and a_label != b_label and {apart} and {_SIZES_FIT}")
            .groupBy("a", "b").agg(F.count("*").alias("c")).filter(f"c >= {MATCHES}").select("a", "b"))


def _cluster_links(members: DataFrame) -> DataFrame:
    """Links between classes of different labels of each cluster, from ``members(cluster, id, label, n, sketch, digest, text)``."""
    dealt = in_blocks(members, BLOCK_ROWS, BLOCK_BYTES)
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "a_label", "b_label")})

    def run(group: pa.Table) -> pa.Table:
        packed = group["text"].to_pylist()
        flat, cut = shingle_sets([zlib.decompress(t) for t in packed])
        digest = group["digest"].to_pylist()
        good = np.fromiter((_digest(flat[a:b]) == d for a, b, d in zip(cut[:-1], cut[1:], digest)), bool, len(digest))
        if not good.all():  # a text under a class's id that is another row's
            return run(group.filter(pa.array(good))) if good.any() else empty
        named, code = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(named), bool)
        label, n, own, ids = (group[c].to_numpy() for c in ("label", "n", "own", "id"))
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        low, high = group["i"][0].as_py(), group["j"][0].as_py()
        found, joined = [], label.copy()  # what a link has joined needs no other one
        for k in np.flatnonzero(own == low).tolist():
            # of one block: each pair once; of two: those across
            at = np.flatnonzero((joined != joined[k]) & (own == high if low != high else ids > ids[k])
                                & (100 * np.minimum(n, n[k]) >= PERCENT * np.maximum(n, n[k])))
            if not len(at):
                continue
            near = estimate(sketch[at], sketch[k], n[at].astype(float), np.full(len(at), float(n[k])))
            at = at[near >= SIEVE]
            if not len(at):
                continue
            mark[code[cut[k]:cut[k + 1]]] = True
            both = np.add.reduceat(mark[code], cut[:-1], dtype=np.int64)[at]  # no set is empty
            mark[code[cut[k]:cut[k + 1]]] = False
            for x in at[100 * both >= PERCENT * (n[at] + n[k] - both)].tolist():
                if joined[x] != joined[k]:
                    found.append((k, x))
                    joined[joined == joined[x]] = joined[k]
        a, b = (np.array([f[s] for f in found], np.int64) for s in (0, 1))
        return pa.table({"a": ids[a], "b": ids[b], "a_label": label[a], "b_label": label[b]})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long, a_label long, b_label long")


def _relabelled(bands: DataFrame, found: DataFrame) -> DataFrame:
    """``bands`` with the labels of linked classes drawn together, to the least label that each one links with."""
    lower = (found.selectExpr("greatest(a_label, b_label) as label", "least(a_label, b_label) as low")
             .groupBy("label").agg(F.min("low").alias("low")))
    return bands.join(lower, "label", "left").withColumn("label", F.coalesce("low", "label")).drop("low")


# ---------------------------------------------------------------- 5: sieve and check
def _sieved(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose estimated similarity is not far below the bound."""
    names = pairs.columns
    sides = [classes.selectExpr(f"id as {s}", f"n as {s}_size", f"sketch as {s}_sketch") for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select(*names, "a_size", "b_size", "a_sketch", "b_sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(names)
        for part in batches:
            a_n, b_n = (part.column(at + k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
            a, b = (np.frombuffer(b"".join(part.column(at + k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
            yield part.select(names).filter(pa.array(estimate(a, b, a_n, b_n) >= SIEVE))

    return joined.mapInArrow(run, pairs.schema)


def _set_of(packed: bytes) -> np.ndarray:
    return shingle_sets([zlib.decompress(packed)])[0]


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link by their full sets."""
    names = pairs.columns
    sides = [texts.selectExpr(f"id as {s}", f"digest as {s}_digest", f"text as {s}_text") for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select(*names, "a_digest", "b_digest", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        at = len(names)
        for part in slices(batches, at + 2):
            good = []
            for a, b, ta, tb in zip(*(part.column(at + k).to_pylist() for k in range(4))):
                if tb != last:
                    last, last_set = tb, _set_of(tb)
                own = _set_of(ta)
                # a text under a class's id may be another row's
                good.append(_digest(own) == a and _digest(last_set) == b and links(own, last_set))
            yield part.select(names).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(run, pairs.schema)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, digest and compressed text of ``wanted(rep, id, digest)``; most other texts go before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            packed = [zlib.compress(t, 1) for t in _raw(part, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["rep", "text"])

    found = may_match(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", wanted.select("rep"))
    return found.mapInArrow(run, "rep long, text binary").join(wanted, "rep").select("id", "digest", "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set) and kept of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = written(docs.mapInArrow(_sketched, "doc_id long, n long, digest binary, sketch binary"), "hmh-rows")
    classes = (rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
               .withColumn("id", F.monotonically_increasing_id()))
    classes = written(classes, "hmh-classes")
    able = classes.filter(f"n >= {LEAST} and rep is not null")
    bands = able.select("id", "n", "sketch").mapInArrow(_banded, "key long, id long, n long")
    bands = written(_split(bands.withColumn("label", F.col("id"))), "hmh-bands")
    wanted = written(able.select("id", "digest", "rep").join(bands.select("id").distinct(), "id"), "hmh-wanted")
    texts = written(_texts(docs, wanted.select("rep", "id", "digest")), "hmh-texts")
    sketch = written(able.select("id", "n", "sketch").join(wanted.select("id"), "id"), "hmh-sketches")

    def linked(pairs: DataFrame) -> DataFrame:
        return written(_checked(written(_sieved(pairs, sketch), "hmh-candidates"), texts).distinct(), "hmh-links")

    found = []
    for number in range(LEADER_ROUNDS):
        found.append(linked(_leaders(bands, number)))
        bands = written(_split(_relabelled(bands, found[-1])), "hmh-bands")
    clusters = hot_clusters(bands.select("key", "id"), HOT)
    members = (clusters.join(bands.select("id", "label").distinct(), "id").join(sketch, "id")
               .join(may_match(texts, "id", clusters.select("id")), "id")
               .select("cluster", "id", "label", "n", "sketch", "digest", "text"))
    found.append(written(_cluster_links(members), "hmh-links"))
    found.append(linked(_rest(bands, clusters)))
    near = reduce(DataFrame.unionByName, (f.select("a", "b") for f in found))
    named = classes.select("digest", "id", "rep").join(components(near).selectExpr("node as id", "root"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(smallest, "root").select("digest", "component", F.col("rep").alias("class"))
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    own = F.col("n") > 0
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(own, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(own, F.col("class")).otherwise(F.col("doc_id")).alias("class_id")).withColumn(
                          "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
