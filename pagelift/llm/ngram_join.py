"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

A document's set holds the distinct 5-word shingles of its lower-cased words;
two documents link when ``100 * intersection >= 75 * union``.  The join keeps
every link between different sets, without emitting all pairs of a group:

1. *Sets.*  Documents of equal sets form a class by a 128-bit digest; only
   classes are joined.  A count sketch of fixed size over all shingles is summed
   by Spark; its logarithmic codes are the global order, rare shingles first.
2. *Prefixes.*  A set of ``n`` shingles must share ``need = ceil(0.75 n)`` with
   any partner, so two partners share ``l`` or more of the first
   ``n - need + l`` shingles of both.  Each document takes the ``l`` that makes
   its estimated cost least: rows to send, rows to meet (from the sketch), and
   candidates to verify, which fall with ``l``.  A pair is verified when it
   shares the smaller ``l`` of the two, and enough for its sizes.
3. *Postings.*  Prefix shingles of low estimated count, whose number of
   occurrences the sketch bounds, are packed by hash bucket; those found in one
   class only go.  Frequent ones are plain rows.  A class stays if it has as
   many as the least ``l`` among the classes it shares them with.
4. *Leaders.*  In a few rounds each shingle among the smallest hashes of its
   documents' prefixes proposes one of its documents as leader: one whose
   shingles are the most frequent, another one in each round.  (In a group of
   near copies such a document has been edited least, and so is close to most
   others.)  Each document is verified against the leader that most of its
   shingles propose, and components that link are drawn together.  So a group of
   near copies takes about one verification per document and round.
5. *Join.*  All prefix matches between documents of different components are
   counted and verified.  No match is left out, so the components are exact.
   Classes that share a prefix shingle with more than ``HOT`` classes form
   clusters, cut into blocks of bounded rows and bytes; each task gets two
   blocks, counts the prefix matches of their classes and verifies those with
   enough of them there, so such a shingle makes no rows.  Outside the clusters
   the matches are a join on the shingle.

Texts needed for verification are fetched once, in the scan, and stay where it left them until a pair needs them.  Components come from star
steps on link tables; nothing but the fixed-size sketch passes the driver.

``class_links`` gives the links themselves: it does without leaders, and counts
and verifies all prefix matches between classes, also within components.

Defined cases: a null or empty text has an empty set, which links with nothing
(its component is its own id); rows that share a doc_id count as one document
in components; a null doc_id keeps its row and never names a component;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import may_match
from .blocks import hot_clusters, in_blocks
from .common import SMALL_SLICE, Shared, slices, texts_of, trimmed, written
from .components import components
from .textgrams import word_hashes

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 22
CHUNK_BITS = 16
MAX_MATCHES = 12
#: Cost of verifying a candidate and of sending a posting, in units of one met posting.
VERIFY_COST, SEND_COST = 16, 4
#: A shingle is frequent when its count, less the sketch's noise, is above this.
FREQUENT = 200
#: Rounds of leaders, and how many shingles of a document vote in them; what they miss the join finds.
LEADER_ROUNDS = 2
VOTES = 8
#: Shingles of more classes than this connect clusters; the classes and bytes (of compressed text) of a block.
HOT, BLOCK_ROWS, BLOCK_BYTES = 64, 512, 1 << 20

_MIX = np.random.default_rng(3).integers(1, 2 ** 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    flat, owner = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        total = flat * _MIX[0]
        for k in range(1, SHINGLE):
            total[:len(flat) - k] += _turned(flat[k:], k) * _MIX[k]
        total = _mixed(total)
        sets = []
        for b, size in zip(first.tolist(), n.tolist()):
            if size >= SHINGLE:
                own = np.sort(total[b:b + size - SHINGLE + 1])
                sets.append(own[np.append(True, own[1:] != own[:-1])])
            elif size:
                short = sum((_turned(flat[b + k:b + k + 1], k) * _MIX[k] for k in range(size)), np.uint64(size))
                sets.append(_mixed(short))
            else:
                sets.append(flat[:0])
    return sets


def _turned(values: np.ndarray, k: int) -> np.ndarray:
    return values << np.uint64(k) | values >> np.uint64(64 - k) if k else values


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return values ^ values >> np.uint64(27)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _class_of(own: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


# ---------------------------------------------------------------- 1: sets and sketch
def _bucket_of(own: np.ndarray, bits: int) -> np.ndarray:
    return (own >> np.uint64(64 - bits)).astype(np.int64)


class _Sketch:
    """Counts by the first bits of a hash, handed on in compressed chunks."""

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros(1 << bits, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        self.counts += np.bincount(_bucket_of(hashes, self.bits), minlength=1 << self.bits).astype(np.uint32)

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        for k, part in enumerate(self.counts.reshape(-1, min(1 << CHUNK_BITS, 1 << self.bits))):
            planes = part.astype("<u4").view(np.uint8).reshape(-1, 4).T
            yield k, zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _first_pass(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "mark", "n", "cid", "check", "chunk", "counts"]
        sketch = _Sketch(bits)
        for part in slices(batches, 1, SMALL_SLICE):
            sets = shingle_sets(texts_of(part, 1))
            sketch.add(np.concatenate(sets))
            classes = [_class_of(s) for s in sets]
            empty = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * len(sets)), part.column(0).cast(pa.int64()), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([c for c, _ in classes], pa.int64()), pa.array([d for _, d in classes], pa.int64()),
                 pa.array(empty, pa.int32()), pa.array(empty, pa.binary())], names)
        rows = list(sketch.chunks()) if sketch.counts.any() else []
        empty = [None] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["sketch"] * len(rows), pa.string()), *(pa.array(empty, pa.int64()) for _ in range(5)),
             pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names)
    return run


def _summed(sketches: DataFrame, bits: int) -> np.ndarray:
    """The summed counts as codes ``round(4 log2(1 + count))``: one byte a bucket, a fixed size."""
    size = min(1 << CHUNK_BITS, 1 << bits)
    chunks = (1 << bits) // size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in batches:
            for k, counts in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                planes = np.frombuffer(zlib.decompress(counts), np.uint8).reshape(4, -1)
                own = np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
                total[k] = total[k] + own if k in total else own.astype(np.uint64)
        codes = {k: np.round(4 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for k, v in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(codes), pa.int32()), pa.array(list(codes.values()), pa.binary())], ["chunk", "codes"])

    table = np.zeros(1 << bits, np.uint8)
    for row in sketches.select("chunk", "counts").repartition(min(chunks, 8), "chunk").mapInArrow(run, "chunk int, codes binary").collect():
        table[row.chunk * size:(row.chunk + 1) * size] = np.frombuffer(row.codes, np.uint8)
    return table


# ---------------------------------------------------------------- 2: prefixes
class Order:
    """The global order of shingles and what it says about their counts."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bits = codes, int(len(codes)).bit_length() - 1
        counts = 2.0 ** (np.arange(256) / 4) - 1
        used = np.bincount(codes, minlength=256)
        noise = float((used * counts).sum() / used.sum())  # what a bucket holds on average
        # twice the spread above the average is noise too
        self.others = np.maximum(0, counts - noise - 2 * np.sqrt(noise) - 1)

    def prefixes(self, sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of non-empty sets: the prefix shingles, the set of each, which are frequent; the matches that a
        partner must have, the length of each prefix, and how frequent a set's shingles are, as a whole logarithm."""
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        first = np.cumsum(n) - n
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        codes = self.codes[_bucket_of(flat, self.bits)]
        by_rank = np.argsort(owner << 8 | codes, kind="stable")  # ties: by hash
        flat, others = flat[by_rank], self.others[codes[by_rank]]
        met_up_to = np.concatenate([[0.0], np.cumsum(others)])
        need = -(-PERCENT * n // 100)
        matches = np.arange(1, MAX_MATCHES + 1)
        length = np.minimum((n - need)[:, None] + matches, n[:, None])
        met = met_up_to[first[:, None] + length] - met_up_to[first][:, None]
        cost = np.where(matches <= need[:, None], SEND_COST * length + met * (1 + VERIFY_COST / matches), np.inf)
        best = cost.argmin(axis=1)
        taken = length[np.arange(len(sets)), best]
        inside = np.arange(len(flat)) - first[owner] < taken[owner]
        central = np.add.reduceat(np.log2(1 + others), first) / n
        return flat[inside], owner[inside], others[inside] > FREQUENT, matches[best], taken, central.astype(np.int64)


def _voting(tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which prefix shingles vote: the ``VOTES`` of each set with the smallest hashes."""
    by_hash = np.lexsort((_mixed(tokens), owner))
    counts = np.bincount(owner)
    place = np.empty(len(tokens), np.int64)
    place[by_hash] = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    return place < VOTES


#: What a packed bucket says of each of its sets, in 19 bytes: there are nearly as many as shingles when buckets are many.
_RUN = np.dtype([("cid", "<i8"), ("n", "<i4"), ("central", "u1"), ("size", "<u4"), ("voting", "u1"), ("matches", "u1")])


def _second_pass(order, buckets: int):
    """Rows of three kinds: packed prefixes by bucket, frequent postings, and a row per set with its sizes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 2 * SMALL_SLICE):
            sets = {}
            for own in shingle_sets(texts_of(part, 1)):
                if len(own):
                    sets[_class_of(own)[0]] = own
            if not sets:
                continue
            cids, n = np.fromiter(sets, np.int64, len(sets)), np.fromiter(map(len, sets.values()), np.int64, len(sets))
            with np.errstate(over="ignore"):
                tokens, owner, hot, matches, length, central = order.value.prefixes(list(sets.values()))
                votes = _voting(tokens, owner)
            cold = np.flatnonzero(~hot)
            bucket = (tokens[cold] % np.uint64(buckets)).astype(np.int64)
            cold = cold[np.lexsort((~votes[cold], owner[cold], bucket))]
            bucket = (tokens[cold] % np.uint64(buckets)).astype(np.int64)
            new = np.flatnonzero(np.diff(bucket * len(sets) + owner[cold], prepend=-1))  # a run for each bucket and set
            size = np.diff(np.append(new, len(cold)))
            voting = np.add.reduceat(votes[cold].astype(np.int64), new) if len(new) else new
            runs_ = np.zeros(len(new), _RUN)
            of = owner[cold[new]]
            for name, value in (("cid", cids[of]), ("n", n[of]), ("central", central[of]), ("size", size), ("voting", voting), ("matches", matches[of])):
                runs_[name] = value
            used = np.unique(bucket)
            cut, run_cut = np.searchsorted(bucket, used), np.searchsorted(bucket[new], used)
            tokens_cut = np.split(tokens[cold], cut[1:]) if len(used) else []
            runs_cut = np.split(runs_, run_cut[1:]) if len(used) else []
            yield _row_batch(len(used), kind="packed", bucket=used, tokens=[t.tobytes() for t in tokens_cut], owners=[r.tobytes() for r in runs_cut])
            at = np.flatnonzero(hot)
            yield _row_batch(len(at), kind="posting", token=tokens[at].view(np.int64), cid=cids[owner[at]], n=n[owner[at]], central=central[owner[at]], vote=votes[at])
            yield _row_batch(len(cids), kind="set", cid=cids, n=n, rest=n - length, matches=matches)
    return run


_SECOND = {"kind": pa.string(), "bucket": pa.int32(), "token": pa.int64(), "cid": pa.int64(), "n": pa.int32(), "central": pa.int32(), "vote": pa.bool_(),
           "rest": pa.int32(), "matches": pa.int32(), "tokens": pa.binary(), "owners": pa.binary()}


def _row_batch(rows: int, kind: str, **columns) -> pa.RecordBatch:
    made = {"kind": [kind] * rows} | columns
    return pa.RecordBatch.from_arrays([pa.array(made[k]).cast(t) if k in made and rows else pa.nulls(rows, t) for k, t in _SECOND.items()], list(_SECOND))


# ---------------------------------------------------------------- 3: postings
def _shared(group: pa.Table) -> pa.Table:
    """Postings of a bucket whose shingle is in two or more classes; ``low`` is the least ``matches`` of these."""
    tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()])
    owners = np.concatenate([np.frombuffer(o, _RUN) for o in group["owners"].to_pylist()])
    size, voting = owners["size"].astype(np.int64), owners["voting"].astype(np.int64)
    vote = np.arange(len(tokens)) < np.repeat(np.cumsum(size) - size + voting, size)  # voting shingles stand first
    cid, run = np.repeat(owners["cid"], size), np.repeat(np.arange(len(owners)), size)
    by_token = np.lexsort((cid, tokens))
    tokens, cid, run, vote = tokens[by_token], cid[by_token], run[by_token], vote[by_token]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (cid[1:] != cid[:-1])) if len(tokens) else np.zeros(0, bool)
    tokens, cid, run, vote = tokens[new], cid[new], run[new], vote[new]
    same = tokens[1:] == tokens[:-1]
    kept = np.append(same, False) | np.append(False, same) if len(tokens) else np.zeros(0, bool)
    tokens, cid, run, vote = tokens[kept], cid[kept], run[kept], vote[kept]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(owners["matches"][run], first) if len(first) else first
    low = np.repeat(low, np.diff(np.append(first, len(tokens))))
    return pa.table({"token": pa.array(tokens.view(np.int64)), "cid": pa.array(cid),
                     "n": pa.array(owners["n"][run].astype(np.int32)), "central": pa.array(owners["central"][run].astype(np.int32)),
                     "vote": pa.array(vote), "low": pa.array(low.astype(np.int32))})


# ---------------------------------------------------------------- 4, 5: candidates
_SIZES_FIT = f"100 * least(a_n, b_n) >= {PERCENT} * greatest(a_n, b_n)"


def _leaders(votes: DataFrame, number: int) -> DataFrame:
    """One candidate (a, b) per document, with their components: the leader of another component that most of
    its voting shingles propose."""
    lead = (votes.groupBy("token").agg(
        F.min_by(F.struct("cid", "n", "comp"), F.struct(-F.col("central"), F.xxhash64("cid", F.lit(number)))).alias("lead"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        .selectExpr("token", "lead.cid as b", "lead.n as b_n", "lead.comp as b_comp"))
    return (votes.withColumnsRenamed({"cid": "a", "n": "a_n", "comp": "a_comp"}).join(lead, "token")
            .filter(f"a_comp != b_comp and {_SIZES_FIT}")
            .groupBy("a", "b", "a_comp", "b_comp").agg(F.count("*").alias("c"))
            .groupBy("a", "a_comp").agg(F.max_by(F.struct("b", "b_comp"), F.struct("c", "b")).alias("lead"))
            .selectExpr("a", "lead.b as b", "a_comp", "lead.b_comp as b_comp"))


def _drawn_together(votes: DataFrame, found: DataFrame) -> DataFrame:
    """``votes`` with linked components under one label (the smaller), without shingles of one component only."""
    lower = (found.selectExpr("greatest(a_comp, b_comp) as comp", "least(a_comp, b_comp) as low")
             .groupBy("comp").agg(F.min("low").alias("low")))
    votes = votes.join(lower, "comp", "left").withColumn("comp", F.coalesce("low", "comp")).drop("low")
    split = votes.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return written(votes.join(split, "token", "left_semi"), "ngram-votes")


def _split(postings: DataFrame) -> DataFrame:
    """Postings of the shingles that several components have; a written table."""
    split = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return written(postings.join(split, "token", "left_semi"), "ngram-split")


def _matched(own: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b) of different components, and not of one cluster, with enough prefix matches to be verified."""
    apart, columns = "", ("cid", "n", "comp", "rest", "matches")
    if clusters is not None:
        own, columns = own.join(clusters.withColumnRenamed("id", "cid"), "cid", "left"), (*columns, "cluster")
        apart = " and (a_cluster is null or b_cluster is null or a_cluster != b_cluster)"
    sides = [own.selectExpr("token", *(f"{x} as {side}{'_' + x if x != 'cid' else ''}" for x in columns)) for side in "ab"]
    counted = (sides[0].join(sides[1], "token").filter(f"a < b and a_comp != b_comp and {_SIZES_FIT}{apart}")
               .groupBy("a", "b").agg(F.count("*").alias("c"), F.first(F.least("a_matches", "b_matches")).alias("l"),
                                      F.first(F.greatest("a_rest", "b_rest")).alias("rest"), F.first(F.col("a_n") + F.col("b_n")).alias("sizes")))
    # a common shingle outside the shorter prefix is among the `rest` of that side
    return counted.filter(f"c >= l and {100 + PERCENT} * (c + rest) >= {PERCENT} * sizes").select("a", "b")


def _cluster_links(members: DataFrame, order: Shared) -> DataFrame:
    """Links between classes of different components of each cluster, one per pair of components and task at most, from
    ``members(cluster, id, comp, text)``."""
    dealt = in_blocks(members, BLOCK_ROWS, BLOCK_BYTES)
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(group: pa.Table) -> pa.Table:
        sets = shingle_sets([zlib.decompress(t).decode("utf-8", "surrogatepass") for t in group["text"].to_pylist()])
        ids = group["id"].to_numpy()
        good = np.fromiter((len(s) > 0 and _class_of(s)[0] == c for s, c in zip(sets, ids.tolist())), bool, len(sets))
        if not good.all():  # a text under a class's document id that is another row's
            return run(group.filter(pa.array(good))) if good.any() else empty
        prefix, owner, _, matches, _, _ = order.value.prefixes(sets)
        prefix_cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
        cut = np.concatenate([[0], np.cumsum(list(map(len, sets)))])
        n = np.diff(cut)
        named, code = np.unique(np.concatenate(sets), return_inverse=True)
        prefix_code = np.searchsorted(named, prefix)
        mark = np.zeros(len(named), bool)

        def shared(own: np.ndarray, k: int, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
            """How many of the codes of set k each set holds."""
            mark[own[starts[k]:starts[k + 1]]] = True
            both = np.add.reduceat(mark[own], starts[:-1], dtype=np.int64)[at]
            mark[own[starts[k]:starts[k + 1]]] = False
            return both

        own = group["own"].to_numpy()
        low, high = group["i"][0].as_py(), group["j"][0].as_py()
        found, joined = [], group["comp"].to_numpy().copy()  # what a link has joined needs no other one
        for k in np.flatnonzero(own == low).tolist():
            at = np.flatnonzero((joined != joined[k]) & (own == high if low != high else ids > ids[k])
                                & (100 * np.minimum(n, n[k]) >= PERCENT * np.maximum(n, n[k])))
            if len(at):
                at = at[shared(prefix_code, k, at, prefix_cut) >= np.minimum(matches[at], matches[k])]
            if len(at):
                both = shared(code, k, at, cut)
                for x in at[100 * both >= PERCENT * (n[at] + n[k] - both)].tolist():
                    if joined[x] != joined[k]:
                        found.append((ids[k], ids[x]))
                        joined[joined == joined[x]] = joined[k]
        return pa.table({c: pa.array([f[s] for f in found], pa.int64()) for s, c in enumerate("ab")})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets, with all their columns; ``reps(cid, rep)`` says where their texts are."""
    schema, names = pairs.schema, pairs.columns
    a, b = (reps.selectExpr(f"cid as {side}", f"rep as {side}_rep") for side in "ab")
    pairs = written(pairs.join(a, "a").join(b, "b").select(*names, "a_rep", "b_rep"), "ngram-pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for part in slices(batches, part_at, SMALL_SLICE):
            good = []
            for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text"))):
                if (b, tb) != last:
                    last, last_set = (b, tb), _set_of(tb)
                own = _set_of(ta)
                # a text under its document's id may be another row's: its set must be that of the class
                good.append(_class_of(own)[0] == a and _class_of(last_set)[0] == b and links(own, last_set))
            yield part.select(names).filter(pa.array(good, pa.bool_()))

    part_at = len(names)
    texts = may_match(texts, "rep", pairs.select(F.explode(F.array("a_rep", "b_rep")).alias("rep")))
    a, b = (texts.selectExpr(f"rep as {side}_rep", f"text as {side}_text") for side in "ab")
    joined = pairs.join(a, "a_rep").join(b, "b_rep").select(*names, "a_text", "b_text")
    return written(joined.mapInArrow(trimmed(run), schema).distinct(), "ngram-links")


def _set_of(packed: bytes) -> np.ndarray:
    return shingle_sets([zlib.decompress(packed).decode("utf-8", "surrogatepass")])[0]


def _texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Compressed texts of the documents ``reps(cid, rep)`` of classes, and few others, as ``rep`` and ``text``; a written table.

    They are filtered in the scan and stay in its order: no text is shuffled before a pair or a block asks for it.  What
    reads them joins on the document's id, exactly, and compares the class.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SMALL_SLICE):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts_of(part, 1)], pa.binary())], ["rep", "text"])

    own = may_match(docs.filter("doc_id is not null").withColumnRenamed("doc_id", "rep"), "rep", reps.select("rep"))
    return written(own.mapInArrow(trimmed(run), "rep long, text binary"), "ngram-texts")


def _bitmap(ids: DataFrame, column: str):
    """Broadcast bitmap, of fixed size, of hashes of the ids: rows outside it are not among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = _Sketch(SKETCH_BITS)
        for part in batches:
            sketch.add(_id_hash(part.column(0).to_numpy(zero_copy_only=False)))
        rows = list(sketch.chunks()) if sketch.counts.any() else []
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["chunk", "counts"])

    held = _summed(ids.select(F.col(column).cast("long")).mapInArrow(run, "chunk int, counts binary"), SKETCH_BITS) > 0
    return Shared(ids.sparkSession, np.packbits(held))


def _id_hash(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _prepared(docs: DataFrame, buckets: int | None) -> tuple:
    """Steps 1 to 3: rows, classes, sets, of the classes that may have a partner the postings, documents and texts, and the order."""
    spark = docs.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(docs.withColumn("mark", F.xxhash64("text")).mapInArrow(
        trimmed(_first_pass(SKETCH_BITS)), "kind string, doc_id long, mark long, n long, cid long, check long, chunk int, counts binary"), "ngram-sets", by="kind")
    rows = first.filter("kind = 'doc'").select("doc_id", "mark", "n", "cid", "check")
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    order = Order(_summed(first.filter("kind = 'sketch'"), SKETCH_BITS))
    order = Shared(spark, order)
    second = written(docs.mapInArrow(trimmed(_second_pass(order, buckets)), ", ".join(
        f"{k} {_SQL_TYPES[t]}" for k, t in _SECOND.items())), "ngram-prefixes", by="kind")
    sets = second.filter("kind = 'set'").select("cid", "n", "rest", "matches").dropDuplicates(["cid"])
    packed = second.filter("kind = 'packed'").select("bucket", "tokens", "owners")
    frequent = second.filter("kind = 'posting'").select("token", "cid", "n", "central", "vote").dropDuplicates(["token", "cid"]).withColumn("low", F.lit(1))
    postings = written(packed.groupBy("bucket").applyInArrow(_shared, "token long, cid long, n int, central int, vote boolean, low int").unionByName(frequent), "ngram-postings")

    # a pair needs the smaller `matches` of its two: a class has no partner if it shares fewer prefix shingles than
    # any class that it shares one with asks for (1 for the frequent ones, whose classes aren't compared here)
    able = postings.groupBy("cid").agg(F.count("*").alias("k"), F.min("low").alias("low")).filter("k >= low").select("cid")
    able = written(able.join(classes.filter("rep is not null"), "cid").select("cid", "rep", "lo", "hi"), "ngram-able")
    if able.filter("lo != hi").limit(1).count():
        raise ValueError("two different sets have one 64-bit class id")
    reps = able.select("cid", "rep")
    texts = _texts(docs, reps)
    postings = written(postings.drop("low").join(able.select("cid"), "cid", "left_semi"), "ngram-postings")
    return rows, classes, sets, postings, reps, texts, order


def join(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest doc_id with an equal set) of every document."""
    return _joined(docs, buckets).select("doc_id", "n_shingles", "component_id", "class_id")


def _joined(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of ``join`` with a hash of the text (``mark``) and the key of the component (``comp``, null for empty sets)."""
    rows, classes, sets, postings, reps, texts, order = _prepared(docs, buckets)
    votes, found = postings.filter("vote").select("token", "cid", "n", "central", F.col("cid").alias("comp")), []
    for number in range(LEADER_ROUNDS):
        found.append(_verified(_leaders(votes, number), reps, texts))
        votes = _drawn_together(votes, found[-1])
    near = reduce(DataFrame.unionByName, (f.select("a", "b") for f in found))
    comp = components(near).selectExpr("node as cid", "root as comp")
    named = sets.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).select("cid", "rest", "matches", "comp")
    split = _split(postings.select("token", "cid", "n").join(named, "cid"))
    clusters = hot_clusters(split.selectExpr("token as key", "cid as id"), HOT)
    members = clusters.join(split.selectExpr("cid as id", "comp").distinct(), "id").join(reps.withColumnRenamed("cid", "id"), "id")
    members = written(members, "ngram-members")
    members = members.join(may_match(texts, "rep", members.select("rep")), "rep")  # the other texts stay where they are
    inside = written(_cluster_links(members.select("cluster", "id", "comp", "text"), order), "ngram-links")
    last = _verified(_matched(split, clusters), reps, texts)
    comp = components(near.unionByName(inside).unionByName(last)).selectExpr("node as cid", "root as comp")

    named = classes.select("cid", "rep").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "comp").select("cid", "comp", "component_id", F.col("rep").alias("class_id"))
    return (rows.join(named, "cid", "left")
            .select("doc_id", "mark", "comp", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")))


def class_links(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All links between classes that have a doc_id, and how many each document has.

    The first table is written: a, b (keys of two classes, a < b) and a_class_id, b_class_id.  The second has a row per
    document: doc_id, class_id and n_links, the number of other classes that its class links with.
    """
    rows, classes, sets, postings, reps, texts, _ = _prepared(docs, buckets)
    named = sets.select("cid", "rest", "matches", F.col("cid").alias("comp"))  # every class on its own: no pair is left out
    pairs = _verified(_matched(_split(postings.select("token", "cid", "n").join(named, "cid"))), reps, texts)
    a, b = (classes.selectExpr(f"cid as {side}", f"rep as {side}_class_id") for side in "ab")
    found = written(pairs.join(a, "a").join(b, "b").select("a", "b", "a_class_id", "b_class_id"), "ngram-class-links")
    counts = found.selectExpr("a as cid").unionByName(found.selectExpr("b as cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    known = classes.select("cid", F.col("rep").alias("class_id"))
    return found, (rows.join(known, "cid", "left").join(counts, "cid", "left")
                   .select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                           F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


_SQL_TYPES = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def one_per_component(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns; rows without an id stay.

    Rows that share a doc_id are told apart by their texts: of equal ones the first stays, others go or stay with
    their own components.  Only rows that a bitmap of the touched ids lets through are shuffled.
    """
    found = written(_joined(docs).filter("doc_id is not null").select("doc_id", "mark", "comp", "component_id"), "ngram-found")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    touched_ids = written(found.filter("doc_id != component_id").select("doc_id").distinct().unionByName(repeated), "ngram-touched")
    shared = _bitmap(touched_ids, "doc_id")
    at = docs.columns.index("doc_id")

    def split(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.unpackbits(shared.value).astype(bool)
            for part in batches:
                ids = part.column(at).cast(pa.int64())
                hit = held[_bucket_of(_id_hash(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)), SKETCH_BITS)]
                hit &= ids.is_valid().to_numpy(zero_copy_only=False)
                yield part.filter(pa.array(hit == wanted))
        return docs.mapInArrow(trimmed(run), docs.schema)

    stays = found.filter("doc_id = component_id").select("doc_id", "mark", "comp").distinct().withColumnsRenamed({"doc_id": "_id", "mark": "_mark", "comp": "_comp"})
    touched = split(True).withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    touched = touched.join(stays, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_text") == F.col("_mark")))
    # one row for each component of an id; texts without a shingle, which have none, each for itself
    first = Window.partitionBy("doc_id", "_comp", F.when(F.col("_comp").isNull(), F.col("_mark"))).orderBy(*(F.col(c).cast("string") for c in docs.columns))
    touched = touched.withColumn("_row", F.row_number().over(first)).filter("_row = 1").select(docs.columns)
    return split(False).unionByName(touched)
