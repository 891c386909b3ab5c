"""Importance resampling, vector codes and HyperMinHash classes against plain versions, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import CLASHING, SCHEMA, documents, prose, rows

from pagelift.llm import hyperminhash, resampling, vector_codes
from pagelift.llm.common import Shared, written

ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- 11
def features(text):
    words = re.findall(ITEM_WORD, lowered(text))
    return len(words), [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resampling(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    found = [(d, *features(t)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    total_s, total_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for d, n, fs in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("size", [0, 1, 7, 64, 65, 300, 4000])
def test_composed_checksums(size):
    rng = random.Random(size)
    a, b = rng.randbytes(50), rng.randbytes(size)
    crc = resampling.moved(np.array([zlib.crc32(a)], np.uint32), np.array([size])) ^ np.uint32(zlib.crc32(b))
    assert crc.tolist() == [zlib.crc32(a + b)]


@pytest.mark.parametrize("bound", [0, 3, 1 << 18])
def test_dictionary_bound_changes_nothing(spark, bound):
    texts = [t.encode() for t in ("", "Aa bb aa", "naïve x" + "y" * 90 + " bb", "--", "bb")]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text binary")
    words = resampling.dictionary(df, max(bound, 1))
    words = words if bound else resampling.Dictionary([])
    crc, size, text = words.scanned(texts)
    want = [(zlib.crc32(w.encode()), len(w.encode()), k) for k, t in enumerate(texts) for w in re.findall(ITEM_WORD, lowered(t.decode()))]
    assert list(zip(crc.tolist(), size.tolist(), text.tolist())) == want
    assert all(len(w) <= resampling.WORD_BYTES for w in words.words)


def test_resampling_on_awkward_rows(spark):
    rng = random.Random(4)
    found = rows() + [(100 + k, prose(rng, rng.randint(15, 60)), "en", "s", 1, *(["x"] * len(CLASHING))) for k in range(120)]
    found += [found[-1]] * 3 + [(None, found[-2][1], None, None, None, *([None] * len(CLASHING)))] * 3
    target = [found[-1][1], prose(rng, 30), None, "", "Ünï cödé"]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(documents(spark, found), aim)
    got_rows = Counter(map(tuple, got.collect()))
    want = plain_resampling([(r[0], r[1]) for r in found], target)
    assert got_rows == want and sum(1 for r in want.elements() if r[4]) >= 6
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_empty_tables(spark):
    docs, aim = documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(docs.filter("false"), aim).collect() == []
    assert Counter(map(tuple, resampling.resampled(docs, aim).collect())) == plain_resampling([(r[0], r[1]) for r in rows()], [])


def test_draw_among_equal_scores(spark):
    scored = spark.createDataFrame([(k % 50, 30, 1, 1, 7) for k in range(200)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = resampling.drawn(written(scored, "test")).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11))
    assert [r.doc_id for r in got] == [0] * 4 + [1] * 4 + [2] * 2


# ---------------------------------------------------------------- 12
@pytest.mark.parametrize("n, spread, block", [(1, 3, 1), (300, 2, 1), (300, 2, 7), (300, 40, 16), (4000, 3, 256), (4000, 900, 256)])
def test_trie_finds_the_nearest_entry(monkeypatch, n, spread, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(n + block)
    parts = np.unique(rng.integers(-spread, spread, (n, 5)), axis=0)
    book = rng.integers(-spread, spread, (16, 5))
    book[9] = book[3]  # a tie goes to the lower index
    far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    index, error = vector_codes.nearest(parts, book)
    assert (index == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def plain_codes(found, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in found
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (math.inf if r[0] is None else r[0], r[1]))
    length = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == length]
    width = length // 8
    cut = [[r[1][k * width:(k + 1) * width] for k in range(8)] for r in kept]
    books = [[c[k] for c in cut[:16]] for k in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(8):
            own = [nearest(c[k], books[k])[1] for c in cut]
            for j in range(len(books[k])):
                at = [c[k] for c, o in zip(cut, own) if o == j]
                if at:
                    books[k][j] = [sum(x) // len(at) for x in zip(*at)]
    best = [[nearest(c[k], books[k]) for k in range(8)] for c in cut]
    errors = [sum(d for d, _ in b) for b in best]
    total = Counter()
    for r, e in zip(kept, errors):
        total[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{j:02x}" for _, j in b), e, total[r[2]], digest) for r, b, e in zip(kept, best, errors))


def vectors(spark, found):
    return spark.createDataFrame([(*r, "x", 1) for r in found], "vec_id long, embedding array<float>, label int, code string, part int").repartition(3)


def test_codes_on_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    near = lambda: [float(np.float32(x)) for x in rng.normal(size=16)]
    hot = near()
    found = [(k, near(), int(k % 3) if k % 4 else None) for k in range(60)] + [(200 + k, hot, 7) for k in range(40)]
    found += [(61, None, 1), (62, [None] * 16, 1), (63, [math.nan] * 16, 2), (64, [math.inf] * 16, 2), (65, near()[:8], 3), (66, [], 3),
              (5, near(), 1), (None, near(), 2), (67, [0.0] * 16, None), (68, [-0.0] * 16, 9)]
    got = vector_codes.compressed(vectors(spark, found))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_codes(found)


def test_codes_of_few_and_no_vectors(spark):
    few = [(3, [0.5] * 8, 1), (1, [0.25] * 8, None), (2, None, 1)]
    assert Counter(map(tuple, vector_codes.compressed(vectors(spark, few)).collect())) == plain_codes(few)
    assert vector_codes.compressed(vectors(spark, few).filter("false")).collect() == []
    assert vector_codes.compressed(vectors(spark, [(1, [1.0] * 9, 1), (2, [1.0] * 8, 1)])).collect() == []
    with pytest.raises(Exception, match="squared distances would not fit"):
        vector_codes.compressed(vectors(spark, [(1, [1e9] * 8, 1)])).collect()


# ---------------------------------------------------------------- 13
def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain_classes(docs):
    """doc_id, n_shingles, component_id, class_id, kept by comparing all sets."""
    sets = [shingles(t) for _, t in docs]
    ids = {}
    for (d, _), s in zip(docs, sets):
        if s and d is not None:
            ids[s] = min(d, ids.get(s, d))
    group = {s: s for s in ids}

    def top(s):
        while group[s] != s:
            s = group[s]
        return s
    for a in ids:
        for b in ids:
            both = len(a & b)
            if a != b and both and 100 * both >= 85 * (len(a) + len(b) - both):
                group[top(a)] = top(b)
    least = {}
    for s, d in ids.items():
        least[top(s)] = min(d, least.get(top(s), d))
    out = []
    for (d, _), s in zip(docs, sets):
        comp, own = (least[top(s)], ids[s]) if s in ids else (None, None) if s else (d, d)
        out.append((d, len(s), comp, own, d is not None and d == comp))
    return Counter(out)


def test_sets_sketches_and_estimates():
    rng = random.Random(1)
    odd = ["a", "B", "c", "Dé", "É", "x\x0by", "\x1c", "z" * 70, " ", "\n"]
    texts = [" ".join(rng.choice(odd) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    flat, cut = hyperminhash.shingle_sets([t.encode() for t in texts])
    seen = {}
    for k, t in enumerate(texts):
        own = frozenset(flat[cut[k]:cut[k + 1]].tolist())
        assert len(own) == len(shingles(t)) and seen.setdefault(shingles(t), own) == own
    assert len(set(seen.values())) == len(seen)

    words = [str(k) for k in range(4000)]
    pairs = []
    for size, changed in ((40, 2), (300, 12), (300, 60), (3000, 150), (3000, 3000)):
        for _ in range(30):
            a = [rng.choice(words) for _ in range(size)]
            b = list(a)
            for k in rng.sample(range(size), changed):
                b[k] = rng.choice(words)
            pairs.append((" ".join(a), " ".join(b)))
    flat, cut = hyperminhash.shingle_sets([t.encode() for p in pairs for t in p])
    found, n = hyperminhash.sketches(flat, cut), np.diff(cut).astype(float)
    assert (found > 0).all()
    guess = hyperminhash.estimate(found[::2], found[1::2], n[::2], n[1::2])
    true = np.array([len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs])
    assert np.abs(guess - true).max() < 0.2 and abs(float((guess - true).mean())) < 0.02
    assert ((guess >= hyperminhash.SIEVE) | (true < 0.85)).all()


def test_chance_is_what_unrelated_sets_share():
    rng = np.random.default_rng(5)
    for n in (200, 20_000):
        flat = [np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64)) for _ in range(200)]
        cut = np.concatenate([[0], np.cumsum(list(map(len, flat)))])
        found = hyperminhash.sketches(np.concatenate(flat), cut)
        equal = float((found[::2] == found[1::2]).mean())
        want = float(hyperminhash.chance(np.array([float(n)]), np.array([float(n)]))[0])
        assert abs(equal - want) < 0.0006, (n, equal, want)


def near_copies(seed, groups=6, copies=25):
    """Groups of texts, each some edits away from a base: similarities on both sides of the bound."""
    rng, docs = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.randint(6, 120))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 10 ** 6))
            docs.append(" ".join(own + ["tail"] * rng.randint(0, 1)))
    return [(k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("hot, rows_", [(64, 512), (3, 10)])
def test_near_duplicates_lose_no_link(spark, monkeypatch, hot, rows_):
    monkeypatch.setattr(hyperminhash, "HOT", hot)
    monkeypatch.setattr(hyperminhash, "BLOCK_ROWS", rows_)
    found = [(r[0], r[1]) for r in rows()] + [(1000 + k, t) for k, t in near_copies(3)]
    found += [(None, "only without an id " * 3), (1003, "another text under an id that is there already, it links with nothing")]
    docs = documents(spark, [(*r, *([None] * (SCHEMA.count(",") - 1))) for r in found])
    got = hyperminhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "class_id", "kept")
    assert Counter(map(tuple, got.collect())) == plain_classes(found)


def test_near_duplicates_of_an_empty_table(spark):
    assert hyperminhash.near_duplicates(documents(spark).filter("false")).collect() == []


def test_shared_values_travel(spark):
    held = Shared(spark, np.arange(5))
    got = spark.range(3).select("id").mapInArrow(
        lambda batches: (b.set_column(0, "id", __import__("pyarrow").array(held.value[b.column(0).to_numpy()])) for b in batches), "id long")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]
