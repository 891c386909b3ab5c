"""Near copies, components, shards, classifiers, archives and the pipeline."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents, prose, rows
from pagelift.llm import components, langid, ngram_join, sharding, toxicity, warc

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- near copies
def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(found):
    sets = [shingles(t) for _, t in found]
    root = list(range(len(found)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(found)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same_id = found[a][0] is not None and found[a][0] == found[b][0]
            if same_id and sets[a] and sets[b] or both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = defaultdict(list)
    for k, (doc, _) in enumerate(found):
        if doc is not None:
            least[top(k)].append(doc)
    return Counter((doc, len(sets[k]), min(least[top(k)], default=None) if sets[k] else doc) for k, (doc, _) in enumerate(found))


def joined(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())


def test_awkward_documents(spark):
    assert joined(documents(spark)) == plain_components([r[:2] for r in rows()])


def crowded(seed):
    """Groups of near copies that drift apart, a passage that many share, and documents made of few common lines."""
    rng = random.Random(seed)
    out, lines, passage = [], [prose(rng, 9) for _ in range(8)], prose(rng, 50)
    for _ in range(3):
        words = prose(rng, 80).split()
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(["p", "q", "r"]) + str(rng.randrange(99))
            out.append(" ".join(own))
            if rng.random() < 0.2:
                words = own
    out += [prose(rng, rng.randint(5, 90)) + " " + passage for _ in range(25)]
    out += ["\n".join(rng.sample(lines, rng.randint(2, 5))) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("hot, block", [(3, 10), (3, 512)])
def test_blocks_of_hot_shingles_lose_no_link(spark, monkeypatch, hot, block):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    test_crowded_groups_lose_no_link(spark, monkeypatch, 1)


@pytest.mark.parametrize("rounds", [1, ngram_join.LEADER_ROUNDS])
def test_crowded_groups_lose_no_link(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", rounds)
    found = crowded(5)
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(4)
    assert joined(df) == plain_components(found)


@pytest.mark.parametrize("matches, frequent", [(1, 0), (12, 3)])
def test_prefix_settings_don_t_change_the_result(spark, monkeypatch, matches, frequent):
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 2)
    monkeypatch.setattr(ngram_join, "MAX_MATCHES", matches)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 17)
    found = crowded(6)
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(4)
    assert joined(df) == plain_components(found)


@pytest.mark.parametrize("copies", [2, 3, 10, 100])
def test_copies_link_with_a_longer_text_that_holds_them(spark, copies):
    rng = random.Random(copies)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    found = []
    for _ in range(20):  # 75 shingles, and 100 that hold them: exactly 75 percent
        text = " ".join(word() for _ in range(79))
        found += [text] * copies + [text + " " + " ".join(word() for _ in range(25))]
    found = list(enumerate(found))
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(4)
    size = copies + 1
    assert joined(df) == Counter((k, 100 if k % size == copies else 75, k - k % size) for k, _ in found)


def test_all_links_between_classes_are_returned(spark):
    found = crowded(7)
    found += [(len(found) + k, text) for k, (_, text) in enumerate(found[:10])]  # copies are of one class
    links, counts = ngram_join.class_links(spark.createDataFrame(found, "doc_id long, text string").repartition(4))
    classes = {}
    for doc, text in found:
        classes.setdefault(frozenset(shingles(text)), doc)
    sets = [(doc, own) for own, doc in classes.items()]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 75 * len(x | y)}
    got = [tuple(sorted((r.a_class_id, r.b_class_id))) for r in links.collect()]
    assert len(got) == len(want) > 50 and set(got) == want
    own = {doc: classes[frozenset(shingles(text))] for doc, text in found}
    each = Counter(x for pair in want for x in pair)
    assert {r.doc_id: (r.class_id, r.n_links) for r in counts.collect()} == {doc: (c, each[c]) for doc, c in own.items()}


def test_texts_stay_where_the_scan_left_them(spark):
    """The texts of the classes are written by the tasks that scan the documents: no exchange of texts comes before."""
    docs = spark.createDataFrame([(i, f"one two three four five {i}") for i in range(40)], "doc_id long, text string")
    reps = spark.createDataFrame([(100 + i, i) for i in range(0, 40, 2)], "cid long, rep long")
    execution = []
    plain, ngram_join.written = ngram_join.written, lambda df, name, **more: execution.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name, **more)
    try:
        found = {r.rep: zlib.decompress(r.text).decode() for r in ngram_join._texts(docs, reps).collect()}
    finally:
        ngram_join.written = plain
    assert all(found[i] == f"one two three four five {i}" for i in range(0, 40, 2))
    assert len(execution) == 1 and "SortMergeJoin" not in execution[0] and "text" not in "".join(x for x in execution[0].splitlines() if re.search(r"\bExchange hash", x))


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    got = ngram_join.one_per_component(docs)
    assert got.columns == docs.columns
    kept = Counter(r.doc_id for r in got.collect())
    want = Counter({doc: 1 for doc, _, comp in plain_components([r[:2] for r in rows()]) if doc is not None and doc == comp})
    want[None] = sum(r[0] is None for r in rows())
    assert kept == want


def test_rows_of_one_id_are_told_apart(spark):
    words = [f"w{k}" for k in range(60)]
    own, near, other = " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(reversed(words))
    rows_ = [(1, own), (2, near), (2, other), (3, other + " y"), (3, "alone under an id that is there twice already"), (4, None), (4, ""), (4, None),
             (None, own), (None, own), (5, own), (5, near)]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows_], "doc_id long, text string, _id string")
    got = Counter((r.doc_id, r.text) for r in ngram_join.one_per_component(docs.withColumnRenamed("_id", "extra")).collect())
    assert got == Counter([(1, own), (2, other), (3, "alone under an id that is there twice already"), (4, None), (4, ""), (None, own), (None, own)])


def test_empty_tables(spark):
    none = documents(spark).filter("false")
    assert ngram_join.join(none).count() == 0 and ngram_join.one_per_component(none).count() == 0
    assert sharding.shards(none).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 9, 2])
def test_components_of_chains_and_stars(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "TASK_LINKS", limit)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(300, 200), (200, 300), (7, 7)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(61)} | {(k, 100) for k in range(100, 150)} | {(200, 200), (300, 200)}


# ---------------------------------------------------------------- shards
def check_shards(found, placed, n):
    counts = Counter(r.shard for r in placed)
    assert set(counts) <= set(range(n)) and max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1
    for s in counts:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(counts[s]))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in found)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in placed) == want
    assert {(r.law, r.grown_shard) for r in placed} == {("rows", None)}


def test_awkward_documents_are_dealt(spark):
    check_shards([r[:2] for r in rows()], sharding.shards(documents(spark)).collect(), 16)


def test_linked_documents_gather(spark):
    found = [(i, f"copy {i % 40}" if i < 400 else ("giant" if i < 1100 else f"unique {i}")) for i in range(3001)]
    placed = sharding.shards(spark.createDataFrame(found, "doc_id long, text string").repartition(3))
    rows_ = placed.collect()
    check_shards(found, rows_, 16)
    text = dict(found)
    homes = defaultdict(Counter)
    for r in rows_:
        homes[text[r.doc_id]][r.shard] += 1
    assert sum(max(homes[f"copy {k}"].values()) for k in range(40)) >= 0.9 * 400
    assert len([s for s, c in homes["giant"].items() if c > 20]) <= 6  # 700 rows need 4 shards of 188
    pairs, cut = placed.transform(sharding.cut_links).first()
    assert cut <= 0.85 * pairs


# ---------------------------------------------------------------- classifiers
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id].predicted == r.toxic for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    sample = docs.limit(50)
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(sample, toxicity.train(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (0, 1), (11, 0), (12, 0), (None, 1), (4, None), (999, 1), (22, 1), (23, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1  # null counts as empty
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    none = toxicity.train(docs, labels.filter("false"))
    assert {round(r.score, 6) for r in toxicity.score(docs, none).collect()} == {0.0}


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_toxicity_fit_holds_its_table_once():
    rng = np.random.default_rng(5)
    x = (rng.random((1500, 1000)) < 0.1).astype(np.float32)
    assert _peak(lambda: toxicity._logistic(x, (x[:, 0] > 0).astype(np.float32), 0.0, 5.0, 3)) < x.nbytes
    assert abs(toxicity._largest(x) / 1.1 / np.linalg.eigvalsh(x.T.astype(float) @ x)[-1] - 1) < 1e-6


def test_toxicity_fit_holds_few_long_texts_at_once():
    words = [w + str(k) for k in range(400) for w in ("ab", "cd", "xyz ")]
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(words, 8000)) + " bad" * (k % 2) for k in range(48)]
    model = []
    assert _peak(lambda: model.append(toxicity.fit(texts, np.arange(48) % 2))) < 70 << 20
    found = model[0].scores(["this is bad bad bad", "this is good"])
    assert found[0] > found[1]
    assert list(toxicity._parts(["a" * toxicity.PART_CHARS] * 2 + ["b", ""] * 40)) == [(0, 1), (1, 2), (2, 66), (66, 82)]
    assert list(toxicity._parts([])) == []


def test_empty_texts_are_not_toxic_whatever_the_share(spark):
    labels = spark.createDataFrame([(k, 1) for k in range(0, 40)], "doc_id long, toxic int")
    docs = documents(spark)
    model = toxicity.train(docs, labels)
    assert model.scores([""])[0] >= 0.3  # all labels are toxic
    kept = Counter(r.doc_id for r in toxicity.drop_toxic(docs, model).collect())
    blank = Counter(r[0] for r in rows() if not (r[1] or "").strip())
    assert kept & blank == blank and sum(blank.values()) >= 4


def test_a_long_text_does_not_end_the_toxicity_sample(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    first = spark.createDataFrame([(k,) for k in ids], "doc_id long").orderBy(F.xxhash64("doc_id")).first().doc_id
    found = [(k, "calm words " * 9000 if k == first else ("vile nasty slur " if k % 2 else "calm kind words ") * 5) for k in ids]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2 if k != first else 0) for k in ids], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_chars=50_000)
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.score(docs, model).collect() if r.doc_id != first)
    with pytest.warns(UserWarning, match="fewer than"):
        toxicity.train(docs, labels, max_chars=10)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    docs = documents(spark)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    for r in got:
        if r.doc_id in (4, 5, 6, 15, 22):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de")
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none, langid.train(none)).collect()} == {"und"}


# ---------------------------------------------------------------- archives
PAGES = [(1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150), (2, "http://b/", "x" * 150), (None, None, "x" * 150), (None, "u", "y" * 200),
         (None, "v", "y" * 200), (3, "h\nttp://c d", None), (4, "http://d/", "short"), (5, "http://e/", "short"), (6, "http://f/", "é" * 40000),
         (7, "http://f/", "\r\n\r\nWARC/1.1\r\n" * 30), (8, None, ""), (9, "http://f/", "é" * 40000)]


def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, data string, record_type string").repartition(3)


def test_archives_round_trip(spark):
    import hashlib
    got = Counter(tuple(r) for r in warc.archived(pages(spark)).collect())
    payloads = [(p, (h or "").encode()) for p, _, h in PAGES]
    want = Counter()
    seen = Counter()
    for p, data in sorted(payloads, key=lambda x: (x[0] is None, x[0] or 0)):
        first = min((q for q, d in payloads if d == data and q is not None), default=None)
        again = len(data) >= 100 and seen[data] > 0
        seen[data] += 1
        want[(p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert got == want


def test_chunks_carry_digests(spark, tmp_path):
    import hashlib
    manifest = warc.write(warc.chunked(warc.records(pages(spark)), chunk=1000), f"file://{tmp_path}/w")
    parts = warc.read(manifest, chunk=700).filter("page_id = 6").orderBy("chunk_no").collect()
    data = b"".join(bytes(r["data"]) for r in parts)
    assert data == ("é" * 40000).encode() and len(parts) == -(-80000 // 700)
    assert [r.is_last for r in parts] == [False] * (len(parts) - 1) + [True]
    assert parts[3].payload_digest == hashlib.sha256(data[:2800]).hexdigest() and parts[3].payload_bytes == 2800
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)


def test_damaged_archive_is_noticed(spark, tmp_path):
    import gzip
    manifest = warc.write(warc.chunked(warc.records(pages(spark).filter("page_id = 7"))), f"file://{tmp_path}/w")
    path = manifest.first().path.removeprefix("file://")
    whole = gzip.open(path).read()
    with gzip.open(path, "wb") as out:
        out.write(whole.replace(b"\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC", b"\r\n\r\nWARC/1.2\r\n\r\n\r\nWARC", 1))
    with pytest.raises(Exception, match="another digest"):
        warc.read(manifest).collect()


def test_no_pages(spark):
    assert warc.archived(pages(spark).filter("false")).count() == 0
