"""Registered queries against their DuckDB SQL, and the pipeline against a brute-force version."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from pagelift.llm import bpe, secrets, toxicity
from pagelift.llm.queries import ORACLE_SQL, QUERIES
from test_llm_groups import plain_components
from test_llm_text_rules import plain_leaks, words_of

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[1]) for q in QUERIES if (n := re.match(r"op(\d+)_", q))) == list(range(1, 14))
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    import tiktoken
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = [(r.doc_id, r.text) for r in docs.collect() if model.scores([r.text or ""])[0] < 0.3]
    kept = {d for d, _, comp in plain_components(left) if d == comp}
    left = [(d, t) for d, t in left if d in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if words_of(r.text)]
    dirty = {d for d, _, hit, _ in plain_leaks(left, items) if hit}
    left = [(d, t) for d, t in left if d not in dirty]
    markov = secrets.train(spark.createDataFrame(left, "doc_id long, text string"))
    ranks = bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    want = set()
    for doc, text in left:
        clean = secrets.cut(text or "", secrets.found_spans(markov, [text or ""])[0], "[secret]")
        ids = reference.encode_ordinary(clean)
        want.add((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_stages_keep_columns_and_awkward_rows(spark, tmp_path):
    from llm_fixtures import documents, rows
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = start = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema == start.schema or [f.dataType for f in docs.schema] == [f.dataType for f in start.schema], name
        assert docs.columns == start.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() and 0 < last.count() <= len(rows())
    empty = start.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
