"""Queries of the training-data operators, one per operator, and their DuckDB SQL.

Each applies its operator with its production parameters to a whole table and
derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, hyperminhash, langid, ngram_join, pii, quality, resampling, secrets, sharding, toxicity,
               vector_codes, warc)
from .common import id_crc, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql.strip()
        return fn
    return register


@query()
def op1_secret_scan(spark, sf):
    docs = table(spark, sf, "documents")
    return secrets.scan(docs, secrets.train(docs))


_WORDS = r"[^\x20\x09-\x0D]+"


_SIZES = (3, 5, 7, 10)


def _grams_sql(n: int) -> str:
    """Per text, words of n-grams that stand more than once (n = 3) or stood before, and their characters."""
    again = "count(*) OVER (PARTITION BY r, gram) > 1" if n == 3 else "row_number() OVER (PARTITION BY r, gram ORDER BY i) > 1"
    return f"""
g{n} AS (SELECT r, i, {again} AS again FROM (
    SELECT r, i, array_to_string(w[i:i + {n - 1}], ' ') AS gram
    FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n}))),
c{n} AS (SELECT r, count(*) AS n, sum(length(d.w[pos])) AS chars FROM (
    SELECT DISTINCT r, unnest(range(i, i + {n})) AS pos FROM g{n} WHERE again) JOIN d USING (r) GROUP BY r)"""


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
{",".join(_grams_sql(n) for n in _SIZES)},
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) > 1 AS again FROM (
    SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORDS}')),
l AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
      FROM lines WHERE again GROUP BY r),
m AS (SELECT d.r, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(l.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words,
             coalesce(c5.chars, 0) AS c5, coalesce(c7.chars, 0) AS c7, coalesce(c10.chars, 0) AS c10, coalesce(l.chars, 0) AS cl
      FROM d LEFT JOIN l ON d.r = l.r LEFT JOIN c3 ON d.r = c3.r LEFT JOIN c5 ON d.r = c5.r
             LEFT JOIN c7 ON d.r = c7.r LEFT JOIN c10 ON d.r = c10.r),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CAST(c5 AS DOUBLE) / greatest(1, word_chars) AS cover_5, CAST(c7 AS DOUBLE) / greatest(1, word_chars) AS cover_7,
             CAST(c10 AS DOUBLE) / greatest(1, word_chars) AS cover_10, CAST(cl AS DOUBLE) / greatest(1, word_chars) AS cover_lines
      FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND cover_5 <= 0.20 AND cover_7 <= 0.18 AND cover_10 <= 0.16 AND cover_lines <= 0.25 AS kept,
       cover_5, cover_7, cover_10, cover_lines
FROM v
""")
def op2_quality_rules(spark, sf):
    return quality.rules(table(spark, sf, "documents"))


@query(rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS gram
      FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS class FROM s GROUP BY r),
c AS (SELECT class, min(r) AS r, any_value(n) AS n FROM n GROUP BY class),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM (SELECT s.* FROM s JOIN c USING (r)) a
      JOIN (SELECT s.* FROM s JOIN c USING (r)) b ON a.gram = b.gram AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN c ca ON ca.r = a JOIN c cb ON cb.r = b WHERE 100 * common >= 75 * (ca.n + cb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
ids AS (SELECT class, min(doc_id) AS class_id FROM d JOIN n USING (r) GROUP BY class),
named AS (SELECT c.class, min(i2.class_id) AS component_id FROM c JOIN reach ON reach.a = c.r
          JOIN c c2 ON c2.r = reach.b JOIN ids i2 ON i2.class = c2.class GROUP BY c.class)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       CASE WHEN n.r IS NULL THEN d.doc_id ELSE named.component_id END AS component_id,
       CASE WHEN n.r IS NULL THEN d.doc_id ELSE ids.class_id END AS class_id
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN named ON named.class = n.class LEFT JOIN ids ON ids.class = n.class
""")
def op3_ngram_jaccard(spark, sf):
    return ngram_join.join(table(spark, sf, "documents"))


@query(rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS gram
      FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS class FROM s GROUP BY r),
c AS (SELECT class, min(r) AS r, any_value(n) AS n, min(doc_id) AS class_id FROM n JOIN d USING (r) GROUP BY class),
g AS (SELECT class, n, gram FROM c JOIN s USING (r) WHERE class_id IS NOT NULL),
l AS (SELECT a.class FROM g a JOIN g b ON a.gram = b.gram AND a.class <> b.class
      GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
k AS (SELECT class, count(*) AS n_links FROM l GROUP BY class)
SELECT d.doc_id, CASE WHEN n.r IS NULL THEN d.doc_id ELSE c.class_id END AS class_id,
       CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN c ON c.class = n.class LEFT JOIN k ON k.class = n.class
""")
def ngram_class_links(spark, sf):
    return ngram_join.class_links(table(spark, sf, "documents"))[1]


@query()
def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return (toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))
            .select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "score", "predicted"))


@query()
def op5_balanced_labels(spark, sf):
    return sharding.shards(table(spark, sf, "documents"))


@query()
def op6_personal_data(spark, sf):
    docs = table(spark, sf, "documents")
    return pii.scan(docs, pii.train(docs))


@query()
def op7_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    return (langid.identify(docs, langid.train(docs))
            .select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score"))


_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORDS}') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORDS}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, greatest(1, len(w) - size + 2))) AS i
        FROM d, (SELECT DISTINCT size FROM bw)) WHERE i + size - 1 <= len(w)),
hit AS (SELECT r, i, size, item FROM dw JOIN bw USING (size, gram)),
words AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN items ON d.r = items.r
""")
def op8_decontaminate(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op9_byte_bpe(spark, sf):
    import public_tokenizers
    ranks = bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf, "documents"), ranks)


@query("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d,
                  row_number() OVER (PARTITION BY sha256(coalesce(html, '')) ORDER BY page_id NULLS LAST, url) AS nth,
                  min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n < 100 OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= 100 AND nth > 1 THEN first END AS refers_to
FROM p
""")
def op10_warc_chunks(spark, sf):
    return warc.archived(table(spark, sf, "pages"))


def _crc_sql(source: str, text: str) -> str:
    """Relations that end in ``crcs(text, crc)``: each byte of a text adds its own checksum, moved on by the bytes behind it."""
    return f"""
bits(b, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
t0 AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
longest AS (SELECT coalesce(max(octet_length(encode({text}))), 0) AS n FROM {source}),
moved(d, b, v) AS (SELECT 0, b, v FROM t0 UNION ALL
  SELECT d + 1, moved.b, xor(moved.v >> 8, t0.v) FROM moved JOIN t0 ON t0.b = moved.v & 255, longest WHERE d < longest.n),
start(n, v) AS (SELECT 0, 4294967295 UNION ALL
  SELECT start.n + 1, xor(start.v >> 8, t0.v) FROM start JOIN t0 ON t0.b = start.v & 255, longest WHERE start.n < longest.n),
bytes AS (
  SELECT {text} AS text, n, n - 1 - i AS d, CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS b
  FROM (SELECT {text}, hex(encode({text})) AS h, octet_length(encode({text})) AS n, unnest(range(octet_length(encode({text})))) AS i FROM {source})),
crcs AS (
  SELECT text, xor(xor(4294967295, any_value(start.v)), bit_xor(moved.v)) AS crc
  FROM bytes JOIN moved USING (d, b) JOIN start ON start.n = bytes.n GROUP BY text)"""


def _runs_sql(name: str, table: str, key: str) -> str:
    """``name(r, n, gram)``: all runs of one to three words of each text; ``n`` is the number of words."""
    return f"""
{name}_w AS (SELECT row_number() OVER () AS r, {key}, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORDS}') AS w FROM {table}),
{name} AS (SELECT r, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM {name}_w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k))"""


@query(f"""
WITH RECURSIVE {_runs_sql("dg", "documents", "doc_id")}, {_runs_sql("bg", "benchmark", "item_id")},
grams AS MATERIALIZED (SELECT DISTINCT gram FROM (SELECT gram FROM dg UNION ALL SELECT gram FROM bg)),
{_crc_sql("grams", "gram")},
c AS MATERIALIZED (SELECT text AS gram, crc % 10000 AS bucket FROM crcs),
s AS (SELECT bucket, count(*) AS n FROM dg JOIN c USING (gram) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bg JOIN c USING (gram) GROUP BY bucket),
gain AS (
  SELECT b.range AS bucket, CAST(floor(1000 * ln(
    (CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM dg) + 10000)
    / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM bg) + 10000)))) AS BIGINT) AS gain
  FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range),
w AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM dg JOIN c USING (gram) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(dg_w.w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5)
              / 4294967296))) AS BIGINT) AS score
  FROM dg_w LEFT JOIN w USING (r)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS draw
  FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
""")
def op11_importance_resampling(spark, sf):
    return resampling.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _codes_sql(rounds: int = 6) -> str:
    def assigned(number: int) -> str:
        far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""
a{number} AS MATERIALIZED (SELECT r, s, arg_min(e, (far, e)) AS e, CAST(min(far) AS BIGINT) AS far
  FROM (SELECT p.r, p.s, b.e, {far} AS far FROM p JOIN b{number} b USING (s)) GROUP BY r, s)"""

    def moved(number: int) -> str:
        return f"""
b{number + 1} AS MATERIALIZED (SELECT s, e, coalesce(m.x, b.x) AS x FROM b{number} b LEFT JOIN (
  SELECT s, e, list(v ORDER BY k) AS x FROM (
    SELECT s, e, k, CAST(floor(sum(p.x[k]) / count(*)) AS BIGINT) AS v
    FROM p JOIN a{number} USING (r, s), (SELECT unnest(range(1, 65)) AS k) WHERE k <= len(p.x) GROUP BY s, e, k) GROUP BY s, e) m USING (s, e))"""

    steps = ",".join(assigned(k) + "," + moved(k) for k in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, s, x[s * (len(x) // 8) + 1:(s + 1) * (len(x) // 8)] AS x FROM (SELECT r, x, unnest(range(8)) AS s FROM v)),
b0 AS MATERIALIZED (SELECT s, r - 1 AS e, x FROM p WHERE r <= 16),{steps},{assigned(rounds)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY s) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY s, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM v JOIN coded USING (r)
"""


@query(_codes_sql())
def op12_vector_codes(spark, sf):
    return vector_codes.compressed(table(spark, sf, "embeddings"))


@query(rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS gram
      FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS class FROM s GROUP BY r),
c AS MATERIALIZED (SELECT class, min(r) AS r, any_value(n) AS n FROM n GROUP BY class),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM (SELECT s.* FROM s JOIN c USING (r)) a
      JOIN (SELECT s.* FROM s JOIN c USING (r)) b ON a.gram = b.gram AND a.r < b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c ca ON ca.r = a JOIN c cb ON cb.r = b WHERE 100 * common >= 85 * (ca.n + cb.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
ids AS (SELECT class, min(doc_id) AS class_id FROM d JOIN n USING (r) GROUP BY class),
named AS (SELECT c.class, min(ids.class_id) AS component_id FROM c JOIN reach ON reach.a = c.r
          JOIN c other ON other.r = reach.b JOIN ids ON ids.class = other.class GROUP BY c.class)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(named.component_id, d.doc_id) AS component_id,
       doc_id = coalesce(named.component_id, d.doc_id) AS kept, coalesce(ids.class_id, d.doc_id) AS class_id
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN named ON named.class = n.class LEFT JOIN ids ON ids.class = n.class
""")
def op13_hyperminhash(spark, sf):
    return hyperminhash.near_duplicates(table(spark, sf, "documents"))
