"""Registered queries: one per operator group of the inventory.

Each query takes ``(spark, sf_dir)``, reads whole driver tables (or tables
Spark derives from them) and returns a DataFrame.  ``ORACLE_SQL`` holds the
DuckDB statement computing the same rows, where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ux
from ..operators.admission import admit
from ..operators.candidates import extract_readable
from ..operators.markdown import extract_basic
from ..operators.render import shell_features
from ..sources.tables import pages as read_pages
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return register


# Shared SQL fragments (DuckDB).  The whitespace class is the one of
# functions.text, valid in both Java regex and RE2.
WS = tx.WS
LB = tx.LINE_BREAK


def _sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


# --------------------------------------------------------------- S1, S2
@query("s1_page_scan", """
SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars,
       CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes
FROM pages
""")
def s1_page_scan(spark, sf):
    p = read_pages(spark, sf)
    return p.select("page_id", "url", F.length("html").cast("long").alias("n_chars"),
                    F.octet_length("html").cast("long").alias("n_bytes"))


@query("s2_admission", """
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes,
       octet_length(encode(html)) <= 5000000 AS admitted,
       CASE WHEN octet_length(encode(html)) > 5000000
            THEN 'The page is larger than the configured download limit.' END AS reject_reason
FROM pages
""")
def s2_admission(spark, sf):
    return admit(read_pages(spark, sf)).select("page_id", "n_bytes", "admitted", "reject_reason")


# --------------------------------------------------------------- U1, U2
_URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?"


@query("u1_u2_url_filter", f"""
WITH h AS (
  SELECT page_id, url,
         lower(regexp_extract(url, '{_URL_PARTS}', 1)) AS scheme,
         regexp_replace(regexp_extract(url, '{_URL_PARTS}', 3), '^.*@', '') AS hostport
  FROM pages),
g AS (
  SELECT page_id, url, scheme,
         lower(CASE WHEN contains(hostport, '[') THEN regexp_extract(hostport, '\\[([^\\]]*)', 1)
                    ELSE regexp_replace(hostport, ':.*$', '') END) AS host
  FROM h)
SELECT page_id, scheme, host,
       scheme IN ('http', 'https') AND host <> '' AS scheme_host_ok,
       (regexp_replace(host, '\\.+$', '') = 'localhost'
        OR suffix(regexp_replace(host, '\\.+$', ''), '.local')) AS local_name
FROM g
""")
def u1_u2_url_filter(spark, sf):
    p = read_pages(spark, sf).select("page_id", "url")
    return p.select("page_id", ux.url_scheme("url").alias("scheme"), ux.url_host("url").alias("host"),
                    ux.scheme_host_ok("url").alias("scheme_host_ok"),
                    ux.local_host("url").alias("local_name"))


# --------------------------------------------------------------- Q1-Q7, A6
_DOC_WORDS = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')"
_DOC_LINES = f"regexp_split_to_array(text, '{LB}')"
_FOLD = "replace(lower({}), 'ß', 'ss')"
_BOILER = " + ".join(
    f"(length({_FOLD.format('text')}) - length(replace({_FOLD.format('text')}, '{t}', ''))) // {len(t)}"
    for t in ('accept cookies', 'privacy policy', 'sign up', 'all rights reserved', 'enable javascript'))


@query("q1_q7_doc_quality", f"""
WITH d AS (
  SELECT doc_id, text, {_DOC_WORDS} AS w, {_DOC_LINES} AS ls FROM documents),
f AS (
  SELECT doc_id,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(list_filter(ls, lambda l: regexp_matches(l, '^{WS}*[#\\-*|]'))) AS BIGINT) AS structure_lines,
    CAST(length(text) - length(translate(text, '.?!:', '')) AS BIGINT) AS sentence_marks,
    CAST({_BOILER} AS BIGINT) AS boilerplate_hits,
    CAST((len(list_filter(list_transform(ls, lambda l: {_sql_strip('l')}), lambda l: length(l) > 40))
      - len(list_distinct(list_filter(list_transform(ls, lambda l: {_sql_strip('l')}),
                                      lambda l: length(l) > 40)))) * 40 AS BIGINT) AS repeat_penalty,
    CASE WHEN len(w) = 0 THEN NULL
         ELSE len(list_distinct(list_transform(w, lambda x: {_FOLD.format('x')})))::DOUBLE / len(w)
    END AS ratio
  FROM d)
SELECT doc_id, n_words, structure_lines, sentence_marks, boilerplate_hits, repeat_penalty,
  round(CASE WHEN n_words = 0 THEN 0.0 ELSE
    (least(n_words, 2000) + least(structure_lines, 30) * 8 + least(sentence_marks, 100) * 2)::DOUBLE
    + ratio * 100.0 - (boilerplate_hits * 80)::DOUBLE - repeat_penalty::DOUBLE END, 6) AS quality
FROM f
""")
def q1_q7_doc_quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    q = tx.with_quality(d, "text", "q", features=True)
    return q.select("doc_id", "n_words", "structure_lines", "sentence_marks", "boilerplate_hits",
                    "repeat_penalty", F.round("q", 6).alias("quality"))


@query("a6_word_count", f"""
SELECT doc_id, CAST(len({_DOC_WORDS}) AS BIGINT) AS words FROM documents
""")
def a6_word_count(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", tx.word_count("text").cast("long").alias("words"))


# --------------------------------------------------------------- R1
# Fixed values, stated here once more so that the oracle doesn't read them from the code under test.
_MARKERS_STATED = (
    'id="root"', "id='root'", 'id="app"', "id='app'", "__next_data__", "enable javascript", "javascript is required",
    "data-reactroot", "ng-version", 'id="__nuxt"', "id='__nuxt'", 'id="___gatsby"', "id='___gatsby'",
    "__preloaded_state__", "__initial_state__", "window.__nuxt__")
_MARKER_SQL = " OR ".join("contains(lower(html), '" + m.replace("'", "''") + "')" for m in _MARKERS_STATED)


@query("r1_shell_markers", f"""
SELECT page_id, ({_MARKER_SQL}) AS has_marker,
       CAST((length(lower(html)) - length(replace(lower(html), '<script', ''))) // 7 AS BIGINT)
         AS script_count,
       CAST(length(html) AS BIGINT) AS html_chars
FROM pages
""")
def r1_shell_markers(spark, sf):
    p = read_pages(spark, sf)
    return p.select("page_id", *[c.alias(n) for n, c in shell_features("html").items()])


# --------------------------------------------------------------- D1-D21, Q8-Q10, C1
@query("d3_titles", f"""
SELECT page_id,
  CASE WHEN regexp_matches(html, '<title>') THEN
    {_sql_strip("replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&quot;', '\"'), '&amp', '&')")}
  ELSE 'Untitled page' END AS title
FROM pages
""")
def d3_titles(spark, sf):
    from ..operators.markdown import UNTITLED
    from ..operators.nodes import page_trees
    p = page_trees(read_pages(spark, sf).select("page_id", "html"))
    return p.select("page_id", F.coalesce(F.array_join("title_parts", " "), F.lit(UNTITLED)).alias("title"))


# The driver's articles hold a heading and paragraphs; an unclosed <p><b> takes in all that follows it.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"),
             ("&middot;", "\u00b7"), ("&amp;", "&"), ("&amp", "&"))


def _plain_sql(e: str) -> str:
    for name, char in _ENTITIES:
        e = f"replace({e}, '{name}', '{char}')"
    return e


def _line_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


_ARTICLE_SQL = f"""
art AS (
  SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
parts AS (
  SELECT page_id, url, html, {_line_sql(_plain_sql("regexp_extract(a, '<h1>([^<]*)</h1>', 1)"))} AS h1,
         CASE WHEN contains(a, '<p><b>') THEN split_part(a, '<p><b>', 1) ELSE a END AS closed,
         CASE WHEN contains(a, '<p><b>') THEN substr(a, strpos(a, '<p><b>') + 6) ELSE '' END AS tail
  FROM art),
texts AS (
  SELECT page_id, url, html, h1,
         list_transform(regexp_extract_all(closed, '(?s)<p>([^<]*)</p>', 1), lambda x: {_line_sql(_plain_sql('x'))}) AS paras,
         list_filter(list_transform(regexp_split_to_array(tail, '<[^>]*>'), lambda x: {_line_sql(_plain_sql('x'))}), lambda x: x <> '') AS rest
  FROM parts),
listed AS (
  SELECT *, list_filter(['# ' || h1] || paras || CASE WHEN len(rest) > 0 THEN ['**' || array_to_string(rest, ' ') || '**'] ELSE [] END,
                        lambda x: x <> '') AS all_lines FROM texts),
basic AS (
  SELECT page_id, url, html, all_lines, array_to_string(list_filter(all_lines, lambda x, i: i = 1 OR x <> all_lines[greatest(i - 1, 1)]), chr(10)) AS text
  FROM listed)"""


def _quality_sql(source: str, keys: str) -> str:
    """Q1-Q7 of ``text`` in a relation, as the relation ``scored``."""
    return f"""
w_ AS (SELECT {keys}, text, {_DOC_WORDS} AS w, {_DOC_LINES} AS ls FROM {source}),
f_ AS (
  SELECT {keys}, text, len(w) AS n_words,
    len(list_filter(ls, lambda l: regexp_matches(l, '^{WS}*[#\\-*|]'))) AS structure_lines,
    length(text) - length(translate(text, '.?!:', '')) AS sentence_marks,
    {_BOILER} AS boilerplate_hits,
    (len(list_filter(list_transform(ls, lambda l: {_sql_strip('l')}), lambda l: length(l) > 40))
      - len(list_distinct(list_filter(list_transform(ls, lambda l: {_sql_strip('l')}), lambda l: length(l) > 40)))) * 40 AS repeat_penalty,
    CASE WHEN len(w) = 0 THEN NULL ELSE len(list_distinct(list_transform(w, lambda x: {_FOLD.format('x')})))::DOUBLE / len(w) END AS ratio
  FROM w_),
scored AS (
  SELECT {keys}, text, n_words, CASE WHEN n_words = 0 THEN 0.0 ELSE
    (least(n_words, 2000) + least(structure_lines, 30) * 8 + least(sentence_marks, 100) * 2)::DOUBLE
    + ratio * 100.0 - (boilerplate_hits * 80)::DOUBLE - repeat_penalty::DOUBLE END AS q FROM f_)"""


_TITLE_SQL = f"""CASE WHEN regexp_matches(html, '<title>') THEN {_line_sql(_plain_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)"))}
  ELSE 'Untitled page' END"""


@query("d1_d21_extract_basic", f"""
WITH {_ARTICLE_SQL},
{_quality_sql('basic', 'page_id, url, html')}
SELECT page_id, url, {_TITLE_SQL} AS title, text AS markdown, round(q, 6) AS quality FROM scored
""")
def d_extract_basic(spark, sf):
    return extract_basic(read_pages(spark, sf))


@query("d15_d21_markdown_lines", f"""
WITH {_ARTICLE_SQL}
SELECT page_id, CAST(i - 1 AS INTEGER) AS line_no, all_lines[i] AS line
FROM (SELECT page_id, all_lines, unnest(range(1, len(all_lines) + 1)) AS i FROM basic)
""")
def d_markdown_lines(spark, sf):
    """Every emitted line of every page."""
    from ..operators.markdown import with_lines
    return with_lines(read_pages(spark, sf)).select("page_id", F.posexplode("lines").alias("line_no", "x")).select(
        "page_id", "line_no", F.col("x.value").alias("line"))


@query("d4_d6_roots", """
SELECT page_id, tag, ord AS sel_order, CAST(len(regexp_extract_all(part, '<p>')) AS BIGINT) > 0 AS has_paragraphs
FROM (SELECT page_id, 'article' AS tag, 1 AS ord, html AS part FROM pages WHERE contains(html, '<article>')
      UNION ALL SELECT page_id, 'body', 12, html FROM pages WHERE contains(html, '<body>'))
""")
def d_roots(spark, sf):
    """The candidate roots of every page, in selector order."""
    from ..operators.markdown import with_lines, with_roots
    return (with_roots(with_lines(read_pages(spark, sf))).select("page_id", F.explode("roots").alias("r"))
            .select("page_id", "r.tag", "r.sel_order", (F.col("r.p_words") > 0).alias("has_paragraphs")))


@query("d2_dropped_chrome", """
SELECT page_id, CAST(len(regexp_extract_all(html, '<nav>')) + len(regexp_extract_all(html, '<footer>'))
       + len(regexp_extract_all(html, '<style>')) + len(regexp_extract_all(html, '<script>')) AS BIGINT) AS chrome_roots,
       CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<li>')) AS BIGINT) AS dropped_items
FROM pages
""")
def d_dropped_chrome(spark, sf):
    """Chrome elements of every page, and list items beneath them."""
    from ..operators.nodes import DROP_TAGS, page_nodes
    n = page_nodes(read_pages(spark, sf)).filter("dropped and kind = 'element'")
    return n.groupBy("page_id").agg(F.count(F.when(F.col("tag").isin(*DROP_TAGS), 1)).alias("chrome_roots"),
                                    F.count(F.when(F.col("tag") == "li", 1)).alias("dropped_items"))


@query("d1_page_nodes", """
WITH t AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
             '(?s)(<script[^>]*>).*?(</script>)', '\\1\\2', 'g'), '<([A-Za-z][A-Za-z0-9]*)', 1) AS tags FROM pages)
SELECT page_id, CAST(len(tags) AS BIGINT) AS n_elements,
       CAST(len(list_filter(tags, lambda t: t = 'p')) AS BIGINT) AS n_paragraphs,
       CAST(len(list_filter(tags, lambda t: t = 'a')) AS BIGINT) AS n_links FROM t
""")
def d1_page_nodes(spark, sf):
    from ..operators.nodes import page_nodes
    count = lambda tag: F.count(F.when(F.col("tag") == tag, 1))
    return (page_nodes(read_pages(spark, sf)).groupBy("page_id")
            .agg(F.count(F.when(F.col("kind") == "element", 1)).alias("n_elements"),
                 count("p").alias("n_paragraphs"), count("a").alias("n_links")))


# --------------------------------------------------------------- C2-C7, M1-M2
# The driver's articles hold no repeated line and no boxes beside the text: all lines (C2) weigh most where they have 20 words,
# else the basic text stays.
_READABLE_SQL = f"""
lined AS (
  SELECT page_id, url, html, text AS basic, {_sql_strip("array_to_string(list_filter(all_lines, lambda x, i: list_position(all_lines, x) = i), chr(10))")} AS recall
  FROM basic),
readable AS (
  SELECT *, CASE WHEN len(list_filter(regexp_split_to_array(recall, '{WS}+'), lambda w: w <> '')) >= 20 THEN recall ELSE basic END AS text,
         CASE WHEN len(list_filter(regexp_split_to_array(recall, '{WS}+'), lambda w: w <> '')) >= 20 THEN 'recall' ELSE 'basic' END AS slot
  FROM lined)"""

@query("c1_c7_extract_readable", f"""
WITH {_ARTICLE_SQL},
{_READABLE_SQL}
SELECT page_id, url, {_TITLE_SQL} AS title, text, slot FROM readable
""")
def c_extract_readable(spark, sf):
    return extract_readable(read_pages(spark, sf))


@query("c2_recall_text", f"""
WITH {_ARTICLE_SQL}
SELECT page_id, {_sql_strip("array_to_string(list_filter(all_lines, lambda x, i: list_position(all_lines, x) = i), chr(10))")} AS recall FROM basic
""")
def c2_recall(spark, sf):
    """All lines of every page, the first of equal ones."""
    from ..operators.candidates import recall_text
    from ..operators.markdown import with_lines
    return with_lines(read_pages(spark, sf)).select("page_id", recall_text().alias("recall"))


def _meta_sql(attr: str, value: str) -> str:
    return (f"nullif(regexp_replace(regexp_replace(regexp_extract(html, "
            f"'<meta {attr}=\"{value}\" content=\"([^\"]*)\"', 1), '{WS}+', ' ', 'g'), "
            f"'^ | $', '', 'g'), '')")


_META_AUTHOR_SQL = f"coalesce({_meta_sql('name', 'author')}, {_meta_sql('property', 'article:author')})"
_META_DESCRIPTION_SQL = f"coalesce({_meta_sql('name', 'description')}, {_meta_sql('property', 'og:description')})"
_META_DATE_SQL = """strftime(TRY_CAST(left(coalesce(
      nullif(regexp_extract(html, '<meta property="article:published_time" content="([^"]*)"', 1), ''),
      nullif(trim(regexp_extract(html, '<time datetime="([^"]*)"', 1)), '')), 10) AS DATE), '%Y-%m-%d')"""


@query("m1_m2_metadata", f"""
SELECT page_id, {_META_AUTHOR_SQL} AS author, {_META_DATE_SQL} AS published_date, {_META_DESCRIPTION_SQL} AS description FROM pages
""")
def m_metadata(spark, sf):
    from ..operators.metadata import page_metadata
    return page_metadata(read_pages(spark, sf))


# --------------------------------------------------------------- U3-U5
# Fixed values, stated independently of the code under test: IPv4 blocks that are not global, and what is global in them.
_V4_STATED = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
              ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
              ("203.0.113.0", 24), ("240.0.0.0", 4))
_V4_GLOBAL_STATED = (("192.0.0.9", 32), ("192.0.0.10", 32))


def _v4_blocks_sql() -> str:
    rows = []
    for blocks, exception in ((_V4_STATED, "false"), (_V4_GLOBAL_STATED, "true")):
        for address, bits in blocks:
            low = sum(int(part) << shift for part, shift in zip(address.split("."), (24, 16, 8, 0)))
            rows.append(f"({low}, {low + 2 ** (32 - bits) - 1}, {exception})")
    return ", ".join(rows)


@query("u1_u5_host_guard", f"""
WITH blocks(lo, hi, exc) AS (VALUES {_v4_blocks_sql()}),
p AS (
  SELECT page_id,
         lower(regexp_extract(url, '{_URL_PARTS}', 1)) AS scheme,
         regexp_replace(lower(regexp_replace(regexp_replace(
           regexp_extract(url, '{_URL_PARTS}', 3), '^.*@', ''), ':.*$', '')), '\\.+$', '') AS host,
         (page_id * 2654435761) % 4294967296 AS n
  FROM pages),
dns AS (SELECT DISTINCT host, n FROM p WHERE host <> ''),
flag AS (
  SELECT d.host, d.n,
         bool_or(b.lo IS NOT NULL AND NOT b.exc) AS in_block,
         bool_or(coalesce(b.exc, false)) AS in_exc
  FROM dns d LEFT JOIN blocks b ON d.n BETWEEN b.lo AND b.hi
  GROUP BY d.host, d.n),
hv AS (SELECT host, bool_or(in_block AND NOT in_exc) AS bad FROM flag GROUP BY host)
SELECT p.page_id, p.host,
  CASE WHEN p.scheme NOT IN ('http', 'https') OR p.host = ''
         THEN 'Only public HTTP and HTTPS URLs are allowed.'
       WHEN p.host = 'localhost' OR suffix(p.host, '.local')
         THEN 'Local network addresses are not allowed.'
       WHEN hv.bad THEN 'Private, loopback, and reserved addresses are not allowed.'
  END AS unsafe_reason
FROM p LEFT JOIN hv USING (host)
""")
def u_host_guard(spark, sf):
    from ..operators.guard import guard_urls
    from ..sources import derived
    p = read_pages(spark, sf).select("page_id", "url")
    out = guard_urls(p, {"url": "unsafe_reason"}, derived.dns(p))
    return out.select("page_id", ux.guard_host("url").alias("host"), "unsafe_reason")


# Hex bounds by prefix, stated independently: IPv6 blocks that are not global, and what is global in them.
_V6_STATED = (("0" * 32, 128), ("0" * 31 + "1", 128), ("0" * 20 + "ffff", 96), ("0064ff9b0001", 48), ("0100" + "0" * 12, 64), ("20010", 23),
              ("20010db8", 32), ("2002", 16), ("fc", 7), ("fe8", 10))
_V6_GLOBAL_STATED = (("20010001" + "0" * 23 + "1", 128), ("20010001" + "0" * 23 + "2", 128), ("20010003", 32), ("200100040112", 48),
                     ("2001002", 28), ("2001003", 28))


def _v6_blocks_sql() -> str:
    rows = []
    for blocks, exception in ((_V6_STATED, "false"), (_V6_GLOBAL_STATED, "true")):
        for prefix, bits in blocks:
            low = int(prefix.ljust(32, "0"), 16)
            rows.append(f"('{low:032x}', '{low + 2 ** (128 - bits) - 1:032x}', {exception})")
    return ", ".join(rows)


#: Rules by doc_id modulo 12: the groups before ``::`` of an IPv6 address that ends in the id, or None for the IPv4 rules.
_V6_PREFIXES = {1: "2001:db8", 2: "fe80", 3: "2606:4700", 5: "fd00:1", 6: "2001:20", 7: "2001:10", 8: "2002:a00", 9: "64:ff9b:1", 10: "64:ff9b"}
_V6_HEX_SQL = " ".join(f"WHEN {r} THEN rpad('{''.join(g.rjust(4, '0') for g in p.split(':'))}', 28, '0') || printf('%04x', doc_id % 65536)"
                       for r, p in _V6_PREFIXES.items())


@query("u4_address_ranges", f"""
WITH v4(lo, hi, exc) AS (VALUES {_v4_blocks_sql()}), v6(lo, hi, exc) AS (VALUES {_v6_blocks_sql()}),
a AS (SELECT doc_id, doc_id % 12 AS r, (doc_id * 2654435761) % 4294967296 AS h FROM documents),
b AS (SELECT doc_id, CASE r WHEN 0 THEN h WHEN 4 THEN h WHEN 11 THEN 3221225472 + doc_id // 12 % 256 END AS n,
             CASE r {_V6_HEX_SQL} END AS x FROM a)
SELECT doc_id, CAST(CASE WHEN n IS NULL THEN 6 ELSE 4 END AS INTEGER) AS family,
       coalesce(bool_or(in_block) AND NOT bool_or(in_exc), false) AS non_global
FROM (SELECT doc_id, n, v4.lo IS NOT NULL AND NOT v4.exc AS in_block, coalesce(v4.exc, false) AS in_exc FROM b LEFT JOIN v4 ON n BETWEEN v4.lo AND v4.hi WHERE n IS NOT NULL
      UNION ALL
      SELECT doc_id, n, v6.lo IS NOT NULL AND NOT v6.exc, coalesce(v6.exc, false) FROM b LEFT JOIN v6 ON x BETWEEN v6.lo AND v6.hi WHERE n IS NULL)
GROUP BY doc_id, n
""")
def u4_address_ranges(spark, sf):
    """U4: an address of either family for every document, against the block table."""
    from ..operators.guard import block_table, block_verdicts, with_address_hex
    d = table(spark, sf, "documents").select("doc_id")
    h = (F.col("doc_id") * F.lit(2654435761)) % F.lit(2 ** 32)
    quad = F.concat_ws(".", *[(F.floor(h / F.lit(256 ** k)) % 256).cast("string") for k in (3, 2, 1, 0)])
    rule, end = F.col("doc_id") % 12, F.lower(F.hex(F.col("doc_id") % 65536))
    address = F.when(rule == 0, quad).when(rule == 4, F.concat(F.lit("::ffff:"), quad)).when(
        rule == 11, F.concat(F.lit("192.0.0."), F.floor(F.col("doc_id") / 12) % 256))
    for r, prefix in _V6_PREFIXES.items():
        address = address.when(rule == r, F.concat(F.lit(prefix + "::"), end))
    found = block_verdicts(with_address_hex(d.withColumn("address", address), "address"), block_table(spark))
    return found.select("doc_id", "family", "non_global")


@query("u5_redirect_guard", """
SELECT page_id, CASE WHEN length(html) % 7 = 4 THEN 'Private, loopback, and reserved addresses are not allowed.' END AS copy_unsafe
FROM pages WHERE length(html) % 7 <> 2
""")
def u5_redirect_guard(spark, sf):
    """The address of every rendered copy, guarded; page hosts count as resolved to a public address."""
    from ..operators.guard import guard_urls
    from ..sources import derived
    p = read_pages(spark, sf)
    public = p.select(ux.guard_host("url").alias("host"), F.lit("93.184.216.34").alias("address"))
    copies = derived.rendered_pages(p).select("page_id", "url")
    return guard_urls(copies, {"url": "copy_unsafe"}, public).select("page_id", "copy_unsafe")


# --------------------------------------------------------------- S3, S4
@query("s3_decoded_bodies", """
WITH p AS (SELECT page_id, html, length(html) % 5 AS r FROM pages)
SELECT page_id, CAST(CASE WHEN r = 1 THEN NULL ELSE octet_length(encode(html)) + 1 END AS BIGINT) AS utf8_bytes,
       CASE WHEN r = 2 THEN NULL WHEN r = 1 THEN html ELSE html || chr(65533) END AS html
FROM p
""")
def s3_decoded_bodies(spark, sf):
    """S3: bodies in several charsets and with bad bytes; one-byte text is compared by its bytes only."""
    from ..sources import derived
    from ..sources.tables import decoded_pages
    p = derived.page_bodies(read_pages(spark, sf)).withColumn("rule", F.col("charset"))
    d = decoded_pages(p)
    return d.select("page_id", F.when(~F.col("rule").eqNullSafe("utf-16"), F.col("n_bytes")).alias("utf8_bytes"),
                    F.when(~F.col("rule").eqNullSafe("windows-1252"), F.col("html")).alias("html"))


@query("s4_rendered_copies", """
SELECT page_id, CASE WHEN length(html) % 7 = 4 THEN 'http://10.0.0.5/copy' ELSE url END AS url,
       CAST(CASE WHEN length(html) % 7 = 3 THEN NULL WHEN length(html) % 7 >= 5 THEN length(html) + 1246 ELSE length(html) END AS BIGINT) AS chars,
       CASE WHEN length(html) % 7 = 3 THEN 'Headless browser rendering timed out.' END AS render_error
FROM pages WHERE length(html) % 7 <> 2
""")
def s4_rendered_copies(spark, sf):
    """The renderer's table, written and scanned with its schema."""
    from ..session import run_folder
    from ..sources import derived
    from ..sources.tables import rendered_pages
    path = run_folder(spark, "rendered")
    derived.rendered_pages(read_pages(spark, sf)).write.parquet(path)
    return rendered_pages(spark, path).select("page_id", "url", F.length("html").cast("long").alias("chars"), "render_error")


# --------------------------------------------------------------- R2-R7, A1, A2
# Stated once more, independently of the code that derives the tables.
_SHELL_SQL = """'<html><head></head><body><div id="root"></div><script src="/app.js"></script></body></html>'"""
_MORE_SQL = "array_to_string(list_transform(range(150), lambda i: 'more' || i || '.'), ' ')"


def _flow_sql(fail: str, long: str, copy: str) -> str:
    """The relation ``flow``: what becomes of each page.  ``fail`` is its fetch error, ``long`` whether its instructions are too
    long, ``copy`` the rule of its rendered copy, all in terms of ``n``, the length of the markup, and ``page_id``."""
    return f"""
WITH blocks(lo, hi, exc) AS (VALUES {_v4_blocks_sql()}),
{_ARTICLE_SQL},
{_READABLE_SQL},
hosts AS (
  SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '{_URL_PARTS}', 3), '^.*@', ''), ':.*$', '')), '\\.+$', '') AS host,
         (page_id * 2654435761) % 4294967296 AS a FROM pages),
bad AS (SELECT DISTINCT host FROM hosts JOIN blocks b ON a BETWEEN b.lo AND b.hi WHERE NOT b.exc),
forms AS (
  SELECT page_id, 'own' AS form, CASE WHEN length(html) % 17 < 3 THEN '' ELSE text END AS text FROM readable
  UNION ALL
  SELECT page_id, 'copy', CASE WHEN length(html) % 7 >= 5 THEN array_to_string(list_filter([recall, {_MORE_SQL}], lambda x: x <> ''), chr(10)) ELSE text END FROM readable),
{_quality_sql('forms', 'page_id, form')},
given AS (
  SELECT page_id, url, html AS page, length(html) AS n, CASE WHEN length(html) % 17 < 3 THEN {_SHELL_SQL} ELSE html END AS html FROM pages),
rules AS (
  SELECT page_id, url, page, {fail} AS fail, {long} AS long, {copy} AS copy, ({_MARKER_SQL}) AS marker, length(html) AS chars,
         (length(lower(html)) - length(replace(lower(html), '<script', ''))) // 7 AS scripts FROM given),
sides AS (
  SELECT r.*, o.text AS own, c.text AS other, o.q AS own_q, c.q AS other_q, h.host IN (SELECT host FROM bad) AS unsafe,
         o.n_words < 180 OR (marker AND o.n_words < 400) OR (scripts >= 8 AND o.n_words < 250)
           OR (chars > 20000 AND length(o.text)::DOUBLE / chars < 0.015 AND o.n_words < 350) AS needs,
         CASE copy WHEN 4 THEN 'Private, loopback, and reserved addresses are not allowed.' WHEN 2 THEN 'No rendered copy is available.'
                   WHEN 3 THEN 'Headless browser rendering timed out.' END AS copy_error
  FROM rules r JOIN scored o ON o.page_id = r.page_id AND o.form = 'own' JOIN scored c ON c.page_id = r.page_id AND c.form = 'copy'
       JOIN hosts h ON h.page_id = r.page_id),
wishes AS (SELECT *, NOT unsafe AND (fail IS NOT NULL OR needs) AS wants FROM sides),
choices AS (SELECT *, wants AND copy_error IS NULL AND (fail IS NOT NULL OR other_q > 1.08 * own_q) AS browser FROM wishes),
errors AS (
  SELECT *, CASE WHEN unsafe THEN 'Private, loopback, and reserved addresses are not allowed.'
                 WHEN fail IS NOT NULL AND NOT browser THEN copy_error
                 WHEN wants AND copy_error IS NOT NULL AND own = '' THEN copy_error
                 WHEN CASE WHEN browser THEN other ELSE own END = '' THEN 'No readable content was found on this page.' END AS error
  FROM choices),
flow AS (
  SELECT page_id, url, page AS html, CASE WHEN browser THEN other ELSE own END AS text, CASE WHEN browser THEN 'browser' ELSE 'http' END AS method,
         CASE WHEN long THEN 422 WHEN unsafe OR (error IS NOT NULL AND wants AND copy = 4) THEN 400 WHEN error IS NOT NULL THEN 502 END AS status,
         CASE WHEN long THEN 'instructions: longer than 2000 characters' WHEN unsafe OR (wants AND copy = 4) THEN 'Private, loopback, and reserved addresses are not allowed.'
              ELSE 'Could not process page: ' || error END AS detail,
         CASE WHEN fail IS NOT NULL THEN 'Direct download failed, so the browser renderer was used: ' || fail
              WHEN wants AND copy_error IS NOT NULL THEN 'Browser enhancement failed, so the direct HTML extraction was retained: ' || copy_error END AS page_warning
  FROM errors)"""


_BATCH_FLOW_SQL = _flow_sql("CASE WHEN n % 11 = 0 THEN 'HTTP 503' WHEN n % 11 = 1 THEN 'The URL did not return an HTML page.' END", "n % 13 = 0", "n % 7")


def _scrape(spark, sf):
    from ..sources import derived
    from .pipeline import scrape
    p = read_pages(spark, sf)
    return scrape(spark, derived.fetched_pages(p), derived.rendered_pages(p), derived.dns(p), requests=derived.requests(p))


@query("p_full_pipeline", f"""
{_BATCH_FLOW_SQL}
SELECT page_id, url, {_TITLE_SQL} AS title, method, text AS raw_text, text AS cleaned_text, false AS llm_used, {_META_AUTHOR_SQL} AS author,
       {_META_DATE_SQL} AS published_date, {_META_DESCRIPTION_SQL} AS description,
       concat_ws(' ', page_warning, 'LLM cleanup is not configured, so the extracted text is shown without LLM cleanup.') AS warning
FROM flow WHERE status IS NULL
""")
def p_full_pipeline(spark, sf):
    """A1: review items of every page that passes (guard, fetch, render, clean)."""
    return _scrape(spark, sf).items


@query("r7_rejected", f"{_BATCH_FLOW_SQL} SELECT page_id, url, status, detail FROM flow WHERE status IS NOT NULL")
def r7_rejected(spark, sf):
    return _scrape(spark, sf).rejected


@query("r2_needs_render", f"""
WITH {_ARTICLE_SQL},
{_READABLE_SQL},
n AS (SELECT page_id, html, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS words, ({_MARKER_SQL}) AS marker,
             (length(lower(html)) - length(replace(lower(html), '<script', ''))) // 7 AS scripts FROM readable)
SELECT page_id, CAST(words AS BIGINT) AS visible_words, words < 180 OR (marker AND words < 400) OR (scripts >= 8 AND words < 250)
         OR (length(html) > 20000 AND chars::DOUBLE / length(html) < 0.015 AND words < 350) AS needs_render FROM n
""")
def r2_needs_render(spark, sf):
    from ..operators.candidates import readable
    from ..operators.render import needs_render
    p = read_pages(spark, sf).select("*", *[c.alias(n) for n, c in shell_features("html").items()])
    return readable(p).select(
        "page_id", tx.word_count("text").cast("long").alias("visible_words"),
        needs_render(F.col("text"), F.col("has_marker"), F.col("script_count"),
                     F.col("html_chars")).alias("needs_render"))


@query("r2_render_rule", f"""
SELECT c.conv_id, c.turn, len(list_filter(regexp_split_to_array(c.text, '{WS}+'), lambda w: w <> '')) < 180 AS needs_render
FROM conversations c
""")
def r2_render_rule(spark, sf):
    """R2 of every turn's text as if it were the text of a plain page of 20,000 characters."""
    from ..operators.render import needs_render
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", needs_render(F.col("text"), F.lit(False), F.lit(0), F.lit(20_000)).alias("needs_render"))


# --------------------------------------------------------------- L1-L5
_SMALL_PARTS = 60


@query("l1_text_parts", r"""
WITH d AS (SELECT doc_id AS page_id, CASE WHEN length(text) <= 60 THEN [text]
                  ELSE regexp_extract_all(text, '(?s)(?:.{30,59}\n|.{1,60})') END AS parts FROM documents)
SELECT page_id, CAST(i - 1 AS INTEGER) AS part, parts[i] AS text
FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)
""")
def l1_text_parts(spark, sf):
    """L1: every document in parts of at most 60 characters."""
    from dataclasses import replace

    from ..config import DEFAULT
    from ..operators.cleanup import parts
    d = table(spark, sf, "documents")
    own = parts(F.col("text"), replace(DEFAULT, max_llm_input_chars=_SMALL_PARTS))
    return d.select(F.col("doc_id").alias("page_id"), F.posexplode(own).alias("part", "text"))


@query("l2_cleanup_requests", r"""
WITH d AS (SELECT doc_id AS page_id, lang, CASE WHEN length(text) <= 60 THEN [text]
                  ELSE regexp_extract_all(text, '(?s)(?:.{30,59}\n|.{1,60})') END AS parts FROM documents)
SELECT page_id, CAST(i - 1 AS INTEGER) AS part, CAST(len(parts) AS INTEGER) AS n_parts, 'llama-3.1-8b-instant' AS model, CAST(0.1 AS DOUBLE) AS temperature,
       'system,user' AS roles, 'User instructions:' || chr(10) || CASE WHEN lang = 'en' THEN 'Keep prices.' ELSE
         'Extract the useful information and remove navigation, ads, and repeated boilerplate.' END
         || chr(10) || chr(10) || 'Extracted page:' || chr(10) || parts[i] AS prompt
FROM (SELECT page_id, lang, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)
""")
def l2_cleanup_requests(spark, sf):
    """L2: one request per part of every document, read back from its JSON."""
    from dataclasses import replace

    from ..config import DEFAULT
    from ..operators.cleanup import cleanup_requests
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("raw_text"),
                                             F.when(F.col("lang") == "en", F.lit("Keep prices.")).alias("instructions"))
    r = cleanup_requests(d, replace(DEFAULT, max_llm_input_chars=_SMALL_PARTS), instructions="instructions")
    body = F.from_json("request", "model string, temperature double, messages array<struct<role:string,content:string>>")
    return r.withColumn("b", body).select(
        "page_id", "part", "n_parts", "b.model", "b.temperature", F.array_join(F.col("b.messages.role"), ",").alias("roles"),
        F.get(F.col("b.messages.content"), F.lit(1)).alias("prompt"))


@query("l3_l4_merge_replies", f"""
WITH t AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
a AS (SELECT conv_id, turn, text AS raw_text, CASE WHEN next_role = 'assistant' THEN next_text END AS reply FROM t WHERE role = 'user')
SELECT conv_id, turn,
  CASE WHEN reply IS NULL THEN raw_text ELSE coalesce(nullif({_sql_strip('reply')}, ''), raw_text) END AS cleaned_text,
  reply IS NOT NULL AS llm_used,
  CASE WHEN reply IS NULL THEN 'LLM cleanup failed; showing extracted text instead: no reply' END AS llm_warning
FROM a
""")
def l3_l4_merge_replies(spark, sf):
    """L3/L4: every user turn with the reply after it, of any length in one part."""
    from dataclasses import replace

    from ..config import DEFAULT
    from ..operators.cleanup import merge_cleanup
    from ..sources import derived
    ex = derived.conversation_exchanges(table(spark, sf, "conversations"))
    cfg = replace(DEFAULT, llm_api_key="configured", max_llm_input_chars=2 ** 30)
    items = ex.select("page_id", "conv_id", "turn", "raw_text")
    return merge_cleanup(items, ex.select("page_id", "body", "error"), cfg).select(
        "conv_id", "turn", "cleaned_text", "llm_used", "llm_warning")


@query("l5_pass_through", """
SELECT doc_id AS page_id, text AS cleaned_text, false AS llm_used,
       'LLM cleanup is not configured, so the extracted text is shown without LLM cleanup.' AS llm_warning FROM documents
""")
def l5_pass_through(spark, sf):
    from ..operators.cleanup import merge_cleanup
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("raw_text"))
    return merge_cleanup(d, None).select("page_id", "cleaned_text", "llm_used", "llm_warning")


@query("a2_merged_warnings", """
SELECT doc_id AS page_id, nullif(concat_ws(' ', CASE WHEN n_chars < 500 THEN 'Short text.' END,
       CASE WHEN lang <> 'en' THEN 'Not in English.' END), '') AS warning FROM documents
""")
def a2_merged_warnings(spark, sf):
    from ..operators.review import merge_warnings
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("page_id"), merge_warnings(
        F.when(F.col("n_chars") < 500, F.lit("Short text.")).otherwise(F.lit("")),
        F.when(F.col("lang") != "en", F.lit("Not in English."))).alias("warning"))


# --------------------------------------------------------------- A3-A7
_APPROVAL_SQL = f"""
WITH a AS (
  SELECT 'https://docs.example.org/' || CAST(doc_id AS VARCHAR) AS url,
         split_part(text, chr(10), 1) AS title, text AS content FROM documents)
SELECT url,
  CASE WHEN length(title) > 500 THEN 'title: longer than 500 characters'
       WHEN content IS NULL OR length(content) < 1 THEN 'content: empty'
       WHEN length(content) > 200000 THEN 'content: longer than 200000 characters'
       WHEN {_sql_strip('content')} = '' THEN 'content: blank' END AS reject_reason,
  coalesce(nullif({_sql_strip('title')}, ''), 'Untitled page') AS approved_title,
  {_sql_strip('content')} AS approved_content
FROM a
"""


@query("a3_a4_approve", _APPROVAL_SQL)
def a3_a4_approve(spark, sf):
    from ..operators.review import validate_approvals
    d = table(spark, sf, "documents")
    a = d.select(F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string"))
                 .alias("url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                 F.col("text").alias("content"))
    v = validate_approvals(a)
    return v.select("url", "reject_reason",
                    F.coalesce(F.nullif(tx.py_strip("title"), F.lit("")), F.lit("Untitled page"))
                    .alias("approved_title"),
                    tx.py_strip("content").alias("approved_content"))


_GATE_SQL = f"""
WITH a AS (
  SELECT p.page_id, p.url, d.text, d.lang, d.doc_id, split_part(d.text, chr(10), 1) AS title
  FROM pages p JOIN documents d ON d.doc_id % (SELECT max(page_id) + 1 FROM pages) = p.page_id),
v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id DESC) AS nth FROM a
      WHERE length(title) <= 500 AND length(text) BETWEEN 1 AND 200000 AND {_sql_strip('text')} <> '' AND lang <> 'en')
SELECT p.page_id, p.url, CASE WHEN v.url IS NULL THEN 'pending' ELSE 'approved' END AS status,
       CASE WHEN v.url IS NOT NULL THEN coalesce(nullif({_sql_strip('v.title')}, ''), 'Untitled page') END AS approved_title,
       {_sql_strip('v.text')} AS approved_content
FROM pages p LEFT JOIN (SELECT * FROM v WHERE nth = 1) v ON p.url = v.url
"""


@query("a5_approval_gate", _GATE_SQL)
def a5_approval_gate(spark, sf):
    """A5: pages against approvals made of documents, several or none for a page; the latest valid one counts."""
    from ..operators.review import approval_gate
    p = read_pages(spark, sf).select("page_id", "url")
    n = p.agg(F.max("page_id") + 1).first()[0]
    d = table(spark, sf, "documents").filter("lang != 'en'")
    a = d.select((F.col("doc_id") % n).alias("page_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                 F.col("text").alias("content"), F.timestamp_seconds("doc_id").alias("approved_at"))
    approved, pending = approval_gate(p, a.join(p, "page_id").drop("page_id"))
    done = approved.select("page_id", "url", F.lit("approved").alias("status"), "approved_title", "approved_content")
    none = F.lit(None).cast("string")
    return done.unionByName(pending.select("page_id", "url", F.lit("pending").alias("status"), none.alias("approved_title"), none.alias("approved_content")))


@query("a7_byline", f"""
SELECT page_id, concat_ws(' \u00b7 ', coalesce({_meta_sql('name', 'author')}, {_meta_sql('property', 'article:author')}),
  strftime(TRY_CAST(left(coalesce(
      nullif(regexp_extract(html, '<meta property="article:published_time" content="([^"]*)"', 1), ''),
      nullif(trim(regexp_extract(html, '<time datetime="([^"]*)"', 1)), '')), 10) AS DATE), '%Y-%m-%d')) AS byline
FROM pages
""")
def a7_byline(spark, sf):
    from ..operators.metadata import page_metadata
    from ..operators.review import byline
    return page_metadata(read_pages(spark, sf)).select("page_id", byline(F.col("author"), F.col("published_date")).alias("byline"))


# --------------------------------------------------------------- K1-K3
_SPANS_SQL = r"'`([^`]+)`|!\[([^\]]*)\]\(([^)\s]+)\)|\[([^\]]*)\]\(([^)\s]+)\)|\*\*([^*]+)\*\*|\*([^*]+)\*'"


# The articles' lines are headings and paragraphs; paragraphs side by side are one block.
@query("k1_k3_markdown_blocks", rf"""
WITH {_ARTICLE_SQL},
{_READABLE_SQL},
l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM readable),
c AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s') AS heading,
             len(regexp_extract_all(CASE WHEN regexp_matches(line, '^#{{1,6}}\s') THEN regexp_replace(line, '^#{{1,6}}\s+', '') ELSE line END, {_SPANS_SQL})) AS spans FROM l),
f AS (SELECT *, heading OR coalesce(lag(heading) OVER (PARTITION BY page_id ORDER BY ln), true) AS fresh FROM c),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY page_id ORDER BY ln) AS block FROM f)
SELECT page_id, CAST(block AS INTEGER) AS block, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind, CAST(min(ln) AS INTEGER) AS first_ln, count(*) AS n_lines,
       CASE WHEN heading THEN 1 END AS level, CAST(sum(spans) AS BIGINT) AS n_spans, CAST(0 AS BIGINT) AS n_blocked_links
FROM g GROUP BY page_id, block, heading
""")
def k_markdown_blocks(spark, sf):
    """Blocks of the extracted Markdown of every page, with span counts."""
    from ..operators.mdtables import markdown_blocks
    ex = extract_readable(read_pages(spark, sf)).select("page_id", F.col("text").alias("markdown"))
    return markdown_blocks(ex)


@query("k3_inline_spans", r"""
WITH l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents),
s AS (SELECT page_id, ln, regexp_extract_all(line, '`([^`]+)`|!\[([^\]]*)\]\(([^)\s]+)\)|\[([^\]]*)\]\(([^)\s]+)\)|\*\*([^*]+)\*\*|\*([^*]+)\*') AS spans
      FROM l WHERE NOT regexp_matches(line, '^\s*\|') AND NOT regexp_matches(line, '^\s*```') AND NOT regexp_matches(line, '^\s*([-*]|[0-9]+\.)\s')
        AND NOT regexp_matches(line, '^#{1,6}\s') AND NOT starts_with(line, '>'))
SELECT page_id, CAST(ln AS INTEGER) AS ln, CAST(i - 1 AS INTEGER) AS pos, spans[i] AS span
FROM (SELECT page_id, ln, spans, unnest(range(1, len(spans) + 1)) AS i FROM s)
""")
def k3_inline_spans(spark, sf):
    """K3 on the paragraph lines of every document."""
    from ..operators.mdtables import inline_spans, markdown_lines
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("markdown"))
    lines = markdown_lines(d).filter("cls = 'paragraph'")
    mark = F.when(F.col("kind") == "code", F.concat(F.lit("`"), "label", F.lit("`"))).when(
        F.col("kind") == "bold", F.concat(F.lit("**"), "label", F.lit("**"))).when(
        F.col("kind") == "italic", F.concat(F.lit("*"), "label", F.lit("*"))).when(
        F.col("kind") == "image", F.concat(F.lit("!["), "label", F.lit("]("), "target", F.lit(")"))).otherwise(
        F.concat(F.lit("["), "label", F.lit("]("), "target", F.lit(")")))
    return inline_spans(lines).select("page_id", "ln", "pos", mark.alias("span"))


_K_TRIM = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


@query("k1_line_classes", rf"""
WITH l AS (
  SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln
  FROM documents),
a AS (
  SELECT *, regexp_matches(line, '^\s*```') AS is_fence,
         starts_with({_K_TRIM}, '|') AS pipe,
         coalesce(regexp_matches(lead(line) OVER (PARTITION BY page_id ORDER BY ln),
                                 '^\s*\|?\s*:?-{{2,}}'), false) AS next_rule
  FROM l),
b AS (
  SELECT *, coalesce(sum(is_fence::INT) OVER (PARTITION BY page_id ORDER BY ln
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences_before
  FROM a),
c AS (
  SELECT *, fences_before % 2 = 1 AS in_code,
         (fences_before % 2 = 0) AND NOT is_fence AND pipe AND next_rule AS table_head
  FROM b),
d AS (
  SELECT *, coalesce(lag(table_head) OVER (PARTITION BY page_id ORDER BY ln), false) AS after_head
  FROM c),
e AS (
  SELECT *, sum((NOT pipe AND NOT after_head)::INT) OVER (PARTITION BY page_id ORDER BY ln
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pipe_run
  FROM d),
f AS (
  SELECT *, max(table_head::INT) OVER (PARTITION BY page_id, pipe_run ORDER BY ln
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS in_table
  FROM e)
SELECT page_id, CAST(ln AS INTEGER) AS ln,
  CASE WHEN is_fence THEN CASE WHEN in_code THEN 'fence_close' ELSE 'fence_open' END
       WHEN in_code THEN 'code'
       WHEN {_K_TRIM} = '' THEN 'blank'
       WHEN regexp_matches(line, '^(#{{1,6}})\s+(.*)$') THEN 'heading'
       WHEN table_head THEN 'table_head'
       WHEN after_head THEN 'table_rule'
       WHEN in_table AND pipe THEN 'table_row'
       WHEN starts_with(line, '>') THEN 'quote'
       WHEN regexp_matches(line, '^(\s*)([-*]|\d+\.)\s+(.*)$') THEN 'list'
       ELSE 'paragraph' END AS cls
FROM f
""")
def k1_line_classes(spark, sf):
    from ..operators.mdtables import markdown_lines
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"),
                                             F.col("text").alias("markdown"))
    return markdown_lines(d).select("page_id", "ln", "cls")


# --------------------------------------------------------------- T1, T2
def _after(time, interval: str):
    return time + F.expr(f"INTERVAL {interval}")


def _drained(start, add_late) -> None:
    """Run a stream over what is there, then over rows far later, so that every time bound passes."""
    start().awaitTermination()
    add_late()
    for _ in range(2):  # one run sees the late rows, the next one the watermark they have moved
        start().awaitTermination()


@query("t1_stream_scrape", f"""
{_flow_sql("CAST(NULL AS VARCHAR)", "false", "CASE WHEN page_id % 5 = 0 THEN 2 ELSE n % 7 END")}
SELECT page_id, coalesce(status, 200) AS status, CASE WHEN status IS NULL THEN method END AS method, CASE WHEN status IS NULL THEN text END AS text FROM flow
""")
def t1_stream_scrape(spark, sf):
    """The flow as a stream: pages arrive first, their copies and addresses with the next files.  Copies come 30 minutes
    after the page; those of every fifth page only after the wait of one hour.  Far later rows let all bounds pass."""
    from ..sources import derived
    from ..streaming.incremental import scratch, stream_scrape
    p = read_pages(spark, sf)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    fetched = derived.fetched_pages(p).select("page_id", "url", "html", at.alias("fetched_at"))
    late = F.col("page_id") % 5 == 0
    rendered_at = F.when(late, _after(at, "90 MINUTES")).otherwise(_after(at, "30 MINUTES"))
    copy = F.struct("html", "render_error", rendered_at.alias("rendered_at"))
    # an earlier copy that the later one replaces
    first = F.struct(F.lit(None).cast("string").alias("html"), F.lit("superseded").alias("render_error"), _after(at, "10 MINUTES").alias("rendered_at"))
    both = F.when(~late & (F.col("page_id") % 5 == 1), F.array(first, copy)).otherwise(F.array(copy))
    copies = derived.rendered_pages(p).select("page_id", "url", F.explode(both).alias("copy")).select("page_id", "url", "copy.*")
    names = derived.dns(p.withColumn("resolved_at", _after(at, "5 MINUTES")), "resolved_at")
    pages_dir, copies_dir, dns_dir, out, ckpt = (scratch(spark, f"t1-{name}") for name in ("pages", "copies", "dns", "out", "ckpt"))
    fetched.write.option("compression", "zstd").parquet(pages_dir)
    for path, df in ((copies_dir, copies), (dns_dir, names)):
        df.limit(0).write.parquet(path)

    def start():
        return stream_scrape(spark, pages_dir, copies_dir, dns_dir, out, ckpt)

    start().awaitTermination()  # a batch with pages alone
    for path, df in ((copies_dir, copies), (dns_dir, names)):
        df.write.option("compression", "zstd").mode("append").parquet(path)

    def add_late():
        end = fetched.agg(_after(F.max("fetched_at"), "30 DAYS").alias("t"))
        none = F.lit(None).cast("string")
        late_id = F.lit(-1).cast("long").alias("page_id")
        end.select(late_id, F.lit("https://late.example.org/").alias("url"), none.alias("html"), F.col("t").alias("fetched_at")).write.mode("append").parquet(pages_dir)
        end.select(late_id, none.alias("url"), none.alias("html"), none.alias("render_error"), F.col("t").alias("rendered_at")).write.mode("append").parquet(copies_dir)
        end.select(F.lit("late.example.org").alias("host"), F.lit("93.184.216.34").alias("address"), F.col("t").alias("resolved_at")).write.mode("append").parquet(dns_dir)

    _drained(start, add_late)
    items, rejected = (spark.read.parquet(f"{out}/{name}") for name in ("items", "rejected"))
    none = F.lit(None).cast("string")
    return items.select("page_id", F.lit(200).alias("status"), "method", F.col("cleaned_text").alias("text")).unionByName(
        rejected.select("page_id", "status", none.alias("method"), none.alias("text"))).filter("page_id >= 0")


@query("t2_approval_join", f"""
WITH d AS (SELECT doc_id, lang, {_sql_strip('text')} AS own,
                  lang = 'en' OR length(split_part(text, chr(10), 1)) > 500 OR {_sql_strip('text')} = '' AS pending FROM documents)
SELECT doc_id AS page_id, CASE WHEN pending THEN 'pending' ELSE 'approved' END AS status,
       CASE WHEN NOT pending THEN CASE WHEN lang = 'de' THEN 'Corrected. ' || own ELSE own END END AS content
FROM d
""")
def t2_approval_join(spark, sf):
    """Documents as items; those that are not in English get an approval half an hour later.  German ones get a corrected
    one an hour after that, which counts; Spanish ones a blank one, and all others one after the bound, which don't.
    A last item and approval, far later, let the time bounds of all others pass."""
    from ..streaming.incremental import approval_stream_join, scratch
    d = table(spark, sf, "documents")
    url = F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    items = d.select(F.col("doc_id").alias("page_id"), url.alias("url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                     F.col("text").alias("cleaned_text"), at.alias("extracted_at"), "lang")
    first = items.filter("lang != 'en'").select("url", "title", F.col("cleaned_text").alias("content"), _after(F.col("extracted_at"), "30 MINUTES").alias("approved_at"), "lang")
    said = (F.when(F.col("lang") == "de", F.when(tx.py_strip("content") != "", F.concat(F.lit("Corrected. "), tx.py_strip("content"))).otherwise(F.col("content")))
            .when(F.col("lang") == "es", F.lit(" ")).otherwise(F.concat(F.lit("Too late. "), "content")))
    when = F.when(F.col("lang").isin("de", "es"), _after(F.col("approved_at"), "1 HOUR")).otherwise(_after(F.col("approved_at"), "2 DAYS"))
    again = first.withColumn("content", said).withColumn("approved_at", when)
    items_dir, approvals_dir, out, ckpt = (scratch(spark, f"t2-{name}") for name in ("items", "approvals", "out", "ckpt"))
    items.drop("lang").write.parquet(items_dir)
    first.unionByName(again).drop("lang").write.parquet(approvals_dir)

    def add_late():
        late = items.agg(_after(F.max("extracted_at"), "30 DAYS").alias("t"))
        late.select(F.lit(-1).cast("long").alias("page_id"), F.lit("https://late.example.org/").alias("url"), F.lit("").alias("title"),
                    F.lit("late").alias("cleaned_text"), F.col("t").alias("extracted_at")).write.mode("append").parquet(items_dir)
        late.select(F.lit("https://late.example.org/").alias("url"), F.lit("").alias("title"), F.lit("late").alias("content"),
                    F.col("t").alias("approved_at")).write.mode("append").parquet(approvals_dir)

    _drained(lambda: approval_stream_join(spark, items_dir, approvals_dir, out, ckpt), add_late)
    return spark.read.parquet(out).filter("page_id >= 0").select("page_id", "status", "content")


# --------------------------------------------------------------- U6, S5, S6
@query("u6_resolve_links", rf"""
WITH a AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href
  FROM pages)
SELECT page_id, href,
  CASE WHEN href LIKE '/%' AND href NOT LIKE '//%'
       THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || href END AS resolved,
  CAST(count(*) AS BIGINT) AS n
FROM a GROUP BY ALL
""")
def u6_resolve_links(spark, sf):
    """Every link target of every page resolved against the page URL."""
    from ..operators.nodes import page_nodes
    p = read_pages(spark, sf)
    links = (page_nodes(p).filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
             .select("page_id", F.col("attrs")["href"].alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n")))
    links = links.join(p.select("page_id", "url"), "page_id")
    return ux.with_resolved_url(links, "href", "url", "resolved").select("page_id", "href", "resolved", "n")


@query("u7_safe_links", r"""
WITH t AS (SELECT doc_id, lang || ':' || source AS target FROM documents UNION ALL SELECT page_id, url FROM pages)
SELECT doc_id, target, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:')
  AND lower(split_part(target, ':', 1)) NOT IN ('http', 'https', 'mailto', 'tel') THEN '#' ELSE target END AS safe FROM t
""")
def u7_safe_links(spark, sf):
    """U7 on every page URL and on a target with another scheme for every document."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit(":"), "source").alias("target"))
    t = d.unionByName(read_pages(spark, sf).select(F.col("page_id").alias("doc_id"), F.col("url").alias("target")))
    return t.select("doc_id", "target", ux.safe_link("target").alias("safe"))


@query("s5_s6_sinks", f"""
WITH a AS (SELECT 'https://docs.example.org/' || CAST(doc_id AS VARCHAR) AS url, split_part(text, chr(10), 1) AS title, text FROM documents)
SELECT url, 'approved' AS status, coalesce(nullif({_sql_strip('title')}, ''), 'Untitled page') AS title, {_sql_strip('text')} AS content
FROM a WHERE length(title) <= 500 AND length(text) BETWEEN 1 AND 200000 AND {_sql_strip('text')} <> ''
""")
def s5_s6_sinks(spark, sf):
    """Documents as review items and as approved items, written and read back."""
    from ..operators.review import approve
    from ..sources.sinks import write_approved, write_review_items
    from ..streaming.incremental import scratch
    none = F.lit(None).cast("string")
    items = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.lit("http").alias("method"), F.col("text").alias("raw_text"),
        F.col("text").alias("cleaned_text"), F.lit(False).alias("llm_used"), none.alias("author"), none.alias("published_date"),
        none.alias("description"), none.alias("warning"))
    items_dir, approved_dir = scratch(spark, "s5-items"), scratch(spark, "s6-approved")
    write_review_items(items, items_dir)
    stored = spark.read.parquet(items_dir)
    write_approved(approve(stored.select("url", "title", F.col("cleaned_text").alias("content"))), approved_dir)
    return spark.read.parquet(approved_dir)


from . import composed  # noqa: E402,F401  registers the queries over composed pages
