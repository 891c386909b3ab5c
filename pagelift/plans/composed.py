"""Queries over composed pages: one page per document, whose markup is put together from the document's words.

The driver's pages hold headings and paragraphs; these hold what else a page may:
links, images, emphasis, lists, code, quotes, tables, side columns, metadata,
shells.  Each query builds its pages from every document by rules on ``doc_id``
and extracts them; its SQL states what must come out from the same words and
rules, without looking at markup.  ``a`` to ``e`` are a document's first words
of ASCII letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.candidates import readable
from ..operators.markdown import with_lines, with_roots
from ..operators.metadata import page_metadata
from ..operators.render import needs_render, shell_features
from ..operators.review import byline
from ..sources.tables import table
from .queries import _MARKERS_STATED, _quality_sql, _sql_strip, query

URL = "https://docs.example.org/a/b?x=1"
_LETTERS = "abcde"
_FIRST = rf"^(?:[^A-Za-z]*+[A-Za-z]++){{0,{len(_LETTERS)}}}"  # a text up to the last of its first words: most pages read no more
_WORDS_SQL = f"""
w AS (SELECT doc_id AS page_id, lang, source, text AS whole, regexp_extract_all(text, '[A-Za-z]+') AS ws, {", ".join(
    f"coalesce(regexp_extract_all(text, '[A-Za-z]+')[{k + 1}], 'none{k}') AS {x}" for k, x in enumerate(_LETTERS))} FROM documents)"""


def _words(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "lang", "source", F.col("text").alias("whole"),
                                             F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("ws"),
                                             F.regexp_extract_all(F.regexp_extract("text", _FIRST, 0), F.lit("[A-Za-z]+"), 0).alias("first"))
    return d.select("*", F.lit(URL).alias("url"), *(F.coalesce(F.get("first", F.lit(k)), F.lit(f"none{k}")).alias(x) for k, x in enumerate(_LETTERS))).drop("first")


def _filled(template: str, **more: Column) -> Column:
    """A template with ``{a}`` for columns."""
    parts, columns = [], {**{x: F.col(x) for x in _LETTERS}, "id": F.col("page_id").cast("string"), **more}
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(columns[piece] if k % 2 else F.lit(piece))
    return F.concat(*parts)


def _chosen(rule: Column, *choices: str) -> Column:
    out = F.lit(choices[-1]) if "{" not in choices[-1] else _filled(choices[-1])
    for k, choice in reversed(list(enumerate(choices[:-1]))):
        out = F.when(rule == k, _filled(choice)).otherwise(out)
    return out


def _lines_of(pages: DataFrame) -> DataFrame:
    """The lines that the article's Markdown holds, repeats dropped."""
    found = with_roots(with_lines(pages.select("page_id", "url", F.concat(F.lit("<html><body><article>"), "html", F.lit("</article></body></html>")).alias("html"))))
    own = F.filter("roots", lambda r: r["tag"] == "article")[0]["markdown"]
    return found.select("page_id", F.posexplode(F.split(own, "\n")).alias("line_no", "line")).filter("line != '' or line_no > 0")


def _lines_sql(lines: str, more: str = "") -> str:
    """``lines`` is a list of the lines, null for none; a line equal to the one before goes."""
    return f"""
WITH {_WORDS_SQL}{more},
x AS (SELECT page_id, list_filter({lines}, lambda v: v IS NOT NULL) AS ls FROM w),
y AS (SELECT page_id, string_split(array_to_string(list_filter(ls, lambda v, i: i = 1 OR v <> ls[greatest(i - 1, 1)]), chr(10)), chr(10)) AS ls FROM x)
SELECT page_id, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line FROM (SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM y)
"""


# --------------------------------------------------------------- S1, D2, D4-D6
@query("s1_json_pages", """
SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars, md5(html) AS digest FROM pages
""")
def s1_json_pages(spark, sf):
    """The pages written as JSON lines and scanned with their schema."""
    from ..session import run_folder
    from ..sources.tables import pages, pages_json
    path = run_folder(spark, "s1-json")
    pages(spark, sf).write.json(path)
    return pages_json(spark, path).select("page_id", "url", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("digest"))


# The tags that are chrome, and what selects a root, in order.
_CHROME = ("script", "style", "noscript", "svg", "canvas", "iframe", "nav", "footer", "header", "form", "button", "aside")
_ROOTS = ("main", "article", "role=main", "id=content", "id=main-content", "class=content", "class=main-content", "class=article-content",
          "class=post-content", "class=entry-content", "class=product", "class=product-detail")


@query("d2_chrome_tags", _lines_sql("[a || ' ' || c, d]"))
def d2_chrome_tags(spark, sf):
    """Each of the chrome tags inside a paragraph and between two, nested in the next one."""
    n = F.col("page_id") % len(_CHROME)
    tag, other = (F.array(*map(F.lit, _CHROME))[((n + k) % len(_CHROME)).cast("int")] for k in (0, 1))
    return _lines_of(_words(spark, sf).withColumn("html", _filled(
        "<p>{a} <{tag}>{b}</{tag}>{c}</p><{tag} class=\"content\"><{other}>{e}</{other}></{tag}><p>{d}</p>", tag=tag, other=other)))


@query("d4_d6_selectors", f"""
WITH {_WORDS_SQL}, r AS (SELECT *, page_id % 14 AS r FROM w)
SELECT page_id, tag, ord AS sel_order, markdown FROM (
  SELECT page_id, CASE r WHEN 0 THEN 'main' WHEN 1 THEN 'article' ELSE 'div' END AS tag, CAST(r AS INTEGER) AS ord, b || ' ' || c AS markdown FROM r WHERE r < 12
  UNION ALL SELECT page_id, 'body', 12, a || chr(10) || b || ' ' || c FROM r WHERE r <= 12
  UNION ALL SELECT page_id, '[document]', 13, a || chr(10) || b || ' ' || c FROM r WHERE r = 13)
""")
def d4_d6_selectors(spark, sf):
    """A root of each kind, one that several selectors pick, pages with the body only and without a body."""
    rule = F.col("page_id") % 14
    start = F.lit("<span>")
    for k, kind in enumerate(_ROOTS):
        name, _, value = kind.partition("=")
        made = f'<div {name}="{"x " + value + " y" if name == "class" else value}">' if value else f'<{name} id="content" class="product">'
        start = F.when(rule == k, F.lit(made)).otherwise(start)
    end = F.when(rule == 0, "</main>").when(rule == 1, "</article>").when(rule < 12, "</div>").otherwise("</span>")
    inner = _filled("<p>{a}</p>{start}<p>{b} {c}</p>{end}", start=start, end=end)
    html = F.when(rule == 13, inner).otherwise(F.concat(F.lit("<html><body>"), inner, F.lit("</body></html>")))
    pages = _words(spark, sf).select("page_id", "url", html.alias("html"))
    return with_roots(with_lines(pages)).select("page_id", F.explode("roots").alias("r")).select("page_id", "r.tag", "r.sel_order", "r.markdown")


# --------------------------------------------------------------- D11-D19
@query("d11_links", _lines_sql("""[a || ' ' || CASE page_id % 6
    WHEN 0 THEN '[' || b || ' ' || c || '](https://docs.example.org/p/' || page_id || ')' WHEN 1 THEN '[' || b || ' ' || c || '](https://docs.example.org/a/q/' || page_id || ')'
    WHEN 2 THEN '[' || b || ' ' || c || '](https://other.example/' || page_id || '#f)' WHEN 5 THEN '[' || b || ' ' || c || '](https://docs.example.org/a/b?y=' || page_id || ')'
    ELSE b || ' ' || c END || ' ' || d || e]"""))
def d11_links(spark, sf):
    """Links with relative, absolute, empty and missing targets, and one without a label."""
    href = _chosen(F.col("page_id") % 6, ' href="/p/{id}"', ' href="q/{id}"', ' href="https://other.example/{id}#f"', ' href=""', "", ' href="?y={id}"')
    return _lines_of(_words(spark, sf).withColumn("html", _filled('<p>{a} <a{href}>{b} <i>{c}</i></a> {d}<a>{e}</a><a href="/none"></a></p>', href=href)))


@query("d12_images", _lines_sql("""[a, CASE page_id % 6 WHEN 0 THEN '![' || b || ' ' || c || '](https://docs.example.org/i/' || page_id || '.png)'
    WHEN 1 THEN '![' || b || ' ' || c || '](https://docs.example.org/a/j.png)' WHEN 2 THEN '![' || b || ' ' || c || '](https://img.example/' || page_id || ')'
    WHEN 5 THEN '![' || b || ' ' || c || '](https://docs.example.org/o.png)' END, d || '![in](https://docs.example.org/x.png)' || e]"""))
def d12_images(spark, sf):
    """Images by each of the sources, as data, without one, and inside a paragraph."""
    source = _chosen(F.col("page_id") % 6, 'src="/i/{id}.png"', 'src="" data-src="j.png"', 'data-lazy-src="https://img.example/{id}" data-original="z.png"',
                     'src="data:image/png;base64,xx" data-src="k.png"', 'title="none"', 'data-original=" /o.png "')
    return _lines_of(_words(spark, sf).withColumn("html", _filled(
        '<p>{a}</p><img {source} alt="  {b}   {c} "><p>{d}<img src="/x.png" alt="in">{e}</p>', source=source)))


@query("d13_emphasis_code", _lines_sql("[a || ' **' || b || '** **' || c || '** *' || d || '**' || e || '* `x ' || a || '`' || b || ' *' || c || ' ' || d || '*']"))
def d13_emphasis_code(spark, sf):
    return _lines_of(_words(spark, sf).withColumn("html", _filled(
        "<p>{a} <strong>{b}</strong> <b>{c}</b>\n<em>{d}</em><i>{e}</i> <code>x {a}</code><u>{b}</u> <em>{c} <b>{d}</b></em></p>")))


_STARTS = (None, "5", "x", "0")
_START_SQL = "CASE page_id % 4 WHEN 1 THEN 4 WHEN 3 THEN -1 ELSE 0 END"


@query("d14_d16_lists", _lines_sql("""[(1 + n) || '. ' || a, '  - ' || b, '  - ' || c || ' **' || d || '**', '    1. ' || e, (2 + n) || '. ' || e,
    (CASE WHEN a = e THEN 2 ELSE 3 END + n) || '. ' || a, (4 + n) || '. same1', (4 + n) || '. same1', '- ' || a || ' ' || b]""",
    f", w AS (SELECT *, {_START_SQL} AS n FROM words)").replace("w AS (SELECT doc_id", "words AS (SELECT doc_id", 1))
def d14_d16_lists(spark, sf):
    """Nested lists of both kinds; start numbers, some that are none; equal items share a number."""
    start = F.lit("")
    for k, value in enumerate(_STARTS):
        start = F.when(F.col("page_id") % 4 == k, F.lit(f' start="{value}"' if value is not None else "")).otherwise(start)
    return _lines_of(_words(spark, sf).withColumn("html", _filled(
        "<ol{start}><li>{a}<ul><li>{b}</li><li>{c} <b>{d}</b><ol><li>{e}</li></ol></li></ul></li><li>{e}</li><li>{a}</li><li>same1</li><li>same1</li></ol>"
        "<ul><li>{a}<nav>menu</nav> {b}</li></ul>", start=start)))


@query("d15_headings", _lines_sql("['# ' || a, '## ', '### ' || b || ' *' || c || '*', '#### ' || d, '##### ' || e, '###### ' || a || ' ' || b]"))
def d15_headings(spark, sf):
    return _lines_of(_words(spark, sf).withColumn("html", _filled(
        "<h1>{a}</h1><h2></h2><h3>{b} <i>{c}</i></h3><h4>\n{d}</h4><h5>{e}</h5><h6>{a} <span>{b}</span></h6>")))


@query("d17_code_blocks", _lines_sql("['```' || chr(10) || a || chr(10) || '  ' || b || chr(10) || chr(10) || c || chr(10) || d || chr(10) || '```', e]"))
def d17_code_blocks(spark, sf):
    """A fence around stripped pieces; inner spaces stay."""
    return _lines_of(_words(spark, sf).withColumn("html", _filled("<pre>\n {a}\n  {b}\n\n{c} <b>{d}</b>\n</pre><p>{e}</p>")))


@query("d18_quotes", _lines_sql("['> ' || a || ' ' || b || chr(10) || '> ' || c || chr(10) || '> ' || d || chr(10) || '> ' || e, c]"))
def d18_quotes(spark, sf):
    """The pieces of a quote line by line; a paragraph in it is a block of its own, too; an empty quote is none."""
    return _lines_of(_words(spark, sf).withColumn("html", _filled("<blockquote>{a} {b}<p>{c}</p><br> {d}\n{e}</blockquote><blockquote> </blockquote>")))


@query("d19_tables", _lines_sql("""['| ' || a || ' | ' || b || ' |  |', '| --- | --- | --- |', '| ' || c || ' |  |  |', '| ' || d || ' | ' || e || ' | x y |',
    '| ' || d || ' | ' || e || ' | x y |', a]""").replace("lambda v, i: i = 1 OR", "lambda v, i: i = 1 OR v[1] = '|' OR"))
def d19_tables(spark, sf):
    """Ragged rows, an empty one, equal ones that stay."""
    return _lines_of(_words(spark, sf).withColumn("html", _filled(
        "<table><tr><th>{a}</th><th>{b}</th></tr><tr></tr><tr><td>{c}</td></tr><tr><td>{d}</td><td>{e}</td><td>x \n y</td></tr>"
        "<tr><td>{d}</td><td>{e}</td><td>x y</td></tr></table><table></table><p>{a}</p>")))


# --------------------------------------------------------------- Q8-Q10, C1
# main holds p words and a link of l words, article the same without the link, and a paragraph that equals the first one of main
_ROOT_WORDS = "least(len(ws), 10 + page_id % 300)"


@query("q8_q10_root_scores", f"""
WITH {_WORDS_SQL},
p AS (SELECT page_id, array_to_string(['first'] || ws[1:{_ROOT_WORDS}], ' ') AS body, array_to_string(['link'] || ws[1:page_id % 60], ' ') AS link, 1 + {_ROOT_WORDS} AS nb,
             1 + least(len(ws), page_id % 60) AS nl FROM w),
r AS (
  SELECT page_id, 'main' AS tag, 0 AS ord, body || chr(10) || '[' || link || '](https://docs.example.org/l)' AS text, nb + nl AS pw,
         length(link) AS links, length(body) + 1 + length(link) AS chars, 120 AS bonus FROM p
  UNION ALL SELECT page_id, 'article', 1, body, nb, 0, length(body), 120 FROM p
  UNION ALL SELECT page_id, 'div', 5, link, 0, 0, length(link), 0 FROM p
  UNION ALL SELECT page_id, 'body', 12, body || chr(10) || '[' || link || '](https://docs.example.org/l)' || chr(10) || body, 2 * nb + nl, length(link),
                   2 * length(body) + 2 * length(link) + 3, 0 FROM p),
q AS (SELECT page_id, tag, ord, pw, links, chars, bonus, CASE WHEN tag = 'div' THEN '' ELSE text END AS text FROM r),
{_quality_sql('q', 'page_id, tag, ord, pw, links, chars, bonus')}
SELECT page_id, tag, ord AS sel_order, CAST(pw AS BIGINT) AS p_words, round(links::DOUBLE / greatest(chars, 1), 6) AS density,
       round(CASE WHEN n_words = 0 THEN 0.0 ELSE q + least(pw, 1500) * 0.35 + bonus - links::DOUBLE / greatest(chars, 1) * least(n_words, 1000) * 1.2 END, 6) AS score
FROM scored
""")
def q8_q10_root_scores(spark, sf):
    """Q8-Q10: link density, paragraph words and score of each root, on pages with a main, an article, a content box and the body."""
    w = _words(spark, sf)
    body = F.concat_ws(" ", F.lit("first"), F.array_join(F.slice("ws", 1, (10 + F.col("page_id") % 300).cast("int")), " "))
    body = F.when(F.size("ws") > 0, body).otherwise("first")
    link = F.when((F.size("ws") > 0) & (F.col("page_id") % 60 > 0),
                  F.concat_ws(" ", F.lit("link"), F.array_join(F.slice("ws", 1, (F.col("page_id") % 60).cast("int")), " "))).otherwise("link")
    html = _filled('<html><body><main><p>{body}</p><p><a href="/l">{link}</a></p></main><article><p>{body}</p></article><div class="x content">{link}</div></body></html>',
                   body=body, link=link)
    r = with_roots(with_lines(w.select("page_id", "url", html.alias("html")))).select("page_id", F.explode("roots").alias("r"))
    density = F.col("r.link_len").cast("double") / F.greatest(F.col("r.text_len"), F.lit(1))
    return r.select("page_id", "r.tag", "r.sel_order", F.col("r.p_words").cast("long").alias("p_words"), F.round(density, 6).alias("density"),
                    F.round("r.score", 6).alias("score"))


# --------------------------------------------------------------- C2-C7
# Blocks: a long paragraph, a menu of one link, a short note after it, a long paragraph again (a repeat on odd ids).
@query("c3_c7_slots", f"""
WITH {_WORDS_SQL},
p AS (SELECT page_id, array_to_string(['one'] || ws[1:60] || ['end.'], ' ') AS p1, array_to_string(['go'] || ws[1:6], ' ') AS menu, 'note ' || a || '.' AS note,
             CASE WHEN page_id % 2 = 1 THEN array_to_string(['one'] || ws[1:60] || ['end.'], ' ') ELSE array_to_string(['two'] || ws[20:80] || ['stop.'], ' ') END AS p2 FROM w),
b AS (SELECT page_id, unnest([1, 2, 3, 4]) AS i, unnest([p1, menu, note, p2]) AS v, unnest([0.0, 1.0, 0.0, 0.0]) AS l,
             unnest([p1, '[' || menu || '](https://docs.example.org/m)', note, p2]) AS line FROM p),
m AS (SELECT *, len(string_split(v, ' ')) AS n, coalesce(lag(len(string_split(v, ' '))) OVER o, 0) AS before, coalesce(lead(len(string_split(v, ' '))) OVER o, 0) AS after,
             coalesce(lag(l) OVER o, 0.0) AS near FROM b WINDOW o AS (PARTITION BY page_id ORDER BY i)),
k AS (SELECT *, l <= 1.0 / 3 AND CASE WHEN near <= 5.0 / 9 THEN n > 16 OR after > 15 OR before > 4 ELSE n > 40 OR after > 17 END AS kept FROM m),
-- the section holds all four and beats main, which holds the section; a paragraph counts from 25 characters on
points AS (SELECT page_id, max(length(v)) >= 25 AS held FROM b GROUP BY page_id),
texts AS (
  SELECT page_id, 'recall' AS slot, 1 AS ord, 1.2 AS weight, string_agg(line, chr(10) ORDER BY i) FILTER (first) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line ORDER BY i) = 1 AS first FROM k) GROUP BY page_id
  UNION ALL SELECT page_id, 'precision', 2, 1.15, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '') FROM k GROUP BY page_id
  UNION ALL SELECT page_id, 'density', 3, 1.05, string_agg(line, chr(10) ORDER BY i) FROM k JOIN points USING (page_id) WHERE held GROUP BY page_id
  UNION ALL SELECT page_id, 'basic', 0, 1.0, string_agg(line, chr(10) ORDER BY i) FROM k GROUP BY page_id),
src AS (SELECT page_id, slot, ord, weight, coalesce(text, '') AS text FROM texts),
{_quality_sql('src', 'page_id, slot, ord, weight')},
able AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY q * weight DESC, ord) AS nth FROM scored
         WHERE (slot = 'basic' AND text <> '') OR (slot <> 'basic' AND n_words >= 20))
SELECT t.page_id, recall.text AS recall, precise.text AS precision, dense.text AS density, t.slot, t.text
FROM able t JOIN src recall ON recall.page_id = t.page_id AND recall.slot = 'recall' JOIN src precise ON precise.page_id = t.page_id AND precise.slot = 'precision'
     LEFT JOIN src dense ON dense.page_id = t.page_id AND dense.slot = 'density'
WHERE nth = 1
""")
def c3_c7_slots(spark, sf):
    """The texts of the slots and the chosen one, on pages with a menu between paragraphs."""
    w = _words(spark, sf)
    run = lambda first, start, n, end: F.array_join(F.concat(F.array(F.lit(first)), F.slice("ws", start, n), F.array(F.lit(end)) if end else F.expr("cast(array() as array<string>)")), " ")
    one = run("one", 1, 60, "end.")
    two = F.when(F.col("page_id") % 2 == 1, one).otherwise(run("two", 20, 61, "stop."))
    html = _filled('<html><body><main><section><p>{one}</p><p><a href="/m">{menu}</a></p><p>note {a}.</p><p>{two}</p></section></main></body></html>',
                   one=one, menu=run("go", 1, 6, None), two=two)
    return readable(w.select("page_id", "url", html.alias("html"))).select("page_id", "recall", "precision", "density", "slot", "text")


# --------------------------------------------------------------- M1, M2, A7
_HEAD_SQL = f"""
WITH {_WORDS_SQL},
m AS (SELECT page_id,
        CASE page_id % 4 WHEN 0 THEN a || ' ' || b WHEN 1 THEN c || ' ' || d WHEN 2 THEN e END AS author,
        CASE page_id % 3 WHEN 0 THEN a || ' & ' || b WHEN 1 THEN c END AS description,
        CASE page_id % 5 WHEN 0 THEN '2024-05-0' || (1 + page_id % 9) WHEN 1 THEN '2023-12-31' WHEN 2 THEN '2022-02-28' WHEN 3 THEN '2021-01-1' || (page_id % 10) END AS published_date
      FROM w)"""


def _headed(spark, sf) -> DataFrame:
    """Pages with heads whose first sources are filled, empty, blank, bad or missing."""
    w, page = _words(spark, sf), F.col("page_id")
    author = _chosen(page % 4, '<meta name="Author" content="  {a}\n {b} "><meta property="article:author" content="{c}">',
                     '<meta name="author" content=" "><meta property="article:author" content="{c} {d}">',
                     '<meta name="author"><meta name="author" content="{e}"><meta name="author" content="{a}">', '<meta name="authors" content="{a}">')
    description = _chosen(page % 3, '<meta property="og:description" content="{e}"><meta name="description" content="{a} &amp; {b}">',
                          '<meta name="description" content=""><meta property="og:description" content="{c}">', '<meta content="{a}">')
    digit = lambda n: (page % n).cast("string")
    date = (F.when(page % 5 == 0, F.concat(F.lit('<meta property="article:published_time" content="2024-05-0'), (1 + page % 9).cast("string"), F.lit('T12:00:00Z">')))
            .when(page % 5 == 1, F.lit('<meta property="article:published_time" content="soon"><time datetime="2023-12-31">x</time>'))
            .when(page % 5 == 2, F.lit('<time datetime="">x</time><time datetime=" 2022-02-28 10:00">x</time><time datetime="2020-01-01">y</time>'))
            .when(page % 5 == 3, F.concat(F.lit('<time datetime="2021-13-40">x</time><time datetime="2021-01-1'), digit(10), F.lit('">x</time>')))
            .otherwise(F.lit("<time>never</time>")))
    return w.select("page_id", F.concat(F.lit("<html><head>"), author, description, F.lit("</head><body>"), date, F.lit("</body></html>")).alias("html"))


@query("m1_m2_head_metadata", f"{_HEAD_SQL} SELECT page_id, author, published_date, description FROM m")
def m1_m2_head_metadata(spark, sf):
    return page_metadata(_headed(spark, sf)).select("page_id", "author", "published_date", "description")


@query("a7_bylines", f"{_HEAD_SQL} SELECT page_id, concat_ws(' · ', author, published_date) AS byline FROM m")
def a7_bylines(spark, sf):
    return page_metadata(_headed(spark, sf)).select("page_id", byline(F.col("author"), F.col("published_date")).alias("byline"))


# --------------------------------------------------------------- R1, R2
_SHELL_WORDS = (179, 180, 249, 250, 349, 350, 399, 400)
_SHELL_SCRIPTS = (0, 7, 8)
_SHELL_CHARS = (0, 20_000, 20_001, 60_000)
_RULES_SQL = f"""
WITH r AS (SELECT doc_id AS page_id, {list(_SHELL_WORDS)}[doc_id % 8 + 1] AS words, {list(_SHELL_SCRIPTS)}[doc_id // 8 % 3 + 1] AS scripts,
                  {list(_SHELL_CHARS)}[doc_id // 24 % 4 + 1] AS chars, doc_id // 3 % 17 > 0 AS marker FROM documents)"""


def _shells(spark, sf) -> DataFrame:
    """Markup with one of the markers or none, some scripts, filled up to a length; and a text of so many words."""
    pick = lambda values, at: F.array(*map(F.lit, values))[at.cast("int")]
    n = F.col("doc_id")
    mark = F.upper(pick(("none", *_MARKERS_STATED), F.floor(n / 3) % 17))
    html = F.concat(F.lit("<html><body "), mark, F.lit(">"), F.repeat(F.lit("<SCRIPT></SCRIPT>"), pick(_SHELL_SCRIPTS, F.floor(n / 8) % 3)))
    d = table(spark, sf, "documents").select(n.alias("page_id"), html.alias("html"), pick(_SHELL_CHARS, F.floor(n / 24) % 4).alias("least"), pick(_SHELL_WORDS, n % 8).alias("words"))
    return d.select("page_id", F.concat("html", F.repeat(F.lit("."), F.greatest(F.col("least") - F.length("html"), F.lit(0)))).alias("html"),
                    F.repeat(F.lit("a "), F.col("words")).alias("text"))


@query("r1_markers_and_scripts", f"{_RULES_SQL} SELECT page_id, marker AS has_marker, CAST(scripts AS BIGINT) AS script_count, chars >= 20000 AS long, chars > 20000 AS longer FROM r")
def r1_markers_and_scripts(spark, sf):
    """Each of the markers in upper case, counts of scripts, lengths on both sides of the bound."""
    f = shell_features("html")
    return _shells(spark, sf).select("page_id", f["has_marker"].alias("has_marker"), f["script_count"].alias("script_count"),
                                     (f["html_chars"] >= 20_000).alias("long"), (f["html_chars"] > 20_000).alias("longer"))


@query("r2_render_rules", f"""{_RULES_SQL}
SELECT page_id, words < 180 OR (marker AND words < 400) OR (scripts >= 8 AND words < 250) OR (chars > 20000 AND 2.0 * words / chars < 0.015 AND words < 350) AS needs_render FROM r
""")
def r2_render_rules(spark, sf):
    """R2: all four branches, on both sides of each bound."""
    f = shell_features("html")
    return _shells(spark, sf).select("page_id", needs_render(F.col("text"), f["has_marker"], f["script_count"], f["html_chars"]).alias("needs_render"))


# --------------------------------------------------------------- K1-K3
# Markdown of every class from the words; a rule without a pipe and a pipe line that heads nothing among it.
_MARKDOWN = ("## {a}", "", "{b} `{c}`", "goes on *{d}*", "```", "# {e}", "| no | table |", "```", "| {a} | [{b}](javascript:x) |", "|---|---|", "| **{c}** | ![{d}](/p.png) |", "---",
             "> {e} [ok](https://e.example/{id})", ">{a}", "- {b}", "  1. {c} **{d}**", "     - {e}", " * {a}", "| lone {b}", "{c}")
_CLASSES = ("heading", "blank", "paragraph", "paragraph", "fence_open", "code", "code", "fence_close", "table_head", "table_rule", "table_row", "paragraph",
            "quote", "quote", "list", "list", "list", "list", "paragraph", "paragraph")
_BLOCKS = (1, 2, 3, 3, 4, 4, 4, 4, 5, 5, 5, 6, 7, 7, 8, 8, 8, 8, 9, 9)


def _sql_text(template: str) -> str:
    parts = template.replace("}", "{").split("{")
    return " || ".join(f"'{p}'" if k % 2 == 0 else ("CAST(page_id AS VARCHAR)" if p == "id" else p) for k, p in enumerate(parts))


def _markdown(spark, sf) -> DataFrame:
    return _words(spark, sf).select("page_id", F.array_join(F.array(*map(_filled, _MARKDOWN)), "\n").alias("markdown"))


@query("k1_composed_lines", f"""
WITH {_WORDS_SQL}
SELECT page_id, CAST(i - 1 AS INTEGER) AS ln, [{", ".join(map(_sql_text, _MARKDOWN))}][i] AS line, {list(_CLASSES)}[i] AS cls,
       CASE WHEN {list(_CLASSES)}[i] <> 'blank' THEN CAST({list(_BLOCKS)}[i] AS INTEGER) END AS block
FROM (SELECT *, unnest(range(1, {len(_MARKDOWN) + 1})) AS i FROM w)
""")
def k1_composed_lines(spark, sf):
    from ..operators.mdtables import markdown_lines
    return markdown_lines(_markdown(spark, sf))


@query("k2_blocks", f"""
WITH {_WORDS_SQL},
b(block, kind, first_ln, n_lines, level, n_spans, n_blocked_links) AS (VALUES (1, 'heading', 0, 1, 2, 0, 0), (3, 'paragraph', 2, 2, NULL, 2, 0), (4, 'code', 4, 4, NULL, 0, 0),
  (5, 'table', 8, 3, NULL, 3, 1), (6, 'paragraph', 11, 1, NULL, 0, 0), (7, 'quote', 12, 2, NULL, 1, 0), (8, 'list', 14, 4, NULL, 1, 0), (9, 'paragraph', 18, 2, NULL, 0, 0))
SELECT page_id, block, kind, first_ln, CAST(n_lines AS BIGINT) AS n_lines, level, CAST(n_spans AS BIGINT) AS n_spans, CAST(n_blocked_links AS BIGINT) AS n_blocked_links FROM w, b
""")
def k2_blocks(spark, sf):
    from ..operators.mdtables import markdown_blocks
    return markdown_blocks(_markdown(spark, sf))


@query("k2_list_items", f"""
WITH {_WORDS_SQL}
SELECT page_id, 8 AS block, ln, indent, ordered, depth, content FROM (
  SELECT page_id, 14 AS ln, 0 AS indent, false AS ordered, 1 AS depth, b AS content FROM w UNION ALL SELECT page_id, 15, 2, true, 2, c || ' **' || d || '**' FROM w
  UNION ALL SELECT page_id, 16, 5, false, 3, e FROM w UNION ALL SELECT page_id, 17, 1, false, 2, a FROM w)
""")
def k2_list_items(spark, sf):
    from ..operators.mdtables import list_items
    return list_items(_markdown(spark, sf))


@query("k2_table_cells", f"""
WITH {_WORDS_SQL}
SELECT page_id, 5 AS block, ln, ln = 8 AS is_head, col, cell FROM (
  SELECT page_id, 8 AS ln, 0 AS col, a AS cell FROM w UNION ALL SELECT page_id, 8, 1, '[' || b || '](javascript:x)' FROM w
  UNION ALL SELECT page_id, 10, 0, '**' || c || '**' FROM w UNION ALL SELECT page_id, 10, 1, '![' || d || '](/p.png)' FROM w)
""")
def k2_table_cells(spark, sf):
    from ..operators.mdtables import markdown_lines, table_cells
    return table_cells(markdown_lines(_markdown(spark, sf)))


@query("k3_composed_spans", f"""
WITH {_WORDS_SQL}
SELECT page_id, ln, cell, 0 AS pos, kind, label, target, safe_target FROM (
  SELECT page_id, 2 AS ln, 0 AS cell, 'code' AS kind, c AS label, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS safe_target FROM w
  UNION ALL SELECT page_id, 3, 0, 'italic', d, NULL, NULL FROM w UNION ALL SELECT page_id, 8, 1, 'link', b, 'javascript:x', '#' FROM w
  UNION ALL SELECT page_id, 10, 0, 'bold', c, NULL, NULL FROM w UNION ALL SELECT page_id, 10, 1, 'image', d, '/p.png', '/p.png' FROM w
  UNION ALL SELECT page_id, 12, 0, 'link', 'ok', 'https://e.example/' || page_id, 'https://e.example/' || page_id FROM w
  UNION ALL SELECT page_id, 15, 0, 'bold', d, NULL, NULL FROM w)
""")
def k3_composed_spans(spark, sf):
    """K3: spans in paragraphs, table cells, quotes and list items; a target that is not allowed."""
    from ..operators.mdtables import inline_spans, markdown_lines
    return inline_spans(markdown_lines(_markdown(spark, sf)))


# --------------------------------------------------------------- S3, S5, L4
_CP1252_SQL = "[" + ", ".join("'" + bytes([b]).decode("cp1252", "replace") + "'" for b in range(128, 256)) + "]"


@query("s3_decoded_texts", f"""
WITH p AS (SELECT page_id, html, length(html) % 5 AS r, hex(encode(html)) AS h FROM pages)
SELECT page_id, CAST(CASE WHEN r = 1 THEN 2 + 2 * (length(html) + length(regexp_replace(html, '[\\x{{0}}-\\x{{ffff}}]', '', 'g'))) ELSE octet_length(encode(html)) + 1 END AS BIGINT) AS n_bytes,
       CASE WHEN r = 1 THEN html WHEN r = 2 AND octet_length(encode(html)) > length(html) THEN array_to_string(list_transform(range(CAST(length(h) // 2 AS BIGINT)),
              lambda i: CASE WHEN substr(h, 2 * i + 1, 1) < '8' THEN chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER))
                        ELSE {_CP1252_SQL}[CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) - 127] END), '') || 'ÿ'
            WHEN r = 2 THEN html || 'ÿ' ELSE html || chr(65533) END AS html
FROM p
""")
def s3_decoded_texts(spark, sf):
    """S3: the whole text of every body, in each charset."""
    from ..sources import derived
    from ..sources.tables import decoded_pages, pages
    return decoded_pages(derived.page_bodies(pages(spark, sf))).select("page_id", "n_bytes", "html")


@query("s5_review_items", f"""
WITH {_WORDS_SQL}
SELECT 'https://docs.example.org/' || page_id AS url, a AS title, CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'browser' END AS method, whole AS raw_text,
       {_sql_strip('whole')} AS cleaned_text, page_id % 3 = 0 AS llm_used, b AS author, '2024-01-0' || (1 + page_id % 9) AS published_date, c AS description,
       CASE WHEN page_id % 5 = 0 THEN d END AS warning FROM w
""")
def s5_review_items(spark, sf):
    """All ten fields of an item for every document, written and read back."""
    from ..session import run_folder
    from ..sources.sinks import write_review_items
    w, page = _words(spark, sf), F.col("page_id")
    path = run_folder(spark, "s5-review")
    write_review_items(w.select(
        "page_id", _filled("https://docs.example.org/{id}").alias("url"), F.col("a").alias("title"), F.when(page % 2 == 0, "http").otherwise("browser").alias("method"),
        F.col("whole").alias("raw_text"), tx.py_strip("whole").alias("cleaned_text"), (page % 3 == 0).alias("llm_used"), F.col("b").alias("author"),
        F.concat(F.lit("2024-01-0"), (1 + page % 9).cast("string")).alias("published_date"), F.col("c").alias("description"),
        F.when(page % 5 == 0, F.col("d")).alias("warning")), path)
    return spark.read.parquet(path).select("url", "title", "method", "raw_text", "cleaned_text", "llm_used", "author", "published_date", "description", "warning")


_PART = 12
_PARTS_SQL = "[substr(v, 1, 12), substr(v, 13, 12), substr(v, 25, 12)]"


@query("l4_merged_parts", f"""
WITH {_WORDS_SQL},
t AS (SELECT page_id, page_id % 5 AS r, rpad(a || b || c || d || e, 36, 'z') AS v FROM w),
p AS (SELECT page_id, r, v, {_PARTS_SQL} AS ps FROM t)
SELECT page_id, CASE r WHEN 0 THEN 'A' || 'B' || 'C' WHEN 1 THEN 'A' || ps[2] || 'C' WHEN 2 THEN ps[1] || 'B' || ps[3] WHEN 3 THEN v ELSE ps[1] || 'B' || ps[3] END AS cleaned_text,
       r <> 3 AS llm_used, CASE r WHEN 1 THEN 'LLM cleanup failed; showing extracted text instead: no reply' WHEN 2 THEN 'LLM cleanup failed; showing extracted text instead: HTTP 500; unreadable reply'
         WHEN 3 THEN 'LLM cleanup failed; showing extracted text instead: HTTP 500' END AS llm_warning
FROM p
""")
def l4_merged_parts(spark, sf):
    """L4: three parts a document, with replies that are there, missing (1), failed and unreadable (2), all failed (3) or blank (4)."""
    from dataclasses import replace

    from ..config import DEFAULT
    from ..operators.cleanup import merge_cleanup
    w, rule = _words(spark, sf), F.col("page_id") % 5
    items = w.select("page_id", F.rpad(F.concat("a", "b", "c", "d", "e"), 36, "z").alias("raw_text"))
    reply = lambda said: F.concat(F.lit('{"choices":[{"message":{"content":"'), said, F.lit('"}}]}'))
    parts = w.select("page_id", rule.alias("r"), F.explode(F.array(*map(F.lit, (2, 0, 1)))).alias("part"))
    said = F.array(*map(F.lit, "ABC"))[F.col("part")]
    failed = (F.col("r") == 3) | ((F.col("r") == 2) & (F.col("part") == 0))
    body = (F.when((F.col("r") == 2) & (F.col("part") == 2), F.lit("not json")).when((F.col("r") == 4) & (F.col("part") != 1), reply(F.lit(" ")))
            .otherwise(reply(F.concat(F.lit(" "), said))))
    answers = parts.filter("not (r = 1 and part = 1)").select("page_id", "part", F.when(~failed, body).alias("body"), F.when(failed, F.lit("HTTP 500")).alias("error"))
    cfg = replace(DEFAULT, llm_api_key="configured", max_llm_input_chars=_PART)
    return merge_cleanup(items, answers, cfg).select("page_id", "cleaned_text", "llm_used", "llm_warning")
