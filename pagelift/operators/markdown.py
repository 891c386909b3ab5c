"""Markdown of candidate roots, as expressions on page rows.

Input are the nested rows of :func:`pagelift.operators.nodes.page_trees`.  All
that follows -- rendering blocks, collecting the lines under a root, dropping
repeats, scoring -- reads one page's row only, so the plan is a scan, the
parser and projections: no shuffle at any size, and a page's work stays within
its row.

Two facts make this exact:

* whether a block element is emitted, and what it renders to, depends only on
  the element, its subtree and its ancestors on the whole page -- not on the
  candidate root that contains it;
* dropping a line equal to the last emitted line equals dropping a line equal
  to the previous non-empty candidate line.

An element's text is a slice of the page's visible strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, let, lines as lines_of, py_strip, quality_of, squeeze_ws, word_count
from ..functions.urls import resolved_url, with_base_parts
from .nodes import page_trees

# Root selectors.
SELECTORS = (
    ("tag", "main"), ("tag", "article"), ("role", "main"),
    ("id", "content"), ("id", "main-content"),
    ("class", "content"), ("class", "main-content"), ("class", "article-content"),
    ("class", "post-content"), ("class", "entry-content"), ("class", "product"),
    ("class", "product-detail"),
)
BODY_ORDER = len(SELECTORS)
DOCUMENT_ORDER = BODY_ORDER + 1
UNTITLED = "Untitled page"
SEMANTIC_ROOTS = ("main", "article")
LINE = "struct<pre:int,value:string,is_table:boolean>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _text(of: Column, sep: str) -> Column:
    """The visible strings under an element, joined."""
    return F.array_join(F.slice(F.col("strings"), of["first"] + 1, of["n"]), sep)


def _target(kid: Column) -> Column:
    """The URL that a link or an image (D12: its first non-empty lazy-load source) names."""
    source = py_strip(F.coalesce(F.get(F.filter(kid["sources"], lambda s: s != ""), F.lit(0)), F.lit("")))
    return F.when(kid["tag"] == "a", kid["href"]).when(kid["tag"] == "img", source)


def _piece(kid: Column) -> Column:
    """A direct child of an inline block, or an image (``![alt](url)``;
    '' when it has no source or a ``data:`` URL)."""
    tag = kid["tag"]

    def rendered(parts: Column) -> Column:
        text, url = parts["text"], parts["url"]
        wrapped = lambda *around: F.concat(*(text if x is None else F.lit(x) for x in around))
        alt = squeeze_ws(py_strip(F.coalesce(kid["alt"], F.lit(""))))
        return (F.when(tag == "a", F.when((text != "") & F.coalesce(url != "", F.lit(False)), F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")")))
                       .otherwise(text))
                .when(tag == "img", F.when((url == "") | url.startswith("data:"), F.lit(""))
                      .otherwise(F.concat(F.lit("!["), alt, F.lit("]("), url, F.lit(")"))))
                .when(tag.isin("ul", "ol"), F.lit(""))
                .when(tag.isin("strong", "b"), wrapped("**", None, "**"))
                .when(tag.isin("em", "i"), wrapped("*", None, "*"))
                .when(tag == "code", wrapped("`", None, "`"))
                .otherwise(text))

    parts = F.struct(_text(kid, " ").alias("text"), resolved_url(_target(kid)).alias("url"))
    return F.when(tag.isNull(), kid["text"]).otherwise(let(parts, rendered))


def _marker(block: Column) -> Column:
    """Indentation by enclosing ``li`` count; ``-`` or the ordinal in the
    nearest ``ol`` (place of the first equal sibling item, + start - 1)."""
    start = F.when(block["list_start"].rlike(r"^[0-9]+$"),
                   F.coalesce(block["list_start"].try_cast("long"), F.lit(1)) - 1).otherwise(F.lit(0))
    sign = F.when(block["list_tag"] == "ol", F.concat((block["ordinal"] + start).cast("string"), F.lit("."))).otherwise(F.lit("-"))
    return F.concat(F.repeat(F.lit("  "), block["item_depth"]), sign)


def _table(block: Column) -> Column:
    """Cells of each row with any, padded; a rule after the first row."""
    cell = lambda c: squeeze_ws(_text(c, " "))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def lines(rows: Column) -> Column:
        def padded(width: Column) -> Column:
            every = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
            rule = F.array(line(F.array_repeat(F.lit("---"), width)))
            return let(every, lambda e: F.concat(F.slice(e, 1, 1), rule, F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0)))))
        return F.when(F.size(rows) == 0, _none("string")).otherwise(
            let(F.array_max(F.transform(rows, lambda r: F.size(r))), padded))

    rows = F.transform(F.filter(block["rows"], lambda r: F.size(r) > 0), lambda r: F.transform(r, cell))
    return let(rows, lines)


def _values(block: Column) -> Column:
    """The lines that a block renders to."""
    tag = block["tag"]

    def value(parts: Column) -> Column:
        raw, text = parts["raw"], parts["text"]
        quote = F.array_join(F.transform(lines_of(text), lambda ln: F.concat(F.lit("> "), ln)), "\n")
        start = (F.when(tag.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" ")))
                 .when(tag == "li", F.concat(_marker(block), F.lit(" "))).otherwise(F.lit("")))
        return (F.when(tag == "pre", F.concat(F.lit("```\n"), text, F.lit("\n```")))
                .when(tag == "blockquote", F.when(text == "", F.lit("")).otherwise(quote))
                .when(tag == "img", raw)
                .otherwise(F.concat(start, collapse_ws(raw))))

    parts = F.struct(F.array_join(F.transform(block["kids"], _piece), "").alias("raw"),
                     F.when(tag.isin("pre", "blockquote"), _text(block, "\n")).alias("text"))
    return F.when(tag == "table", _table(block)).otherwise(F.array(let(parts, value)))


def _lines() -> Column:
    """All emitted, non-empty lines of the page: ``array<struct<pre, value, is_table>>``."""
    made = F.transform("blocks", lambda b: F.transform(_values(b), lambda v: F.struct(
        b["pre"].alias("pre"), v.alias("value"), (b["tag"] == "table").alias("is_table"))))
    return F.filter(F.flatten(made), lambda x: x["value"] != "")


def _selector(of: Column) -> Column:
    """The first selector an element matches; the first body is last in line."""
    classes = F.split(F.coalesce(of["classes"], F.lit("")), r"\s+")
    order = F.lit(None).cast("int")
    for i, (kind, value) in reversed(list(enumerate(SELECTORS))):
        hit = F.array_contains(classes, value) if kind == "class" else of[kind] == value
        order = F.when(F.coalesce(hit, F.lit(False)), F.lit(i)).otherwise(order)
    return order


def _roots() -> Column:
    """Candidate roots: selector matches, then the first body, else the whole document."""
    fields = ("pre", "last", "tag", "text_len", "link_len", "p_words")
    root = lambda of, order: F.struct(*(of[f].alias(f) for f in fields), order.alias("order"))
    first_body = F.get(F.filter("marked", lambda m: m["tag"] == "body"), F.lit(0))["pre"]
    order = lambda m: F.coalesce(_selector(m), F.when(m["pre"] == first_body, F.lit(BODY_ORDER)))
    found = F.filter(F.transform("marked", lambda m: root(m, order(m))), lambda r: r["order"].isNotNull())
    whole = F.array(root(F.col("whole"), F.lit(DOCUMENT_ORDER)))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))


def markdown_under(pre: Column, last: Column, lines: str = "lines") -> Column:
    """The emitted lines under a root in document order, a line
    equal to the previous one dropped unless it is a table line."""
    under = F.filter(lines, lambda x: (x["pre"] > pre) & (x["pre"] <= last))
    kept = let(under, lambda u: F.filter(u, lambda x, i: x["is_table"] | (i == 0) | (
        x["value"] != F.coalesce(F.get(u, i - 1)["value"], F.lit("")))))
    return F.array_join(F.transform(kept, lambda x: x["value"]), "\n")


def _score(root: Column, words: Column, quality: Column) -> Column:
    """Q8-Q10: quality, paragraph words, semantic roots, less the share of link text."""
    density = F.try_divide(root["link_len"].cast("double"), F.greatest(root["text_len"], F.lit(1)).cast("double"))
    semantic = F.when(root["tag"].isin(*SEMANTIC_ROOTS), 120).otherwise(0)
    return F.when(words == 0, F.lit(0.0)).otherwise(
        quality + F.least(root["p_words"], F.lit(1500)) * 0.35 + semantic - density * F.least(words, F.lit(1000)) * 1.2)


def with_lines(pages: DataFrame) -> DataFrame:
    """Page rows (``page_id, url, html`` and more) with their tree, ``title`` and emitted ``lines``."""
    trees = with_base_parts(page_trees(pages), "url")
    title = F.coalesce(F.array_join("title_parts", " "), F.lit(UNTITLED))
    return trees.withColumn("title", title).withColumn("lines", F.coalesce(_lines(), _none(LINE)))


def with_roots(lined: DataFrame) -> DataFrame:
    """Adds ``roots``: candidate roots with their Markdown, its words and quality, and the score."""
    texts = F.transform(_roots(), lambda r: F.struct(r.alias("root"), markdown_under(r["pre"], r["last"]).alias("markdown")))
    measured = F.transform(texts, lambda x: F.struct(x["root"].alias("root"), x["markdown"].alias("markdown"),
                                                     word_count(x["markdown"]).alias("words"), quality_of(x["markdown"]).alias("quality")))
    named = F.transform(F.col("_roots"), lambda x: F.struct(
        x["root"]["pre"].alias("pre"), x["root"]["tag"].alias("tag"), x["root"]["order"].alias("sel_order"),
        x["markdown"].alias("markdown"), x["root"]["p_words"].alias("p_words"), x["root"]["text_len"].alias("text_len"),
        x["root"]["link_len"].alias("link_len"), x["words"].alias("words"), x["quality"].alias("quality"),
        _score(x["root"], x["words"], x["quality"]).alias("score")))
    return lined.withColumn("_roots", measured).withColumn("roots", named).drop("_roots")


def with_basic(lined: DataFrame) -> DataFrame:
    """Adds ``basic``, the non-empty root Markdown with the highest score (first in selector order on ties; null
    when there is none), and its ``basic_quality``."""
    ranked = F.transform(F.filter("roots", lambda r: r["markdown"] != ""), lambda r: F.struct(
        r["score"], -r["sel_order"], -r["pre"], r["markdown"].alias("markdown"), r["quality"].alias("quality")))
    best = with_roots(lined).withColumn("_best", F.array_max(ranked))
    return best.withColumn("basic", F.col("_best.markdown")).withColumn("basic_quality", F.col("_best.quality")).drop("_best")


def extract_basic(pages: DataFrame) -> DataFrame:
    """Minimum slice: one row per page -- ``(page_id, url, title, markdown, quality)``."""
    found = with_basic(with_lines(pages.select("page_id", "url", "html"))).withColumn("markdown", F.coalesce("basic", F.lit("")))
    return found.select("page_id", "url", "title", "markdown", F.round(F.coalesce("basic_quality", F.lit(0.0)), 6).alias("quality"))
