"""K1-K3: the Markdown the engine produces, as tables (the data part of the
review preview renderer).

* K1 ``markdown_lines``: one row per line with its class -- fence, code, blank,
  heading, table (head / rule / row), quote, list, paragraph -- and its block;
* K2 ``markdown_blocks``, ``list_items``, ``table_cells``: consecutive lines that
  belong together, and the structure of lists and tables;
* K3 ``inline_spans``: code, image, link, bold and italic spans of the rendered
  texts -- a table cell each on its own -- with link targets through the scheme
  allow-list (U7).

A document is one row, and never needs another one, so all of this is a
projection: no window, no group, no join, no shuffle.  Each line becomes a
letter by what it looks like on its own; the string of letters is then parsed
by patterns, in one pass each:

* between an odd fence and the next one all lines are code;
* a table begins at a line that starts with a pipe and is followed by a rule;
  the rule is used up, and all pipe lines after it are rows -- leftmost matches
  of ``[pipe][rule][pipe]*``;
* blocks are the tokens of the string that results.

List depth needs a memory: a fold over a block's indents with the stack of open
items as its state, in chunks, so that its output is copied once per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.urls import safe_link

# White space and line ends of the preview's pattern language, and its patterns.
SPACE = r"[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
REST = r"([^\n\r\x{2028}\x{2029}]*)\z"
HEADING = rf"^(#{{1,6}}){SPACE}+{REST}"
TABLE_RULE = rf"^{SPACE}*\|?{SPACE}*:?-{{2,}}"
LIST_START = rf"^({SPACE}*)([-*]|[0-9]+\.){SPACE}+"
LIST_ITEM = LIST_START + REST
_TARGET = rf"\(((?:(?!{SPACE})[^)])+)\)"
INLINE = (rf"`([^`]+)`|!\[([^\]]*)\]{_TARGET}|\[([^\]]*)\]{_TARGET}"
          r"|\*\*([^*]+)\*\*|\*([^*]+)\*")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


#: Letters of the final string: what they stand for, and the kind of block that they begin.
_CLASSES = {"F": "fence_open", "c": "code", "G": "fence_close", "b": "blank", "a": "heading", "h": "table_head", "t": "table_rule",
            "w": "table_row", "u": "quote", "l": "list", "P": "paragraph", "X": "paragraph"}
_KINDS = {"F": "code", "a": "heading", "h": "table", "u": "quote", "l": "list", "P": "paragraph", "X": "paragraph", "b": "blank"}
_BLOCK = r"Fc*G?|a|htw*|u+|l+|[PX]P*|b+"
FOLD_CHUNK = 256


def _letter(line: Column) -> Column:
    """What a line looks like on its own: F fence, p pipe, q pipe and rule, r rule, X a paragraph that a paragraph before
    it can't take in, and the letters of the other classes."""
    def letter(trimmed: Column) -> Column:
        rule = line.rlike(TABLE_RULE)
        return (F.when(trimmed.startswith("```"), "F").when(trimmed == "", "b")
                .when(trimmed.startswith("|"), F.when(rule, "q").otherwise("p")).when(rule, "r")
                .when(line.rlike(HEADING), "a").when(line.startswith(">"), "u").when(line.rlike(LIST_ITEM), "l")
                .when(line.rlike(LIST_START) | line.rlike(rf"^#{{1,6}}{SPACE}+"), "X").otherwise("P"))
    return let(_trim(line), letter)


def _parsed(letters: Column) -> Column:
    """The final string, from the letters of the lines on their own."""
    def fenced(s: Column, k: Column) -> Column:
        odd = k % 2 == 1
        return F.concat(F.when(k == 0, "").when(odd, "F").otherwise("G"), F.when(odd, F.repeat(F.lit("c"), F.length(s))).otherwise(s))
    code = F.array_join(F.transform(F.split(letters, "F"), fenced), "")
    headed = F.regexp_replace(code, r"[pq][qr]([pq]*)", "ht$1")
    rows = F.regexp_replace(headed, r"(?:(?<=ht)|(?!\A)\G)[pq]", "w")  # those that follow a head without a gap
    return F.translate(rows, "pqr", "XXP")


def _named(letter: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), letter)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, lines, letters, blocks, block_of, firsts)``: arrays over the lines, the tokens of the blocks, and arrays
    that give each line its block (from 1) and each block its first line."""
    d = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    d = d.withColumn("final", _parsed(F.array_join(F.transform("lines", _letter), "")))
    d = d.withColumn("letters", F.slice(F.split("final", ""), F.lit(1), F.size("lines"))).withColumn("blocks", F.regexp_extract_all("final", F.lit(_BLOCK), 0))
    d = d.withColumn("block_of", F.flatten(F.transform("blocks", lambda b, k: F.array_repeat(k + 1, F.length(b)))))
    fresh = lambda i: (i == 0) | (F.get(F.col("block_of"), i) != F.get(F.col("block_of"), i - 1))
    return d.withColumn("firsts", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), fresh)).drop("final")


def markdown_lines(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """K1/K2: ``(key, ln, line, cls, block)``; blank lines get block null."""
    d = _documents(docs, key, text)
    rows = d.select(key, F.posexplode(F.arrays_zip("lines", "letters", "block_of")).alias("ln", "x"))
    return rows.select(key, "ln", F.col("x.lines").alias("line"), _named(F.col("x.letters"), _CLASSES).alias("cls"),
                       F.when(F.col("x.letters") != "b", F.col("x.block_of")).alias("block"))


def _in_blocks(kind: str | None, use) -> Column:
    """``use(token, number from 0)`` for the blocks of a kind (None: all but blank ones)."""
    made = F.transform("blocks", lambda b, k: F.when(
        (F.substring(b, 1, 1) != "b") if kind is None else F.substring(b, 1, 1) == kind, use(b, k)))
    return F.filter(made, lambda x: x.isNotNull())


def markdown_blocks(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """K2: ``(key, block, kind, first_ln, n_lines, level, n_spans, n_blocked_links)``:
    the level of a heading, the inline spans and those whose target is not allowed."""
    def measured(line: Column, i: Column) -> Column:
        spans = F.flatten(F.transform(rendered_texts(_named(F.get(F.col("letters"), i), _CLASSES), line), lambda t: F.regexp_extract_all(t, F.lit(INLINE), 0)))
        blocked = lambda s: F.coalesce(_target(s).isNotNull() & (safe_link(_target(s)) == "#"), F.lit(False))
        return let(spans, lambda x: F.struct(F.size(x).cast("long").alias("spans"), F.size(F.filter(x, blocked)).cast("long").alias("blocked")))

    def block(token: Column, k: Column) -> Column:
        first, n = F.get(F.col("firsts"), k), F.length(token)
        own = F.slice("measures", first + 1, n)
        total = lambda name: F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x[name])
        level = F.when(token == "a", F.length(F.regexp_extract(F.get(F.col("lines"), first), HEADING, 1)))
        return F.struct((k + 1).alias("block"), _named(F.substring(token, 1, 1), _KINDS).alias("kind"), first.alias("first_ln"),
                        n.cast("long").alias("n_lines"), level.alias("level"), total("spans").alias("n_spans"), total("blocked").alias("n_blocked_links"))

    d = _documents(docs, key, text).withColumn("measures", F.transform("lines", measured))
    return d.select(key, F.explode(_in_blocks(None, block)).alias("x")).select(key, "x.*")


def _cells(line: Column) -> Column:
    """The trimmed cells of a table line."""
    inner = F.regexp_replace(F.regexp_replace(_trim(line), r"^\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"\|"), _trim)


def table_cells(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """K2: ``(key, block, ln, is_head, col, cell)`` of every table."""
    return (lines.filter(F.col("cls").isin("table_head", "table_row"))
            .select(key, "block", "ln", (F.col("cls") == "table_head").alias("is_head"), F.posexplode(_cells(F.col("line"))).alias("col", "cell")))


def _depths(indents: Column) -> Column:
    """How many items are open at each line, itself included: an item closes those that are indented as far or further."""
    stack = "cast(array() as array<int>)"

    def line(state: Column, at: Column) -> Column:
        opened = F.concat(F.filter(state["open"], lambda x: x < at), F.array(at))
        return F.struct(opened.alias("open"), F.concat(state["out"], F.array(F.size(opened))).alias("out"))

    def chunk(state: Column, part: Column) -> Column:
        start = F.struct(state["open"].alias("open"), F.expr(stack).alias("out"))
        return let(F.aggregate(part, start, line), lambda x: F.struct(x["open"].alias("open"), F.concat(state["out"], x["out"]).alias("out")))

    starts = F.sequence(F.lit(1), F.greatest(F.size(indents), F.lit(1)), F.lit(FOLD_CHUNK))
    chunks = F.transform(starts, lambda i: F.slice(indents, i, FOLD_CHUNK))
    return F.aggregate(chunks, F.struct(F.expr(stack).alias("open"), F.expr(stack).alias("out")), chunk, lambda x: x["out"])


def list_items(docs: DataFrame, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """K2: ``(key, block, ln, indent, ordered, depth, content)`` of every list line; the depth counts the items that an
    item stands under, and itself."""
    def items(token: Column, k: Column) -> Column:
        first = F.get(F.col("firsts"), k)

        def listed(own: Column) -> Column:
            indents = F.transform(own, lambda x: F.length(F.regexp_extract(x, LIST_ITEM, 1)))
            return let(let(indents, _depths), lambda depths: F.transform(own, lambda x, i: F.struct(
                (k + 1).alias("block"), (first + i).alias("ln"), F.length(F.regexp_extract(x, LIST_ITEM, 1)).alias("indent"),
                F.regexp_extract(x, LIST_ITEM, 2).rlike(r"[0-9]").alias("ordered"), F.get(depths, i).alias("depth"),
                F.regexp_extract(x, LIST_ITEM, 3).alias("content"))))
        return let(F.slice("lines", first + 1, F.length(token)), listed)

    d = _documents(docs, key, text)
    return d.select(key, F.explode(F.flatten(_in_blocks("l", items))).alias("x")).select(key, "x.*")


def rendered_texts(cls: Column, line: Column) -> Column:
    """The texts of a line in which spans are looked for: one, or one per table cell; none in code and rules."""
    text = (F.when(cls == "heading", F.regexp_extract(line, HEADING, 2))
            .when(cls == "list", F.regexp_extract(line, LIST_ITEM, 3))
            .when(cls == "quote", F.regexp_replace(line, rf"^>{SPACE}?", ""))
            .when(cls == "paragraph", line))
    return (F.when(cls.isin("table_head", "table_row"), _cells(line))
            .when(text.isNotNull(), F.array(text)).otherwise(F.expr("cast(array() as array<string>)")))


def _target(span: Column) -> Column:
    return F.when(span.rlike(r"^!?\[") & span.endswith(")"), F.regexp_extract(span, r"\]\(([^)]+)\)\z", 1))


def inline_spans(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """K3: ``(key, ln, cell, pos, kind, label, target, safe_target)`` for every span
    of the rendered texts; ``cell`` is 0 but in tables."""
    texts = lines.select(key, "ln", F.posexplode(rendered_texts(F.col("cls"), F.col("line"))).alias("cell", "text"))
    spans = texts.select(key, "ln", "cell", F.posexplode(F.regexp_extract_all("text", F.lit(INLINE), 0)).alias("pos", "span"))
    s = F.col("span")
    kind = (F.when(s.startswith("`"), "code").when(s.startswith("!["), "image")
            .when(s.startswith("["), "link").when(s.startswith("**"), "bold").otherwise("italic"))
    label = (F.when(kind == "code", F.regexp_extract(s, r"^`([^`]+)`$", 1))
             .when(kind == "image", F.regexp_extract(s, r"^!\[([^\]]*)\]", 1))
             .when(kind == "link", F.regexp_extract(s, r"^\[([^\]]*)\]", 1))
             .when(kind == "bold", F.regexp_extract(s, r"^\*\*([^*]+)\*\*$", 1))
             .otherwise(F.regexp_extract(s, r"^\*([^*]+)\*$", 1)))
    target = F.when(kind.isin("image", "link"), _target(s))
    return spans.select(key, "ln", "cell", "pos", kind.alias("kind"), label.alias("label"), target.alias("target"),
                        F.when(target.isNotNull(), safe_link(target)).alias("safe_target"))
