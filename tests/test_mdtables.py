"""K1-K3 on a hand-written Markdown document."""

from pagelift.operators.mdtables import inline_spans, list_items, markdown_blocks, markdown_lines, table_cells

DOC = "\n".join([
    "# Title with `code`",       # 0 heading
    "First para line",           # 1 paragraph
    "continues here **bold**",   # 2 paragraph (same block)
    "",                          # 3 blank
    "```",                       # 4 fence_open
    "# not a heading",           # 5 code
    "```",                       # 6 fence_close
    "| A | B |",                 # 7 table_head
    "| --- | --- |",             # 8 table_rule
    "| [x](javascript:1) | 2 |", # 9 table_row
    "> quoted *it*",             # 10 quote
    "> more",                    # 11 quote
    "- item ![i](/a.png)",       # 12 list
    "  - sub [ok](https://e.org)",  # 13 list
    "| lone pipe",               # 14 paragraph
])


def test_line_classes_blocks_and_spans(spark):
    df = spark.createDataFrame([(1, DOC)], "page_id long, markdown string")
    lines = markdown_lines(df)
    cls = [r.cls for r in lines.orderBy("ln").collect()]
    assert cls == ["heading", "paragraph", "paragraph", "blank", "fence_open", "code",
                   "fence_close", "table_head", "table_rule", "table_row", "quote", "quote",
                   "list", "list", "paragraph"]
    blocks = [(r.kind, r.first_ln, r.n_lines) for r in markdown_blocks(df).orderBy("block").collect()]
    assert blocks == [("heading", 0, 1), ("paragraph", 1, 2), ("code", 4, 3), ("table", 7, 3),
                      ("quote", 10, 2), ("list", 12, 2), ("paragraph", 14, 1)]
    spans = [(r.ln, r.kind, r.label, r.safe_target)
             for r in inline_spans(lines).orderBy("ln", "pos").collect()]
    assert spans == [(0, "code", "code", None), (2, "bold", "bold", None),
                     (9, "link", "x", "#"), (10, "italic", "it", None),
                     (12, "image", "i", "/a.png"), (13, "link", "ok", "https://e.org")]


def classes(spark, *docs):
    df = spark.createDataFrame(list(enumerate(docs)), "page_id long, markdown string")
    lines = markdown_lines(df)
    got = {k: [] for k in range(len(docs))}
    for r in lines.orderBy("page_id", "ln").collect():
        got[r.page_id].append((r.cls, r.block))
    return df, lines, got


def test_tables_by_hand(spark):
    *_, got = classes(
        spark, "| a |\n|---|\n|---|\n| x |",            # the second rule is a row
        "text\n| solo\nmore",                             # a pipe line opens a paragraph of its own
        "| h |\n---\n| r |\n---\n| s |\nend",           # a rule without a pipe; then no rule but a paragraph line
        "| a |\n---\n| b |\n---\n| c |",                 # b is a body row, so what follows it is no rule
        "| a |\n| b |\n|---|\n| c |", "| x |", "```\n| a |\n|---|\n```\n| b |\n|--|")
    names = {k: [c for c, _ in v] for k, v in got.items()}
    assert names[0] == ["table_head", "table_rule", "table_row", "table_row"]
    assert names[1] == ["paragraph"] * 3 and [b for _, b in got[1]] == [1, 2, 2]
    assert names[2] == ["table_head", "table_rule", "table_row", "paragraph", "paragraph", "paragraph"]
    assert [b for _, b in got[2]][3:] == [2, 3, 3]
    assert names[3] == ["table_head", "table_rule", "table_row", "paragraph", "paragraph"]
    assert names[4] == ["paragraph", "table_head", "table_rule", "table_row"]
    assert names[5] == ["paragraph"]
    assert names[6] == ["fence_open", "code", "code", "fence_close", "table_head", "table_rule"]


def by_hand(text):
    """Line classes by reading a document from its first line to its last."""
    import re
    lines, out, i = text.split("\n"), [], 0
    rule = lambda s: re.match(r"\s*\|?\s*:?-{2,}", s)
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            out.append("blank")
        elif line.strip().startswith("```"):
            out.append("fence_open")
            i += 1
            while i < len(lines) and not lines[i].strip().startswith("```"):
                out.append("code")
                i += 1
            if i < len(lines):
                out.append("fence_close")
        elif re.match(r"#{1,6}\s+", line):
            out.append("heading")
        elif line.strip().startswith("|") and i + 1 < len(lines) and rule(lines[i + 1]):
            out += ["table_head", "table_rule"]
            i += 2
            while i < len(lines) and lines[i].strip().startswith("|"):
                out.append("table_row")
                i += 1
            continue
        elif line.startswith(">"):
            out.append("quote")
        elif re.match(r"\s*([-*]|[0-9]+\.)\s+", line):
            out.append("list")
        else:
            out.append("paragraph")
        i += 1
    return out


def test_random_documents_read_line_by_line(spark):
    import random
    rng = random.Random(3)
    pieces = ["| a | b |", "|---|", "---", "| x", "text", "", "```", "# h", "> q", "- item", "  2. two", "--- x", "|--", ":--"]
    docs = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    *_, got = classes(spark, *docs)
    for k, doc in enumerate(docs):
        assert [c for c, _ in got[k]] == by_hand(doc), doc


def test_cells_items_and_spans(spark):
    doc = "| **a | b** | c |\n|--|\n| [x](y) | `p|q` |\n\n- one\n  - two *it*\n    1. three\n - four\n- five"
    df, lines, _ = classes(spark, doc)
    cells = {(r.ln, r.col): (r.is_head, r.cell) for r in table_cells(lines).collect()}
    assert cells[(0, 0)] == (True, "**a") and cells[(0, 1)] == (True, "b**") and cells[(2, 0)] == (False, "[x](y)")
    items = {r.content: (r.indent, r.ordered, r.depth) for r in list_items(df).collect()}
    assert items == {"one": (0, False, 1), "two *it*": (2, False, 2), "three": (4, True, 3), "four": (1, False, 2), "five": (0, False, 1)}
    spans = [(r.ln, r.cell, r.kind, r.label) for r in inline_spans(lines).orderBy("ln", "cell", "pos").collect()]
    assert spans == [(2, 0, "link", "x"), (5, 0, "italic", "it")]  # nothing spans two cells
    block = markdown_blocks(df).filter("kind = 'table'").first()
    assert (block.n_lines, block.n_spans, block.n_blocked_links) == (3, 1, 0)
