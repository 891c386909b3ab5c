"""Random articles from a small grammar, with the Markdown that each must give."""

import random

import pytest
from pyspark.sql import functions as F

from pagelift.functions.text import quality
from pagelift.operators.markdown import extract_basic
from pagelift.operators.render import needs_render, shell_features

NOUNS = "harbour kettle meadow violin lantern pebble orchard compass saddle quartz ribbon thimble".split()
CHROME = ["<nav>{x}</nav>", "<aside><p>{x}</p></aside>", "<footer><ul><li>{x}</li></ul></footer>", "<form><p>{x}</p></form>",
          "<header><h1>{x}</h1></header>", "<script>var x = '<p>{x}</p>'</script>", "<svg><title>{x}</title></svg>", "<button>{x}</button>"]


class Article:
    """Markup and expected lines, grown side by side."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.markup, self.lines = [], []

    def words(self, low=1, high=6):
        return " ".join(self.rng.choice(NOUNS) + str(self.rng.randrange(100)) for _ in range(self.rng.randint(low, high)))

    def inline(self):
        html, text = [], []
        for _ in range(self.rng.randint(1, 4)):
            own = self.words()
            kind = self.rng.randrange(7)
            at = self.rng.choice(["/top/x", "next", "../up?q=1", "https://other.example/z#f"])
            full = {"/top/x": "https://site.example/top/x", "next": "https://site.example/a/b/next", "../up?q=1": "https://site.example/a/up?q=1"}.get(at, at)
            pieces = [(own, own), (f"<b>{own}</b>", f"**{own}**"), (f"<em>\n {own}</em>", f"*{own}*"), (f"<code>{own}</code>", f"`{own}`"),
                      (f"<a href='{at}'>{own}</a>", f"[{own}]({full})"), (f"<span>{own}<i></i></span>", own),
                      (f'<img src="" data-src="{at}" alt="{own}">', f"![{own}]({full})")]
            html.append(pieces[kind][0])
            text.append(pieces[kind][1])
        return "\n ".join(html), " ".join(text)

    def listing(self, depth, tag, start=1):
        number, attribute = start, f' start="{start}"' if start != 1 else ""
        self.markup.append(f"<{tag}{attribute}>")
        for _ in range(self.rng.randint(1, 3)):
            html, text = self.inline()
            unique = f"item{self.rng.randrange(10 ** 9)}"
            self.markup.append(f"<li>{html} {unique}")
            self.lines.append("  " * depth + (f"{number}." if tag == "ol" else "-") + f" {text} {unique}")
            if depth < 2 and self.rng.random() < 0.3:
                self.listing(depth + 1, self.rng.choice(["ul", "ol"]))
            self.markup.append("</li>")
            number += 1
        self.markup.append(f"</{tag}>")

    def table(self):
        width, rows = self.rng.randint(1, 4), self.rng.randint(1, 4)
        self.markup.append("<table><tbody>")
        cells = [[self.words(0 if r else 1, 2) for _ in range(width if r == 0 else self.rng.randint(1, width))] for r in range(rows)]
        for k, row in enumerate(cells):
            self.markup.append("<tr>" + "".join(f"<t{'dh'[k == 0]}> {c} </t{'dh'[k == 0]}>" for c in row) + "</tr><tr></tr>")
            self.lines.append("| " + " | ".join(row + [""] * (width - len(row))) + " |")
            if k == 0:
                self.lines.append("| " + " | ".join(["---"] * width) + " |")
        self.markup.append("</tbody></table>")

    def grow(self):
        for _ in range(self.rng.randint(2, 7)):
            kind = self.rng.randrange(7)
            if kind == 0:
                level, own = self.rng.randint(1, 6), self.words()
                self.markup.append(f"<h{level}>{own}</h{level}>")
                self.lines.append("#" * level + " " + own)
            elif kind == 1:
                self.listing(0, "ul")
            elif kind == 2:
                self.listing(0, "ol", self.rng.choice([1, 1, 4]))
            elif kind == 3:
                self.table()
            elif kind == 4:
                own = [self.words() for _ in range(2)]
                self.markup.append(f"<blockquote>{own[0]}<br>{own[1]}</blockquote>")
                self.lines += [f"> {x}" for x in own]
            elif kind == 5:
                own = self.words()
                self.markup.append(f"<pre>  {own}\n    indented </pre>")
                self.lines += ["```", f"{own}\n    indented", "```"]
            else:
                html, text = self.inline()
                self.markup.append(f"<p>{html}</p>")
                self.lines.append(text)
            self.markup.append(self.rng.choice(CHROME).format(x=self.words()))
        return self


def test_articles_give_their_markdown(spark):
    articles = [Article(seed).grow() for seed in range(120)]
    rows = []
    for k, a in enumerate(articles):
        root = ("main", "article", 'div role="main"', 'div class="x entry-content"', 'section id="content"')[k % 5]
        rows.append((k, "https://site.example/a/b/c.html", f"<html><head><title> T{k}\n x </title></head><body>{CHROME[k % len(CHROME)].format(x='noise')}"
                     f"<{root}>{''.join(a.markup)}</{root.split()[0]}><nav>more noise</nav></body></html>"))
    got = {r.page_id: r for r in extract_basic(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, a in enumerate(articles):
        assert got[k].title == f"T{k}\n x"
        assert got[k].markdown == "\n".join(a.lines), rows[k][2]


def test_text_beats_a_wall_of_links(spark):
    prose = "<p>" + " ".join(f"{n}, polished by hand," for n in NOUNS) + ".</p>"
    links = "".join(f"<div><a href='/{n}/{k}'>{n} {k}</a></div>" for n in NOUNS for k in range(5))
    html = f"<body><div class='content'>{links}</div><div class='product-detail'><h2>Catalogue</h2>{prose}</div></body>"
    r = extract_basic(spark.createDataFrame([(1, "https://e.org/", html)], "page_id long, url string, html string")).first()
    assert r.markdown.startswith("## Catalogue") and "/harbour/0" not in r.markdown


def test_quality_orders_texts(spark):
    varied = ". ".join(f"The {n} stands near the {m}" for n, m in zip(NOUNS, NOUNS[1:]))
    texts = [f"## Walk\n- {varied}", varied, varied + "\n" + "All rights reserved. Sign up! " * 3,
             "\n".join(["A line that is long enough to be counted as a repeat."] * 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    order = [r.k for r in df.orderBy(quality(F.col("t")).desc()).collect()]
    assert order[:2] == [0, 1]


@pytest.mark.parametrize("html, words, want", [
    ("<section id='app'></section>", 0, True), ("<section id='app'></section>", 399, True), ("<section id='app'></section>", 400, False),
    ("<p>plain</p>", 180, False), ("<p>plain</p>", 179, True), ("<SCRIPT></SCRIPT>" * 8, 249, True)])
def test_render_decision(spark, html, words, want):
    df = spark.createDataFrame([(html, "w " * words)], "html string, text string")
    f = shell_features(F.col("html"))
    assert df.select(needs_render(F.col("text"), f["has_marker"], f["script_count"], f["html_chars"]).alias("n")).first().n is want
