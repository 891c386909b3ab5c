"""D1-D21, Q8-Q10, C1 on hand-written pages with exact expected Markdown."""

import pytest

from pagelift.operators.markdown import extract_basic


def run(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = extract_basic(df)
    return {r.page_id: r for r in out.collect()}


def one(spark, html, url="https://example.com/page"):
    return run(spark, [(1, url, html)])[1]


def test_chrome_removed_main_wins(spark):
    r = one(spark, """<html><head><title> Trail notes </title></head><body>
      <header>Site banner</header><nav><a href="/">Home</a></nav>
      <main><h2>Spring hike</h2><p>The river was high after the melt.</p></main>
      <aside>Related links</aside><script>track()</script><footer>(c) 2024</footer>
    </body></html>""")
    assert r.title == "Trail notes"
    assert r.markdown == "## Spring hike\nThe river was high after the melt."


def test_lists_headings_and_numbering(spark):
    r = one(spark, """<body><article>
      <h1>Setup</h1><p>Before you start, read this.</p>
      <ul><li>Fast <b>disk</b></li><li>Quiet room<ul><li>no fans</li></ul></li></ul>
      <ol start="5"><li>Plug in</li><li>Switch on</li><li>Plug in</li></ol>
    </article></body>""")
    assert r.markdown == "\n".join([
        "# Setup", "Before you start, read this.",
        "- Fast **disk**", "- Quiet room", "  - no fans",
        "5. Plug in", "6. Switch on", "5. Plug in",
    ])


def test_table_padded_with_header_rule(spark):
    r = one(spark, """<main><h1>Prices</h1><table>
      <tr><th>Item</th><th>Cost</th><th>Note</th></tr>
      <tr><td>Tea</td><td>2</td></tr><tr></tr><tr><td> Cake  slice </td><td>3</td><td>new</td></tr>
    </table></main>""")
    assert r.markdown == "\n".join([
        "# Prices", "| Item | Cost | Note |", "| --- | --- | --- |",
        "| Tea | 2 |  |", "| Cake slice | 3 | new |"])


def test_images_and_links_resolved(spark):
    r = one(spark, """<html><head><title>Photos</title></head><body><article>
      <p>See <a href="../gallery/">the gallery</a> and <a href="">nothing</a>.</p>
      <img data-src="img/a.jpg" src="" alt=" A  lake ">
      <img src="data:image/png;base64,xx" alt="inline">
      <p><img src="/b.png" alt="B"> inline image</p>
    </article></body></html>""", url="https://example.com/trips/2024/report.html")
    assert r.markdown == "\n".join([
        "See [the gallery](https://example.com/trips/gallery/) and nothing.",
        "![A lake](https://example.com/trips/2024/img/a.jpg)",
        "![B](https://example.com/b.png) inline image"])


def test_link_heavy_sidebar_loses(spark):
    links = "".join(f"<a href='/tag/{i}'>Tag {i}</a> " for i in range(60))
    r = one(spark, f"""<body><div class="post-content"><h1>Review</h1>
      <p>The lamp is bright, sturdy and easy to adjust for reading at night.</p></div>
      <div class="tags">{links}</div></body>""")
    assert r.markdown == ("# Review\nThe lamp is bright, sturdy and easy to adjust for "
                          "reading at night.")


def test_pre_blockquote_and_repeats(spark):
    r = one(spark, """<body><div id="content">
      <p>Same line</p><p>Same line</p>
      <pre>  x = 1
  y = 2  </pre>
      <blockquote><p>First said</p>then more</blockquote>
      <h3></h3><p>  </p>
    </div></body>""")
    assert r.markdown == "\n".join([
        "Same line", "```\nx = 1\n  y = 2\n```", "> First said\n> then more",
        "First said", "### "])


def test_unclosed_paragraph_bold_nests(spark):
    r = one(spark, "<article><h1>T</h1><p><b>Lead text<br><p>Second para.</p>"
                   "<p>Third para.</p></article><p>after</p>")
    assert r.markdown == "# T\n**Lead text Second para. Third para.**"


def test_no_body_no_root_uses_document(spark):
    r = one(spark, "<p>Just a fragment</p><p>and another</p>")
    assert r.title == "Untitled page"
    assert r.markdown == "Just a fragment\nand another"


def test_empty_page(spark):
    r = one(spark, "")
    assert (r.title, r.markdown, r.quality) == ("Untitled page", "", 0.0)


def test_comment_in_paragraph_kept_as_text(spark):
    r = one(spark, "<main><p>one <!-- two --> three</p></main>")
    assert r.markdown == "one two three"


def test_metadata_fields(spark):
    from pagelift.operators.metadata import page_metadata
    html = """<html><head><title>Trip</title>
      <meta property="og:description" content="Fallback text">
      <meta name="Description" content="  A weekend on the  coast. ">
      <meta property="article:author" content="Second Choice">
      <meta name="author" content="R. Walker">
      <meta property="article:published_time" content="2023-11-05T08:30:00Z">
    </head><body><article><p>Body text.</p></article></body></html>"""
    df = spark.createDataFrame([(1, "https://e.org/t", html),
                                (2, "https://e.org/u", "<body><time datetime='2022-02-03'>x</time></body>"),
                                (3, "https://e.org/v", "<p>none</p>")],
                               "page_id long, url string, html string")
    got = {r.page_id: r for r in page_metadata(df).collect()}
    assert (got[1].author, got[1].published_date, got[1].description) == (
        "R. Walker", "2023-11-05", "A weekend on the coast.")
    assert (got[2].author, got[2].published_date, got[2].description) == (None, "2022-02-03", None)
    assert (got[3].author, got[3].published_date, got[3].description) == (None, None, None)


def test_candidates_prefer_longer_clean_text(spark):
    from pagelift.operators.candidates import extract_readable
    para = " ".join(f"word{i}" for i in range(30)) + "."
    html = f"""<body><div class="content"><h1>Head</h1><p>short intro.</p></div>
      <div><p>{para}</p><p>{para} again</p></div></body>"""
    df = spark.createDataFrame([(1, "https://e.org/", html)], "page_id long, url string, html string")
    r = extract_readable(df).collect()[0]
    assert r.slot in ("basic", "recall", "precision", "density")
    assert "again" in r.text and r.title == "Untitled page"


def test_equal_items_share_a_number_however_their_class_is_spaced(spark):
    r = one(spark, """<main><ol><li class="a b">One</li><li>Two</li><li class="a  b">One</li></ol></main>""")
    assert r.markdown == "1. One\n2. Two\n1. One"


def test_empty_sources_fall_through_to_the_next(spark):
    from pagelift.operators.metadata import page_metadata
    html = """<meta name="author" content=""><meta property="article:author" content="Ann Lee">
      <meta name="description" content="  "><meta property="og:description" content="Short.">
      <meta property="article:published_time" content="soon"><time datetime="2020-09-08T10:00">then</time>"""
    df = spark.createDataFrame([(1, "https://e.org/", html)], "page_id long, url string, html string")
    r = page_metadata(df).first()
    assert (r.author, r.published_date, r.description) == ("Ann Lee", "2020-09-08", "Short.")


def test_deep_nesting_is_linear(spark):
    import time

    from pagelift.operators.nodes import page_tree, parse_html
    times = []
    for n in (50_000, 200_000):
        start = time.process_time()
        nodes, error = parse_html("<p>" + "<b>" * n + "deep" + "</i>" * 10)
        tree = page_tree(nodes)
        times.append(time.process_time() - start)
        assert error is None and len(nodes) == n + 2 and tree["strings"] == ["deep"]
        assert sum(len(b["kids"] or ()) for b in tree["blocks"]) == 1
    assert times[1] < 12 * times[0] + 1
    r = one(spark, "<p>" + "<b>" * 20_000 + "deep")
    assert r.markdown == "**deep**"


def test_refused_markup_is_told(spark):
    from pagelift.operators import nodes
    from pagelift.operators.candidates import readable

    def refuse(self, data):
        raise AssertionError("unknown declaration")

    old = nodes._TreeBuilder.handle_decl
    nodes._TreeBuilder.handle_decl = refuse
    try:
        df = spark.createDataFrame([(1, "u", "<!DOCTYPE html><p>x"), (2, "u", "<p>y")], "page_id long, url string, html string")
        got = {r.page_id: (r.parse_error, r.text) for r in readable(df).select("page_id", "parse_error", "text").collect()}
    finally:
        nodes._TreeBuilder.handle_decl = old
    assert got == {1: ("The markup could not be parsed: unknown declaration", ""), 2: (None, "y")}


def test_no_shuffle_in_the_extraction(spark):
    from pagelift.operators.candidates import extract_readable
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = extract_readable(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
