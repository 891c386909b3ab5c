"""Tag soup never breaks the extraction: one row per page, no task errors."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagelift.operators.candidates import extract_readable
from pagelift.operators.metadata import page_metadata

TAGS = ["p", "div", "li", "ul", "ol", "h2", "b", "a", "img", "table", "tr", "td", "th", "pre",
        "blockquote", "main", "article", "nav", "script", "br", "span", "em", "code", "body",
        "title", "meta", "time"]
ATTRS = ['', ' class="content"', ' href="../x?y=1#z"', ' src="/i.png" alt="A"', ' start="3"',
         ' id="main-content"', ' role="main"', ' data-src="data:x"', ' name="author" content="Q"',
         ' datetime="2021-02-03"', ' href="javascript:void(0)"']
WORDS = ["alpha", "beta,", "gamma.", "&amp;", "&#xe9;", "  ", "\n", "ß", "“q”", "<!-- c -->",
         "<![CDATA[d]]>", "</p>", "</b>", "<br/>", "　"]


def soup(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        r = rng.random()
        if r < 0.45:
            out.append(f"<{rng.choice(TAGS)}{rng.choice(ATTRS)}>")
        elif r < 0.65:
            out.append(f"</{rng.choice(TAGS)}>")
        else:
            out.append(rng.choice(WORDS))
    return "".join(out)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(min_value=0, max_value=2**31))
def test_tag_soup_extracts(spark, seed):
    rng = random.Random(seed)
    pages = [(i, f"https://e{i % 3}.example/a/b", soup(rng, rng.randint(0, 120))) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = extract_readable(df).collect()
    assert sorted(r.page_id for r in rows) == list(range(40))
    page_metadata(df).collect()
