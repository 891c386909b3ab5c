"""Edge cases of FIXTURES section 3 with hand-computed expectations."""

from pyspark.sql import functions as F

from pagelift.functions.text import quality, with_quality
from pagelift.operators.candidates import weighted_top1
from pagelift.operators.markdown import extract_basic
from pagelift.operators.render import needs_render, shell_features


def _extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in extract_basic(df).collect()}


def test_nested_table_rows_and_cells_are_recursive(spark):
    got = _extract(spark, [
        (1, "https://e.org/", "<main><table><tr><td>A</td><td><table><tr><td>x</td></tr>"
                              "</table></td></tr></table></main>"),
        (2, "https://e.org/p", '<p><a href="/x"><img src="/i.png" alt="i"></a> text</p>'),
        (3, "https://e.org/t", "<html><head><title></title></head><body><p>b</p></body></html>"),
    ])
    assert got[1].markdown == "| A | x | x |\n| --- | --- | --- |\n| x |  |  |"
    assert got[2].markdown == "text"  # an image inside a link is lost
    assert got[3].title == "" and got[3].markdown == "b"


def test_quality_boundaries(spark):
    cases = {
        "a" * 41 + "\n" + "a" * 41: 2 + 50.0 - 40,
        "b" * 40 + "\n" + "b" * 40: 2 + 50.0,
        "x　y z": 3 + 100.0,
        "Straße STRASSE strasse": 3 + (1 / 3) * 100,
        "Accept Cookies and accept cookies. Sign up!": (7 + 4) + (6 / 7) * 100 - 240,
        "# h\n  - item\n* x\n| t |\n1. no": (11 + 4 * 8 + 2) + (10 / 11) * 100,
        "   ": 0.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (r.q, r.q2) for r in with_quality(df, "t", "q").select(
        "t", "q", quality(F.col("t")).alias("q2")).collect()}
    for text, want in cases.items():
        assert got[text][0] == want and got[text][1] == want, text


def test_render_thresholds(spark):
    def words(n):
        return " ".join(["word"] * n)
    shell = '<div id="app"></div>'
    scripts8 = "<script></script>" * 8
    big = "<html>" + "x" * 100_000 + "</html>"
    rows = [
        ("<p></p>", words(179), True), ("<p></p>", words(180), False),
        (shell, words(399), True), (shell, words(400), False),
        (scripts8, words(249), True), (scripts8, words(250), False),
        ("<script></script>" * 7, words(249), False),
        (big, words(300), True),           # 1,499 chars of text / 100,013 of html < 0.015
        (big, words(350), False),
        ("x" * 20_000, words(200), False),  # not over 20,000 chars
    ]
    df = spark.createDataFrame([(h, t) for h, t, _ in rows], "html string, text string")
    f = shell_features(F.col("html"))
    got = [r.n for r in df.select(needs_render(F.col("text"), f["has_marker"], f["script_count"],
                                               f["html_chars"]).alias("n")).collect()]
    assert got == [want for _, _, want in rows]


def test_twenty_word_floor_and_slot_ties(spark):
    w19 = " ".join(f"u{i}" for i in range(19))
    w20 = " ".join(f"v{i}" for i in range(20))
    df = spark.createDataFrame([(1, "short", w19), (2, "short", w20), (3, "same text here", "same text here"), (4, None, None)],
                               "page_id long, basic string, recall string")
    got = {r.page_id: (r.slot, r.text) for r in weighted_top1(df, ("recall",)).collect()}
    # 19 words: stand-in dropped; 20 words: kept and better; 3: too short to compete
    assert got == {1: ("basic", "short"), 2: ("recall", w20), 3: ("basic", "same text here"), 4: ("basic", "")}


def test_case_folding_is_that_of_the_standard_library(spark):
    from pagelift.functions.text import casefold
    texts = ["STRASSE Straße", "ΟΔΥΣΣΕΥΣ ὈΔΥΣΣΕΎΣ λόγος", "ﬁnd eﬀect ﬃ", "ſ µ ŉ ǰ", "İstanbul ISPARTA", "և ẖ ᾳ ᾲ", "Ünïcode", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(casefold("t").alias("f")).collect()] == [t.casefold() for t in texts]


def test_structure_lines_are_counted_once(spark):
    from pagelift.functions.text import structure_lines
    texts = ["# a\n\n\n  - b\r\n* c\nd # e\n|\u2028#f", "\n\n#", "a\n-", "--\n--", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [sum(x.lstrip().startswith(("#", "-", "*", "|")) for x in t.splitlines()) for t in texts]
    assert [r.n for r in df.select(structure_lines("t").alias("n")).collect()] == want
