"""R2-R7, L1-L5, A1-A7 and the full flow on hand-written pages."""

from dataclasses import replace

from pyspark.sql import functions as F

from pagelift.config import DEFAULT
from pagelift.operators import cleanup, review
from pagelift.operators.render import needs_render, shell_features
from pagelift.plans.pipeline import ENHANCE_WARNING, FALLBACK_WARNING, NO_CONTENT, scrape

WORDS = " ".join(f"w{i}." for i in range(300))
RICH = f"<html><head><title>Rich</title></head><body><main><p>{WORDS}</p></main></body></html>"
THIN = "<html><head><title>Thin</title></head><body><main><p>just a few words</p></main></body></html>"
SHELL = "<body><p>Loading</p><section id='app'></section></body>"


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, fetch_error string")


def test_needs_render_rules(spark):
    df = spark.createDataFrame([(SHELL, ""), (RICH, WORDS), ("<p>x</p>" * 10, "one two")],
                               "html string, text string")
    f = shell_features(F.col("html"))
    got = [r.n for r in df.select(needs_render(F.col("text"), f["has_marker"], f["script_count"],
                                               f["html_chars"]).alias("n")).collect()]
    assert got == [True, False, True]


def test_scrape_flow_invariants(spark):
    pages = _pages(spark, [
        (1, "https://good.example/rich", RICH, None),
        (2, "https://good.example/thin", THIN, None),      # needs render, copy not better
        (3, "https://good.example/down", None, "HTTP 503"),  # fallback to rendered copy
        (4, "http://bad.example/", RICH, None),            # private address
        (5, "https://good.example/empty", "<html><body></body></html>", None),
        (6, "https://good.example/upgrade", THIN, None),    # rendered copy much better
    ])
    rendered = spark.createDataFrame([
        (2, "https://good.example/thin", THIN, None),
        (3, "https://good.example/down", RICH, None),
        (5, "https://good.example/empty", None, "timeout"),
        (6, "https://good.example/upgrade", RICH, None),
    ], "page_id long, url string, html string, render_error string")
    dns = spark.createDataFrame([("good.example", "93.184.216.34"), ("bad.example", "10.0.0.7")],
                                "host string, address string")
    res = scrape(spark, pages, rendered, dns)
    items = {r.page_id: r for r in res.items.collect()}
    rejected = {r.page_id: r for r in res.rejected.collect()}
    assert set(items) | set(rejected) == {1, 2, 3, 4, 5, 6}
    assert not set(items) & set(rejected)
    assert items[1].method == "http" and items[1].warning.startswith("LLM cleanup is not configured")
    assert items[2].method == "http" and items[2].title == "Thin"
    assert items[3].method == "browser" and items[3].warning.startswith(FALLBACK_WARNING + "HTTP 503")
    assert items[6].method == "browser" and items[6].title == "Rich"
    assert rejected[4].status == 400
    assert rejected[5].status == 502 and rejected[5].detail.endswith("timeout")
    assert items[1].cleaned_text == items[1].raw_text and items[1].llm_used is False


def test_enhancement_failure_keeps_text_with_warning(spark):
    pages = _pages(spark, [(1, "https://good.example/thin", THIN, None),
                           (2, "https://good.example/blank", "<p></p>", None)])
    rendered = spark.createDataFrame([(1, "https://good.example/thin", None, "crashed")],
                                     "page_id long, url string, html string, render_error string")
    dns = spark.createDataFrame([("good.example", "93.184.216.34")], "host string, address string")
    res = scrape(spark, pages, rendered, dns)
    items = {r.page_id: r for r in res.items.collect()}
    rejected = {r.page_id: r for r in res.rejected.collect()}
    assert items[1].warning.startswith(ENHANCE_WARNING + "crashed")
    assert rejected[2].status == 502


def test_cleanup_requests_and_merge(spark):
    cfg = replace(DEFAULT, llm_api_key="k", max_llm_input_chars=10)
    texts = {1: "0123456789abc", 2: "text two", 3: "one\ntwo\nthree four five", 4: "text four", 5: "text five", 6: ""}
    items = spark.createDataFrame([(k, v, "Be kind." if k == 2 else None) for k, v in texts.items()], "page_id long, raw_text string, wish string")
    req = cleanup.cleanup_requests(items, cfg, instructions="wish").collect()
    sent = {}
    for r in sorted(req, key=lambda r: (r.page_id, r.part)):
        import json
        body = json.loads(r.request)
        prompt = body["messages"][1]["content"]
        assert body["temperature"] == 0.1 and ("Be kind." in prompt) == (r.page_id == 2)
        sent.setdefault(r.page_id, []).append(prompt.split("Extracted page:\n", 1)[1])
        assert r.n_parts == len([x for x in req if x.page_id == r.page_id])
    assert {k: "".join(v) for k, v in sent.items()} == texts  # no character is lost
    assert all(len(part) <= 10 for v in sent.values() for part in v)
    assert sent[3][0] == "one\ntwo\n"  # cut at a line break in the second half
    reply = lambda text: '{"choices":[{"message":{"content":"%s"}}]}' % text
    resp = spark.createDataFrame([
        (1, 1, reply("  tail  "), None), (1, 0, reply("head,"), None),
        (2, 0, reply("   "), None), (3, 0, "not json", None), (3, 1, reply("x"), None), (4, 0, None, "HTTP 500"),
    ], "page_id long, part int, body string, error string")
    got = {r.page_id: r for r in cleanup.merge_cleanup(items, resp, cfg).collect()}
    assert (got[1].cleaned_text, got[1].llm_used, got[1].llm_warning) == ("head,tail", True, None)
    assert (got[2].cleaned_text, got[2].llm_used) == ("text two", True)
    assert got[3].cleaned_text.startswith("one\ntwo\nx") and got[3].llm_used
    assert got[3].llm_warning == cleanup.FAILED_PREFIX + "unreadable reply; no reply"
    assert got[4].llm_warning == cleanup.FAILED_PREFIX + "HTTP 500" and got[4].llm_used is False
    assert got[5].llm_used is False and got[5].cleaned_text == "text five"
    passthrough = cleanup.merge_cleanup(items, None, DEFAULT).collect()
    assert all(r.cleaned_text == r.raw_text and r.llm_warning == cleanup.NOT_CONFIGURED
               for r in passthrough)


def test_large_pages_and_unsafe_copies(spark):
    cfg = replace(DEFAULT, max_download_bytes=len(RICH) - 1)
    pages = _pages(spark, [(1, "https://good.example/big", RICH, None), (2, "https://good.example/gone", None, "HTTP 404"),
                           (3, "https://good.example/none", None, "HTTP 404"), (4, "https://good.example/thin", THIN, None)])
    rendered = spark.createDataFrame([
        (1, "https://good.example/big", RICH, None), (2, "http://10.0.0.9/x", RICH, None), (4, "http://10.0.0.9/y", RICH, None),
    ], "page_id long, url string, html string, render_error string")
    dns = spark.createDataFrame([("good.example", "93.184.216.34")], "host string, address string")
    asked = spark.createDataFrame([(1, "Keep all."), (4, "y" * 2001)], "page_id long, instructions string")
    res = scrape(spark, pages, rendered, dns, cfg, requests=asked)
    items = {r.page_id: r for r in res.items.collect()}
    rejected = {r.page_id: r for r in res.rejected.collect()}
    assert set(items) == {1} and items[1].method == "browser" and items[1].title == "Rich"  # served from its copy
    assert rejected[2].status == 400 and rejected[3].status == 502 and rejected[4].status == 422
    (request,) = res.requests.collect()
    assert request.page_id == 1 and "Keep all." in request.request


def test_latest_approval_counts(spark):
    items = spark.createDataFrame([(1, "https://a.example/1")], "page_id long, url string")
    approvals = spark.createDataFrame([("https://a.example/1", "t", "aaa old", 1), ("https://a.example/1", "t", "zzz older", 0),
                                       ("https://a.example/1", "t", "  new ", 2), ("https://a.example/1", "t", " ", 3)],
                                      "url string, title string, content string, s long")
    approvals = approvals.withColumn("approved_at", F.timestamp_seconds("s")).drop("s")
    approved, _ = review.approval_gate(items, approvals)
    assert [r.approved_content for r in approved.collect()] == ["new"]


def test_bodies_decode_as_declared(spark):
    from pagelift.sources.tables import decoded_pages
    cases = [("é€".encode("utf-8"), None, "é€"), ("é".encode("windows-1252") + b"\x80", "windows-1252", "é€"), (b"a\xffb", "us-ascii", "a\ufffdb"),
             ("ж".encode("koi8-r"), "KOI8-R", "ж"), (b"\xff\xfeA\x00B", "utf-16", "A\ufffd"), (b"x\xc3", "no-such", "x\ufffd"), (b"hi", "base64", "hi"), (None, "utf-8", None), (b"", None, "")]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None, c) for k, (b, c, _) in enumerate(cases)], "page_id long, body binary, charset string")
    got = {r.page_id: (r.html, r.n_bytes) for r in decoded_pages(df).collect()}
    for k, (body, _, want) in enumerate(cases):
        assert got[k] == (want, None if body is None else len(body))


def test_review_validation_gate_and_byline(spark):
    approvals = spark.createDataFrame([
        ("https://a.example/1", "  Title  ", " body "),
        ("https://a.example/2", "", "body"),
        ("https://a.example/3", "x" * 501, "body"),
        ("https://a.example/4", "ok", "   "),
        ("ftp://a.example/5", "ok", "body"),
        ("https://a.example/6", "ok", "y" * 200_001),
    ], "url string, title string, content string")
    reasons = {r.url: r.reject_reason for r in review.validate_approvals(approvals).collect()}
    assert reasons["https://a.example/1"] is None and reasons["https://a.example/2"] is None
    assert reasons["https://a.example/3"].startswith("title")
    assert reasons["https://a.example/4"] == "content: blank"
    assert reasons["ftp://a.example/5"].startswith("url")
    assert reasons["https://a.example/6"].startswith("content: longer")
    ok = {r.url: r for r in review.approve(approvals).collect()}
    assert (ok["https://a.example/1"].title, ok["https://a.example/1"].content) == ("Title", "body")
    assert ok["https://a.example/2"].title == "Untitled page"
    items = spark.createDataFrame([(1, "https://a.example/1"), (9, "https://a.example/9")],
                                  "page_id long, url string")
    approved, pending = review.approval_gate(items, approvals)
    assert [r.page_id for r in approved.collect()] == [1]
    assert [r.page_id for r in pending.collect()] == [9]
    df = spark.createDataFrame([("Ann", "2024-01-02"), ("", "2024-01-02"), (None, None)],
                               "a string, d string")
    assert [r.b for r in df.select(review.byline(F.col("a"), F.col("d")).alias("b")).collect()] == [
        "Ann · 2024-01-02", "2024-01-02", ""]
    w = spark.createDataFrame([("a", None), ("", "b"), (None, None)], "x string, y string")
    assert [r.m for r in w.select(review.merge_warnings(F.col("x"), F.col("y")).alias("m"))
            .collect()] == ["a", "b", None]
