"""The whole scrape flow over a table of pages.

pages --S2 admission, U1/U2--> extraction of the fetched html (a projection), written once
      --U3/U4 guard--> R2: which pages want a rendered copy
      --> extraction of those copies (a projection of a filtered scan), written once --> their guard
      --> R3-R6: the choice, on ids, flags and qualities
      --> the chosen text with M1/M2 --> L2 requests, L4/L5 merge --> A1/A2
and the rejections (R7) as a second table.

Html is never shuffled: both extractions are projections of a scan; the scan of
the copies is filtered by a broadcast table of bits over the wanted ids.  What is
guarded, joined and decided holds no text; texts are joined last, once, to the
rows that are given out.  Each row of ``pages`` is a request of its own, under a
row number given where it is read, so a repeated page id gives one result per
row.  Of several copies of a page the first counts that is safe, rendered without
an error, and has the smallest URL and text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, JobConfig
from ..functions.urls import local_host, scheme_host_ok
from ..operators.admission import admit
from ..operators.candidates import readable
from ..operators.cleanup import cleanup_requests, merge_cleanup
from ..operators.guard import guard_urls
from ..operators.metadata import metadata
from ..operators.render import UPGRADE_FACTOR, needs_render, shell_features
from ..operators.review import INSTRUCTIONS_TOO_LONG, REVIEW_FIELDS, instructions_ok, merge_warnings
from ..session import run_table
from .joins import may_match

# Warning and error texts.
FALLBACK_WARNING = "Direct download failed, so the browser renderer was used: "
ENHANCE_WARNING = "Browser enhancement failed, so the direct HTML extraction was retained: "
NO_CONTENT = "No readable content was found on this page."
NO_COPY = "No rendered copy is available."
PROCESS_ERROR = "Could not process page: "


@dataclass
class ScrapeResult:
    items: DataFrame      # A1: page_id + the ten review fields
    rejected: DataFrame   # R7: page_id, url, status, detail
    requests: DataFrame   # L2: one cleanup request per part of an item's text


def _column(pages: DataFrame, name: str, kind: str, other=None):
    return F.col(name) if name in pages.columns else (F.lit(None).cast(kind) if other is None else other)


_TEXTS = ("url", "title", "text", "author", "published_date", "description")


def _extracted(pages: DataFrame) -> DataFrame:
    return readable(pages).select("*", *metadata())


def _fetched(pages: DataFrame, cfg: JobConfig) -> DataFrame:
    """Pass 1, a projection of the page scan: the text of each page, null where the row itself rules it out."""
    html_size = F.octet_length("html").cast("long")
    p = pages.select(
        "page_id", F.col("url").alias("requested"), _column(pages, "final_url", "string", F.col("url")).alias("url"),
        _column(pages, "fetch_error", "string").alias("fetch_error"),
        *([F.col("content_type")] if "content_type" in pages.columns else []),
        _column(pages, "n_bytes", "long", html_size).alias("n_bytes"), "html")
    public = scheme_host_ok("requested") & ~local_host("requested") & scheme_host_ok("url") & ~local_host("url")
    p = admit(p, cfg).withColumn("fetch_fail", F.coalesce("fetch_error", "reject_reason"))
    p = p.withColumn("parsed", F.col("fetch_fail").isNull() & F.coalesce(public, F.lit(False)))
    own = p.select("page_id", "requested", "url", "fetch_fail", "parsed", F.when(F.col("parsed"), F.col("html")).alias("html"))
    own = own.select("*", *[c.alias(n) for n, c in shell_features("html").items()])
    needs = needs_render(F.col("text"), F.col("has_marker"), F.col("script_count"), F.col("html_chars"))
    kept = lambda c: F.when(F.col("parsed"), F.col(c)).alias(c)
    return _extracted(own).select(
        F.monotonically_increasing_id().alias("row"), "page_id", "requested", "fetch_fail", "parse_error", "url",
        *(kept(c) for c in (*_TEXTS[1:], "quality")), (F.col("parsed") & F.coalesce(needs, F.lit(False))).alias("needs"))


def _rendered(rendered: DataFrame | Callable[[DataFrame], DataFrame], wanted: DataFrame) -> DataFrame:
    """Pass 2, a projection of the filtered scan of the copies."""
    columns = ("page_id", "url", "html", "render_error")
    copies = rendered(wanted).select(*columns) if callable(rendered) else may_match(rendered.select(*columns), "page_id", wanted)
    return _extracted(copies).select(F.monotonically_increasing_id().alias("copy"), "page_id", *_TEXTS, "quality",
                                     F.coalesce("render_error", "parse_error").alias("r_error"))


def _best_copies(second: DataFrame, dns: DataFrame) -> DataFrame:
    """One copy per page, without its text."""
    narrow = second.select("copy", "page_id", F.col("url").alias("r_url"), F.col("quality").alias("r_quality"), "r_error",
                           (F.col("text") == "").alias("r_bare"), F.xxhash64("text").alias("mark"))
    narrow = guard_urls(narrow, {"r_url": "r_unsafe"}, dns, salt_cols=("copy",))
    first = F.struct(F.col("r_unsafe").isNotNull(), F.col("r_error").isNotNull(), "r_url", "mark", "copy")
    best = F.min_by(F.struct("copy", "r_quality", "r_error", "r_bare", "r_unsafe"), first)
    return narrow.groupBy("page_id").agg(best.alias("c")).select("page_id", "c.*")


def scrape(spark: SparkSession, pages: DataFrame, rendered: DataFrame | Callable[[DataFrame], DataFrame], dns: DataFrame,
           cfg: JobConfig = DEFAULT, llm_responses: DataFrame | None = None,
           requests: DataFrame | None = None) -> ScrapeResult:
    """``pages(page_id, url, html[, final_url, fetch_error, content_type, n_bytes])`` to review items.

    ``requests(page_id, instructions)`` may name the instructions of a page's
    cleanup; a page whose instructions are too long is rejected (422).  ``rendered``
    may be a function of the wanted page ids that gives the copies of these pages."""
    first = run_table(_fetched(pages, cfg), "scrape-fetched")

    # U1-U5 of the requested and the final URL, on a narrow table
    narrow = first.select("row", "page_id", "requested", F.col("url").alias("final_url"), F.coalesce("fetch_fail", "parse_error").alias("fail"),
                          "needs", "quality", (F.coalesce("text", F.lit("")) == "").alias("bare"))
    narrow = guard_urls(narrow, {"requested": "own_unsafe", "final_url": "final_unsafe"}, dns, salt_cols=("row",))
    unsafe, enabled = F.coalesce("own_unsafe", "final_unsafe"), F.lit(cfg.enable_browser_fallback)
    wants = unsafe.isNull() & enabled & (F.col("fail").isNotNull() | F.col("needs"))
    state = run_table(narrow.select("row", "page_id", "requested", "fail", "quality", "bare", unsafe.alias("unsafe"), wants.alias("wants")), "scrape-guard")

    # rendered copies of the pages that want one
    second = run_table(_rendered(rendered, state.filter("wants").select("page_id").distinct()), "scrape-rendered")
    j = state.join(_best_copies(second, dns), "page_id", "left")

    no_copy = F.when(F.col("copy").isNull(), F.lit(NO_COPY))
    r_error = F.coalesce("r_unsafe", "r_error", no_copy)
    fail, wants, unsafe = F.col("fail"), F.col("wants"), F.col("unsafe")
    r_ok = wants & r_error.isNull()
    better = F.col("r_quality") > F.col("quality") * UPGRADE_FACTOR
    browser = r_ok & F.when(fail.isNotNull(), F.lit(True)).otherwise(F.coalesce(better, F.lit(False)))
    error = (F.when(unsafe.isNotNull(), unsafe)
             .when(fail.isNotNull() & ~enabled, fail)
             .when(fail.isNotNull() & ~r_ok, r_error)
             .when(fail.isNull() & wants & ~r_ok & F.col("bare"), r_error)
             .when(F.when(browser, F.col("r_bare")).otherwise(F.col("bare")), F.lit(NO_CONTENT)))  # R6
    # an unsafe copy of a page that has nothing else is an unsafe URL, like the page's own
    refused = F.when(unsafe.isNotNull(), unsafe).when(error.isNotNull(), F.when(wants, F.col("r_unsafe")))
    warning = (F.when(fail.isNotNull() & r_ok, F.concat(F.lit(FALLBACK_WARNING), fail))
               .when(fail.isNull() & wants & ~r_ok, F.concat(F.lit(ENHANCE_WARNING), r_error)))
    j = j.select("row", "page_id", "requested", F.when(browser, F.col("copy")).alias("copy"), F.when(browser, "browser").otherwise("http").alias("method"),
                 error.alias("error"), refused.alias("refused"), warning.alias("page_warning"))
    if requests is not None:
        j = j.join(requests.groupBy("page_id").agg(F.max("instructions").alias("instructions")), "page_id", "left")
    else:
        j = j.withColumn("instructions", F.lit(None).cast("string"))
    j = run_table(j.withColumn("bad_request", F.when(~instructions_ok(F.col("instructions")), F.lit(INSTRUCTIONS_TOO_LONG))), "scrape-chosen")

    # texts, once, of what is given out
    ok = j.filter(F.col("error").isNull() & F.col("bad_request").isNull()).select("row", "page_id", "copy", "method", "page_warning", "instructions")
    http = ok.filter("copy is null").join(first.select("row", *_TEXTS), "row")
    browser = ok.filter("copy is not null").join(second.select("copy", *_TEXTS), "copy")
    ok = http.unionByName(browser).withColumnRenamed("text", "raw_text").drop("row", "copy")
    items = merge_cleanup(ok, llm_responses, cfg).withColumn("warning", merge_warnings(F.col("page_warning"), F.col("llm_warning")))
    rejected = j.filter(F.col("error").isNotNull() | F.col("bad_request").isNotNull()).select(
        "page_id", F.col("requested").alias("url"),
        F.when(F.col("bad_request").isNotNull(), 422).when(F.col("refused").isNotNull(), 400).otherwise(502).alias("status"),
        F.when(F.col("bad_request").isNotNull(), F.col("bad_request")).when(F.col("refused").isNotNull(), F.col("refused"))
        .otherwise(F.concat(F.lit(PROCESS_ERROR), F.col("error"))).alias("detail"))
    return ScrapeResult(items.select("page_id", *REVIEW_FIELDS), rejected, cleanup_requests(ok, cfg, instructions="instructions"))
