"""Review items, validation, approval and the approval gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.urls import url_host, url_scheme
from ..plans.joins import join_hot
from ..session import run_table

# Request limits and defaults.
MAX_INSTRUCTIONS = 2_000
MAX_TITLE = 500
MAX_CONTENT = 200_000
UNTITLED = "Untitled page"
INSTRUCTIONS_TOO_LONG = "instructions: longer than 2000 characters"
REVIEW_FIELDS = ("url", "title", "method", "raw_text", "cleaned_text", "llm_used", "author",
                 "published_date", "description", "warning")


def merge_warnings(*cols: Column) -> Column:
    """A2: non-empty warnings joined by a space; none -> null."""
    arr = F.filter(F.array(*cols), lambda w: w.isNotNull() & (w != ""))
    return F.nullif(F.array_join(arr, " "), F.lit(""))


def http_url_ok(url: Column) -> Column:
    return url_scheme(url).isin("http", "https") & (url_host(url) != "")


def validate_approvals(approvals: DataFrame) -> DataFrame:
    """A3: adds ``reject_reason`` (null = valid): http(s) URL, title at most
    500 characters, content 1 to 200,000 characters and not blank."""
    url, title, content = F.col("url"), F.coalesce(F.col("title"), F.lit("")), F.col("content")
    reason = (F.when(~F.coalesce(http_url_ok(url), F.lit(False)), F.lit("url: not an http(s) URL"))
              .when(F.length(title) > MAX_TITLE, F.lit("title: longer than 500 characters"))
              .when(content.isNull() | (F.length(content) < 1), F.lit("content: empty"))
              .when(F.length(content) > MAX_CONTENT, F.lit("content: longer than 200000 characters"))
              .when(py_strip(content) == "", F.lit("content: blank")))
    return approvals.withColumn("reject_reason", reason)


def approve(approvals: DataFrame, *keep: str) -> DataFrame:
    """A4: valid approvals -> ``(url, status, title, content)`` and the columns to
    keep, title and content stripped, an empty title replaced by "Untitled page"."""
    valid = validate_approvals(approvals).filter(F.col("reject_reason").isNull())
    title = F.coalesce(F.nullif(py_strip(F.coalesce(F.col("title"), F.lit(""))), F.lit("")),
                       F.lit(UNTITLED))
    return valid.select("url", F.lit("approved").alias("status"), title.alias("title"),
                        py_strip("content").alias("content"), *keep)


def approval_gate(items: DataFrame, approvals: DataFrame,
                  salt_cols: tuple[str, ...] = ("page_id",)) -> tuple[DataFrame, DataFrame]:
    """A5: (approved, pending).  Only items with a valid approval leave; the
    approved text is the human's.  One approval per URL is kept -- the latest by
    ``approved_at`` where there is that column, ties by content -- so the join
    cannot multiply items.  These are written once.  Contents are repeated for no
    URL but one that very many items share, whose items would else meet in one
    task; who is pending is found from the URLs alone."""
    at = F.col("approved_at") if "approved_at" in approvals.columns else F.lit(None).cast("timestamp")
    ok = approve(approvals.withColumn("_at", at), "_at")
    one = run_table(ok.groupBy("url").agg(F.max(F.struct("_at", "content", "title")).alias("a")).select(
        "url", F.col("a.title").alias("approved_title"), F.col("a.content").alias("approved_content")), "approvals")
    approved = join_hot(items, one, "url", salt_cols)
    pending = join_hot(items, one.select("url"), "url", salt_cols, how="left_anti")
    return approved, pending


def byline(author: Column, published: Column) -> Column:
    """Author and date joined by " · ", empties skipped."""
    arr = F.filter(F.array(author, published), lambda v: v.isNotNull() & (v != ""))
    return F.array_join(arr, " · ")


def instructions_ok(instructions: Column) -> Column:
    """A3: request instructions at most 2,000 characters."""
    return F.coalesce(F.length(instructions) <= MAX_INSTRUCTIONS, F.lit(True))
