"""M1/M2: author, description and published date from a page's metadata elements.

A native stand-in for the external metadata extractor, as expressions on the
page row: each field takes the first source in priority order that has a value
(for dates: one that is a date), and within a source the first element in
document order.  The date is reduced to ``yyyy-MM-dd``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_ws
from .nodes import page_trees

# ours: sources per field, in priority order: (attribute, attribute value)
AUTHOR_SOURCES = (("name", "author"), ("property", "article:author"))
DESCRIPTION_SOURCES = (("name", "description"), ("property", "og:description"))
DATE_SOURCES = (("property", "article:published_time"),)


def _values(attribute: str, value: str) -> Column:
    """Non-empty contents of the meta elements of one source, in document order."""
    hits = F.filter("metas", lambda m: F.lower(F.coalesce(m[attribute], F.lit(""))) == value)
    return F.filter(F.transform(hits, lambda m: collapse_ws(F.coalesce(m["content"], F.lit("")))), lambda v: v != "")


def _day(value: Column) -> Column:
    return F.date_format(F.coalesce(F.try_to_date(value), F.try_to_date(F.substring(value, 1, 10))), "yyyy-MM-dd")


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def metadata() -> list[Column]:
    """``author``, ``published_date`` and ``description`` of a page row."""
    first = lambda sources: F.coalesce(*(_first(_values(*s)) for s in sources))
    days = F.concat(*(_values(*s) for s in DATE_SOURCES), F.transform(F.coalesce("times", F.expr("cast(array() as array<string>)")), F.trim))
    return [first(AUTHOR_SOURCES).alias("author"),
            _first(F.filter(F.transform(days, _day), lambda d: d.isNotNull())).alias("published_date"),
            first(DESCRIPTION_SOURCES).alias("description")]


def page_metadata(pages: DataFrame) -> DataFrame:
    """``(page_id, author, published_date, description)`` per page."""
    return page_trees(pages.select("page_id", "html")).select("page_id", *metadata())
