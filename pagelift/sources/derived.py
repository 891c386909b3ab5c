"""Auxiliary tables derived from the driver tables.

The fetcher, renderer, DNS and LLM endpoints are outside the engine; their
outputs arrive as tables.  For runs on the driver data these tables are derived
from the given tables, by a rule over all their rows:

* ``rendered_pages``: what a renderer would give for each page, by the length
  of its markup modulo 7 -- the same markup (0, 1), no copy at all (2), a
  failure (3), a copy at an address inside the network (4), or the markup with
  one more paragraph, ``MORE``, at its end (5, 6);
* ``fetched_pages``: how the fetch went, by the length modulo 11 -- HTTP 503
  (0), a body that is no HTML (1), else as requested -- and by the length modulo
  17 what it gave: a shell that scripts would fill (0 to 2), else the page;
* ``dns``: each page contributes one IPv4 address to its host, spread over the
  whole address space by a multiplicative hash of ``page_id`` (ids below 2^32);
* ``requests``: the requested pages with instructions, some of them too long;
* ``page_bodies``: the markup as bytes in one of several charsets;
* ``conversation_exchanges``: every user turn with the assistant turn after it,
  as a chat-completion response body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import guard_host

HASH_MULTIPLIER = 2654435761
#: A paragraph of 150 words, and the body that a page rendered in the browser gives to a plain fetch.
MORE = " ".join(f"more{k}." for k in range(150))
SHELL = '<html><head></head><body><div id="root"></div><script src="/app.js"></script></body></html>'
INSIDE = "http://10.0.0.5/copy"
#: Charsets of ``page_bodies``, by the length of the markup modulo their number.
CHARSETS = ("utf-8", "utf-16", "windows-1252", "no-such-charset", None)


def rendered_pages(pages: DataFrame) -> DataFrame:
    rule = F.length("html") % 7
    return pages.filter(rule != 2).select(
        "page_id", F.when(rule == 4, F.lit(INSIDE)).otherwise(F.col("url")).alias("url"),
        F.when(rule == 3, F.lit(None)).when(rule >= 5, F.concat("html", F.lit(f"<p>{MORE}</p>"))).otherwise(F.col("html")).alias("html"),
        F.when(rule == 3, F.lit("Headless browser rendering timed out.")).alias("render_error"))


def fetched_pages(pages: DataFrame) -> DataFrame:
    rule = F.length("html") % 11
    html = F.when(F.length("html") % 17 < 3, F.lit(SHELL)).otherwise(F.col("html"))
    return pages.select(
        "page_id", "url", html.alias("html"), F.when(rule == 0, F.lit("HTTP 503")).alias("fetch_error"),
        F.when(rule == 1, F.lit("application/pdf")).otherwise(F.lit("text/HTML; charset=utf-8")).alias("content_type"))


def dns(pages: DataFrame, *keep: str) -> DataFrame:
    h = (F.col("page_id") * F.lit(HASH_MULTIPLIER)) % F.lit(2 ** 32)
    quad = F.concat_ws(".", *[(F.floor(h / F.lit(256 ** k)) % 256).cast("string")
                              for k in (3, 2, 1, 0)])
    return pages.select(guard_host("url").alias("host"), quad.alias("address"), *keep)


def requests(pages: DataFrame) -> DataFrame:
    rule = F.length("html") % 13
    return pages.select("page_id", F.when(rule == 0, F.repeat(F.lit("x"), 2001)).when(rule < 7, F.lit("Keep prices.")).alias("instructions"))


def page_bodies(pages: DataFrame) -> DataFrame:
    rule = F.length("html") % len(CHARSETS)
    name, body = F.lit(None).cast("string"), F.encode("html", "UTF-8")
    for k, charset in enumerate(CHARSETS):
        name = F.when(rule == k, F.lit(charset)).otherwise(name)
    body = F.when(rule == 1, F.encode("html", "UTF-16")).otherwise(body)
    # a byte that no UTF-8 text holds ends every body in a one-byte charset
    return pages.select("page_id", "url", name.alias("charset"), F.when(rule == 1, body).otherwise(F.concat(body, F.lit(b"\xff"))).alias("body"))


def conversation_exchanges(conversations: DataFrame) -> DataFrame:
    """Every user turn, keyed ``(conv_id, turn)``: its text, and the reply if the next turn is the assistant's."""
    after = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = (conversations.select("conv_id", "turn", "role", "text")
         .withColumn("next_role", F.lead("role").over(after)).withColumn("next_text", F.lead("text").over(after))
         .filter(F.col("role") == "user"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.lit("assistant").alias("role"), F.col("next_text").alias("content")).alias("message"))).alias("choices")))
    answered = F.coalesce(F.col("next_role") == "assistant", F.lit(False)) & F.col("next_text").isNotNull()
    return c.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("page_id"), F.col("text").alias("raw_text"),
                    F.when(answered, body).alias("body"), F.when(~answered, F.lit("no reply")).alias("error"))
