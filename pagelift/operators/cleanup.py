"""LLM cleanup as batch tables (the HTTP call itself stays outside).

A page's text is cut into parts of at most ``max_llm_input_chars`` characters,
at a line break where there is one in the second half of a part; no character
is left out.  ``cleanup_requests`` builds one chat request per part, keyed
``(page_id, part)``; an external batch client answers into
``llm_responses(page_id, part, body, error)``; ``merge_cleanup`` puts the
replies together in order.  A part without a usable reply keeps its own text
and gives a warning.  Without a configured key, text passes through with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, JobConfig
from ..functions.text import py_strip

# Our own instructions for the cleanup model.
SYSTEM_PROMPT = (
    "Input: one part of a web page as Markdown, made by an extractor, which a reviewer will read next.\n"
    "Task: hand back the same part, made readable. What a reader came for stays word for word, "
    "in place, with its links and its Markdown marks; join lines that were cut in mid-sentence. "
    "Lines that serve the site and not the text (menus, consent notices, adverts, sharing, repeats) go. "
    "Output: Markdown only, nothing of your own before, after or in between."
)
# Fixed value: the instructions of a request that names none.
DEFAULT_INSTRUCTIONS = ("Extract the useful information and remove navigation, ads, "
                        "and repeated boilerplate.")
TEMPERATURE = 0.1
# Warning texts.
NOT_CONFIGURED = ("LLM cleanup is not configured, so the extracted text is shown "
                  "without LLM cleanup.")
FAILED_PREFIX = "LLM cleanup failed; showing extracted text instead: "
REPLY_PATH = "$.choices[0].message.content"


def parts(text: Column, cfg: JobConfig = DEFAULT) -> Column:
    """L1: the text as parts of at most ``max_llm_input_chars`` characters; joined, they are the text.

    A part ends after the last line break of its second half, or else at the limit."""
    limit = cfg.max_llm_input_chars
    half = max(1, limit // 2)
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(?:.{{{half},{limit - 1}}}\n|.{{1,{limit}}})"), 0)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(cut)


def cleanup_requests(items: DataFrame, cfg: JobConfig = DEFAULT,
                     text: str = "raw_text", instructions: str | None = None) -> DataFrame:
    """L2: ``(page_id, part, n_parts, request)``, one JSON request body per part."""
    instr = F.coalesce(F.col(instructions), F.lit(DEFAULT_INSTRUCTIONS)) if instructions else F.lit(DEFAULT_INSTRUCTIONS)
    user = F.concat(F.lit("User instructions:\n"), F.col("_instr"), F.lit("\n\nExtracted page:\n"), F.col("_text"))
    body = F.struct(
        F.lit(cfg.llm_model).alias("model"),
        F.lit(TEMPERATURE).alias("temperature"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
                F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"))
    cut = items.select("page_id", instr.alias("_instr"), parts(F.coalesce(F.col(text), F.lit("")), cfg).alias("_parts"))
    return (cut.select("page_id", "_instr", F.size("_parts").alias("n_parts"), F.posexplode("_parts").alias("part", "_text"))
            .select("page_id", "part", "n_parts", F.to_json(body).alias("request")))


def read_reply(body: Column) -> Column:
    """L3: the reply text (stripped); null when absent or malformed."""
    return py_strip(F.get_json_object(body, REPLY_PATH))


def merge_cleanup(items: DataFrame, responses: DataFrame | None, cfg: JobConfig = DEFAULT,
                  text: str = "raw_text") -> DataFrame:
    """Adds ``cleaned_text``, ``llm_used``, ``llm_warning``.

    ``responses(page_id[, part], body, error)``; without a part column a row
    answers part 0.  Reply present -> reply (an empty reply keeps the part's
    text), used.  Error or an unreadable reply -> the part's text and a
    warning.  A page is ``llm_used`` when any of its parts was.  Not
    configured -> pass-through.
    """
    if not cfg.llm_api_key or responses is None:
        return items.select("*", F.col(text).alias("cleaned_text"), F.lit(False).alias("llm_used"),
                            F.lit(NOT_CONFIGURED).alias("llm_warning"))
    part = F.col("part") if "part" in responses.columns else F.lit(0)
    r = responses.select("page_id", F.struct(
        part.cast("int").alias("part"), F.col("error").alias("error"), read_reply(F.col("body")).alias("reply"),
        F.col("body").isNotNull().alias("answered")).alias("r"))
    r = r.groupBy("page_id").agg(F.collect_list("r").alias("_replies"))  # at most one row per part of a page
    empty = F.expr("cast(array() as array<struct<text:string,ok:boolean,reason:string>>)")

    def merged(own: Column, k: Column) -> Column:
        reply = F.get(F.filter("_replies", lambda x: x["part"] == k), F.lit(0))
        ok = F.coalesce(reply["error"].isNull() & reply["reply"].isNotNull(), F.lit(False))
        reason = F.coalesce(reply["error"], F.when(F.coalesce(reply["answered"], F.lit(False)), F.lit("unreadable reply")).otherwise(F.lit("no reply")))
        return F.struct(F.when(ok, F.coalesce(F.nullif(reply["reply"], F.lit("")), own)).otherwise(own).alias("text"),
                        ok.alias("ok"), F.when(~ok, reason).alias("reason"))

    j = items.join(r, "page_id", "left").withColumn("_parts", F.coalesce(F.transform(parts(F.col(text), cfg), merged), empty))
    reasons = F.array_distinct(F.filter(F.transform("_parts", lambda p: p["reason"]), lambda x: x.isNotNull()))
    joined = F.array_join(F.transform("_parts", lambda p: p["text"]), "")
    return (j.withColumn("cleaned_text", F.when(F.col(text).isNotNull(), joined))
            .withColumn("llm_used", F.exists("_parts", lambda p: p["ok"]))
            .withColumn("llm_warning", F.when(F.size(reasons) > 0, F.concat(F.lit(FAILED_PREFIX), F.array_join(reasons, "; "))))
            .drop("_replies", "_parts"))
