"""More extraction candidates per page, and the weighted top-1.

The reference asks three external extractors for extra candidates; here they
are native stand-ins over the same page rows, each an expression:

* recall (C2, weight 1.2): every emitted line of the page, a line that stood
  earlier dropped;
* precision (C3, weight 1.15): blocks kept by shallow text features -- words and
  link density of the block and its neighbours, after Kohlschuetter et al.,
  "Boilerplate detection using shallow text features", WSDM 2010;
* density (C4, weight 1.05): paragraph-like elements score their parent (full)
  and grandparent (half), scaled by (1 - link density); the best element's
  Markdown, as in the public Readability heuristic.

C5 gathers the candidates, C6 drops the stand-ins under 20 words, C7 keeps the
highest quality x weight (first slot on ties), falling back to the basic text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, py_strip, quality_of, word_count
from .markdown import markdown_under, with_basic, with_lines

# Candidate weights (slot order = tie order) and the word floor.
SLOTS = (("basic", 1.0), ("recall", 1.2), ("precision", 1.15), ("density", 1.05))
MIN_WORDS = 20
# ours: stand-in thresholds
MAX_LINK_DENSITY = 1.0 / 3.0
NEAR_LINK_DENSITY = 5.0 / 9.0
DENSITY_MIN_CHARS = 25


def _density(of: Column) -> Column:
    return F.try_divide(of["link_len"].cast("double"), F.greatest(of["text_len"], F.lit(1)).cast("double"))


def recall_text() -> Column:
    """All emitted lines of the page, the first of equal ones."""
    return py_strip(F.array_join(F.array_distinct(F.transform("lines", lambda x: x["value"])), "\n"))


def _kept_blocks() -> Column:
    """Places of the blocks classified as content, by words and link
    density of the block and its neighbours in page order."""
    def kept(blocks: Column) -> Column:
        def keep(b: Column, i: Column) -> Column:
            before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
            near = F.coalesce(before["l"], F.lit(0.0)) <= NEAR_LINK_DENSITY
            pw, nw = F.coalesce(before["w"], F.lit(0)), F.coalesce(after["w"], F.lit(0))
            return (b["l"] <= MAX_LINK_DENSITY) & F.when(near, (b["w"] > 16) | (nw > 15) | (pw > 4)).otherwise((b["w"] > 40) | (nw > 17))
        return F.filter(blocks, keep)
    measured = F.transform("blocks", lambda b: F.struct(b["pre"].alias("pre"), b["words"].alias("w"), _density(b).alias("l")))
    return F.map_from_arrays(F.transform("_kept", lambda b: b["pre"]), F.transform("_kept", lambda b: F.lit(True))), let(measured, kept)


def _best_holder() -> Column:
    """C4: the element with the highest paragraph points, the first on ties."""
    point = lambda p: F.when(p["len"] >= DENSITY_MIN_CHARS, F.lit(1.0) + p["commas"] + F.least(p["len"] / 100.0, F.lit(3.0))).otherwise(0.0)
    total = lambda paras: F.aggregate(paras, F.lit(0.0).cast("double"), lambda acc, p: acc + point(p))
    some = lambda h: F.exists(F.concat(h["kids"], h["grandkids"]), lambda p: p["len"] >= DENSITY_MIN_CHARS)
    scored = F.transform(F.filter("holders", some), lambda h: F.struct(
        ((total(h["kids"]) + total(h["grandkids"]) / 2.0) * (1.0 - _density(h))).alias("score"),
        (-h["pre"]).alias("at"), h["last"].alias("last")))
    return F.array_max(scored)


def with_candidates(lined: DataFrame) -> DataFrame:
    """Adds the texts ``recall``, ``precision`` and ``density`` (null: no holder)."""
    places, kept = _kept_blocks()
    held = lined.withColumn("_kept", kept).withColumn("_places", places).withColumn("_best", _best_holder())
    content = F.filter("lines", lambda x: F.map_contains_key("_places", x["pre"]))
    return (held.withColumn("recall", recall_text())
            .withColumn("precision", py_strip(F.array_join(F.transform(content, lambda x: x["value"]), "\n")))
            .withColumn("density", F.when(F.col("_best").isNotNull(), markdown_under(-F.col("_best.at"), F.col("_best.last"))))
            .drop("_kept", "_places", "_best"))


def weighted_top1(df: DataFrame, others: tuple[str, ...] = ("recall", "precision", "density")) -> DataFrame:
    """C5-C7 over the text columns ``basic`` (with ``basic_quality`` where it is known) and ``others``: adds ``text``, ``slot`` and
    ``quality`` of the best quality x weight; no candidate gives '' and basic.  A slot whose text is the basic one
    takes over its quality."""
    weights, order = dict(SLOTS), {name: i for i, (name, _) in enumerate(SLOTS)}

    def candidate(name: str, text: Column):
        return lambda q: F.struct((q * weights[name]).alias("weighted"), F.lit(-order[name]).alias("order"),
                                  F.lit(name).alias("slot"), text.alias("text"), q.alias("quality"))

    known = F.col("basic_quality") if "basic_quality" in df.columns else quality_of(F.coalesce("basic", F.lit("")))
    slots = []
    for name in ("basic", *others):
        text = F.coalesce(F.col(name), F.lit(""))
        fits = text != "" if name == "basic" else word_count(text) >= MIN_WORDS
        own = known if name == "basic" else F.when(text == F.col("basic"), known).otherwise(quality_of(text))
        slots.append(F.when(fits, let(own, candidate(name, text))))
    return (df.withColumn("_top", F.array_max(F.filter(F.array(*slots), lambda s: s.isNotNull())))
            .withColumn("text", F.coalesce("_top.text", "basic", F.lit("")))
            .withColumn("slot", F.coalesce("_top.slot", F.lit("basic")))
            .withColumn("quality", F.coalesce("_top.quality", F.lit(0.0))).drop("_top"))


def readable(pages: DataFrame) -> DataFrame:
    """Page rows with all extraction columns: ``title``, ``text``, its ``slot`` and ``quality``, ``parse_error``, the metadata
    elements, and the columns of ``pages`` but html."""
    return weighted_top1(with_candidates(with_basic(with_lines(pages))))


def extract_readable(pages: DataFrame) -> DataFrame:
    """``extract_readable_text`` for a table of pages: ``(page_id, url, title, text, slot)``."""
    return readable(pages.select("page_id", "url", "html")).select("page_id", "url", "title", "text", "slot")
