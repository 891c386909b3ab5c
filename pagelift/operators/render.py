"""When a rendered copy is needed, whether it is better, and errors.

R1/R2 are pure expressions over a page's html and its extracted text.  R3-R5
join the ``rendered_pages`` table (the renderer's output) -- only for pages that
need it, filtered before the join.  R6/R7 split results from rejections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

# Markers of a client-rendered shell (lower-case).
SHELL_MARKERS = (
    'id="root"', "id='root'", 'id="app"', "id='app'",
    "__next_data__", "enable javascript", "javascript is required",
    "data-reactroot", "ng-version", 'id="__nuxt"', "id='__nuxt'",
    'id="___gatsby"', "id='___gatsby'", "__preloaded_state__",
    "__initial_state__", "window.__nuxt__",
)
# Render decision thresholds.
THIN_WORDS = 180
SHELL_WORDS = 400
SCRIPT_HEAVY = 8
SCRIPT_WORDS = 250
LARGE_HTML = 20_000
TEXT_RATIO = 0.015
LARGE_WORDS = 350
UPGRADE_FACTOR = 1.08


def shell_features(html) -> dict[str, Column]:
    """R1 inputs from the html alone: marker present, script count, length.

    Computed once per page, so the wide html column can be dropped early."""
    h = F.col(html) if isinstance(html, str) else html
    lower = F.lower(h)
    marker = None
    for m in SHELL_MARKERS:
        hit = lower.contains(m)
        marker = hit if marker is None else (marker | hit)
    scripts = F.floor((F.length(lower) - F.length(F.replace(lower, F.lit("<script"), F.lit(""))))
                      / F.lit(len("<script"))).cast("long")
    return {"has_marker": marker, "script_count": scripts,
            "html_chars": F.length(h).cast("long")}


def needs_render(text: Column, has_marker: Column, script_count: Column,
                 html_chars: Column) -> Column:
    """R2 (``needs_browser``) from the shell features and the extracted text."""
    words = word_count(text)
    ratio = F.try_divide(F.length(text).cast("double"),
                         F.greatest(html_chars, F.lit(1)).cast("double"))
    return ((words < THIN_WORDS)
            | (has_marker & (words < SHELL_WORDS))
            | ((script_count >= SCRIPT_HEAVY) & (words < SCRIPT_WORDS))
            | ((html_chars > LARGE_HTML) & (ratio < TEXT_RATIO) & (words < LARGE_WORDS)))
