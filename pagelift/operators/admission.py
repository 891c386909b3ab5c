"""Admission of fetched pages before any parsing.

Keep pages whose content type mentions "html" (any case) and whose body is at
most ``max_download_bytes``; the others are not dropped but carry a reason, so
the render fallback (R3) can still serve them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, JobConfig

# Rejection messages.
NOT_HTML = "The URL did not return an HTML page."
TOO_LARGE = "The page is larger than the configured download limit."
DEFAULT_CONTENT_TYPE = "text/html; charset=utf-8"


def admit(pages: DataFrame, cfg: JobConfig = DEFAULT) -> DataFrame:
    """Adds ``n_bytes``, ``admitted`` and ``reject_reason``.

    ``content_type`` / ``n_bytes`` are used when present; a page table without
    them holds bodies that were served as HTML, and their size is the UTF-8
    length of the body.
    """
    cols = set(pages.columns)
    ct = F.col("content_type") if "content_type" in cols else F.lit(DEFAULT_CONTENT_TYPE)
    nb = F.col("n_bytes") if "n_bytes" in cols else F.octet_length("html").cast("long")
    reason = (F.when(~F.coalesce(F.lower(ct).contains("html"), F.lit(False)), F.lit(NOT_HTML))
              .when(nb > cfg.max_download_bytes, F.lit(TOO_LARGE)))
    out = pages.withColumn("n_bytes", nb).withColumn("reject_reason", reason)
    return out.withColumn("admitted", F.col("reject_reason").isNull())
