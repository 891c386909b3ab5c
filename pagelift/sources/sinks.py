"""Review-item and approved-item sinks.

Both are idempotent parquet writes (overwrite of the target folder, or of the
given partition values with dynamic partition overwrite), so a retried job
replaces its output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.review import REVIEW_FIELDS

APPROVED_FIELDS = ("url", "status", "title", "content")


def write_review_items(items: DataFrame, path: str, partition_by: str | None = None) -> None:
    """The ten review fields (plus page_id) as parquet."""
    out = items.select("page_id", *REVIEW_FIELDS)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_approved(approved: DataFrame, path: str) -> None:
    """Approved items ``(url, status, title, content)``; the URL is kept as
    the key (the reference's response drops it)."""
    approved.select(*APPROVED_FIELDS).write.mode("overwrite").parquet(path)
