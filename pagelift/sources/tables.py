"""Scans of the input tables.

Pages arrive as rows (page_id, url, html[, content_type, n_bytes, fetch_error]);
the network fetch and the browser renderer stay outside and land here as
tables.  Only the columns a query touches are read (column pruning reaches the
parquet scan).
"""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import parts_of

# The decoder runs in Python workers: ship this module's code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table."""
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def pages_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages as JSON lines, with an explicit schema (no inference)."""
    return spark.read.schema(PAGES_SCHEMA).json(path)


def pages_from_files(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """S1 + S3: raw fetched bodies as files (``binaryFile``), decoded with one declared charset.

    The page id is a 128-bit digest of the path (as text): no two files share one.
    """
    raw = spark.read.format("binaryFile").load(path)
    return decoded_pages(raw.select(
        F.md5("path").alias("page_key"), F.col("path").alias("url"), F.col("content").alias("body"),
        F.lit(charset).cast("string").alias("charset")))


def decode_body(body: bytes | None, charset: str | None) -> str | None:
    """S3: declared charset, else (or when there is no such charset) UTF-8; bad bytes become U+FFFD."""
    if body is None:
        return None
    try:
        text = body.decode((charset or "").strip() or "utf-8", errors="replace")
    except (LookupError, ValueError, UnicodeError):  # unknown names, codecs that are no text encodings
        text = body.decode("utf-8", errors="replace")
    return text.encode("utf-8", "replace").decode("utf-8")


def decoded_pages(bodies: DataFrame, body: str = "body", charset: str = "charset") -> DataFrame:
    """S3: ``html`` and ``n_bytes`` in place of the body and its charset; never raises on bad bytes."""
    names = [c for c in bodies.columns if c not in (body, charset)]
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in bodies.schema if f.name in names]

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, body):
                raw = part.column(body)
                html = [decode_body(b.as_py(), c) for b, c in zip(raw, part.column(charset).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(html, pa.string()), pc.binary_length(raw).cast(pa.int64())],
                    [*names, "html", "n_bytes"])

    return bodies.select(*names, body, charset).mapInArrow(run, ", ".join([*given, "html string", "n_bytes long"]))


RENDERED_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("render_error", T.StringType()),
])


def rendered_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The renderer's output table ``(page_id, url, html, render_error)``."""
    reader = spark.read.schema(RENDERED_SCHEMA)
    return reader.json(path) if fmt == "json" else reader.parquet(path)
