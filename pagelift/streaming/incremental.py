"""The scrape flow as a stream that waits for its side inputs, and the
wait for a human's approval.

Both rest on the same wait: rows of one stream wait, in event time, for rows of
another one (:func:`latest_within`, :func:`waited_pages`).  What waits are keys, times, addresses and the names of the
files that hold the rows; html and contents are read back from those files, once,
when the wait is over.  (So files stay in the streams' folders for the wait.)  It is a stream-stream outer join with a time bound,
followed by an aggregate per waiting row that keeps the *latest* match; a row is
given out once, when the watermark has passed its bound, so a correction that
arrives in time counts and the state of the past is dropped.

T1: pages, rendered copies and DNS answers arrive as three file streams.  A page
waits for its copy (a later one replaces an earlier one) and for the addresses
of its host, whichever batch they come in.  Answers are combined per host, kind
of address and step of time before they meet a page, under a key that names the
span of time too, so a page meets a few rows, not all answers of its host.  What the wait gives is written once
per micro-batch and goes through the batch flow (guard, admission, extraction,
choice of the copy, review items) into ``epoch=N`` folders, so a retried epoch
replaces its output instead of duplicating it (exactly-once files).

T2: review items wait for approvals.  Approvals are validated like the batch
gate's, the latest one within the bound counts, ties by content as there; an
item whose bound has passed without one comes out as pending.

A key that many rows share (the host of a third of all pages, the URL of many
items) is salted: the waiting side is dealt over ``SALT`` values by its page id,
the other, narrow one is repeated for each.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, JobConfig
from ..functions.urls import guard_host
from ..operators.guard import non_global, with_address_hex
from ..operators.review import approve
from ..plans.joins import join_hot, may_match
from ..plans.pipeline import scrape
from ..session import run_folder
from ..sources.tables import PAGES_SCHEMA, RENDERED_SCHEMA

ITEM_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("cleaned_text", T.StringType()),
    T.StructField("extracted_at", T.TimestampType()),
])
APPROVAL_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("approved_at", T.TimestampType()),
])
FETCHED_SCHEMA = T.StructType([*PAGES_SCHEMA.fields, T.StructField("fetched_at", T.TimestampType())])
COPY_SCHEMA = T.StructType([*RENDERED_SCHEMA.fields, T.StructField("rendered_at", T.TimestampType())])
DNS_SCHEMA = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("resolved_at", T.TimestampType()),
])
SALT = 8
#: Steps of time in a wait, by which the answers for a host are combined.
STEPS = 4


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder."""
    return run_folder(spark, name)


def waiting(left: DataFrame, right: DataFrame, on: str, at: str, right_at: str, wait: str, salt: int = 1) -> DataFrame:
    """``left`` with ``match``: each row of ``right`` with the same ``on`` between ``at`` and ``at + wait``, as a struct
    that begins with its time; null once the bound has passed without one.  Both streams carry watermarks."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in right.columns})
    cond = f"{on} = _{on} AND _{right_at} >= {at} AND _{right_at} <= {at} + INTERVAL {wait}"
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(salt)).cast("int"))
        right = right.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        cond += " AND _salt = _of"
    joined = left.join(right, F.expr(cond), "leftOuter")
    time = F.col(f"_{right_at}") + F.expr("INTERVAL 0 SECONDS")  # one event time goes on
    found = F.struct(time.alias(right_at), *(F.col(c).alias(c[1:]) for c in right.columns if c not in (f"_{right_at}", f"_{on}", "_of")))
    kept = [c for c in left.columns if c != "_salt"]
    return joined.select(*kept, F.when(F.col(f"_{right_at}").isNotNull(), found).alias("match"))


def latest_within(left: DataFrame, right: DataFrame, on: str, at: str, right_at: str, wait: str, salt: int = 1) -> DataFrame:
    """Each row of ``left``, by page id and time, once, with its smallest address and the ``files`` that hold it, and its
    latest ``match``: the greatest one in time and address, with the files that hold that one.

    Both streams are narrow (see :func:`_narrow`): all that is carried besides keys and times are addresses and names of files."""
    same = lambda x, y: F.lit(True)
    for c in right.columns:
        if c not in (on, "file"):
            same = lambda x, y, c=c, before=same: before(x, y) & x[c].eqNullSafe(y[c])
    one = waiting(left, right, on, at, right_at, wait, salt).groupBy("page_id", at).agg(
        F.collect_set(F.struct("url", "file")).alias("rows"), F.collect_set("match").alias("matches"))
    one = one.withColumns({"url": F.array_min("rows")["url"], "last": F.array_max("matches")})
    files = F.transform(F.filter("rows", lambda x: x["url"].eqNullSafe(F.col("url"))), lambda x: x["file"])
    found = F.transform(F.filter("matches", lambda x: same(x, F.col("last"))), lambda x: x["file"])
    match = F.struct(*(F.col(f"last.{c}").alias(c) for c in [right_at, *(c for c in right.columns if c not in (on, right_at, "file"))]), found.alias("files"))
    return one.select("page_id", at, "url", files.alias("files"), F.when(F.col("last").isNotNull(), match).alias("match"))


def _narrow(rows: DataFrame, *kept: str) -> DataFrame:
    """Keys, times and addresses of a stream's rows with the ``file`` each is in, from which :func:`_read_back` takes the texts."""
    return rows.select(*kept, F.col("_metadata.file_path").alias("file"))


def _read_back(spark: SparkSession, path: str, schema: T.StructType, wanted: DataFrame, keys: list[str], prepared=lambda rows: rows) -> DataFrame:
    """``key``, a struct of ``keys``, with each row of a stream's folder that ``wanted(*keys, files)`` names.

    Only files that are named are read; their names, not their rows, pass the driver.  Nulls equal nulls in a key."""
    named = [r.file for r in wanted.select(F.explode("files").alias("file")).distinct().collect()]
    rows = spark.read.schema(schema).parquet(path).withColumn("file", F.col("_metadata.file_path")).filter(F.col("file").isin(named))
    rows = prepared(rows).withColumn("key", F.struct(*keys))
    asked = wanted.groupBy(F.struct(*keys).alias("key")).agg(F.array_distinct(F.flatten(F.collect_set("files"))).alias("files"))
    return rows.drop(*keys).join(asked, "key").filter(F.array_contains("files", F.col("file"))).drop("files", "file")


def _stream(spark: SparkSession, path: str, schema: T.StructType, at: str, delay: str, files: int) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withWatermark(at, delay))


def _micros(spark: SparkSession, wait: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {wait})").first()[0]


def _answers(dns: DataFrame, step: int) -> DataFrame:
    """``dns`` by host, ``step`` (ms) of time and kind of address: ``first`` and ``last`` time, and one address of the kind.

    A page asks whether its host has an address within its wait, and a non-global one.  Of the answers of a kind in one step
    the first and the last one tell that for every wait that is no shorter than the step, however many there are."""
    judged = with_address_hex(dns, "address").withColumn("inside", non_global(F.col("family"), F.col("hx")))
    at = F.when(F.col("address").isNotNull(), F.unix_micros("resolved_at"))  # no filter: a row without an address is a sign of time, too
    steps = judged.groupBy(F.window("resolved_at", f"{step} milliseconds"), "host", "inside").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.min("address").alias("address"))
    return steps.filter("first is not null").select(F.window_time("window").alias("seen_at"), "host", "first", "last", "address")


def waited_pages(pages: DataFrame, copies: DataFrame, dns: DataFrame, wait: str) -> DataFrame:
    """Pages with ``copy`` (null: none came in time) and ``addresses`` of their host, one of each kind that it has within the
    wait at least; no html.

    Copies and addresses come as one stream, under the names that a page waits for: that of its copy, and those of its host
    in each span of time that the wait reaches into.  So a page meets the few answers of these spans, not all of its host."""
    step = max(1, -(-_micros(pages.sparkSession, wait) // (STEPS * 1000)))
    span = lambda micros: F.floor(micros / F.lit(STEPS * step * 1000)).cast("long")
    of_page = F.concat(F.lit("page:"), F.col("page_id").cast("string"))
    of_host = lambda x, salt: F.concat(F.lit("host:"), x.cast("string"), F.lit(":"), salt.cast("string"), F.lit(":"), F.col("host"))

    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALT))
    spans = F.sequence(span(F.unix_micros("fetched_at")), span(F.expr(f"unix_micros(fetched_at + INTERVAL {wait})")))
    left = pages.withColumn("host", guard_host("url"))
    left = left.withColumn("awaited", F.explode_outer(F.array_compact(F.concat(
        F.array(of_page), F.coalesce(F.transform(spans, lambda x: of_host(x, salt)), F.array().cast("array<string>"))))))

    copy, at = F.struct((F.col("rendered_at") + F.expr("INTERVAL 0 SECONDS")).alias("rendered_at"), "url", "file"), F.unix_micros("rendered_at")
    rows = copies.select(of_page.alias("key"), F.col("rendered_at").alias("seen_at"), at.alias("first"), at.alias("last"),
                         copy.alias("copy"), F.lit(None).cast("string").alias("address"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    answers = _answers(dns, step).withColumn("salt", salts).select(
        of_host(span(F.col("first")), F.col("salt")).alias("key"), "seen_at", "first", "last", F.lit(None).cast(rows.schema["copy"].dataType).alias("copy"), "address")
    right = rows.unionByName(answers)

    # an answer is seen at the end of its step, so the wait is longer by a step; what counts is the time of the copy and the answers
    cond = (f"awaited = key AND seen_at >= fetched_at AND seen_at <= fetched_at + INTERVAL {wait} + INTERVAL {step} MILLISECONDS"
            f" AND last >= unix_micros(fetched_at) AND first <= unix_micros(fetched_at + INTERVAL {wait})")
    met = left.join(right, F.expr(cond), "leftOuter").drop("awaited", "key", "seen_at", "first", "last")
    one = met.groupBy("page_id", "fetched_at").agg(
        F.collect_set(F.struct("url", "file")).alias("rows"), F.collect_set("copy").alias("copies"),
        F.collect_set(F.when(F.col("address").isNotNull(), F.struct("host", "address"))).alias("names"))
    one = one.withColumns({"url": F.array_min("rows")["url"], "last": F.array_max("copies")}).withColumn("host", guard_host("url"))
    files = F.transform(F.filter("rows", lambda x: x["url"].eqNullSafe(F.col("url"))), lambda x: x["file"])
    same = F.filter("copies", lambda x: x["rendered_at"].eqNullSafe(F.col("last.rendered_at")) & x["url"].eqNullSafe(F.col("last.url")))
    found = F.struct("last.rendered_at", "last.url", F.transform(same, lambda x: x["file"]).alias("files"))
    addresses = F.transform(F.filter("names", lambda x: x["host"] == F.col("host")), lambda x: x["address"])
    return one.select("page_id", "fetched_at", "url", files.alias("files"), "host",
                      F.when(F.col("last").isNotNull(), found).alias("copy"), addresses.alias("addresses"))


def stream_scrape(spark: SparkSession, pages_dir: str, copies_dir: str, dns_dir: str, out_dir: str, ckpt: str,
                  wait: str = "1 hour", delay: str = "10 minutes", files_per_trigger: int = 16, cfg: JobConfig = DEFAULT):
    """Run the flow over page files as they arrive, each page when its wait is over; returns the query.

    Items go to ``out_dir/items`` with ``extracted_at`` (the time of the fetch), rejections to ``out_dir/rejected``."""
    pages, copies, dns = (_stream(spark, path, schema, at, delay, files_per_trigger) for path, schema, at in (
        (pages_dir, FETCHED_SCHEMA, "fetched_at"), (copies_dir, COPY_SCHEMA, "rendered_at"), (dns_dir, DNS_SCHEMA, "resolved_at")))
    pages, copies = _narrow(pages, "page_id", "url", "fetched_at"), _narrow(copies, "page_id", "url", "rendered_at")

    def run(batch: DataFrame, epoch_id: int) -> None:
        held = os.path.join(out_dir, "waited", f"epoch={epoch_id}")
        batch.write.mode("overwrite").parquet(held)  # the state is read once
        ready = spark.read.schema(batch.schema).parquet(held)  # in the caller's session: the stream's own one has no adaptive execution
        if ready.isEmpty():
            return
        # of rows equal in page, time and address: the page with the smallest html, the copy with the greatest
        page = _read_back(spark, pages_dir, FETCHED_SCHEMA, ready, ["page_id", "fetched_at", "url"])
        page = page.groupBy("key").agg(F.min(F.struct("html")).alias("row")).select("key.page_id", "key.url", "row.html")

        def copy(wanted: DataFrame) -> DataFrame:
            asked = ready.filter("copy is not null").select("page_id", "copy.*").join(wanted, "page_id", "left_semi")
            rows = _read_back(spark, copies_dir, COPY_SCHEMA, asked, ["page_id", "rendered_at", "url"], lambda rows: may_match(rows, "page_id", wanted))
            return rows.groupBy("key").agg(F.max(F.struct("html", "render_error")).alias("row")).select("key.page_id", "key.url", "row.*")

        names = ready.select("host", F.explode("addresses").alias("address")).distinct()
        found = scrape(spark, page, copy, names, cfg)
        items = found.items.join(ready.select("page_id", F.col("fetched_at").alias("extracted_at")), "page_id")
        for name, df in (("items", items), ("rejected", found.rejected)):
            df.write.mode("overwrite").parquet(os.path.join(out_dir, name, f"epoch={epoch_id}"))

    return (waited_pages(pages, copies, dns, wait).writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
            .outputMode("append").trigger(availableNow=True).start())


def approval_stream_join(spark: SparkSession, items_dir: str, approvals_dir: str,
                         out_dir: str, ckpt: str, item_delay: str = "1 hour",
                         approval_delay: str = "2 hours", approval_window: str = "1 day"):
    """Items with their latest approval within the window, or pending, once the window has passed."""
    items = spark.readStream.schema(ITEM_SCHEMA).parquet(items_dir).withWatermark("extracted_at", item_delay)
    approvals = spark.readStream.schema(APPROVAL_SCHEMA).parquet(approvals_dir).withColumn("file", F.col("_metadata.file_path"))
    approvals = approve(approvals, "approved_at", "file").select("url", "approved_at", "file").withWatermark("approved_at", approval_delay)
    joined = latest_within(_narrow(items, "page_id", "url", "extracted_at"), approvals, "url", "extracted_at", "approved_at", approval_window, SALT)

    def run(batch: DataFrame, epoch_id: int) -> None:
        own = batch.sparkSession
        held = os.path.join(out_dir, "_waited", f"epoch={epoch_id}")  # the underscore hides it from readers of the results
        batch.drop("files").write.mode("overwrite").parquet(held)  # the state is read once
        ready = own.read.schema(batch.drop("files").schema).parquet(held)
        said = ready.filter("match is not null").select("page_id", "url", "extracted_at", "match.approved_at", "match.files")
        texts = _read_back(own, approvals_dir, APPROVAL_SCHEMA, said, ["url", "approved_at"], lambda rows: approve(rows, "approved_at", "file"))
        texts = texts.groupBy("key").agg(F.max(F.struct("content", "title")).alias("text"))  # ties by content
        approved = join_hot(said.withColumn("key", F.struct("url", "approved_at")), texts, "key", ("page_id",)).select(
            "page_id", "url", F.lit("approved").alias("status"), "text.title", "text.content", "extracted_at", "approved_at")
        none = F.lit(None).cast("string")
        pending = ready.filter("match is null").select("page_id", "url", F.lit("pending").alias("status"), none.alias("title"), none.alias("content"),
                                                       "extracted_at", F.lit(None).cast("timestamp").alias("approved_at"))
        approved.unionByName(pending).write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch_id}"))

    return (joined.writeStream.foreachBatch(run).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
