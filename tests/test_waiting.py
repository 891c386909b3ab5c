"""T1/T2 waits, the joins that keep wide rows in place, and the shared folder."""

import ipaddress
import os
import random
from collections import Counter
from datetime import datetime, timedelta
from urllib.parse import urlparse

from pyspark.sql import functions as F

from pagelift import session
from pagelift.operators import guard, mdtables, review
from pagelift.plans import joins
from pagelift.plans.pipeline import scrape
from pagelift.streaming.incremental import (
    APPROVAL_SCHEMA, COPY_SCHEMA, DNS_SCHEMA, FETCHED_SCHEMA, ITEM_SCHEMA, STEPS, _narrow, _stream, approval_stream_join, scratch,
    stream_scrape, waited_pages)

START = datetime(2024, 5, 1, 12)
RICH = "<html><head><title>Rich</title></head><body><main><p>" + " ".join(f"w{i}." for i in range(300)) + "</p></main></body></html>"
SHELL = "<html><body><div id='app'></div></body></html>"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_a_correction_in_time_replaces_the_approval(spark):
    items, approvals, out, ckpt = (scratch(spark, f"test-{n}") for n in ("items", "approvals", "out", "ckpt"))

    def arrive(items_, approvals_):
        spark.createDataFrame(items_, "page_id long, url string, title string, cleaned_text string, extracted_at timestamp").write.mode("append").parquet(items)
        spark.createDataFrame(approvals_, "url string, title string, content string, approved_at timestamp").write.mode("append").parquet(approvals)
        approval_stream_join(spark, items, approvals, out, ckpt).awaitTermination()

    u = "https://a.example/{}".format
    arrive([(k, u(k), "t", "x", at(0)) for k in range(5)], [(u(0), "", "first", at(10)), (u(1), "One", "early", at(5)), (u(9), "t", "nobody waits", at(5))])
    # a later file: a correction, one that came in late but is older, a blank one, and one after the bound
    arrive([(5, u(0), "t", "same address", at(1))],
           [(u(0), "Two", " corrected ", at(50)), (u(1), "One", "earlier", at(2)), (u(1), "One", "  ", at(60)), (u(2), "t", "too late", at(26 * 60)),
            (u(3), "t", "before the item", at(-5))])
    for day in (10, 20, 30):
        arrive([(-day, u("late"), "", "", at(day * 1440))], [(u("late"), "", "late", at(day * 1440))])
    got = {r.page_id: (r.status, r.title, r.content) for r in spark.read.parquet(out).filter("page_id >= 0").collect()}
    pending = ("pending", None, None)
    assert got == {0: ("approved", "Two", "corrected"), 1: ("approved", "One", "early"), 2: pending, 3: pending, 4: pending, 5: ("approved", "Two", "corrected")}
    assert spark.read.parquet(out).filter("page_id >= 0").count() == 6


def test_a_copy_that_comes_a_batch_later_is_used(spark):
    pages, copies, dns, out, ckpt = (scratch(spark, f"test-{n}") for n in ("pages", "copies", "dns", "out", "ckpt"))

    def arrive(pages_, copies_, dns_):
        for rows, schema, path in ((pages_, FETCHED_SCHEMA, pages), (copies_, COPY_SCHEMA, copies), (dns_, DNS_SCHEMA, dns)):
            spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        stream_scrape(spark, pages, copies, dns, out, ckpt).awaitTermination()

    u = "https://good.example/{}".format
    arrive([(k, u(k), SHELL, at(0)) for k in range(4)] + [(4, "https://bad.example/", RICH, at(0)), (5, "https://unknown.example/", RICH, at(0))], [], [])
    arrive([], [(0, u(0), RICH, None, at(20)), (1, u(1), None, "crashed", at(10)), (1, u(1), RICH, None, at(30)), (2, u(2), RICH, None, at(90))],
           [("good.example", "93.184.216.34", at(1)), ("bad.example", "93.184.216.34", at(1)), ("bad.example", "10.0.0.1", at(2))])
    for day in (10, 20, 30):
        arrive([(-day, u("late"), RICH, at(day * 1440))], [(-day, u("late"), RICH, None, at(day * 1440))], [("good.example", "93.184.216.34", at(day * 1440))])
    items = {r.page_id: (r.method, r.title) for r in spark.read.parquet(f"{out}/items").filter("page_id >= 0").collect()}
    rejected = {r.page_id: r.status for r in spark.read.parquet(f"{out}/rejected").filter("page_id >= 0").collect()}
    assert items == {0: ("browser", "Rich"), 1: ("browser", "Rich")}
    assert rejected == {2: 502, 3: 502, 4: 400, 5: 400}


def _state_bytes(ckpt):
    folder = urlparse(ckpt).path
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(os.path.join(folder, "state")) for f in files if f.endswith(".delta"))


def test_texts_do_not_wait_in_the_state(spark):
    long = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=150_000))  # can't be compressed much
    pages, copies, dns, items, approvals, out, ckpt1, ckpt2 = (
        scratch(spark, f"test-{n}") for n in ("pages", "copies", "dns", "items", "approvals", "out", "ckpt1", "ckpt2"))
    u = "https://a.example/1"
    for rows, schema, path in (([(1, u, long, at(0))], FETCHED_SCHEMA, pages), ([(1, u, long, None, at(1))], COPY_SCHEMA, copies), ([], DNS_SCHEMA, dns),
                               ([(1, u, "t", "x", at(0))], ITEM_SCHEMA, items), ([(u, "t", long, at(1))], APPROVAL_SCHEMA, approvals)):
        spark.createDataFrame(rows, schema).write.parquet(path)
    approval_stream_join(spark, items, approvals, out, ckpt2).awaitTermination()
    assert 0 < _state_bytes(ckpt2) < len(long) // 2
    stream_scrape(spark, pages, copies, dns, out, ckpt1).awaitTermination()
    assert 0 < _state_bytes(ckpt1) < len(long) // 2


def test_a_page_meets_few_answers_however_many_its_host_has(spark):
    rng = random.Random(11)
    pages, copies, dns, out, ckpt = (scratch(spark, f"test-{n}") for n in ("pages", "copies", "dns", "out", "ckpt"))
    second, micro = timedelta(seconds=1), timedelta(microseconds=1)
    hosts = ("busy.example", "rare.example", "edge.example")
    fetched = [(k, rng.choice(hosts[:2]), at(0) + second * rng.randint(0, 6 * 3600)) for k in range(80)] + [(100 + k, hosts[2], at(90 * k)) for k in range(12)]
    answers = [(hosts[0], at(0) + second * rng.randint(-3600, 8 * 3600)) for _ in range(1500)] + [(hosts[1], at(0) + second * rng.randint(-3600, 8 * 3600)) for _ in range(9)]
    answers = [(host, rng.choice(("93.184.216.{}", "10.0.{}.1", None)), t) for host, t in answers]
    for k, t in enumerate(at(90 * k) for k in range(12)):  # just inside and just outside of the wait
        answers.append((hosts[2], ("93.184.216.{}", "10.0.{}.1")[k % 2], (t, t - micro, t + second * 3600, t + second * 3600 + micro)[k // 3]))
    answers = [(host, a and a.format(n % 250), t) for n, (host, a, t) in enumerate(answers)] + [(None, "10.0.0.1", at(1))]
    rng.shuffle(answers)
    copied = [(k, "https://b.example/", None, None, t + timedelta(minutes=m)) for k, _, t in fetched for m in (5, 60, 61) if (k + m) % 4]

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    def arrive(pages_, copies_, dns_):
        for rows, schema, path in ((pages_, FETCHED_SCHEMA, pages), (copies_, COPY_SCHEMA, copies), (dns_, DNS_SCHEMA, dns)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        p, c, d = (_stream(spark, path, schema, t, "10 minutes", 16) for path, schema, t in (
            (pages, FETCHED_SCHEMA, "fetched_at"), (copies, COPY_SCHEMA, "rendered_at"), (dns, DNS_SCHEMA, "resolved_at")))
        waited = waited_pages(_narrow(p, "page_id", "url", "fetched_at"), _narrow(c, "page_id", "url", "rendered_at"), d, "1 hour")
        waited.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()

    arrive([(k, f"https://{host}/{k}", None, t) for k, host, t in fetched], [], [])
    arrive([], copied[::2], answers[::2])
    arrive([], copied[1::2], answers[1::2])
    arrive([(-1, "https://late.example/", None, at(43200))], [(-1, None, None, None, at(43200))], [("late.example", "10.0.0.1", at(43200))])
    got = {r.page_id: r for r in spark.read.parquet(out).filter("page_id >= 0").collect()}
    assert len(got) == len(fetched) == spark.read.parquet(out).filter("page_id >= 0").count()
    hour = timedelta(hours=1)
    for k, host, t in fetched:
        met = {a for h, a, s in answers if h == host and a and t <= s <= t + hour}
        kinds = lambda found: {a.startswith("10.") for a in found}
        assert kinds(got[k].addresses) == kinds(met), (k, host)
        assert set(got[k].addresses) <= {a for h, a, _ in answers if h == host}
        assert len(got[k].addresses) <= 2 * (STEPS + 1)  # not one for each answer
        last = max((s for i, _, _, _, s in copied if i == k and t <= s <= t + hour), default=None)
        assert (got[k].copy and got[k].copy.rendered_at) == last


def test_copies_may_be_asked_for_the_pages_that_want_one(spark):
    u = "https://good.example/{}".format
    pages = spark.createDataFrame([(1, u(1), RICH), (2, u(2), SHELL), (3, u(3), SHELL)], "page_id long, url string, html string")
    rendered = spark.createDataFrame([(1, u(1), RICH, None), (2, u("b"), RICH, None)], "page_id long, url string, html string, render_error string")
    dns = spark.createDataFrame([("good.example", "93.184.216.34")], "host string, address string")
    asked = []

    def copies(wanted):
        asked.extend(r.page_id for r in wanted.collect())
        return rendered.join(wanted, "page_id", "left_semi")

    res = scrape(spark, pages, copies, dns)
    assert sorted(asked) == [2, 3]
    assert sorted((r.page_id, r.url, r.method) for r in res.items.collect()) == [(1, u(1), "http"), (2, u("b"), "browser")]
    assert [(r.page_id, r.status) for r in res.rejected.collect()] == [(3, 502)]


def test_of_equal_approvals_the_greatest_content_counts_and_rows_that_came_late_do_not(spark):
    items, approvals, out, ckpt = (scratch(spark, f"test-{n}") for n in ("items", "approvals", "out", "ckpt"))
    u = "https://a.example/{}".format
    for files in ([(u(0), "t", "aa", at(5)), (u(0), "t", "zz", at(5)), (u(0), "t", "older", at(4))], [(u(0), "t", "mm", at(5))],
                  [(u("late"), "", "late", at(30 * 1440))]):
        spark.createDataFrame(files, APPROVAL_SCHEMA).coalesce(1).write.mode("append").parquet(approvals)
    for row in ((1, u(0), "t", "x", at(0)), (2, None, "t", "x", at(0)), (-1, u("late"), "", "", at(30 * 1440))):
        spark.createDataFrame([row], ITEM_SCHEMA).write.mode("append").parquet(items)
    approval_stream_join(spark, items, approvals, out, ckpt).awaitTermination()
    spark.createDataFrame([(u(0), "t", "zzz", at(5))], APPROVAL_SCHEMA).write.mode("append").parquet(approvals)
    approval_stream_join(spark, items, approvals, out, ckpt).awaitTermination()
    got = sorted((r.page_id, r.status, r.content) for r in spark.read.parquet(out).filter("page_id >= 0").collect())
    assert got == [(1, "approved", "zz"), (2, "pending", None)]


def test_a_row_of_pages_gives_one_result(spark):
    u = "https://good.example/{}".format
    pages = spark.createDataFrame([(1, u(1), RICH), (1, u(1), RICH), (2, u(2), SHELL), (2, u(2), SHELL), (3, u(3), SHELL)], "page_id long, url string, html string")
    rendered = spark.createDataFrame([(2, u("b"), RICH, None), (2, u("a"), None, "crashed"), (2, u("c"), RICH, None), (2, "http://10.0.0.1/", RICH, None),
                                      (3, u(3), None, "crashed")], "page_id long, url string, html string, render_error string")
    dns = spark.createDataFrame([("good.example", "93.184.216.34")], "host string, address string")
    asked = spark.createDataFrame([(1, "Keep all."), (1, "Keep all.")], "page_id long, instructions string")
    res = scrape(spark, pages, rendered, dns, requests=asked)
    assert sorted((r.page_id, r.url, r.method) for r in res.items.collect()) == [(1, u(1), "http")] * 2 + [(2, u("b"), "browser")] * 2
    assert [(r.page_id, r.status) for r in res.rejected.collect()] == [(3, 502)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_may_match_keeps_wide_rows_in_place(spark):
    wide = spark.range(5000).select((F.col("id") % 1000).alias("page_id"), F.repeat(F.lit("x"), 20).alias("html"))
    ids = spark.range(0, 1000, 10).select(F.col("id").alias("page_id"))
    got = joins.may_match(wide, "page_id", ids)
    kept = Counter(r.page_id for r in got.select("page_id").collect())
    assert all(kept[k] == 5 for k in range(0, 1000, 10)) and len(kept) < 200
    plan = _plan(got)
    assert "hashpartitioning" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan
    assert joins.may_match(wide, "page_id", ids.filter("false")).count() == 0


def test_hot_keys_are_dealt_and_the_rest_joins_as_it_is(spark):
    fact = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(40)], "k long, v string")
    for how in ("inner", "left", "left_anti"):
        got = joins.join_hot(fact, dim, "k", ("page_id",), how, least=500, salt_buckets=7)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, fact.join(dim, "k", how).select(got.columns).collect()))


def test_gate_repeats_contents_of_hot_addresses_only(spark):
    items = spark.range(50).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/"), (F.col("id") % 5).cast("string")).alias("url"))
    approvals = spark.createDataFrame([(f"https://a.example/{k}", "t", f"c{k}") for k in range(3)], "url string, title string, content string")
    approved, pending = review.approval_gate(items, approvals)
    assert approved.count() == 30 and pending.count() == 20
    assert {(r.url[-1], r.approved_content) for r in approved.collect()} == {(str(k), f"c{k}") for k in range(3)}


def test_blocks_of_addresses_against_the_standard_library(spark):
    rng = random.Random(8)
    nets = [*guard.NON_GLOBAL_V4, *guard.GLOBAL_EXCEPTIONS_V4, *guard.NON_GLOBAL_V6, *guard.GLOBAL_EXCEPTIONS_V6]
    found = []
    for net in map(ipaddress.ip_network, nets):
        first, last = int(net.network_address), int(net.broadcast_address)
        kind = type(net.network_address)
        found += [kind(n) for n in (first - 1, first, last, last + 1, rng.randint(first, last)) if 0 <= n < 2 ** net.max_prefixlen]
    found += [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(200)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(50)]
    df = spark.createDataFrame([(k, str(a)) for k, a in enumerate(found)] + [(-1, "no address"), (-2, "1.2.3.400"), (-3, "1:2:3"), (-4, "::1.2.3.999")], "id long, address string")
    got = {r.id: r.non_global for r in guard.block_verdicts(guard.with_address_hex(df, "address"), guard.block_table(spark)).collect()}
    assert all(got[-k] for k in range(1, 5))
    for k, a in enumerate(found):
        mapped = getattr(a, "ipv4_mapped", None)
        assert got[k] == (not (mapped or a).is_global), a


def test_the_smallest_block_decides(spark):
    cidr = spark.createDataFrame([(4, "0a000000", "0affffff", False), (4, "0a010000", "0a01ffff", True), (4, "0a010100", "0a0101ff", False),
                                  (4, "00000000", "ffffffff", True)], "family int, lo string, hi string, is_global boolean")
    df = spark.createDataFrame([("10.0.0.1",), ("10.1.0.1",), ("10.1.1.1",), ("11.0.0.1",)], "address string")
    got = {r.address: r.non_global for r in guard.block_verdicts(guard.with_address_hex(df, "address"), cidr).collect()}
    assert got == {"10.0.0.1": True, "10.1.0.1": False, "10.1.1.1": True, "11.0.0.1": False}
    hosts = spark.createDataFrame([("a.example",), ("10.1.0.7",)], "host string")
    dns = spark.createDataFrame([("a.example", "10.1.0.1"), ("a.example", "10.1.1.1")], "host string, address string")
    got = {r.host: r.unsafe_reason for r in guard.host_verdicts(hosts, dns, cidr).collect()}
    assert got == {"a.example": guard.NON_GLOBAL, "10.1.0.7": None}


def test_list_depth_is_that_of_a_stack(spark, monkeypatch):
    rng = random.Random(5)
    docs = ["\n".join(" " * rng.randint(0, 6) + "- item" for _ in range(n)) for n in (1, 2, 30, 300)]
    want = set()
    for k, doc in enumerate(docs):
        stack = []
        for ln, line in enumerate(doc.split("\n")):
            indent = len(line) - len(line.lstrip())
            stack = [s for s in stack if s < indent] + [indent]
            want.add((k, ln, indent, len(stack)))
    df = spark.createDataFrame(list(enumerate(docs)), "page_id long, markdown string")
    for chunk in (256, 7):
        monkeypatch.setattr(mdtables, "FOLD_CHUNK", chunk)
        assert {(r.page_id, r.ln, r.indent, r.depth) for r in mdtables.list_items(df).collect()} == want
    assert "Exchange" not in _plan(mdtables.list_items(df)) and "Window" not in _plan(mdtables.markdown_blocks(df))


def test_a_local_session_without_a_folder_gets_one(spark, monkeypatch):
    monkeypatch.setattr(session, "_configured", lambda s: None)
    folder = session.checkpoint_dir(spark)
    assert folder and session.checkpoint_dir(spark) == folder
    assert session.run_table(spark.range(3), "test").count() == 3
