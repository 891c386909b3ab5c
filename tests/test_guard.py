"""Address normalisation and host verdicts against the standard library."""

import ipaddress

from pyspark.sql import functions as F

from pagelift.operators import guard
from pagelift.plans import joins

ADDRS = ["127.0.0.1", "93.184.216.34", "10.1.2.3", "100.64.0.1", "100.128.0.1", "192.0.0.9",
         "192.0.0.8", "224.0.0.1", "255.255.255.255", "8.8.8.8", "::1", "::", "2001:db8::1",
         "2606:4700::1111", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "fe80::1", "ff02::1",
         "2001:1::1", "2001:1::3", "fd00::5", "2002::1", "64:ff9b::8.8.8.8", "2001:4:112::1"]


def test_address_globality_matches_stdlib(spark):
    dns = spark.createDataFrame([(f"h{i}.example", a) for i, a in enumerate(ADDRS)],
                                "host string, address string")
    hosts = dns.select("host")
    got = {r.host: r.unsafe_reason for r in guard.host_verdicts(hosts, dns).collect()}
    for i, a in enumerate(ADDRS):
        want = None if ipaddress.ip_address(a).is_global else guard.NON_GLOBAL
        assert got[f"h{i}.example"] == want, a


def test_guard_urls_reasons(spark):
    pages = spark.createDataFrame([
        (1, "https://public.example/a"), (2, "http://private.example/"), (3, "ftp://x.example/"),
        (4, "http://localhost:8000/"), (5, "https://printer.local./"), (6, "https://nowhere.example/"),
        (7, "http://127.0.0.1/"), (8, "https://[2606:4700::1111]/"), (9, "https://mixed.example/"),
    ], "page_id long, url string")
    dns = spark.createDataFrame([
        ("public.example", "93.184.216.34"), ("private.example", "192.168.1.10"),
        ("mixed.example", "8.8.8.8"), ("mixed.example", "10.0.0.1")], "host string, address string")
    got = {r.page_id: r.unsafe_reason for r in guard.guard_urls(pages, {"url": "unsafe_reason"}, dns).collect()}
    assert got == {1: None, 2: guard.NON_GLOBAL, 3: guard.NOT_HTTP, 4: guard.LOCAL_NAME,
                   5: guard.LOCAL_NAME, 6: guard.UNRESOLVED, 7: guard.NON_GLOBAL, 8: None,
                   9: guard.NON_GLOBAL}


def test_salted_join_equals_plain_join(spark):
    fact = spark.range(0, 2000).select(F.col("id").alias("page_id"),
                                       (F.col("id") % 3).alias("k"))
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    salted = joins.join_dimension(fact, dim, "k", max_broadcast_bytes=-1, salt_buckets=7,
                                  salt_cols=("page_id",))
    plain = fact.join(dim, "k", "left")
    assert sorted(salted.collect()) == sorted(plain.collect())


def test_salted_anti_join_equals_plain(spark):
    fact = spark.range(0, 500).select(F.col("id").alias("page_id"), (F.col("id") % 4).alias("k"))
    dim = spark.createDataFrame([(0,), (2,)], "k long")
    salted = joins.join_dimension(fact, dim, "k", how="left_anti", max_broadcast_bytes=-1,
                                  salt_buckets=5, salt_cols=("page_id",))
    assert sorted(salted.collect()) == sorted(fact.join(dim, "k", "left_anti").collect())


def test_a_dimension_of_unknown_size_is_measured(spark):
    dim = spark.createDataFrame(spark.sparkContext.parallelize([(k, "v" * 100) for k in range(50)]), "k long, v string")
    assert joins.measured_bytes(dim) == sum(joins.ROW_BYTES + len(str(k)) + 100 for k in range(50))
    fact = spark.range(100).select(F.col("id").alias("page_id"), (F.col("id") % 50).alias("k"))
    small = joins.join_dimension(fact, dim, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small
    assert joins.join_dimension(fact, dim, "k", max_broadcast_bytes=1000, salt_cols=("page_id",)).count() == 100


def test_only_one_row_per_host_is_shuffled(spark):
    """No exchange by host but above a partial aggregate."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("https://hot.example/").alias("url"))
        dns = pages.select(F.lit("hot.example").alias("host"), F.lit("8.8.8.8").alias("address"))
        hosts = pages.select(F.lit("hot.example").alias("host"))
        lines = guard.host_verdicts(hosts, dns)._jdf.queryExecution().sparkPlan().toString()
        df = guard.host_verdicts(hosts, dns)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        for k, line in enumerate(plan.split("\n")):
            if "Exchange hashpartitioning(host" in line:
                below = plan.split("\n")[k + 1:k + 4]
                assert any("HashAggregate" in x for x in below), (line, below)
        assert "CartesianProduct" not in lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_several_url_columns_are_guarded_at_once(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "http://10.1.1.1/"), (2, "ftp://a.example/", None)], "page_id long, url string, final string")
    dns = spark.createDataFrame([("a.example", "8.8.8.8")], "host string, address string")
    got = {r.page_id: (r.u, r.f) for r in guard.guard_urls(pages, {"url": "u", "final": "f"}, dns).collect()}
    assert got == {1: (None, guard.NON_GLOBAL), 2: (guard.NOT_HTTP, None)}
