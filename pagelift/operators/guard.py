"""Host -> address join and the non-global address test.

Addresses are normalised to fixed-width hex (8 digits for IPv4, 32 for IPv6) so
that CIDR blocks become ``lo <= hex <= hi``; the blocks are a fixed list, so the
test is an expression and every address row is flagged where it is read; a table
of blocks of any size is joined instead by prefix (``block_verdicts``).  Then the flags are combined per host before any shuffle (a partial aggregate): what
is shuffled and joined is one row per host, never one per address.  Verdicts
go back to pages through :func:`pagelift.plans.joins.join_dimension` (measured
broadcast, else a salted join).
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.urls import guard_host, local_host, scheme_host_ok
from ..plans.joins import join_dimension
from ..session import run_table

# Non-global address blocks, and the exceptions inside them that
# are global (standard-library ``is_global`` of Python 3.13).
NON_GLOBAL_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
GLOBAL_EXCEPTIONS_V4 = ("192.0.0.9/32", "192.0.0.10/32")
NON_GLOBAL_V6 = (
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
GLOBAL_EXCEPTIONS_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
)

# Rejection messages.
NOT_HTTP = "Only public HTTP and HTTPS URLs are allowed."
LOCAL_NAME = "Local network addresses are not allowed."
UNRESOLVED = "The hostname could not be resolved."
NON_GLOBAL = "Private, loopback, and reserved addresses are not allowed."


def _within(nets: tuple[str, ...], hx: Column) -> Column:
    """Does the hex address lie in one of the blocks?"""
    hit = F.lit(False)
    for net in map(ipaddress.ip_network, nets):
        width = net.max_prefixlen // 4
        hit = hit | hx.between(f"{int(net.network_address):0{width}x}", f"{int(net.broadcast_address):0{width}x}")
    return hit


def non_global(family: Column, hx: Column) -> Column:
    """U4: an address in a non-global block and in none of its global exceptions; what is no address counts too."""
    v4 = _within(NON_GLOBAL_V4, hx) & ~_within(GLOBAL_EXCEPTIONS_V4, hx)
    v6 = _within(NON_GLOBAL_V6, hx) & ~_within(GLOBAL_EXCEPTIONS_V6, hx)
    return F.when(family == 4, v4).when(family == 6, v6).otherwise(F.lit(True))


#: Hex digits of the prefixes that blocks and addresses meet by: 2^8 for IPv4, 2^16 for IPv6.
PREFIX = {4: 2, 6: 4}


def block_table(spark: SparkSession) -> DataFrame:
    """``cidr(family, lo, hi, is_global)``: the fixed blocks as a table, bounds in hex."""
    rows = []
    for family, nets, ok in ((4, NON_GLOBAL_V4, False), (4, GLOBAL_EXCEPTIONS_V4, True), (6, NON_GLOBAL_V6, False), (6, GLOBAL_EXCEPTIONS_V6, True)):
        for net in map(ipaddress.ip_network, nets):
            width = net.max_prefixlen // 4
            rows.append((family, f"{int(net.network_address):0{width}x}", f"{int(net.broadcast_address):0{width}x}", ok))
    return spark.createDataFrame(rows, "family int, lo string, hi string, is_global boolean")


def block_verdicts(addresses: DataFrame, cidr: DataFrame, salt_cols: tuple[str, ...] = ("hx",)) -> DataFrame:
    """U4 against a table of blocks: the rows of ``addresses(family, hx, ...)`` with ``non_global``.

    Of the blocks that hold an address the smallest decides (of equal ones, one that is global); an address in no
    block is global, what is no address is not.  Blocks and addresses meet by (family, first digits of the address), a
    block in each prefix that it reaches into.  Distinct addresses are judged, and the verdicts go back to the rows."""
    digits = F.when(F.col("family") == 4, PREFIX[4]).otherwise(PREFIX[6])
    number = lambda c: F.conv(F.substring(c, F.lit(1), digits), 16, 10).cast("int")
    reach = cidr.withColumn("_prefix", F.explode(F.sequence(number(F.col("lo")), number(F.col("hi")))))
    reach = reach.select(F.concat_ws(":", "family", "_prefix").alias("_meet"), "lo", "hi", "is_global")
    own = addresses.select("family", "hx").filter("family is not null").distinct().withColumn(
        "_meet", F.concat_ws(":", "family", number(F.col("hx"))))
    held = join_dimension(own, reach, "_meet", how="inner", salt_cols=salt_cols).filter("hx between lo and hi")
    # bounds are hex of one width and blocks nest or lie apart: the smallest has the greatest lower bound, then the least upper one
    upper = F.translate("hi", "0123456789abcdef", "fedcba9876543210")
    best = held.groupBy("family", "hx").agg(F.max(F.struct("lo", upper, "is_global")).alias("b")).select("family", "hx", (~F.col("b.is_global")).alias("_in"))
    found = addresses.join(best, ["family", "hx"], "left")
    return found.withColumn("non_global", F.col("family").isNull() | F.coalesce("_in", F.lit(False))).drop("_in")


def _v4_hex(addr: Column) -> Column:
    def joined(parts: Column) -> Column:
        octets = F.transform(parts, lambda p: F.lpad(F.hex(p.try_cast("int")), 2, "0"))
        return F.when(F.forall(parts, lambda p: p.try_cast("int") <= 255), F.lower(F.array_join(octets, "")))
    return F.when(addr.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), let(F.split(addr, r"\."), joined))


def _v6_hex(addr: Column) -> Column:
    """Zero-padded 32-digit hex of an IPv6 literal (embedded IPv4 allowed)."""
    tail = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"

    def spelled(a: Column) -> Column:
        """An embedded IPv4 address as two groups; null if it is none."""
        quad = let(_v4_hex(F.regexp_extract(a, f"({tail})", 1)), lambda v4: F.concat(
            F.substring(v4, 1, 4), F.lit(":"), F.substring(v4, 5, 4)))
        return F.when(a.rlike(tail), F.concat(F.regexp_replace(a, tail, ""), quad)).otherwise(a)

    def grouped(a: Column) -> Column:
        some = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
        gap = F.struct(a.contains("::").alias("gap"), some(F.when(a.contains("::"), F.regexp_extract(a, "^(.*?)::", 1)).otherwise(a)).alias("head"),
                       some(F.when(a.contains("::"), F.regexp_extract(a, "::(.*)$", 1)).otherwise(F.lit(""))).alias("tail"))
        fill = lambda x: F.greatest(8 - F.size(x["head"]) - F.size(x["tail"]), F.lit(0))
        return let(gap, lambda x: F.concat(x["head"], F.when(x["gap"], F.array_repeat(F.lit("0"), fill(x))).otherwise(F.expr("cast(array() as array<string>)")), x["tail"]))

    def joined(groups: Column) -> Column:
        ok = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike(r"^[0-9a-f]{1,4}$"))
        return F.when(ok, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))
    return let(let(let(F.lower(F.regexp_replace(addr, r"%.*$", "")), spelled), grouped), joined)


def with_address_hex(df: DataFrame, col: str, fam_out: str = "family",
                     hex_out: str = "hx") -> DataFrame:
    """Adds (family, hex) of an address literal; IPv4-mapped IPv6 counts as
    IPv4; both null when ``col`` is not an address literal."""
    def named(x: Column) -> Column:
        v4, v6 = x["v4"], x["v6"]
        mapped = F.coalesce(v6.startswith("00000000000000000000ffff"), F.lit(False))
        return F.struct(F.when(v4.isNotNull() | mapped, F.lit(4)).when(v6.isNotNull(), F.lit(6)).alias("family"),
                        F.when(v4.isNotNull(), v4).when(mapped, F.substring(v6, 25, 8)).otherwise(v6).alias("hx"))

    both = let(F.col(col), lambda a: F.struct(_v4_hex(a).alias("v4"), _v6_hex(a).alias("v6")))
    df = df.withColumn("_address", let(both, named))
    return df.withColumn(fam_out, F.col("_address.family")).withColumn(hex_out, F.col("_address.hx")).drop("_address")


def host_verdicts(hosts: DataFrame, dns: DataFrame, cidr: DataFrame | None = None) -> DataFrame:
    """U3/U4 per distinct host: ``(host, unsafe_reason)``; ``cidr`` is a table of blocks in place of the fixed list.

    An IP-literal host is its own address; a host without addresses is
    unresolved; a host is unsafe when any address is non-global.
    """
    def flagged(addresses: DataFrame) -> DataFrame:
        if cidr is None:
            return addresses.withColumn("non_global", non_global(F.col("family"), F.col("hx")))
        return block_verdicts(addresses, cidr)

    flag = F.col("non_global").cast("int")
    literal = flagged(with_address_hex(hosts.select("host").distinct(), "host")).select(
        "host", F.when(F.col("family").isNotNull(), flag).alias("own"))
    named = (flagged(with_address_hex(dns.select("host", "address"), "address"))
             .select("host", flag.alias("bad")).groupBy("host").agg(F.max("bad").alias("bad")))
    bad = F.greatest("own", "bad")
    return literal.join(named, "host", "left").select("host", F.when(bad.isNull(), F.lit(UNRESOLVED)).when(
        bad == 1, F.lit(NON_GLOBAL)).alias("unsafe_reason"))


def guard_urls(df: DataFrame, url_cols: dict[str, str], dns: DataFrame,
               salt_cols: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``df`` plus, for each URL column, its output column: null when the
    URL is public, else the reason.  The hosts of all columns are judged once."""
    base, hosts = df, None
    for url, out in url_cols.items():
        before = (F.when(~scheme_host_ok(url), F.lit(NOT_HTTP)).when(local_host(url), F.lit(LOCAL_NAME)))
        base = base.withColumn(f"_host_{out}", guard_host(url)).withColumn(f"_before_{out}", F.when(F.col(url).isNotNull(), before))
        own = base.filter(F.col(f"_before_{out}").isNull()).select(F.col(f"_host_{out}").alias("host"))
        hosts = own if hosts is None else hosts.unionByName(own)
    verdicts = run_table(host_verdicts(hosts, dns), "guard")
    for url, out in url_cols.items():
        own = verdicts.select(F.col("host").alias(f"_host_{out}"), F.col("unsafe_reason").alias("_verdict"))
        base = join_dimension(base, own, f"_host_{out}", salt_cols=salt_cols)
        reason = F.coalesce(f"_before_{out}", F.when(F.col(url).isNotNull(), F.col("_verdict")))
        base = base.withColumn(out, reason).drop(f"_host_{out}", f"_before_{out}", "_verdict")
    return base
