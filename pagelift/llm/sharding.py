"""Balanced label propagation: linked documents gather in shards of even size.

Links join documents of equal texts.  Every document starts in a shard drawn
from a hash of its row.  In each round Spark joins count, for every group of
linked documents, its members by shard; members elsewhere ask for the shard
that holds most of their neighbours, and each shard admits as many as its
quota has room for.  A histogram of a group hash (a table of fixed size)
decides who moves, so that groups move whole while the quota lasts, and a group
larger than a shard moves in part.  Rounds end when no link can be mended or
the quotas are used up.

Documents without links have no neighbours to prefer: together with what a
shard holds above its quota they fill the shards up to counts at most one
apart (law ``rows``).  Row numbers come from counts per hash bucket, offsets
over those counts and numbers within a bucket, so no task sorts a whole shard.

All steps are DataFrame operations.  A group may hold any share of the rows:
its counts are combined before the shuffle and its rows are narrow.

Defined cases: a null text has size 1, checksum 0 and no links (nor do texts
that stand once); empty texts are equal texts; repeated rows are linked
documents with slots of their own; fewer documents than shards leave shards
empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
MAX_ROUNDS = 8
GROUP_BUCKETS = 1024
BUCKET_ROWS = 20_000
_UNIT = 1 << 30


def _hash(n: int, *columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n))


def numbered(rows: DataFrame, within: list[str], coarse: Column, fine: Column) -> DataFrame:
    """``rows`` with a gapless ``number`` from 0 within ``within``, in order of ``coarse``, ``fine`` and ``row``."""
    rows = rows.withColumns({"_coarse": coarse, "_fine": fine})
    keys = [*within, "_coarse", "_fine"]
    fine_counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    upper = fine_counts.groupBy(*keys[:-1]).agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.withColumn("_upper", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    before = Window.partitionBy(*keys[:-1]).orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (fine_counts.withColumn("_lower", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
               .join(upper, keys[:-1]).withColumn("_offset", F.col("_upper") + F.col("_lower")).select(*keys, "_offset"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("row")) - 1
    return (rows.withColumn("_own", own).join(offsets, keys)
            .withColumn("number", F.col("_own") + F.col("_offset")).drop("_coarse", "_fine", "_own", "_offset"))


def linked_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a link, rows with one and their ``group``): doc_id, size, text_crc32 and a row number."""
    text = F.col("text").cast("string")
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("key")).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    same = ["key", "text_crc32", "size"]
    groups = rows.filter("key is not null").groupBy(*same).agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    linked = rows.join(groups, same, "left_semi").withColumn("group", F.xxhash64(*same))
    free = rows.join(groups, same, "left_anti")
    return free.drop("key"), linked.drop("key")


def _targets(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _by_number(values: dict[int, float], key: Column) -> Column:
    """The value of a small driver-side table for ``key``; 0 elsewhere."""
    cells = reduce(lambda out, kv: [*out, F.lit(kv[0]), F.lit(kv[1])], values.items(), [])
    return F.coalesce(F.try_element_at(F.create_map(*cells), key), F.lit(0)) if cells else F.lit(0)


def propagate(linked: DataFrame, targets: list[int], rounds: int = MAX_ROUNDS) -> DataFrame:
    """``linked`` with a ``shard`` each, after rounds of moves under quotas."""
    shards = len(targets)
    linked = written(linked.withColumn("shard", _hash(shards, "row", F.lit("start")).cast("int")), "shard-labels")
    for number in range(rounds):
        load = {r.shard: r.c for r in linked.groupBy("shard").agg(F.count("*").alias("c")).collect()}
        rooms = {s: targets[s] - load.get(s, 0) for s in range(shards) if targets[s] > load.get(s, 0)}
        counts = linked.groupBy("group", "shard").agg(F.count("*").alias("c"))
        whole = counts.groupBy("group").agg(F.sum("c").alias("n"))
        if rooms:  # besides its neighbours' shards, a group may go to one that has room
            other = F.element_at(F.array(*map(F.lit, rooms)), (_hash(len(rooms), "group", F.lit(number)) + 1).cast("int"))
            counts = counts.unionByName(whole.select("group", other.alias("shard"), F.lit(0).cast("long").alias("c")))
        # a group larger than a shard has as many homes as it needs
        homes = F.ceil(F.col("n") / max(1, min(targets)))
        room = _by_number(rooms, F.col("shard"))
        order = Window.partitionBy("group").orderBy(
            F.desc(F.least(F.col("c") + room, F.ceil(F.col("n") / homes))), F.desc("c"), F.xxhash64("group", "shard"))
        ranked = (counts.groupBy("group", "shard").agg(F.max("c").alias("c")).join(whole, "group")
                  .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= homes))
        ranked = ranked.groupBy("group").agg(F.collect_list("shard").alias("homes"),
                                             F.collect_list(F.when(room > 0, F.col("shard"))).alias("open"))
        picked = F.try_element_at("open", (F.pmod(F.xxhash64("row", F.lit(number)), F.greatest(F.lit(1), F.size("open"))) + 1).cast("int"))
        asking = (linked.join(ranked, "group")
                  .withColumn("wish", F.when(F.array_contains("homes", F.col("shard")) | (F.size("open") == 0), F.col("shard")).otherwise(picked))
                  .drop("homes", "open").withColumn("bucket", _hash(GROUP_BUCKETS, "group", F.lit(number)).cast("int")))
        # shards x shards x buckets rows at most
        histogram = written(asking.groupBy("shard", "wish", "bucket").agg(F.count("*").alias("c")), "shard-histogram")
        wants = {(r.shard, r.wish): r.c for r in histogram.filter("shard != wish").groupBy("shard", "wish").agg(F.sum("c").alias("c")).collect()}
        quota = {}
        for (a, b), c in wants.items():
            room = rooms.get(b, 0)
            all_wants = sum(n for (_, to), n in wants.items() if to == b)
            # a move between two shards that is met by one the other way needs no room
            met = min(c, wants.get((b, a), 0))
            quota[a * shards + b] = min(c, max(met, int(c * min(1.0, room / all_wants))))
        if not sum(quota.values()):
            break
        up_to = Window.partitionBy("shard", "wish").orderBy("bucket")
        left = _by_number(quota, F.col("shard") * shards + F.col("wish")) - (F.sum("c").over(up_to) - F.col("c"))
        admitted = (histogram.filter("shard != wish").withColumn("part", F.greatest(F.lit(0), F.least(left, F.col("c"))) / F.col("c"))
                    .select("shard", "wish", "bucket", "part"))
        moves = _hash(_UNIT, "row", F.lit(number)) < F.coalesce("part", F.lit(0.0)) * _UNIT
        linked = written(asking.join(F.broadcast(admitted), ["shard", "wish", "bucket"], "left")
                         .withColumn("shard", F.when(moves, F.col("wish")).otherwise(F.col("shard"))).drop("wish", "bucket", "part"), "shard-labels")
    return linked


def shards(docs: DataFrame, n_shards: int = SHARDS, rounds: int = MAX_ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    free, linked = linked_groups(docs)
    total = free.count() + linked.count()
    targets = _targets(total, n_shards)
    buckets = max(1, -(-total // BUCKET_ROWS))
    linked = propagate(linked, targets, rounds)
    row_bucket = _hash(buckets, "row", F.lit("slot"))
    group_bucket = _hash(max(64, buckets), "group")

    # what is above a quota leaves: the last groups in order of the group hash
    placed = written(numbered(linked, ["shard"], group_bucket, row_bucket), "shard-placed")
    fits = F.col("number") < _by_number(dict(enumerate(targets)), F.col("shard"))
    kept = placed.filter(fits).drop("number")
    held = {r.shard: r.c for r in kept.groupBy("shard").agg(F.count("*").alias("c")).collect()}
    # the rest fills what is missing, those of one group next to each other
    rest = placed.filter(~fits).drop("number", "shard").unionByName(free.withColumn("group", F.lit(None).cast("long")))
    rest = numbered(rest, [], F.when(F.col("group").isNull(), max(64, buckets) + row_bucket).otherwise(group_bucket),
                    F.when(F.col("group").isNull(), F.lit(0)).otherwise(row_bucket))
    ends, end = [], 0
    for s in range(n_shards):
        end += targets[s] - held.get(s, 0)
        ends.append((s, end))
    shard = reduce(lambda other, part: F.when(F.col("number") < part[1], F.lit(part[0])).otherwise(other), reversed(ends[:-1]), F.lit(n_shards - 1))
    rest = rest.withColumn("shard", shard.cast("int")).drop("number")
    final = written(kept.unionByName(rest), "shard-final")
    return (numbered(final, ["shard"], row_bucket, F.lit(0))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("number").cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def cut_links(placed: DataFrame) -> DataFrame:
    """Pairs of equal texts, and those in different shards, from ``placed(text_crc32, size, shard)``."""
    by = placed.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("c"))
    return by.groupBy("text_crc32", "size").agg(F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1) / 2")).alias("inside")).agg(
        F.sum(F.expr("n * (n - 1) / 2")).alias("pairs"), F.sum(F.expr("n * (n - 1) / 2 - inside")).alias("cut"))
