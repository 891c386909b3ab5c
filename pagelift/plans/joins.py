"""Join helpers for a large fact table against a per-key dimension.

``join_dimension`` broadcasts the dimension only when its measured size (a sum
over its rows, not an estimate) is within a bound; otherwise it salts: the fact
side gets a deterministic salt from a hash of its row, the dimension is
replicated once per salt value, and the join runs on (key, salt) -- so one key
holding a large share of the fact rows is spread over ``salt_buckets`` tasks
instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``join_hot``: rows that a key needs to be hot, and the most hot keys there can be.
HOT_ROWS, HOT_SHARE = 100_000, 10_000
#: ``may_match``: bits per id, and the most bits (2^26 are 2^21 broadcast rows of two numbers, 32 MB).
FILTER_BITS_PER_ID, FILTER_MAX_BITS = 16, 26
BROADCAST_MAX_BYTES = 32 * 1024 * 1024
SALT_BUCKETS = 32
ROW_BYTES = 64


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``: the length of all strings, and ``ROW_BYTES`` for each row."""
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    return df.agg(F.coalesce(F.sum(sum(texts, F.lit(ROW_BYTES)).cast("long")), F.lit(0))).first()[0]


def join_dimension(fact: DataFrame, dim: DataFrame, key: str, how: str = "left",
                   max_broadcast_bytes: int = BROADCAST_MAX_BYTES,
                   salt_buckets: int = SALT_BUCKETS,
                   salt_cols: tuple[str, ...] | None = None) -> DataFrame:
    """``fact`` joined to ``dim`` on ``key``.  ``salt_cols`` (e.g. a unique id)
    give a deterministic salt; without them rows are dealt round-robin.  Any
    salt assignment gives the same result: every salt value exists in the
    replicated dimension.  ``dim`` is read once to measure it, so it should be
    a written table or a cheap plan."""
    if max_broadcast_bytes >= 0 and measured_bytes(dim) <= max_broadcast_bytes:
        return fact.join(F.broadcast(dim), key, how)
    if salt_cols:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salt_buckets))
    else:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(salt_buckets))
    salted_fact = fact.withColumn("_salt", salt.cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return salted_fact.join(salted_dim, [key, "_salt"], how).drop("_salt")


def join_hot(fact: DataFrame, dim: DataFrame, key: str, salt_cols: tuple[str, ...], how: str = "inner",
             least: int = HOT_ROWS, salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """``fact`` joined to a wide ``dim``, whose rows are repeated for hot keys only.

    Keys are counted first (combined before the shuffle).  A hot key has more than ``least`` rows and more than one in
    ``HOT_SHARE`` of all, so there are fewer than ``HOT_SHARE`` of them, which bounds what is broadcast; its rows are
    dealt over salts by ``salt_cols``.  All other keys join as they are.  Both sides are read twice."""
    total = fact.count()
    hot = (fact.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(least, total // HOT_SHARE))
           .select(key, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64(*salt_cols), F.lit(salt_buckets)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt_buckets - 1))).otherwise(F.array(F.lit(0)))
    own = fact.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    other = dim.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return own.join(other, [key, "_salt"], how).drop("_salt")


def may_match(wide: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``wide`` whose ``key`` may be in ``ids`` (one column of that name): all that are, and few others.

    A hash of each id sets a bit; the words of bits are a broadcast table whose size is bounded whatever the number
    of ids, so ``wide`` is filtered in its scan and never shuffled.  Past the bound more rows slip through; an exact
    join on what is left of them follows anyway.  ``ids`` is read twice, so it should be a written table."""
    n = ids.count()
    if not n:
        return wide.filter("false")
    bits = min(FILTER_MAX_BITS, max(10, (FILTER_BITS_PER_ID * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    words = (ids.select(place.alias("_p")).groupBy(F.expr("_p div 32").alias("_word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(_p % 32 as int)))").alias("_bits")))
    held = wide.withColumn("_p", place).withColumn("_word", F.expr("_p div 32")).join(F.broadcast(words), "_word")
    return held.filter("shiftright(_bits, cast(_p % 32 as int)) & 1 = 1").select(wide.columns)
