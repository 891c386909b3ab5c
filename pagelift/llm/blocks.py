"""Large groups of similar documents, compared block by block.

A key that very many documents share would make a join on it as long as the
square of their number.  The documents that such keys connect form clusters; a
cluster is cut into blocks of bounded rows and bytes, and each task gets two
blocks (or one).  Every pair of a cluster meets in one task, and none is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components


def hot_clusters(rows: DataFrame, hot: int) -> DataFrame:
    """``(id, cluster)`` of the ids in ``rows(key, id)`` that keys of more than ``hot`` rows connect; a written table."""
    keys = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("b")).filter(f"c > {hot}").select("key", "b")
    pairs = rows.join(keys, "key").selectExpr("id as a", "b").distinct()
    return written(components(pairs).selectExpr("node as id", "root as cluster"), "clusters")


def in_blocks(members: DataFrame, rows: int, size: int) -> DataFrame:
    """``members(cluster, id, text, ...)`` once for each pair of blocks ``i <= j`` that its block ``own`` is part of."""
    cut = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum(F.octet_length("text")).alias("bytes"))
    cut = cut.selectExpr("cluster", f"cast(greatest(ceil(c / {rows}), ceil(bytes / {size})) as int) as blocks")
    dealt = members.join(cut, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("_other", met).selectExpr("least(own, _other) as i", "greatest(own, _other) as j", "own", *members.columns)
