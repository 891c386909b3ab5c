"""Connected components of a link table: contraction inside tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that a task contracts at once (some 50 MB).
TASK_LINKS = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node of its component.

    First the links are dealt to tasks of ``TASK_LINKS`` or fewer, and each task draws its own ones together to stars
    around their smallest nodes: as many links remain as there are nodes in it, at most.  One task's stars are the
    components.  Those of several are joined by steps: each is a minimum per node (combined before the shuffle) and a
    join that spreads it over the node's links; the links between steps are a table in the shared folder.  The steps
    end when the links no longer change: all are then stars around their roots.
    """
    edges = written(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").filter("u > v"), "links")
    tasks = -(-edges.count() // TASK_LINKS)
    if tasks:
        edges = written(edges.repartition(tasks).mapInArrow(_contracted, "u long, v long"), "links")
    before = None
    while tasks > 1 and (now := _signature(edges)) != before:
        before = now
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").selectExpr("v as u", "m as v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.selectExpr("v as u", "m as v").filter("u > v").unionByName(low.selectExpr("u", "m as v"))
        edges = written(small.distinct(), "links")
    return edges.selectExpr("u as node", "v as root").unionByName(edges.selectExpr("v as node", "v as root").distinct())


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars around the smallest nodes."""
    pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if pairs:
        nodes, at = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)  # roots are compared by place
        u, v = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[u] != root[v]).any():
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while (root[root] != root).any():
                root = root[root]
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(u, v) as decimal(20, 0))), 0)")).first())
