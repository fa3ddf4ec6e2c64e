"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, larger, settle, unite, written

#: Links of whole numbers that a task contracts at once; where there are no more in all, the last task finds the components by itself.
CHUNK = 1 << 20


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node and root, its component's least node, for every node that has a link.

    ``links`` has columns a and b of one sortable type; loops, repeated links and nulls are ignored; no links give no rows.
    Links of integers are first contracted in chunks within tasks.  If at most ``CHUNK`` are left (16 MB), one task
    does the rest; else rounds of stars do, each beginning with such a contraction.  In these a node with very many links costs a partial minimum for each task, and
    as the minima are a written table, the join with them is one that Spark splits where a node's links are too many for one task.
    Each round is a written table, from which lost executors' work is resumed.
    """
    plain = links.schema["a"].dataType.simpleString() in ("bigint", "int")
    edges = _ordered(links)
    edges = written(edges.mapInArrow(_contracted, edges.schema) if plain else edges, "links")
    n = edges.count()
    if plain and n <= chunk or not n:
        edges = edges.repartition(1).mapInArrow(_contracted, edges.schema) if n else edges
        return _hung(written(edges, "links"))
    seen = None
    while True:
        # Large star: each node's greater neighbours go to the least of its neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        # Small star: of each node's lesser neighbours, all go to the least, and so does the node.
        pairs = written(_ordered(large), "links")
        low = written(pairs.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = pairs.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b"))
        edges = _ordered(small)
        edges = written(edges.mapInArrow(_contracted, edges.schema) if plain else edges, "links")
        # At the end every node hangs on its root alone: the sum over links no longer changes.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return _hung(edges)
        seen = now


def _hung(edges: DataFrame) -> DataFrame:
    """node and root from links (root, node)."""
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _contracted(batches):
    """Each chunk's links as stars around the least nodes of its own components."""
    for b in larger(batches, CHUNK):
        ends = np.stack([np.asarray(column(b, c)) for c in ("a", "b")])
        nodes, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        root = settle(unite(np.arange(len(nodes)), at[0], at[1]))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[moved]], b.schema.field("a").type), pa.array(nodes[moved], b.schema.field("b").type)], ["a", "b"])


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
