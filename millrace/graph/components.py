"""Connected components of a link table.

A table of a few million links at most is joined up in one task by union-find; a
larger one by alternating large-star and small-star steps (Kiveris et al., 2014).
Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from millrace.core.deploy import ship
from millrace.core.durable import cut, release

#: Links that one task takes: 128-bit names of this many pairs need about 300 MB there.
ONE_TASK = 1_000_000


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node u with its least neighbour, itself included; a hot node is pre-aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = _both_ways(edges)
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges run from larger to smaller."""
    low = _lowest(edges)
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of the batches, by union-find with the least node as root."""
    parent: dict = {}
    kind = None

    def root(x):
        top = x
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for start in range(0, len(nodes), 50_000):
        part = nodes[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array(map(root, part), kind)], ["node", "root"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node that has a link to another; root is the least node reachable.

    links has two columns of one orderable type; direction, repeats and loops don't
    matter, and rows with a null are left out. It is read more than once, so it should
    come from a checkpoint or a file; the result does. Beyond one_task links every step
    is a join on a node or a distinct, never a list of neighbours.
    """
    a, b = links.columns
    links = links.where(F.col(a) != F.col(b))
    n = links.count()
    if n <= one_task:
        ship(links.sparkSession)
        kind = links.schema[a].dataType
        schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
        return cut(links.repartition(1).mapInArrow(_joined, schema))
    edges, seen, last = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), None, []
    while (now := _print(edges)) != seen:
        seen = now
        edges = cut(_small_star(_large_star(edges)), n)
        release(*last)  # only the next round read it
        last = [edges]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
