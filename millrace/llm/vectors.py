"""Near-duplicate vectors: tiles of int8 products, with full precision where they can't decide.

A vector x of length 1 is written as s q + e with whole numbers q of at most 127 and
the rest e. For two of them the cosine differs from the product of the quantised parts
by at most |s q| |e'| + |e| |s' q'| + |e| |e'|. The lengths are computed once for each
vector, so the bound is rigorous. Tiles get a byte a component and two lengths; a pair
is linked, not linked, or open by the bound. Vectors with open pairs go to their tile
once more in double precision, which decides them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.deploy import ship
from millrace.core.durable import cut
from millrace.graph.components import components
from millrace.operators.join import apart

#: Rounding of the few double operations behind a bound.
_SLACK = 1e-9
_PAIRS = 50_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(q, |s q|, |e|) of a vector scaled to length 1; s is |s q| over the length of q."""
    unit = x / np.linalg.norm(x)
    scale = np.abs(unit).max() / 127
    q = np.rint(unit / scale)
    return q.astype(np.int8), float(np.linalg.norm(scale * q)), float(np.linalg.norm(unit - scale * q))


def _usable(vector) -> np.ndarray | None:
    if vector is None or not vector or None in vector:
        return None
    x = np.array(vector, dtype=np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return x / 2.0 ** np.frexp(np.abs(x).max())[1]  # a power of two: exact, and squares stay in range


def _prepared(rows: DataFrame) -> DataFrame:
    """(id, group, node, vector) of (id, label, vector): group of equal label and length, node of equal vectors in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, nodes, vectors = [], [], []
            for label, value in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
                x = None if label is None else _usable(value)
                group = None if x is None else f"{len(x)}:{label}"
                groups.append(group)
                vectors.append(None if x is None else x.tobytes())
                nodes.append(None if x is None else xxhash.xxh3_128_digest(group.encode() + b"\0" + (x + 0.0).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(groups, pa.string()), pa.array(nodes, pa.binary()), pa.array(vectors, pa.binary())], ["id", "group", "node", "vector"]
            )

    schema = T.StructType([rows.schema["id"]]).add("group", "string").add("node", "binary").add("vector", "binary")
    return rows.mapInArrow(run, schema)


def _quantised(nodes: DataFrame) -> DataFrame:
    """nodes with q (int8), size and rest of each vector, see quantise()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [quantise(np.frombuffer(v, dtype=np.float64)) for v in batch.column("vector").to_pylist()]
            q, size, rest = zip(*parts) if parts else ((), (), ())
            new = [pa.array([v.tobytes() for v in q], pa.binary()), pa.array(size, pa.float64()), pa.array(rest, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "q", "size", "rest"])

    schema = T.StructType([*nodes.schema.fields]).add("q", "binary").add("size", "double").add("rest", "double")
    return nodes.mapInArrow(run, schema)


class _Forest:
    """Links as a root for each place, the least of those joined."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while len(u) and (label[u] != label[v]).any():  # hang the greater root below the less, then level
            low = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            while (label != label[label]).any():
                label = label[label]
        self.label = label


def _bounded(table: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, sure) of the pairs of a tile that the bound leaves possible; sure are those that it makes certain."""
    own = table.column("block").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    q = np.stack([np.frombuffer(v, dtype=np.int8) for v in table.column("q").to_pylist()])
    size, rest = table.column("size").to_numpy(), table.column("rest").to_numpy()
    exact = np.float32 if 127 * 127 * q.shape[1] < 2**24 else np.float64  # sums of products of int8 are whole numbers
    scale = size / np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    wide = q[right].astype(exact).T
    for start in range(0, len(left), 128):
        some = left[start : start + 128]
        near = (q[some].astype(exact) @ wide).astype(np.float64) * (scale[some, None] * scale[right])
        bound = size[some, None] * rest[right] + rest[some, None] * (size[right] + rest[right]) + _SLACK
        a, b = np.nonzero(near + bound >= least)
        u, v, sure = some[a], right[b], near[a, b] - bound[a, b] >= least
        if i == j:
            first = u < v
            u, v, sure = u[first], v[first], sure[first]
        yield u, v, sure


def _counted(table: pa.Table, links: np.ndarray, forest: _Forest) -> pa.Table:
    nodes = np.array(table.column("node").to_pylist(), dtype=object)
    return pa.table({"node": pa.array(nodes.tolist(), pa.binary()), "links": pa.array(links), "root": pa.array(nodes[forest.label].tolist(), pa.binary())})


def _tile(least: float):
    """Of a pair of blocks: how many vectors each is certainly linked with in it, a forest of these links, and whether it has open pairs."""

    def run(table: pa.Table) -> pa.Table:
        copies = table.column("copies").to_numpy()
        links, forest, open_ = np.zeros(len(copies), np.int64), _Forest(len(copies)), np.zeros(len(copies), bool)
        for u, v, sure in _bounded(table, least):
            open_[u[~sure]] = open_[v[~sure]] = True
            u, v = u[sure], v[sure]
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            forest.join(u, v)
        out = _counted(table, links, forest)
        for c in ("group", "i", "j", "block", "copies"):
            out = out.append_column(c, table.column(c))
        return out.append_column("open", pa.array(open_))

    return run


def _decided(least: float):
    """The same of the open pairs, from the vectors that have any."""

    def run(table: pa.Table) -> pa.Table:
        copies = table.column("copies").to_numpy()
        x = np.stack([np.frombuffer(v, dtype=np.float64) for v in table.column("vector").to_pylist()])
        lengths = np.linalg.norm(x, axis=1)
        links, forest = np.zeros(len(copies), np.int64), _Forest(len(copies))
        for u, v, sure in _bounded(table, least):
            u, v = u[~sure], v[~sure]
            for at in range(0, len(u), _PAIRS):
                a, b = u[at : at + _PAIRS], v[at : at + _PAIRS]
                near = np.einsum("ij,ij->i", x[a], x[b]) / (lengths[a] * lengths[b]) >= least
                a, b = a[near], b[near]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                forest.join(a, b)
        return _counted(table, links, forest)

    return run


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, tile: int = 8192
) -> DataFrame:
    """Link vectors of one label whose cosine in double precision is least or more.

    Returns one row for each input row: id_col, n_links (other rows linked directly),
    component_id (smallest id reachable over links, itself included) and kept (the
    row's id is that one).

    Vectors that are null, empty, zero, or hold null or non-finite components, and those
    with a null label, link with nothing; vectors of different lengths don't link.
    Equal vectors of a label are one node with a number of copies. Rows with a null id
    count as links of others, get null in component_id and aren't kept. Rows that share
    an id all count. Other columns aren't read; an empty table gives an empty result.

    The nodes of a label are dealt out to blocks of about tile nodes by a hash; each
    pair of blocks is one task's work. A task returns sums and one root for each node,
    so no pair of vectors becomes a row. A node of d components goes to each block of
    its label as d bytes and some 60 more, and as 8 d bytes again only to those where
    it has open pairs. All vectors of a label are compared, as it is asked for, so the
    work, and what is sent divided by tile, grows with the square of a label.
    """
    ship(rows.sparkSession)
    given = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    base = _prepared(given)
    nodes = base.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("group").alias("group"), F.min("vector").alias("vector"))
    nodes = cut(_quantised(nodes))
    sizes = nodes.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "q", "size", "rest")
    counted = "node binary, links long, root binary"
    bounded = cut(tiles.groupBy("group", "i", "j").applyInArrow(_tile(least), f"{counted}, group string, i int, j int, block int, copies long, open boolean"))
    asked = bounded.where("open").select("group", "i", "j", "block", "node", "copies").join(nodes.select("node", "q", "size", "rest", "vector"), "node")
    decided = asked.groupBy("group", "i", "j").applyInArrow(_decided(least), counted)
    found = cut(bounded.select("node", "links", "root").unionByName(decided))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> root").select("node", "root"))
    named = nodes.select("node", "first_id", "copies").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    whole = named.join(apart(ids, "root"), "root").join(linked, "node").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = base.select("id", "node").join(whole, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))
    )
