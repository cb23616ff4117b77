"""Near-duplicate documents: similarity sketches, banding and exact verification.

The sketch is the one of Dahlgaard, Knudsen and Thorup (2017): in round i each
element is thrown into one of t bins with value i plus a fraction; rounds from t on
throw all elements into bin i - t, so 2t rounds fill every bin, and the share of
equal coordinates is concentrated about the Jaccard similarity as if coordinates
were independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.deploy import ship
from millrace.core.durable import cut, release
from millrace.graph.components import components
from millrace.operators.join import apart
from millrace.llm.kept import tidy
from millrace.llm.text import fold, mix, shingle_hashes, text_slices, word_hashes, words

_EMPTY = np.uint64(2**64 - 1)
_VALUE = np.uint64(2**52 - 1)
_S32, _S52 = np.uint64(32), np.uint64(52)


def similarity_sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of a set of 64-bit hashes (at least one), as one number for each bin."""
    out = np.full(bins, _EMPTY)
    step = max(1, min(2 * bins, -(-4 * bins // len(elements))))  # rounds at once: later ones never change a full bin
    for start in range(0, 2 * bins, step):
        rounds = np.arange(start, min(2 * bins, start + step), dtype=np.uint64)[:, None]
        hashes = mix(elements[None, :] ^ mix(rounds + np.uint64(1)))
        at = ((hashes >> _S32) * np.uint64(bins)) >> _S32
        fixed = rounds >= bins
        if fixed.any():
            at = np.where(fixed, rounds - np.uint64(bins) * fixed, at)
        np.minimum.at(out, at.ravel().astype(np.intp), ((rounds << _S52) | (hashes & _VALUE)).ravel())
        if start + step >= 1 and not (out == _EMPTY).any():
            break
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band of consecutive coordinates; equal only for equal bands of one place."""
    rows = sketch.reshape(bands, -1)
    return fold([np.arange(bands, dtype=np.uint64), *rows.T])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words(text)), width))


def _node(elements: np.ndarray) -> bytes | None:
    """The identity of a set: 128 bits over its sorted hashes."""
    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int, bands: int) -> DataFrame:
    """(id, n_shingles, node, keys) of each row; node identifies the shingle set, keys its bands; both null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
            keys = [band_keys(similarity_sketch(s, rows * bands), bands).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(map(len, sets), pa.int64()), pa.array(map(_node, sets), pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n_shingles", "node", "keys"],
            )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("n_shingles", "long").add("node", "binary").add("keys", T.ArrayType(T.LongType()))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def _sets(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """(node, elements, keys) of each row of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sets = [s for t in part.column("text").to_pylist() if len(s := shingle_set(t, width))]
            keys = [band_keys(similarity_sketch(s, rows * bands), bands).view(np.int64) for s in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_node, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], longs), pa.array(keys, longs)], ["node", "elements", "keys"]
            )

    return docs.select("text").mapInArrow(tidy(run), "node binary, elements array<long>, keys array<long>")


def _similar(a: Column, b: Column, common: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(_similar(F.size("x"), F.size("y"), common, percent)).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (node, ...) with the root of each node, itself if it has no link."""
    return members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open_buckets(members: DataFrame) -> DataFrame:
    """The members of those buckets that still hold more than one component."""
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return members.join(apart(mixed, "key"), "key")


def _tile(percent: int):
    """Links across components between the nodes of one block, or of two, as a forest over the components.

    Only pairs that share a band count. A node's set is looked up in the sets of all
    its candidates at once; pairs connected by then are skipped.
    """

    def run(table: pa.Table) -> pa.Table:
        first = table.column("i").to_numpy() == table.column("block").to_numpy()
        nodes, roots = table.column("node").to_pylist(), table.column("root").to_pylist()
        lists = table.column("elements").combine_chunks()
        ends = lists.offsets.to_numpy()
        values, codes = np.unique(lists.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)
        ends = ends - ends[0]
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        sizes = np.diff(ends)
        parent = {r: r for r in roots}

        def top(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = (np.arange(len(nodes)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        mark, links = np.zeros(len(values), bool), []
        for a in left.tolist():
            others = right[right > a] if same else right
            others = others[(keys[others] == keys[a]).any(axis=1)]
            others = others[100 * np.minimum(sizes[others], sizes[a]) >= percent * np.maximum(sizes[others], sizes[a])]
            own = top(roots[a])
            others = np.array([b for b in others.tolist() if top(roots[b]) != own], dtype=int)
            if not len(others):
                continue
            mark[codes[ends[a] : ends[a + 1]]] = True
            found = np.concatenate([codes[ends[b] : ends[b + 1]] for b in others.tolist()])
            starts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
            common = np.add.reduceat(mark[found].astype(np.int64), starts)
            mark[codes[ends[a] : ends[a + 1]]] = False
            for b in others[100 * common >= percent * (sizes[a] + sizes[others] - common)].tolist():
                x, y = top(roots[a]), top(roots[b])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((nodes[a], nodes[b]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return run


def _across(members: DataFrame, sets: DataFrame, percent: int, block: int, large: int) -> DataFrame:
    """The links (a, b), as far as components need them, between members (key, node, n, root) of one bucket.

    Buckets that share members are taken together as a group, so that a pair is looked
    at once however many bands it shares; the buckets of a group of more than large
    elements stay apart. A group is dealt out to blocks of about block elements by a
    hash of the node, and each pair of blocks is one task's work: no pair of nodes
    becomes a row, and no task holds more than two blocks.
    """
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    spokes = cut(members.join(apart(hubs, "key"), "key").select("node", "hub").distinct())
    joined = components(spokes)
    release(spokes)
    named = joined.withColumnRenamed("root", "group")
    nodes = members.select("node", "n", "root").distinct().join(named, "node")
    sizes = nodes.groupBy("group").agg(F.sum("n").alias("total"))
    whole = nodes.join(sizes.where(F.col("total") <= large), "group").select("group", "node", "root", "total")
    by_band = members.join(named, "node").join(sizes.where(F.col("total") > large).select("group"), "group", "left_semi")
    by_band = by_band.select(F.col("key").cast("string").cast("binary").alias("group"), "node", "root", "n")
    parts = by_band.groupBy("group").agg(F.sum("n").alias("total"))
    every = whole.unionByName(by_band.join(parts, "group").select("group", "node", "root", "total"))
    blocks = F.ceil(F.col("total") / block).cast("int")
    dealt = every.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "elements", "keys")
    return tiles.groupBy("group", "i", "j").applyInArrow(_tile(percent), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = 5, bands: int = 32, block: int = 600_000, large: int = 20_000_000
) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more.

    Returns one row for each input row: id_col, n_shingles (size of its set of distinct
    shingles of width words; fewer words make one shingle), component_id (smallest id
    reachable over links) and kept (the row's id is that one). Links are confirmed on
    the full sets. A pair at the threshold shares no band with probability
    (1 - s^rows)^bands: 3e-6 for s = 0.8 and 7e-9 for 0.85 at the defaults.

    Rows without words or text have an empty set and link with nothing. Equal sets are
    one node from the start. Rows of one id all count; each has the id's own flags.
    Rows with a null id link like any others, also with each other only through them,
    but get null in component_id, aren't kept, and never give a component its id; a
    component of such rows alone has no id. Other columns aren't read; an empty table
    gives an empty result.

    No bucket is expanded into all its pairs. First each node is compared with one
    pivot, the least node of its buckets; that joins most copies. Buckets that still
    hold several components are then compared across components in tiles, see
    _across(), so every pair that shares a bucket is either compared or connected.
    """
    ship(docs.sparkSession)
    base = cut(sketches(docs, id_col, text_col, width, rows, bands))
    classes = base.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))

    placed = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot <> other").select("key", "pivot")
    members = cut(placed.join(apart(shared, "key"), "key"))

    wanted = members.select("node").distinct()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = base.where("node is not null").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    texts = named.join(chosen.select("id").distinct(), "id", "left_semi").unionByName(named.where("id is null"))  # a node may have rows without an id only
    sets = cut(_sets(texts, width, rows, bands).join(wanted, "node", "left_semi").dropDuplicates(["node"]))

    count = members.count()
    pairs = members.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("b")).withColumnRenamed("node", "a")
    verified = cut(_verified(pairs, sets, percent), count)
    labels = components(verified)
    opened = cut(_open_buckets(_labelled(members.select("key", "node", "n"), labels)), count)
    release(members, verified)
    if not opened.isEmpty():
        links = cut(_across(opened, sets, percent, block, large))
        labels = components(links.unionByName(labels.toDF("a", "b")))
        release(links)
    release(opened, sets)

    named = _labelled(classes.select("node", "first_id"), labels)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = named.join(apart(least, "root"), "root").select("node", "component_id")
    out = base.join(of_node, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))
    )
