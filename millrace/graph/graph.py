"""Property graphs: vertices with an id, edges between ids, and fields on both.

A graph never changes; every method gives a new one. Edges may repeat.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.core import types as K
from millrace.core.deploy import ship
from millrace.core.durable import cut
from millrace.table import Table

ID, SRC, DST = "__id", "__src_id", "__dst_id"


@dataclass
class Vertex:
    vid: object
    attr: dict = field(default_factory=dict)


@dataclass
class Edge:
    src_vid: object
    dst_vid: object
    attr: dict = field(default_factory=dict)


def _rows(spark: SparkSession, items, keys: list[str]) -> DataFrame:
    """Vertices, edges, tables or DataFrames as a DataFrame."""
    if isinstance(items, DataFrame):
        return K.standardised(items)
    if isinstance(items, Table):
        return items.frame()
    items = [items] if isinstance(items, (Vertex, Edge)) else list(items)
    named = [dict(zip(keys, (i.vid,) if isinstance(i, Vertex) else (i.src_vid, i.dst_vid))) | i.attr for i in items]
    return Table.of(spark, named).frame()


class Graph:
    def __init__(self, spark: SparkSession, vertices=None, edges=None, vid_field: str = ID, src_field: str = SRC, dst_field: str = DST):
        self.spark = spark
        self._v = self._e = None
        graph = self
        if vertices is not None:
            graph = graph.add_vertices(vertices, vid_field)
        if edges is not None:
            graph = graph.add_edges(edges, src_field, dst_field)
        self._v, self._e = graph._v, graph._e

    @classmethod
    def _of(cls, spark: SparkSession, v: DataFrame | None, e: DataFrame | None) -> Graph:
        out = cls(spark)
        out._v, out._e = v, e
        return out

    def _kind(self) -> T.DataType:
        return self._v.schema[ID].dataType if self._v is not None else K.INT

    @property
    def vertices(self) -> DataFrame:
        return self._v if self._v is not None else self.spark.createDataFrame([], T.StructType([T.StructField(ID, self._kind())]))

    @property
    def edges(self) -> DataFrame:
        return self._e if self._e is not None else self.spark.createDataFrame([], T.StructType([T.StructField(SRC, self._kind()), T.StructField(DST, self._kind())]))

    # construction ------------------------------------------------------------
    def add_vertices(self, vertices, vid_field: str = ID) -> Graph:
        """Vertices that are new, or replace all fields of one with their id; fields that one side lacks are null."""
        df = _rows(self.spark, vertices, [vid_field]).withColumnRenamed(vid_field, ID).dropDuplicates([ID])
        if self._v is None:
            return Graph._of(self.spark, df, self._e)
        kept = self._v.join(df.select(ID), ID, "left_anti")
        return Graph._of(self.spark, kept.unionByName(df, allowMissingColumns=True), self._e)

    def add_edges(self, edges, src_field: str = SRC, dst_field: str = DST) -> Graph:
        """More edges; ends that aren't vertices yet become vertices without fields."""
        df = _rows(self.spark, edges, [src_field, dst_field]).withColumnsRenamed({src_field: SRC, dst_field: DST})
        ends = df.select(F.col(SRC).alias(ID)).union(df.select(F.col(DST).alias(ID))).distinct()
        if self._v is None:
            v = ends
        else:
            v = self._v.unionByName(ends.join(self._v.select(ID), ID, "left_anti"), allowMissingColumns=True)
        return Graph._of(self.spark, v, df if self._e is None else self._e.unionByName(df, allowMissingColumns=True))

    # queries -----------------------------------------------------------------
    def summary(self) -> dict[str, int]:
        return {"num_vertices": self.vertices.count(), "num_edges": self.edges.count()}

    def get_vertex_fields(self) -> list[str]:
        return self.vertices.columns

    def get_edge_fields(self) -> list[str]:
        return self.edges.columns

    def get_fields(self) -> list[str]:
        return self.get_vertex_fields() + self.get_edge_fields()

    @staticmethod
    def _matching(df: DataFrame, fields: dict | None) -> DataFrame:
        for name, v in (fields or {}).items():
            if v is not None:
                df = df.where(F.col(f"`{name}`").isin(*v) if isinstance(v, (list, tuple)) else F.col(f"`{name}`") == v)
        return df

    def get_vertices(self, ids=None, fields: dict | None = None) -> DataFrame:
        """Vertices of some ids whose fields have the values given; a value of None allows any."""
        df = self._matching(self.vertices, fields)
        if ids is None:
            return df
        ids = ids if isinstance(ids, (list, tuple, set, DataFrame)) else [ids]
        return df.join(ids.toDF(ID), ID, "left_semi") if isinstance(ids, DataFrame) else df.where(F.col(ID).isin(*ids))

    def get_edges(self, src_ids=None, dst_ids=None, fields: dict | None = None) -> DataFrame:
        """Edges between pairs of ids, given as two lists; None in a pair, or for a list, allows any."""
        df = self._matching(self.edges, fields)
        one = lambda x: x if isinstance(x, (list, tuple)) else [x]
        src, dst = one(src_ids), one(dst_ids)
        n = max(len(src), len(dst))
        src, dst = (x * n if len(x) == 1 else list(x) for x in (list(src), list(dst)))
        if len(src) != len(dst):
            raise ValueError("source and destination ids must pair up")
        if (None, None) in zip(src, dst):
            return df
        found, rest = None, df
        for keys in ([SRC, DST], [SRC], [DST]):  # pairs, then what only one end is given for, among the edges left
            asked = {tuple(v for v in p if v is not None) for p in zip(src, dst) if (p[0] is not None, p[1] is not None) == (SRC in keys, DST in keys)}
            if asked:
                wanted = self.spark.createDataFrame(list(asked), T.StructType([T.StructField(k, self._kind()) for k in keys]))
                hit, rest = rest.join(wanted, keys, "left_semi"), rest.join(wanted, keys, "left_anti")
                found = hit if found is None else found.unionByName(hit)
        return (df.limit(0) if found is None else found).select(df.columns)

    # fields ------------------------------------------------------------------
    def select_fields(self, names: Sequence[str]) -> Graph:
        names = [names] if isinstance(names, str) else list(names)
        v = self.vertices.select(ID, *(n for n in self.vertices.columns if n in names and n != ID))
        e = self.edges.select(SRC, DST, *(n for n in self.edges.columns if n in names and n not in (SRC, DST)))
        return Graph._of(self.spark, v, e)

    def with_vertices(self, change: Callable[[DataFrame], DataFrame]) -> Graph:
        """The graph with edited vertex fields; ids must stay."""
        v = change(self.vertices)
        if ID not in v.columns:
            raise ValueError(f"{ID} can't be removed")
        return Graph._of(self.spark, v, self._e)

    def with_edges(self, change: Callable[[DataFrame], DataFrame]) -> Graph:
        e = change(self.edges)
        if not {SRC, DST} <= set(e.columns):
            raise ValueError(f"{SRC} and {DST} can't be removed")
        return Graph._of(self.spark, self._v, e)

    def add_vertex_field(self, name: str, value) -> Graph:
        return self.with_vertices(lambda v: v.withColumn(name, value if isinstance(value, Column) else K.literal(value)))

    def add_edge_field(self, name: str, value) -> Graph:
        return self.with_edges(lambda e: e.withColumn(name, value if isinstance(value, Column) else K.literal(value)))

    def remove_vertex_field(self, name: str) -> Graph:
        return self.with_vertices(lambda v: v.drop(name))

    def remove_edge_field(self, name: str) -> Graph:
        return self.with_edges(lambda e: e.drop(name))

    def rename_vertex_fields(self, names: dict[str, str]) -> Graph:
        return self.with_vertices(lambda v: v.withColumnsRenamed(names))

    def rename_edge_fields(self, names: dict[str, str]) -> Graph:
        return self.with_edges(lambda e: e.withColumnsRenamed(names))

    @staticmethod
    def _swapped(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(*(f"`{({a: b, b: a}).get(n, n)}`" for n in df.columns))

    def swap_vertex_fields(self, a: str, b: str) -> Graph:
        """Two fields in each other's place."""
        return self.with_vertices(lambda v: self._swapped(v, a, b))

    def swap_edge_fields(self, a: str, b: str) -> Graph:
        return self.with_edges(lambda e: self._swapped(e, a, b))

    # neighbours --------------------------------------------------------------
    def get_neighborhood(self, ids: Iterable, radius: int = 1, full_subgraph: bool = True) -> Graph:
        """What lies within radius steps of the ids, directions apart.

        With full_subgraph all edges between the vertices found; else those by which the
        last step was made.
        """
        seen = self.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(ID, self._kind())])).distinct()
        path = self.edges.limit(0)
        for _ in range(radius):
            out = self.edges.join(seen.withColumnRenamed(ID, SRC), SRC, "left_semi")
            into = self.edges.join(seen.withColumnRenamed(ID, DST), DST, "left_semi").join(seen.withColumnRenamed(ID, SRC), SRC, "left_anti")
            path = out.unionByName(into)
            ends = path.select(F.col(SRC).alias(ID)).union(path.select(F.col(DST).alias(ID)))
            seen = cut(seen.union(ends).distinct())
        if full_subgraph:
            path = self.edges.join(seen.withColumnRenamed(ID, SRC), SRC, "left_semi").join(seen.withColumnRenamed(ID, DST), DST, "left_semi")
        return Graph._of(self.spark, self.vertices.join(seen, ID, "left_semi"), path.select(self.edges.columns))

    def gather(self, aggregates: dict[str, Column], direction: str = "in", init: dict | None = None) -> Graph:
        """Vertex fields from aggregates over neighbours.

        The aggregates may use the edge's fields and the neighbour's, as nbr.field.
        direction: 'in' gathers at the destination of an edge, 'out' at its source, 'any'
        at both. Vertices without neighbours get the value of init, else null.
        """
        if direction not in ("in", "out", "any"):
            raise ValueError("direction must be 'in', 'out' or 'any'")
        e = self.edges.select(F.struct("*").alias("edge"))
        sides = []
        if direction in ("in", "any"):
            sides.append(e.select(F.col(f"edge.{DST}").alias("__at"), F.col(f"edge.{SRC}").alias("__from"), "edge"))
        if direction in ("out", "any"):
            sides.append(e.select(F.col(f"edge.{SRC}").alias("__at"), F.col(f"edge.{DST}").alias("__from"), "edge"))
        pairs = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        nbr = self.vertices.select(F.col(ID).alias("__from"), F.struct("*").alias("nbr"))
        got = pairs.join(nbr, "__from").groupBy("__at").agg(*(c.alias(n) for n, c in aggregates.items()))
        v = self.vertices.drop(*aggregates).join(got.withColumnRenamed("__at", ID), ID, "left")
        for n, x in (init or {}).items():
            v = v.withColumn(n, F.coalesce(n, F.lit(x)))
        return Graph._of(self.spark, v, self._e)

    def vertex_apply(self, name: str, expr: Column) -> Graph:
        return self.add_vertex_field(name, expr)

    def edge_apply(self, name: str, expr: Column) -> Graph:
        return self.add_edge_field(name, expr)

    def _triples(self) -> DataFrame:
        side = lambda key, name: self.vertices.select(F.col(ID).alias(key), F.struct("*").alias(name))
        return self.edges.select(F.struct("*").alias("edge")).withColumn(SRC, F.col(f"edge.{SRC}")).withColumn(DST, F.col(f"edge.{DST}")).join(side(SRC, "source"), SRC).join(side(DST, "target"), DST)

    def send(self, to_source: dict[str, Column] | None = None, to_target: dict[str, Column] | None = None, combine: dict[str, Callable[[str], Column]] | None = None) -> Graph:
        """A triple-wise update in which order doesn't count.

        Each edge, with both ends as source.field, edge.field and target.field, sends
        values; each vertex combines what it gets, by the sum unless combine says
        otherwise, into a field of the same name. A vertex that gets nothing keeps its value.
        """
        t = self._triples()
        sent = []
        for key, values in ((SRC, to_source), (DST, to_target)):
            if values:
                sent.append(t.select(F.col(key).alias(ID), *(c.alias(f"m_{n}") for n, c in values.items())))
        got = sent[0] if len(sent) == 1 else sent[0].unionByName(sent[1], allowMissingColumns=True)
        names = [c[2:] for c in got.columns if c != ID]
        sums = got.groupBy(ID).agg(*((combine or {}).get(n, F.sum)(f"m_{n}").alias(f"g_{n}") for n in names))
        v = self.vertices.join(sums, ID, "left")
        fields = {n: F.coalesce(f"g_{n}", n) if n in self.vertices.columns else F.col(f"g_{n}") for n in names}
        return Graph._of(self.spark, v.withColumns(fields).drop(*(f"g_{n}" for n in names)), self._e)

    def map_edges(self, fields: dict[str, Column]) -> Graph:
        """Edge fields from source.field, edge.field and target.field."""
        names = [c for c in self.edges.columns if c not in fields]
        return Graph._of(self.spark, self._v, self._triples().select(*(F.col(f"edge.{n}").alias(n) for n in names), *(c.alias(n) for n, c in fields.items())))

    def triple_apply(self, fn: Callable[[dict, dict, dict], tuple], mutated_fields: Sequence[str]) -> Graph:
        """fn(source, edge, target) for each edge in turn, in order of the ends' ids; each sees what the ones before wrote.

        Edges that share no vertex can't see each other, so components are dealt out to
        tasks. A task sorts its components' vertices and edges, which may spill, holds
        the vertices of one component at a time and passes its edges through one by one.
        A sequence can't be dealt out further: where a component's vertices are too many
        for a task, or its edges too many to wait for, write the update with send() or
        map_edges(), which have neither bound.
        """
        from millrace.graph.components import components

        ship(self.spark)
        names = {mutated_fields} if isinstance(mutated_fields, str) else set(mutated_fields)
        links = cut(self.edges.select(SRC, DST))
        roots = components(links)
        v = self.vertices.join(roots.withColumnRenamed("node", ID), ID, "left").withColumn("root", F.coalesce("root", ID))
        e = self.edges.join(roots.withColumnRenamed("node", SRC), SRC, "left").withColumn("root", F.coalesce("root", SRC))
        vf, ef = self.vertices.schema, self.edges.schema
        none = lambda schema: F.lit(None).cast(schema)
        place = [F.col(c).cast("string") for c in (SRC, DST)]
        rows = v.select("root", F.lit(0).alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"), F.struct(*vf.names).alias("v"), none(ef).alias("e")).unionByName(
            e.select("root", F.lit(1).alias("kind"), place[0].alias("a"), place[1].alias("b"), none(vf).alias("v"), F.struct(*ef.names).alias("e"))
        )
        dealt = rows.repartition("root").sortWithinPartitions("root", "kind", "a", "b")
        out = T.StructType([T.StructField("v", vf), T.StructField("e", ef)])
        kinds = [pa.field("v", to_arrow_type(vf)), pa.field("e", to_arrow_type(ef))]

        def run(batches):
            vertices, root, done = {}, None, []

            def flushed():
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kinds[k].type) for k in (0, 1)], schema=pa.schema(kinds))

            for batch in batches:
                for own, kind, vertex, edge in zip(*(batch.column(c).to_pylist() for c in ("root", "kind", "v", "e"))):
                    if own != root:
                        done += [(x, None) for x in vertices.values()]
                        vertices, root = {}, own
                    if kind == 0:
                        vertices[vertex[ID]] = vertex
                        continue
                    s, x, t = fn(dict(vertices[edge[SRC]]), dict(edge), dict(vertices[edge[DST]]))
                    for mine, new in ((vertices[edge[SRC]], s), (edge, x), (vertices[edge[DST]], t)):
                        mine.update({n: new[n] for n in names if n in new and n in mine})
                    done.append((None, edge))
                    if len(done) >= 10_000:
                        yield flushed()
                        done.clear()
            done += [(x, None) for x in vertices.values()]
            if done:
                yield flushed()

        done = cut(dealt.mapInArrow(run, out))
        return Graph._of(self.spark, done.where("v is not null").select("v.*"), done.where("e is not null").select("e.*"))

    # worked examples -----------------------------------------------------------
    def degrees(self) -> DataFrame:
        """(__id, in_degree, out_degree) of each vertex."""
        ends = self.edges.select(F.col(SRC).alias(ID), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(self.edges.select(F.col(DST).alias(ID), F.lit(1).alias("i"), F.lit(0).alias("o")))
        sums = ends.groupBy(ID).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return self.vertices.select(ID).join(sums, ID, "left").na.fill(0, ["in_degree", "out_degree"])

    def pagerank(self, iterations: int = 3, damping: float = 0.85) -> DataFrame:
        """(__id, rank) after some rounds from 1.0: 1 - damping plus damping times what in-neighbours share out."""
        out = self.edges.groupBy(SRC).agg(F.count(F.lit(1)).alias("n"))
        links = cut(self.edges.select(SRC, DST).join(out, SRC).repartition(SRC))
        ranks = self.vertices.select(ID, F.lit(1.0).alias("rank"))
        for k in range(iterations):
            shares = links.join(ranks.withColumnRenamed(ID, SRC), SRC).groupBy(F.col(DST).alias(ID)).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
            ranks = self.vertices.select(ID).join(shares, ID, "left").select(ID, (1 - damping + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
            if k % 5 == 4:
                ranks = cut(ranks)
        return ranks

    # files -----------------------------------------------------------------------
    def save(self, path: str, format: str = "binary") -> None:
        """Vertices and edges as two tables below path, in the binary, json or csv format, with their schemas beside them.

        In csv, lists and dictionaries are JSON text.
        """
        writer = {"binary": "parquet", "json": "json", "csv": "csv"}[format]
        for name, df in (("vertices", self.vertices), ("edges", self.edges)):
            self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.schema")
            if format == "csv":
                df = df.select(*((F.to_json(f"`{c.name}`") if _deep(c.dataType) else F.col(f"`{c.name}`")).alias(c.name) for c in df.schema))
            df.write.mode("overwrite").options(header=True, ignoreNullFields=False, quoteAll=True, escape='"', nullValue="\\N", emptyValue="").format(writer).save(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, format: str = "binary", delimiter: str | None = None) -> Graph:
        """A graph that save() wrote, in any format, or edges in text files: csv, tsv, or snap with # for comments.

        In a text file the first two columns are the ends, of numbers or text alike, and
        further ones are edge fields; snap has whole numbers only. There is no header.
        """
        if format == "binary" or format in ("json", "csv") and _exists(spark, f"{path}/edges.schema"):
            return cls._of(spark, *(cls._read(spark, f"{path}/{name}", format) for name in ("vertices", "edges")))
        if format == "json":
            raise ValueError("no saved graph is there")
        from millrace.sources import readers

        sep = delimiter or ("," if format == "csv" else "\t")
        t = readers.read_csv(spark, path, delimiter=sep, header=False, comment_char="#" if format == "snap" else "", column_type_hints=int if format == "snap" else None)
        return cls(spark, edges=t.frame(), src_field="X1", dst_field="X2")

    @staticmethod
    def _read(spark: SparkSession, path: str, format: str) -> DataFrame:
        if format == "binary":
            return spark.read.parquet(path)
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}.schema").first()[0]))
        if format == "json":
            return spark.read.schema(schema).json(path)
        plain = T.StructType([T.StructField(c.name, T.StringType() if _deep(c.dataType) else c.dataType) for c in schema])
        df = spark.read.options(header=True, escape='"', nullValue="\\N", emptyValue="", multiLine=True).schema(plain).csv(path)
        return df.select(*((F.from_json(f"`{c.name}`", c.dataType) if _deep(c.dataType) else F.col(f"`{c.name}`")).alias(c.name) for c in schema))


def _deep(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(found)
