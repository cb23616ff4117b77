import random

import pytest
from pyspark.sql import functions as F

from millrace.graph.graph import Edge, Graph, Vertex


def edges(g):
    return sorted((r["__src_id"], r["__dst_id"]) for r in g.edges.collect())


@pytest.fixture
def g(spark):
    v = [Vertex("a", {"color": "red", "n": 1}), Vertex("b", {"color": None, "n": 2}), Vertex("c", {"color": "blue", "n": 3})]
    e = [Edge("a", "b", {"w": 0.5}), Edge("b", "c", {"w": None}), Edge("a", "b", {"w": 2.0}), Edge("c", "d", {"w": 1.0})]
    return Graph(spark, v, e)


def test_building(g, spark):
    assert g.summary() == {"num_vertices": 4, "num_edges": 4}
    assert g.get_vertices("d").first().asDict() == {"__id": "d", "color": None, "n": None}
    h = g.add_vertices([Vertex("a", {"size": 9})])
    assert h.get_vertices(["a"]).first().asDict() == {"__id": "a", "color": None, "n": None, "size": 9} and h.summary() == g.summary()
    assert Graph(spark).summary() == {"num_vertices": 0, "num_edges": 0}
    assert Graph(spark, edges=spark.createDataFrame([(1, 2)], "s long, d long"), src_field="s", dst_field="d").summary() == {"num_vertices": 2, "num_edges": 1}


def test_selection(g):
    assert {r["__id"] for r in g.get_vertices(fields={"color": "red"}).collect()} == {"a"}
    assert {r["__id"] for r in g.get_vertices(fields={"color": None}).collect()} == {"a", "b", "c", "d"}
    assert g.get_edges("a", "b").count() == 2 and g.get_edges(src_ids=["a", None], dst_ids=[None, "d"]).count() == 3
    assert g.get_edges(fields={"w": [0.5, 1.0]}).count() == 2
    assert g.get_edges().count() == 4 and g.get_edges("zz", None).count() == 0 and g.get_edges(["a", "a", None], ["b", None, "b"]).count() == 2
    assert g.swap_vertex_fields("color", "n").get_vertex_fields() == ["__id", "n", "color"] and g.add_edge_field("k", 1).swap_edge_fields("w", "k").get_edge_fields()[2:] == ["k", "w"]
    assert g.get_fields() == ["__id", "color", "n", "__src_id", "__dst_id", "w"]
    assert g.select_fields("n").get_fields() == ["__id", "n", "__src_id", "__dst_id"]
    h = g.add_edge_field("k", 1).remove_vertex_field("n").rename_edge_fields({"w": "weight"})
    assert h.get_fields() == ["__id", "color", "__src_id", "__dst_id", "weight", "k"]
    with pytest.raises(ValueError):
        g.remove_vertex_field("__id")


def test_neighbourhood(g):
    assert edges(g.get_neighborhood(["a"], 1)) == [("a", "b"), ("a", "b")]
    assert {r["__id"] for r in g.get_neighborhood(["a"], 2).vertices.collect()} == {"a", "b", "c"}
    assert edges(g.get_neighborhood(["c"], 1, full_subgraph=False)) == [("b", "c"), ("c", "d")]


def test_gather_and_send(g):
    got = {r["__id"]: (r["n_in"], r["s"]) for r in g.gather({"n_in": F.count("nbr.__id"), "s": F.sum("nbr.n")}, "in", {"n_in": 0}).vertices.collect()}
    assert got == {"a": (0, None), "b": (2, 2), "c": (1, 2), "d": (1, 3)}
    h = g.add_vertex_field("deg", 0).send({"deg": F.lit(1)}, {"deg": F.lit(1)})
    assert {r["__id"]: r["deg"] for r in h.vertices.collect()} == {"a": 2, "b": 3, "c": 2, "d": 1}
    m = g.map_edges({"w": F.col("source.n") + F.coalesce("edge.w", F.lit(0.0))})
    assert sorted(r["w"] for r in m.edges.collect()) == [1.5, 2.0, 3.0, 4.0]


def test_triple_apply_in_turn(spark):
    star = Graph(spark, edges=[Edge(i, 0) for i in range(1, 40)]).add_vertex_field("deg", 0).add_edge_field("seen", -1)

    def count(source, edge, target):
        source["deg"] += 1
        target["deg"] += 1
        edge["seen"] = target["deg"]
        return source, edge, target

    done = star.triple_apply(count, ["deg", "seen"])
    assert {r["__id"]: r["deg"] for r in done.vertices.collect()} == {0: 39} | {i: 1 for i in range(1, 40)}
    assert sorted(r["seen"] for r in done.edges.collect()) == list(range(1, 40))
    rng = random.Random(3)
    pairs = sorted((rng.randrange(30), rng.randrange(30)) for _ in range(40))
    many = Graph(spark, [Vertex(i, {"log": ""}) for i in range(32)], [Edge(*p) for p in pairs])

    def note(source, edge, target):
        source["log"] = target["log"] = f"{source['log'][-6:]}|{target['log'][-6:]}|{edge['__src_id']}-{edge['__dst_id']}"
        return source, edge, target

    want = {i: "" for i in range(32)}
    for s, d in sorted(pairs, key=lambda p: (str(p[0]), str(p[1]))):
        want[s] = want[d] = f"{want[s][-6:]}|{want[d][-6:]}|{s}-{d}"
    assert {r["__id"]: r["log"] for r in many.triple_apply(note, "log").vertices.collect()} == want


def test_pagerank_and_degrees(spark):
    ring = Graph(spark, edges=[Edge(i, (i + 1) % 10) for i in range(10)])
    assert all(abs(r["rank"] - 1.0) < 1e-9 for r in ring.pagerank(3).collect())
    star = {r["__id"]: r["rank"] for r in Graph(spark, edges=[Edge(i, 0) for i in range(1, 10)]).pagerank(3).collect()}
    assert abs(star[0] - (0.15 + 0.85 * 0.15 * 9)) < 1e-9 and all(abs(star[i] - 0.15) < 1e-9 for i in range(1, 10))
    rng = random.Random(1)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(60)]
    got = {r["__id"]: (r["in_degree"], r["out_degree"]) for r in Graph(spark, edges=[Edge(*p) for p in pairs]).degrees().collect()}
    assert got == {v: (sum(d == v for _, d in pairs), sum(s == v for s, _ in pairs)) for v in {x for p in pairs for x in p}}


def test_files(g, spark, tmp_path):
    g.save(str(tmp_path / "g"))
    back = Graph.load(spark, str(tmp_path / "g"))
    assert back.summary() == g.summary() and edges(back) == edges(g)
    (tmp_path / "s.txt").write_text("# from to\n1\t2\n2\t3\n")
    assert edges(Graph.load(spark, str(tmp_path / "s.txt"), "snap")) == [(1, 2), (2, 3)]
    (tmp_path / "s.csv").write_text("1,2\n")
    assert edges(Graph.load(spark, str(tmp_path / "s.csv"), "csv")) == [(1, 2)]
    (tmp_path / "t.tsv").write_text("a\tb\t1.5\nc\td\t2\n")
    text = Graph.load(spark, str(tmp_path / "t.tsv"), "tsv")
    assert edges(text) == [("a", "b"), ("c", "d")] and sorted(r["X3"] for r in text.edges.collect()) == [1.5, 2.0]
    deep = g.add_vertex_field("list", F.array(F.lit(1), F.col("n"))).add_edge_field("note", F.when(F.col("w").isNotNull(), 'a "b", c\nd').otherwise(""))
    plain = lambda df: sorted(map(str, df.collect()))
    for format in ("binary", "json", "csv"):
        deep.save(str(tmp_path / format), format)
        back = Graph.load(spark, str(tmp_path / format), format)
        assert plain(back.vertices) == plain(deep.vertices) and plain(back.edges) == plain(deep.edges)
    with pytest.raises(ValueError):
        Graph.load(spark, str(tmp_path), "json")


def test_released_checkpoints_are_gone(spark):
    import os

    from millrace.core.durable import cut, ensure_checkpoint_dir, release

    home = ensure_checkpoint_dir(spark).removeprefix("file://")
    count = lambda: sum(len(f) for _, _, f in os.walk(home))
    before = count()
    a, b = cut(spark.range(100)), cut(spark.range(50))
    assert count() > before and a.count() == 100
    release(a, b, spark.range(3))
    assert count() == before
