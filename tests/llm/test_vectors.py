import math
import random

import numpy as np

from millrace.llm import vectors

FIELDS = "vec_id long, embedding array<float>, label int, node string, links int"


def brute(rows, least):
    def usable(v):
        return v and None not in v and all(map(math.isfinite, v)) and any(v)

    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a, (_, x, la, *_) in enumerate(rows):
        for b, (_, y, lb, *_) in enumerate(rows[:a]):
            if la is not None and la == lb and usable(x) and usable(y) and len(x) == len(y):
                p, q = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= least:
                    links[a] += 1
                    links[b] += 1
                    parent[top(a)] = top(b)
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[top(k)] = min(r[0], ids.get(top(k), r[0]))
    out = [(r[0], links[k], None if r[0] is None else ids[top(k)]) for k, r in enumerate(rows)]
    return sorted(((*r, r[0] is not None and r[0] == r[2]) for r in out), key=str)


def test_links_are_those_of_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(12):
        centre = [rng.gauss(0, 1) for _ in range(24)]
        for _ in range(14):
            spread = rng.choice([0.0, 0.1, 0.14, 0.2])
            rows.append([len(rows) * 2, [c + rng.gauss(0, spread) for c in centre], rng.choice([0, 0, 1])])
    rows += [[900, None, 1], [901, [], 1], [902, [0.0] * 24, 1], [903, [float("nan")] * 24, 1], [904, [1.0, None], 1], [905, [float("inf")] * 3, 0], [906, [1.0] * 24, None], [907, [1.0] * 3, 0], [908, [2.0] * 3, 0], [909, [1e30] * 3, 0], [910, [1e-30] * 3, 0], [None, [3.0] * 3, 0], [907, rows[0][1], 0], [911, [-0.0, 1.0, 0.0], 1], [912, [0.0, 1.0, 0.0], 1]]
    rows = [(*r, "clash", 9) for r in rows]
    df = spark.createDataFrame(rows, FIELDS).repartition(4)
    for tile in (2048, 16):
        found = vectors.near_vectors(df, least=0.98, tile=tile)
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 0.98)


def test_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = rng.normal(size=48), rng.normal(size=48)
        (q, m, e), (r, n, f) = vectors.quantise(x), vectors.quantise(y)
        near = (q.astype(int) @ r.astype(int)) * (m / np.linalg.norm(q.astype(float))) * (n / np.linalg.norm(r.astype(float)))
        assert abs(near - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) <= m * f + e * n + e * f + 1e-12


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], FIELDS)).collect() == []


def test_bound_decides_most_pairs_and_bytes_go_to_tiles(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 384))
    rows = [(i, x[i % 40].tolist() if i % 5 else x[i].tolist(), 0, "", 0) for i in range(400)]
    nodes = vectors._quantised(vectors._prepared(spark.createDataFrame(rows, FIELDS).selectExpr("vec_id as id", "label", "embedding as vector")).where("node is not null"))
    row = nodes.first()
    assert len(row.q) == 384 and len(row.vector) == 8 * 384
    table = nodes.withColumn("i", nodes.id * 0).withColumn("j", nodes.id * 0).withColumn("block", nodes.id * 0).toArrow()
    possible = [(u, v, s) for u, v, s in vectors._bounded(table, 0.98)]
    exact = sum(len(u) for u, _, _ in possible)
    y = np.stack([np.frombuffer(v) for v in table.column("vector").to_pylist()])
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = int((np.triu(y @ y.T, 1) >= 0.98).sum())
    assert links == exact == sum(int(s.sum()) for _, _, s in possible)
