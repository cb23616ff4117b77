import random

import numpy as np
import pytest

from millrace.graph.components import components
from millrace.llm import minhash

FIELDS = "doc_id long, text string, component_id string, keys int"


def brute(rows, width, percent):
    sets = [(i, frozenset(minhash.shingle_set(t, width).tolist())) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    out = []
    for k, (i, s) in enumerate(sets):
        own = None if i is None else i if not s else least[top(k)]
        out.append((i, len(s), own, i is not None and i == own))
    return sorted(out, key=str)


def families(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    texts = []
    for _ in range(6):
        start = rng.choices(vocabulary, k=rng.choice([12, 60, 150]))
        for _ in range(25):
            words = list(start)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 85), (2, 5, 80)])
def test_groups_are_those_of_brute_force(spark, seed, width, percent):
    texts = families(seed)
    texts += texts[:5] * 6 + [None, "", " \t\n", "one", "ONE", "one two", "A b C", "a B c", "é É", "x y z x y z x y z"]
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None), (3, texts[40], None, 2), (3, texts[1], "", 3)]
    docs = spark.createDataFrame(rows, FIELDS).repartition(5)
    for block, large in ((600_000, 20_000_000), (300, 2_000)):
        found = minhash.near_duplicates(docs, width=width, percent=percent, block=block, large=large)
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows, width, percent)


def test_rows_without_an_id_link_others(spark):
    base = [f"w{i}" for i in range(100)]
    middle = base[:6] + ["x"] + base[7:]
    far = middle[:90] + ["y"] + middle[91:]
    texts = [" ".join(w) for w in (base, middle, far)]
    alone = " ".join(f"v{i}" for i in range(40))
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (None, alone), (None, alone)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], FIELDS).repartition(3)
    found = sorted(map(tuple, minhash.near_duplicates(docs, width=5, percent=86).collect()), key=str)
    assert found == brute(rows, 5, 86)
    assert [r[2:] for r in found if r[0] in (1, 2)] == [(1, True), (1, False)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], FIELDS)
    found = minhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.collect() == []


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 100, 3000):
        assert (minhash.similarity_sketch(rng.integers(0, 2**63, n).astype(np.uint64), 160) != minhash._EMPTY).all()
    errors = []
    for _ in range(60):
        common = rng.integers(0, 2**63, 850).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 75).astype(np.uint64)]) for _ in range(2))
        errors.append((minhash.similarity_sketch(a, 160) == minhash.similarity_sketch(b, 160)).mean() - 0.85)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components_both_ways(spark, one_task):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + chain + [(7, 7), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(links, "a long, b long"), one_task)
    assert {r.node: r.root for r in found.collect()} == {x: top(x) for x in parent}
    assert found.count() == len(parent)
    assert components(spark.createDataFrame([], "a string, b string"), one_task).collect() == []
