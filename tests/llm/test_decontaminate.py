import random

import numpy as np

from millrace.llm import decontaminate as d
from millrace.llm.text import shingle_hashes, word_hashes, words

DOCS, ITEMS = "doc_id long, text string, item_id string, similarity int", "item_id int, text string, doc_id string"


def brute(docs, items, width=5, least=0.8):
    out = set()
    for i, text, *_ in docs:
        own = word_hashes(words(text))
        for k, item, *_ in items:
            wanted = word_hashes(words(item))
            n = len(wanted)
            best = (-1.0, 0)
            for start in range(len(own) - n + 1) if n else []:
                score = d.weighted_similarity(shingle_hashes(own[start : start + n], width), shingle_hashes(wanted, width))
                best = max(best, (score, -start))
            if best[0] >= least:
                out.add((i, k, -best[1], n, round(best[0], 9)))
    return out


def test_matches_are_those_of_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 7, 18, 40, 90])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "a b c d e f a b c d e f a b c"), (103, items[3][1].upper()), (None, items[4][1])]
    docs = [(900, None), (901, ""), (902, "a b c d e f a b c d e f a b c d e f"), (None, items[5][1])]
    for n in range(60):
        body = rng.choices(vocabulary, k=rng.randint(0, 120))
        part = items[rng.randrange(25)][1].split()
        for _ in range(rng.randint(0, 2)):
            part[rng.randrange(len(part))] = "changed"
        if rng.random() < 0.2:
            part = part[: len(part) // 2]
        docs.append((n, " ".join(body[:50] + part + body[50:])))
    docs.append((950, " ".join(items[6][1] for _ in range(50))))
    left = spark.createDataFrame([(*r, "clash", 1) for r in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(*r, "clash") for r in items], ITEMS)
    want = brute(docs, items)
    for at_once in (20_000, 7):
        found = {(r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in d.contaminated(left, right, at_once=at_once).collect()}
        assert found == want and len({r[0] for r in want}) > 20
    kept = d.uncontaminated(left, right, at_once=7)
    assert kept.columns == left.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - {r[0] for r in want}


def test_documents_shorter_than_an_item_are_one_window(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in rng.sample(range(1000), 39)]
    items = [(1, " ".join(item)), (2, "a b c d e f a b c d e f a b c"), (3, "one two three four"), (4, "p q r s t u")]
    docs = [(1, item[:-1]), (2, item[1:]), (3, item[3:-4]), (4, item[:31]), (5, ["W0", *item[:20]]), (6, list("abcdefabcdefab")), (7, "one two three".split()), (8, list("pqrst")), (9, item[:33] + ["x"]), (10, ["x", *item])]
    docs = [(i, " ".join(w)) for i, w in docs]
    hashed = {i: word_hashes(words(t)) for i, t in docs}
    want = set()
    for k, text in items:
        own = word_hashes(words(text))
        for i, h in hashed.items():
            if len(h) < len(own):
                score = d.weighted_similarity(shingle_hashes(h, 5), shingle_hashes(own, 5))
                want |= {(i, k, 0, len(h), round(score, 9))} if score >= 0.8 else set()
    left = spark.createDataFrame([(*r, "clash", 1) for r in docs], DOCS)
    right = spark.createDataFrame([(*r, None) for r in items], ITEMS)
    found = {(r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in d.contaminated(left, right).collect()}
    assert found == want | brute(docs, items) and {r[0] for r in want} >= {1, 2, 3, 6}
    assert {r.doc_id for r in d.uncontaminated(left, right).collect()} == set(hashed) - {r[0] for r in found}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 256, (200, d.BITS // 8)).astype(np.uint8)
    index = d.HammingIndex(prints)
    asked = prints[:40].copy()
    for k, p in enumerate(asked):
        bits = np.unpackbits(p)
        bits[rng.choice(d.BITS, k, replace=False)] ^= 1
        asked[k] = np.packbits(bits)
    want = [(w, i) for w, p in enumerate(asked) for i, q in enumerate(prints) if np.unpackbits(p ^ q).sum() <= d.RADIUS]
    assert list(zip(*(x.tolist() for x in index.near(asked)))) == want and len(want) >= 30


def test_index_is_selective():
    rng = np.random.default_rng(3)
    index = d.HammingIndex(rng.integers(0, 256, (5000, d.BITS // 8)).astype(np.uint8))
    block = rng.integers(0, 1 << 16, 2000).astype(np.uint16)
    met = [sum(int(starts[v + 1] - starts[v]) for v in (b ^ d._MASKS).astype(int)) for b, starts in zip(block, index.starts * 250)]
    assert np.mean(met) < 0.015 * 5000  # of 5,000 items, for one block of a window


def test_twenty_thousand_items(spark):
    """Recall against brute force over windows at all similarities from 0.8 on, and no more than brute force finds."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(16, 59)))) for i in range(20_500)]
    docs = []
    for n in range(900):
        part = items[rng.randrange(len(items))][1].split()
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            part[rng.choice([0, 1, -1, -2, rng.randrange(len(part))])] = "changed"
        docs.append((n, " ".join(rng.choices(vocabulary, k=30) + part + rng.choices(vocabulary, k=30))))
    bags = {i: shingle_hashes(word_hashes(words(t)), 5) for i, t in items}
    owners = {}
    for i, bag in bags.items():
        for s in bag.tolist():
            owners.setdefault(s, set()).add(i)
    want = set()
    for n, text in docs:
        own = word_hashes(words(text))
        for i in {i for s in shingle_hashes(own, 5).tolist() for i in owners.get(s, ())}:
            size = len(bags[i]) + 4
            scores = [d.weighted_similarity(shingle_hashes(own[a : a + size], 5), bags[i]) for a in range(len(own) - size + 1)]
            if max(scores) >= 0.8:
                want.add((n, i, scores.index(max(scores))))
    left = spark.createDataFrame([(*r, "clash", 1) for r in docs], DOCS).repartition(4)
    right = spark.createDataFrame([(*r, "") for r in items], ITEMS)
    for at_once in (50_000, 6_000):
        found = {(r.doc_id, r.item_id, r.first_word) for r in d.contaminated(left, right, at_once=at_once).collect()}
        pairs, wanted = {p[:2] for p in found}, {p[:2] for p in want}
        print(f"recall {len(pairs & wanted) / len(wanted):.4f} of {len(wanted)}")
        assert pairs <= wanted and len(pairs) >= 0.995 * len(wanted) and len(wanted) > 500


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert d.contaminated(none, items).collect() == [] and d.uncontaminated(none, items).collect() == []
    one = spark.createDataFrame([(1, "x", None, None)], DOCS)
    assert d.contaminated(one, items).collect() == [] and d.uncontaminated(one, items).count() == 1
