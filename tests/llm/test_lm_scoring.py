import math
import random
from collections import Counter

import pytest

from millrace.llm import lm_scoring
from millrace.llm.text import words

FIELDS = "doc_id long, text string, hits int, block string"


def brute(rows, order, backoff=0.4):
    docs = [words(t) for _, t, *_ in rows]
    own = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in docs]
    total = sum(own, Counter())
    size = sum(map(len, docs))
    out = []
    for (i, *_), w, mine in zip(rows, docs, own):
        rest = lambda g: (size - len(w)) if not g else total[g] - mine[g]  # noqa: B023, E731
        score, hits = 0.0, [0] * (order + 1)
        for k in range(len(w)):
            top = min(order, k + 1)
            for n in range(top, 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if rest(gram) > 0:
                    score += (top - n) * math.log(backoff) + math.log(rest(gram)) - math.log(rest(gram[:-1]))
                    hits[n] += 1
                    break
            else:
                score += top * math.log(backoff) - math.log(max(rest(()), 1))
                hits[0] += 1
        out.append((i, len(w), round(score, 6), hits))
    return sorted(out, key=str)


@pytest.mark.parametrize("order,block,entries,together", [(3, 5_000_000, 2_000_000, 4096), (3, 200, 50, 5), (1, 300, 10, 4096), (5, 1000, 100, 1)])
def test_scores_are_those_of_brute_force(spark, order, block, entries, together):
    rng = random.Random(order)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "A", "a"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 40])))) for i in range(80)] + [(None, "a a b"), (3, "a a b"), (3, None), (200, " \n"), (201, "only here"), (202, "w1 w2 w3 " * 200)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], FIELDS).repartition(3)
    found = lm_scoring.stupid_backoff(df, order=order, block=block, entries=entries, together=together).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6), list(r.hits)) for r in found), key=str) == brute(rows, order)


def test_lone_and_empty(spark):
    assert lm_scoring.stupid_backoff(spark.createDataFrame([], FIELDS)).collect() == []
    one = lm_scoring.stupid_backoff(spark.createDataFrame([(1, "a b", 0, "")], FIELDS)).first()
    assert one.n_words == 2 and list(one.hits) == [2, 0, 0, 0] and abs(one.log_score - 3 * math.log(0.4)) < 1e-9


def test_rows_grow_with_n_grams_not_with_blocks_times_buckets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(5000)], k=60)), 1, "") for i in range(400)]
    texts = spark.createDataFrame(rows, FIELDS).repartition(4).selectExpr("doc_id as id", "text")
    blocks = lm_scoring._blocks(texts.sortWithinPartitions("id", "text"), 700)
    n, made = blocks.count(), lm_scoring._exploded(blocks, 3, 14, 1)
    grams = sum(len(lm_scoring._numbers(r.grams)) for r in made.collect())
    assert made.count() <= grams and made.count() < 0.05 * n * 2**14


def test_blocks_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(50)]), " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for _ in range(200)]
    made = []
    for _ in range(2):
        rng.shuffle(rows)
        texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
        made.append([(r.block, r.ids, r.lengths, bytes(r.texts)) for r in lm_scoring._blocks(texts.sortWithinPartitions("id", "text"), 300).collect()])
    assert made[0] == made[1] and len(made[0]) > 5
