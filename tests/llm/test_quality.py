import math
import random
import re
import weakref
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash

from millrace.llm import bpe, kept, quality

DOCS, LABELS = "doc_id long, text string, score double, known int", "doc_id long, quality int, toxic int, text string"


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("tha", "re", "on", "ing", "est", "wo") for b in ("nd", "er", "ti", "lo", "sa")]
    docs, kinds = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 120))
        kind = rng.choice(["clean", "clean", "clean", "toxic", "junk"])
        if kind == "toxic":
            for _ in range(max(2, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "trash"])
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        kinds.append(kind)
    return docs, kinds


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 0.5, 1) for d in docs], DOCS).repartition(4), spark.createDataFrame([(*x, "clash") for x in labels], LABELS)


def shape(word):
    if word.isalpha():
        return "low" if word == word.lower() else "title" if word[1:] == word[1:].lower() else "UP" if word == word.upper() else "mIx"
    return "digits" if word.isdigit() else "both" if word.isalnum() else "mark" if len(word) == 1 else "marks"


def grams(text):
    """Counters of words, pairs of words and runs of three shapes, as plain strings; letters count alike in words, not in shapes."""
    raw = re.findall(r"\w+|[^\w\s]+", text or "")
    low = [w.lower() for w in raw]
    marked = [(shape(w), k > 0 and w.lower() == raw[k - 1].lower() and shape(w) == shape(raw[k - 1])) for k, w in enumerate(raw)]
    return Counter(low), Counter(zip(low, low[1:])), Counter(zip(marked, marked[1:], marked[2:]))


def key_of(i, text):
    return xxhash.xxh3_64_intdigest((f"={text}" if i is None else str(i)).encode())


def brute(docs, labels, temperature):
    """Models of plain strings, calibration and Gumbel top-k over plain lists."""
    good = {}
    for i, q, t, *_ in labels:
        if i is not None and q is not None:
            good[i] = good.get(i, True) and q == 1 and not t
    keys = [key_of(*d) for d in docs]
    held = [xxhash.xxh3_64_intdigest(k.to_bytes(8, "little")) % 5 == 0 for k in keys]
    clean = [i is not None and good.get(i) is True for i, _ in docs]
    counts = [grams(t) for _, t in docs]
    raw, target = ([sum((c[f] for k, c in enumerate(counts) if pick(k)), Counter()) for f in range(3)] for pick in (lambda k: True, lambda k: clean[k] and not held[k]))
    raws, targets = sum(raw[0].values()), sum(target[0].values())
    weights = []
    for k, c in enumerate(counts):
        words = sum(c[0].values())
        if not words:
            weights.append(-math.inf)
            continue
        own = clean[k] and not held[k]
        share, total = (targets - words * own) / max(raws - words, 1), 0.0
        for f, (smoothing, margin) in enumerate([(0.5, 1.0), (2.0, 3.0), (1.0, 1.0)]):
            for g, n in c[f].items():
                ratio = math.log((target[f][g] - n * own + smoothing) / ((raw[f][g] - n) * share + smoothing))
                total += n * math.copysign(max(abs(ratio) - margin, 0), ratio)
        u = (xxhash.xxh3_64_intdigest(keys[k].to_bytes(8, "little"), seed=1) + 0.5) / 2**64
        weights.append(total / (words + sum(c[2].values())) / temperature - math.log(-math.log(u)))
    calibrate = sorted(w for k, w in enumerate(weights) if clean[k] and held[k] and w > -math.inf)
    line = calibrate[max(0, math.ceil(0.01 * len(calibrate)) - 1)]
    return {docs[k][0] for k, w in enumerate(weights) if w >= line}, weights


def test_sample_is_that_of_brute_force(spark):
    docs, kinds = corpus(2000)
    docs += [(9000, None), (9001, ""), (9002, " \n"), (None, docs[0][1]), (9003, "Ab 12 12 x9 -- ! !"), (9004, "one")]
    labels = [(i, int(k != "junk"), int(k == "toxic")) for (i, _), k in zip(docs, kinds) if i % 2 == 0] + [(None, 1, 0), (7, None, 0), (11, 1, None), (0, 1, 0)]
    left, right = frames(spark, docs, labels)
    want, _ = brute(docs, labels, 0.002)
    kept = quality.keep(left, right)
    assert kept.columns == left.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in quality.sample(left, right).collect()} == want
    share = lambda kind: np.mean([i in ids for (i, _), k in zip(docs, kinds) if k == kind and i % 2])
    print({k: round(float(share(k)), 4) for k in ("clean", "toxic", "junk")})
    assert share("clean") > 0.93 and share("toxic") < 0.1 and share("junk") < 0.02


def test_it_is_a_sample(spark):
    """With a temperature as large as the weights' spread, the draw decides as well as the weight; the likelier rows are kept more often."""
    docs, kinds = corpus(seed=3)
    labels = [(i, int(k != "junk"), int(k == "toxic")) for (i, _), k in zip(docs, kinds) if i % 2 == 0]
    left, right = frames(spark, docs, labels)
    ids = {r.doc_id for r in quality.sample(left, right, temperature=2.0, clean_share=0.5).collect()}
    scores = {r.id: r.score for r in quality.fit(left, right).scores.collect()}
    share = lambda kind: np.mean([i in ids for (i, _), k in zip(docs, kinds) if k == kind])
    assert 0.3 < share("clean") < 0.7 and 0 < share("junk") < share("clean")
    assert min(scores[i] for i in ids) < np.median([scores[i] for i in scores if i not in ids])
    noise = [-math.log(-math.log((xxhash.xxh3_64_intdigest(key_of(*d).to_bytes(8, "little"), seed=1) + 0.5) / 2**64)) for d in docs]
    assert abs(np.mean(noise) - 0.5772) < 0.15 and abs(np.std(noise) - math.pi / math.sqrt(6)) < 0.15


def test_nothing_to_fit_on_keeps_rows_with_words(spark):
    left, right = frames(spark, [(1, "a b"), (2, None), (3, "c")], [])
    assert {r.doc_id for r in quality.keep(left, right, buckets=64).collect()} == {1, 3}
    none, _ = frames(spark, [], [])
    assert quality.keep(none, right, buckets=64).collect() == [] and quality.sample(none, right, buckets=64).collect() == []


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([-5, 0, 2**62, -(2**63), 7, rng.randrange(-(2**63), 2**63)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, 500):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 501) is None
    x = np.array([-np.inf, -2.5, -0.0, 0.0, 1e-9, 3.0, np.inf])
    assert (np.diff(quality.ordered_bits(x)) >= 0).all()


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_tasks_send_rows_of_many_counts(spark):
    """A task's counts are a row for each 512 places, not for each place; sums are those of all rows and of the clean ones."""
    rng, buckets, tasks = random.Random(5), 2**10, 4
    docs = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(300))) for i in range(40)] + [(40, "again " * 70_000), (41, None)]
    table = spark.createDataFrame(docs, "id long, text string").repartition(tasks).localCheckpoint()
    keys = np.sort(np.array([key_of(i, None) for i in range(0, 42, 2)], np.uint64))
    labels = quality.Labels(keys, np.ones(len(keys), bool), 5)
    before = shuffled_rows(spark)
    raw, target = quality._counts(table, labels, buckets)
    assert 0 < shuffled_rows(spark) - before <= tasks * (2 * buckets + 16**3) / 512
    want = np.zeros((2, 2 * buckets + 16**3))
    for i, text in docs:
        for places in quality.features(text, buckets):
            for total in want[: 1 + (labels.of(key_of(i, text)) == 1)]:
                np.add.at(total, places, 1)
    assert raw.max() >= 70_000 and (raw == want[0]).all() and (target == want[1]).all() and 0 < target.sum() < raw.sum()


def test_counts_of_any_width_are_packed():
    for most in (0, 1, 255, 256, 2**16 - 1, 2**16, 2**32 - 1, 2**32, 2**53 + 1, 2**62):
        for used in ([3], [0, 511], range(512), range(0, 512, 3), range(0, 512, 2)):
            counts = np.zeros(512, np.int64)
            counts[used] = most
            assert (quality._unpack(quality._pack(counts)) == counts).all()
    one = np.zeros(512, np.int64)
    assert quality._pack(one) == b"" and len(quality._pack(one + 255)) == 513
    one[7] = 255
    assert len(quality._pack(one)) == 4


def test_a_worker_keeps_the_memo_of_one_operator():
    """Words' codes take the place of a tokenizer that an earlier stage left, and the other way round."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    left = weakref.ref(bpe.tokenizer(spec))
    assert bpe.tokenizer(spec) is left()
    quality.features("some words", 64)
    assert left() is None and len(kept._kept) == 1
    bpe.tokenizer(spec)
    assert not any(isinstance(x, quality._Codes) for x in kept._kept.values())
