import random
import re
from collections import defaultdict

import numpy as np
import pytest
from test_decontaminate import brute as brute_items
from test_minhash import brute as brute_groups
from test_quality import brute as brute_quality
from test_secret_scan import battery
from test_secret_scan import brute as brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("tha", "re", "on", "ing", "est", "wo") for b in ("nd", "er", "ti", "lo", "sa")]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item = text(30)
    rows = [(i, text(rng.randint(30, 90)), "en", f"src{i % 3}") for i in range(400)]
    rows += [(1000 + i, rows[i][1], "en", "copy") for i in range(30)]
    rows += [(2000 + i, f"{text(20)} {item} {text(20)}", "en", "leak") for i in range(10)]
    rows += [(3000 + i, f"{text(30)} token = \"{rng.randbytes(20).hex()}\" {text(30)}", "en", "secret") for i in range(10)]
    rows += [(4000 + i, " ".join(w.upper() + "!!" for w in text(60).split()), "en", "junk") for i in range(60)]
    rows += [(5000, None, None, None), (5001, "", "en", "x"), (None, text(40), "en", "x"), (1, rows[1][1], "en", "x")]
    # unlike rows of one id, equal rows, near copies of one id, rows without an id that copy others
    rows += [(7, text(50), "en", "other"), (8, text(50), "en", "other"), rows[20], rows[20], (9, rows[9][1] + " thand", "en", "near"), (None, rows[30][1], "en", "x"), (None, text(45), "de", "x")]
    rows += [rows[-1], rows[-1]]
    home = tmp_path_factory.mktemp("tables")
    frame = lambda data, schema, name: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{home}/{name}.parquet")
    frame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCUMENTS, "documents")
    labels = [(r[0], int(r[3] != "junk"), 0) for r in rows if r[0] is not None and r[0] % 2 == 0 and r[1]]
    frame(labels, "doc_id long, quality int, toxic int", "labels")
    items = [(1, item), (2, text(25)), (3, None)]
    frame(items, "item_id long, text string", "benchmark")
    return str(home), rows, labels, items


def redacted(texts):
    """Texts with their secrets replaced, by fixed patterns, the battery and step-up discoveries of structure over all texts."""
    tokens = [(k, m.start(), m.end(), m.group(), battery(m.group())) for k, t in enumerate(texts) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t or "", re.A)]
    classes = defaultdict(list)
    for t in tokens:
        if t[4]:
            classes[t[4][0]].append((min(1.0, 3 * min(t[4][1])), t))
    spans = defaultdict(list)
    for found in classes.values():
        found.sort(key=lambda x: x[0])
        n = max((k for k in range(1, len(found) + 1) if found[k - 1][0] <= 0.05 * k / len(found)), default=0)
        for _, (k, start, end, string, _) in found[n:]:
            spans[k].append((start, end, string))
    out = []
    for k, t in enumerate(texts):
        own = sorted(spans[k] + [(s, e, g) for s, _, e, _, g in brute_spans(t)])
        if not own:
            out.append(t)
            continue
        new, at = "", 0
        for start, end, _ in own:
            if start >= at:
                new += t[at:start] + "[secret]"
            at = max(at, end)
        new += t[at:]
        for string in sorted({s for *_, s in own}, key=len, reverse=True):
            new = new.replace(string, "[secret]")
        out.append(new)
    return out


def brute(rows, labels, items):
    """(doc_id, ids) of what all stages leave, over plain lists."""
    kept, weights = brute_quality([r[:2] for r in rows], labels, 0.002)
    line = min(w for (i, *_), w in zip(rows, weights) if i in kept and w > -np.inf and i is not None)
    rows = [r for r, w in zip(rows, weights) if w >= line]
    rows = list(dict.fromkeys(rows))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    groups = {k: root for k, _, root, _ in brute_groups([(k, r[1]) for k, r in enumerate(rows)], 5, 80)}
    first = {}
    for k, r in enumerate(rows):  # of rows of one doc_id in one group any one may stay
        first.setdefault(groups[k], (r[0], []))
        if r[0] == first[groups[k]][0]:
            first[groups[k]][1].append(r)
    choices = [rows_ for _, rows_ in first.values()]
    held = {i for i, *_ in brute_items([(str(r), r[1]) for c in choices for r in c], items)}
    choices = [[r for r in c if str(r) not in held] for c in choices]
    flat = [r for c in choices for r in c]
    clean = dict(zip(flat, redacted([r[1] for r in flat])))
    library = Tokenizer.from_file(queries.VOCABULARY)
    coded = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    return [{(r[0], coded(clean[r])) for r in c} for c in choices if c]


def test_each_stage_keeps_what_it_should(spark, tables):
    home, rows, _, _ = tables
    docs = spark.read.parquet(f"{home}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, home).collect()
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = spark.createDataFrame(out, docs.schema)
            assert docs.columns == columns
    first, second, third, fourth, last = (seen[n] for n, _ in corpus_pipeline.STAGES)
    ids = lambda found: [r.doc_id for r in found]
    assert not [i for i in ids(first) if i is not None and 4000 <= i < 4060 or i == 5000]
    assert sum(i is not None and i < 400 for i in ids(first)) > 380
    texts = [r.text for r in second]
    assert len(texts) == len(set(texts))
    assert {r.text for r in first if r.source == "other"} <= set(texts) and sum(r.doc_id == 7 for r in second) == 2
    assert [i for i in ids(second) if i not in ids(third)] == [i for i in ids(second) if i is not None and 2000 <= i < 2010]
    assert sorted(ids(third), key=str) == sorted(ids(fourth), key=str)
    assert all("[secret]" in r.text and len(r.text) == r.n_chars for r in fourth if r.doc_id is not None and 3000 <= r.doc_id < 3010)
    assert all("[secret]" not in r.text for r in fourth if r.doc_id is not None and r.doc_id < 400)
    library = Tokenizer.from_file(queries.VOCABULARY)
    want = sorted((str(r.doc_id), np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()) for r in fourth)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in last) == want


def test_run_is_brute_force(spark, tables):
    home, rows, labels, items = tables
    found = sorted(((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, home).collect()), key=str)
    want = brute(rows, labels, items)
    assert len(found) == len(want) > 380
    for choice in want:
        assert sum(f in choice for f in found) == 1
    assert all(any(f in choice for choice in want) for f in found)


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_run_on_empty_tables(spark, tables, tmp_path, empty):
    home, rows, labels, items = tables
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{home}/{name}.parquet")
        (df.limit(0) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found == [] if empty == "documents" else len(found) > 380


def test_rows_without_words_and_other_columns(spark):
    rows = [(1, None, "x"), (1, None, "x"), (1, "", "y"), (None, None, "x"), (None, None, "x"), (2, " ", "z")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, "clash") for i, t, s in rows], DOCUMENTS + ", row string")
    out = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str) == sorted({(i, t, s) for i, t, s in rows}, key=str)
