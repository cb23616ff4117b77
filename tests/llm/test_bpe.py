import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
POOL = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "Bc", "'s", "'ll", "<|endoftext|>", "12", "½", "é", "漢字", "😀", "!!", "_", "​", "\r\n", "x" * 50, "́", "ǅ", " '", "''t"]


def test_ids_and_texts_are_those_of_the_library(spark):
    rng = random.Random(1)
    texts = ["", None, "ab" * 20_000, " ".join(["word"] * 3000)] + ["".join(rng.choices(POOL, k=rng.randint(1, 25))) for _ in range(3000)]
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    rows += rows[:20]
    found = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3), VOCABULARY).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), len(ids), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded) for r in found), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_stale_heap_entries_are_skipped():
    with open(VOCABULARY, encoding="utf-8") as f:
        coder = bpe.ByteBPE(f.read())
    library = Tokenizer.from_file(VOCABULARY)
    for word in ("aaaaaaaaaaaaaaaaaaaaaaa", "abababababa", "thethethethe", "!!!!!!!!!!!!!!!!!!"):
        assert coder.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids
