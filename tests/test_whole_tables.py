"""Queries over whole tables: every row of the inputs reaches the operator."""

import re
import threading
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import text as X
from millrace.operators import group as agg
from millrace.table import Table

SF = "/root/testdata/sf0.001"
SPACE, MARKS = " \t\n\x0b\f\r", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def one(sql):
    return duckdb.sql(sql.replace("{", f"read_parquet('{SF}/").replace("}", ".parquet')")).fetchall()


def found(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_quantiles_are_of_all_rows(spark):
    rows = found(spark, "groupby_quantile")
    assert sum(r.n for r in rows) == one("SELECT count(*) FROM {lineitem}")[0][0]
    assert all(r.median_near == 1 and r.high_near == 1 for r in rows)


def test_joins_are_of_all_rows(spark):
    assert {r.o_orderkey for r in found(spark, "join_right")} - {None} == {k for k, in one("SELECT o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey")}
    assert sum(r.x is not None for r in found(spark, "join_outer")) == one("SELECT count(*) FROM {customer}")[0][0]
    n = {r.k: r.n for r in found(spark, "join_null_keys")}
    assert n[None] == one("SELECT (SELECT count(*) FROM {customer} WHERE c_custkey % 2 <> 0) * (SELECT count(*) FROM {supplier} WHERE s_suppkey % 2 <> 0)")[0][0]


def test_whole_lists_are_stacked(spark):
    got = Counter((r.vec_id, r.x) for r in found(spark, "stack_list"))
    assert got == Counter((i, x) for i, v in one("SELECT vec_id, embedding FROM {embeddings}") for x in v)


def brute_bags(texts, n, character):
    out = {}
    for i, text in texts:
        if text and text.strip(SPACE):
            cut = "".join(" " if c in SPACE or c in MARKS else c for c in text.lower())
            units = cut.replace(" ", "") if character else cut.split()
            grams = Counter(units[k : k + n] if character else " ".join(units[k : k + n]) for k in range(len(units) - n + 1))
            out[i] = dict(grams)
    return out


def bags(rows):
    return {r.doc_id: {k: int(v) for k, v in re.findall(r"([^=]+)=([0-9]+)(?: |$)", r.bag)} for r in rows}


def test_ngrams_are_of_whole_documents(spark, tmp_path):
    texts = one("SELECT doc_id, text FROM {documents}")
    skewed = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "so much, " * 20_000), (10**6 + 4, "😀 é!x"), (10**6 + 5, "one")]
    spark.createDataFrame(texts + skewed, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, n, character in (("word_ngrams", 2, False), ("char_ngrams", 3, True)):
        assert bags(entry.queries()[name](spark, str(tmp_path)).collect()) == brute_bags(texts + skewed, n, character)


def test_ngrams_of_characters_take_time_by_length(spark):
    """A million characters, for which counting to each n-gram from the start would be 500 billion steps."""
    text = "".join(f"{i * i:x}é " for i in range(110_000))
    given = Table.of(spark, {"text": [text]})["text"]
    for n in (3, X.LONGEST + 1):
        limit = threading.Timer(90, spark.sparkContext.cancelAllJobs)
        limit.start()
        try:
            (got,) = given.count_ngrams(n, method="character").to_list()
        finally:
            limit.cancel()
        assert got == brute_bags([(0, text)], n, True)[0]


def test_ngrams_of_characters_by_lot(monkeypatch):
    texts = [None, "", "a", "ab", " \n", "😀é!x😀é x", "a\x0bb c d", "\0" * 5, "abcabcabcd" * 9]
    for characters, n in ((1, 1), (7, 2), (20, 3), (10**6, X.LONGEST)):
        monkeypatch.setattr(X, "CHARACTERS", characters)
        got = X.character_bags(pa.array(texts), n, MARKS + SPACE).to_pylist()
        want = brute_bags(enumerate(texts), n, True)
        assert [dict(g) for g in got] == [want.get(i, {}) for i in range(len(texts))]


def test_null_keys_take_no_time_by_pair(spark, tmp_path):
    """90 billion pairs of null keys, and one pair with a key."""
    for name, key, nation in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        spark.sql(f"SELECT 2 * id + 1 AS {key}, 7 AS {nation} FROM range(300000) UNION ALL SELECT 2L, 7").write.parquet(f"{tmp_path}/{name}.parquet")
    limit = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    limit.start()
    try:
        got = {r.k: (r.n, r.x, r.y) for r in entry.queries()["join_null_keys"](spark, str(tmp_path)).collect()}
    finally:
        limit.cancel()
    n, odd = 300_000, 300_000**2
    assert got == {None: (n * n, odd * n, odd * n), 7: (1, 2, 2)}


def test_groups_of_a_join_without_its_rows(spark):
    left = Table.of(spark, {"k": [None, None, 1, 1, 2, 3, None], "j": ["a", None, "a", "a", None, "b", None], "x": [1, None, 3, 4, None, 6, 7], "f": [0.5, 1.5, None, 2.5, None, 1.0, -3.0]})
    right = Table.of(spark, {"k": [None, 1, 1, 2, 2, 4, None, None], "i": [None, "a", "b", None, None, "b", None, "a"], "x": [10, None, 30, 40, 50, 60, 10, None]})
    ops = {"n": agg.COUNT(), "s": agg.SUM("x"), "t": agg.SUM("x.1"), "f": agg.SUM("f"), "m": agg.NONNULL_COUNT("x"), "o": agg.NONNULL_COUNT("x.1"), "lo": agg.MIN("x.1"), "hi": agg.MAX("x"), "a": agg.AVG("x"), "v": agg.VAR("f"), "d": agg.COUNT_DISTINCT("x.1")}
    for on, keys in (("k", ["k"]), ({"k": "k", "j": "i"}, ["k", "j"]), ({"x": "k", "k": "k"}, ["x", "k"])):
        want, got = (t.frame().withColumns({c: F.round(c, 9) for c in "fav"}) for t in (left.join(right, on=on).groupby(keys, ops), left.join_groupby(right, on, ops)))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert not left.head(0).join_groupby(right, "k", ops).num_rows()
    with pytest.raises(ValueError):
        left.join_groupby(right, "k", {"c": agg.CONCAT("x")})
    with pytest.raises(KeyError):
        left.join_groupby(right, "k", {"c": agg.SUM("y")})
