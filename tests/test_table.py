import array
import datetime as dt
import math
import random
import statistics

import pytest

from millrace.operators import group as agg
from millrace.operators import windows as W
from millrace.streaming.builders import ColBuilder, TableBuilder
from millrace.table import Col, Table

NAN, INF = float("nan"), float("inf")


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9 * max(1, abs(a))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def check(got, want):
    assert same(list(got), list(want)), (list(got), list(want))


@pytest.fixture(scope="module")
def col(spark):
    return lambda values, dtype=None: Col.of(spark, values, dtype)


# missing values and truth -----------------------------------------------------------
def test_missing_values(col):
    x = col([1.0, None, NAN, -2.0])
    check(x.dropna(), [1.0, -2.0])
    check(x.fillna(9), [1.0, 9.0, 9.0, -2.0])
    assert x.num_missing() == 1 and x.max() == 1.0 and x.min() == -2.0
    assert col([None, None], float).max() is None and col([None, None], int).sum() == 0
    check(x == None, [0, 1, 0, 0])  # noqa: E711
    check(x != None, [1, 0, 1, 1])  # noqa: E711
    check(x == x, [1, 1, 1, 1])
    check(x + 1, [2.0, None, NAN, -1.0])


def test_truth(col):
    check(col([0, 3, None]) & col([1, 1, 1]), [0, 1, None])
    check(col([0, 3, None]) | col([0, 0, 1]), [0, 1, None])
    for values, want in (([0, 1, None], (False, True)), ([0.0, NAN], (False, True)), (["", "a"], (False, True)), ([1, 2], (True, True)), ([0, None], (False, False))):
        c = col(values)
        assert (c.all(), c.any()) == want
    assert col([], int).all() and not col([], int).any()
    assert col([0, 5, None, 7]).nnz() == 2
    check(col([1, 2, 3, 4])[col([1, 0, None, 1])], [1, 4])
    check(col([1, 2, 3])[col(["", "x", None])], [2])


# scalars ------------------------------------------------------------------------------
def test_division(col):
    a, b = col([7, -7, 7, -7, 1, 0]), col([2, 2, -2, -2, 0, 0])
    check(a / b, [3.5, -3.5, -3.5, 3.5, INF, NAN])
    check(a // b, [3, -4, -4, 3, None, None])
    check(a % b, [1, 1, -1, -1, None, None])
    check(-1 / col([0.0]), [-INF])
    check(col([7.5]) // 2, [3.0])
    check(2 ** col([3]), [8.0])


def test_arithmetic_kinds(col):
    check(col(["a", None]) + "b", ["ab", None])
    check("b" + col(["a"]), ["ba"])
    v = col([array.array("d", [1, 2]), array.array("d", [3]), None])
    check(v + v, [[2.0, 4.0], [6.0], None])
    check(v * 2, [[2.0, 4.0], [6.0], None])
    check(v + col([array.array("d", [1, 2])] * 3), [[2.0, 4.0], None, None])
    check(abs(-v), [[1.0, 2.0], [3.0], None])
    t = col([dt.datetime(2020, 1, 1), None])
    check((t + 60) - t, [60.0, None])
    assert (col([1]) + col([1])).dtype is int and (col([1]) + 1.5).dtype is float
    with pytest.raises(TypeError):
        col(["a"]) * 2


def test_comparison(col):
    check(col([1, 2, None]) < 2, [1, 0, None])
    check(col(["a", "b"]) >= "b", [0, 1])
    check(col([1, 2]) == col(["1", "2"]), [0, 0])
    check(col([1, 2]) == col([1.0, 2.5]), [1, 0])
    check(col([NAN]) == col([NAN]), [1])
    with pytest.raises(TypeError):
        col(["a"]) < 1


def test_membership_and_bounds(col):
    check(col(["steel", None]).contains("tee"), [1, 0])
    check(col([[1, 2], [3]], list).contains(2), [1, 0])
    check(col([{"a": 1}, {"b": 1}]).contains("a"), [1, 0])
    check(col([1, 5, None]).is_in([5, None]), [0, 1, 1])
    check(col([1, 5, None]).clip(2, 4), [2, 4, None])
    assert col([1]).clip(0.5).dtype is float
    check(col([NAN, 9.0]).clip(0, 1), [NAN, 1.0])
    with pytest.raises(ValueError):
        col([1]).clip(2, 1)
    check(Col.where(col([1, 0, None]), col([1, 2, 3]), 9), [1, 9, 9])


def test_casts(col):
    check(col(["1", " 2 "]).astype(int), [1, 2])
    check(col(["1", "x"]).astype(int, undefined_on_failure=True), [1, None])
    with pytest.raises(Exception, match="x"):
        list(col(["1", "x"]).astype(int))
    check(col([1.9, -1.9]).astype(int), [1, -1])
    check(col([1, None]).astype(str), ["1", None])
    check(col(["[1, 2]"]).astype(array.array), [[1.0, 2.0]])


def test_slices(col):
    v = [array.array("d", range(5)), array.array("d", [9]), None]
    check(col(v).vector_slice(1, 3), [[1.0, 2.0], None, None])
    check(col(v).vector_slice(0), [0.0, 9.0, None])
    texts = ["abcdef", "", "x", None]
    for s in (slice(1, 3), slice(None, None, -1), slice(-3, None), slice(None, None, 2), slice(10, 2, -3), slice(-2, -9, -1)):
        check(col(texts).subslice(s.start, s.stop, s.step), [None if t is None else t[s] for t in texts])
        check(col(v).subslice(s.start, s.stop, s.step), [None if t is None else list(t[s]) for t in v])


# text, dictionaries, times ------------------------------------------------------------
def test_text(col):
    assert list(col(["A a b, b", "", None]).count_words()) == [{"a": 2, "b,": 1, "b": 1}, {}, None]
    assert list(col(["x,y x"]).count_words(delimiters=[",", " "])) == [{"x": 2, "y": 1}]
    assert list(col(["I like big dogs. I like", "one"]).count_ngrams(2)) == [{"i like": 2, "like big": 1, "big dogs": 1, "dogs i": 1}, {}]
    assert list(col(["Fun. is"]).count_ngrams(3, "character")) == [{"fun": 1, "uni": 1, "nis": 1}]
    assert list(col(["a b"]).count_ngrams(2, "character", ignore_space=False)) == [{"a ": 1, " b": 1}]


def test_dictionaries(col):
    d = col([{"a": 1, "b": 5}, {}, None])
    assert [sorted(k) if k is not None else None for k in d.dict_keys()] == [["a", "b"], [], None]
    assert list(d.dict_trim_by_keys(["a"])) == [{"b": 5}, {}, None]
    assert list(d.dict_trim_by_keys(["a"], exclude=False)) == [{"a": 1}, {}, None]
    assert list(d.dict_trim_by_values(2)) == [{"b": 5}, {}, None]
    assert list(d.dict_trim_by_values("x")) == [{"a": 1, "b": 5}, {}, None]
    check(d.dict_has_any_keys(["a", "z"]), [1, 0, None])
    check(d.dict_has_all_keys(["a", "b"]), [1, 0, None])
    check(d.item_length(), [2, 0, None])


def test_times(col):
    t = col(["2011-01-02T03:04:05", None]).str_to_datetime()
    got = list(t.split_datetime("d", ["year", "weekday", "isoweekday", "tmweekday", "us"]))[0]
    assert got == {"d.year": 2011, "d.weekday": 6, "d.isoweekday": 7, "d.tmweekday": 0, "d.us": 0}
    check(t.datetime_to_str("%d/%m/%Y at %H"), ["02/01/2011 at 03", None])
    with pytest.raises(ValueError):
        t.datetime_to_str("%G")
    with pytest.raises(ValueError):
        t.split_datetime(limit=["era"])


# reductions ---------------------------------------------------------------------------
def test_reductions(col):
    x = col([3, 1, None, 3, 8])
    assert (x.sum(), x.max(), x.min(), x.argmax(), x.argmin(), len(x)) == (15, 8, 1, 4, 1, 5)
    values = [3, 1, 3, 8]
    assert abs(x.mean() - statistics.mean(values)) < 1e-12 and abs(x.var() - statistics.pvariance(values)) < 1e-12
    assert abs(x.std(1) - statistics.stdev(values)) < 1e-12
    with pytest.raises(ValueError):
        x.var(5)
    assert col([], int).argmax() is None and col([], float).mean() is None
    v = col([array.array("d", [1, 2]), None, array.array("d", [3, 4])])
    assert list(v.sum()) == [4.0, 6.0] and list(v.mean()) == [2.0, 3.0]
    assert sorted(col([3, 3, None, 1]).unique(), key=str) == [1, 3, None]


# windows -------------------------------------------------------------------------------
ROLL = {"mean": lambda v: sum(v) / len(v), "sum": sum, "min": min, "max": max, "var": statistics.pvariance, "stdv": statistics.pstdev}


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_windows_are_those_of_brute_force(spark, monkeypatch, block):
    for f in (W.rolling, W.running, W.running_vectors):
        monkeypatch.setattr(f, "__defaults__", tuple(block if d == W.BLOCK else d for d in f.__defaults__))
    rng = random.Random(1)
    values = [None, None] + [rng.choice([None, rng.uniform(-5, 5), rng.uniform(-5, 5)]) for _ in range(60)]
    x = Col.of(spark, values, float)
    for start, end, least in ((-2, 0, None), (-3, 3, 1), (1, 4, 0), (-6, -2, 2), (0, 0, None), (-40, 40, 3)):
        frames = [[v for v in (values[j] for j in range(i + start, i + end + 1) if 0 <= j < len(values)) if v is not None] for i in range(len(values))]
        needs = end - start + 1 if least is None else min(least, end - start + 1)
        for how, f in ROLL.items():
            empty = 0.0 if how == "sum" and needs == 0 else None
            want = [None if len(v) < needs else f(v) if v else empty for v in frames]
            check(getattr(x, f"rolling_{how}")(start, end, least), want)
        check(x.rolling_count(start, end), [len(v) for v in frames])
    seen = [[v for v in values[: i + 1] if v is not None] for i in range(len(values))]
    for how, f in ROLL.items():
        check(getattr(x, "cumulative_" + {"stdv": "std"}.get(how, how))(), [f(v) if v else None for v in seen])
    vectors = [None, array.array("d", [1, 2]), array.array("d", [3, 5]), None, array.array("d", [1, 1])]
    v = Col.of(spark, vectors * 4)
    run, n, want_sum, want_mean = [0.0, 0.0], 0, [], []
    for cell in vectors * 4:
        if cell is not None:
            run, n = [a + b for a, b in zip(run, cell)], n + 1
        want_sum.append(list(run) if n else None)
        want_mean.append([a / n for a in run] if n else None)
    check(v.cumulative_sum(), want_sum)
    check(v.cumulative_mean(), want_mean)
    check(v.rolling_sum(-1, 0, 1), [None] + [[sum(p) for p in zip(*w)] for w in ([c for c in (vectors * 4)[i - 1 : i + 1] if c is not None] for i in range(1, 20))])
    with pytest.raises(ValueError):
        x.rolling_sum(1, 0)


# tables --------------------------------------------------------------------------------
@pytest.fixture
def t(spark):
    return Table.of(spark, {"id": list(range(8)), "k": ["a", "b", None, "a", "b", "a", None, "c"], "x": [5.0, 1.0, 7.0, None, NAN, 2.0, 7.0, 3.0]})


def rows(table):
    return [tuple(r.values()) for r in table]


def test_editing(t):
    t["y"] = t["id"] * 2
    t["one"] = 1
    t.add_column([9] * 8)
    assert t.column_names() == ["id", "k", "x", "y", "one", "X6"] and t.column_types() == [int, str, float, int, int, int]
    t.rename({"y": "z"}).swap_columns("id", "z")
    assert t.column_names() == ["z", "k", "x", "id", "one", "X6"]
    del t["X6"]
    assert t[float].column_names() == ["x"] and t[["k", int]].column_names() == ["k", "z", "id", "one"]
    old = t["z"]
    t["z"] = t["z"] + 1
    check(t["z"] - old, [1] * 8)
    with pytest.raises(KeyError):
        t["nothing"]
    with pytest.raises(ValueError):
        t["w"] = Col.of(t.spark, [1, 2])


def test_row_selection(t):
    assert [r[0] for r in rows(t[t["x"] > 2.0])] == [0, 2, 4, 6, 7]
    assert [r["id"] for r in t.head(3)] == [0, 1, 2] and [r["id"] for r in t.tail(3)] == [5, 6, 7]
    assert t[2] == {"id": 2, "k": None, "x": 7.0} and t[-1]["id"] == 7
    assert [r["id"] for r in t[1:7:2]] == [1, 3, 5] and [r["id"] for r in t[-3:]] == [5, 6, 7]
    with pytest.raises(IndexError):
        t[8]
    assert [r["id"] for r in t.dropna()] == [0, 1, 5, 7]
    assert [r["id"] for r in t.dropna("x", "all")] == [0, 1, 2, 5, 6, 7] and t.dropna([]).num_rows() == 8
    kept, dropped = t.dropna_split("x")
    assert [r["id"] for r in dropped] == [3, 4]
    assert [r["x"] for r in t.fillna("x", 0.0)] == [5.0, 1.0, 7.0, 0.0, 0.0, 2.0, 7.0, 3.0]
    assert [r["id"] for r in t.filter_by(["a", None], "k")] == [0, 2, 3, 5, 6] and [r["id"] for r in t.filter_by("a", "k", exclude=True)] == [1, 2, 4, 6, 7]
    assert [r["id"] for r in t.topk("x", 3)] == [2, 6, 0] and [r["id"] for r in t.topk("x", 2, reverse=True)] == [1, 5]
    check(t["x"].topk_index(2), [0, 0, 1, 0, 0, 0, 1, 0])
    assert [r["n"] for r in t.add_row_number("n", 5)] == list(range(5, 13)) and t.add_row_number("n").column_names()[0] == "n"
    a, b = t.random_split(0.5, 3)
    assert sorted(r["id"] for r in a) + sorted(r["id"] for r in b) == sorted([r["id"] for r in a]) + [i for i in range(8) if i not in {r["id"] for r in a}]


def test_sort_append_unique(t):
    assert [r["id"] for r in t.sort("k")][:2] in ([2, 6], [6, 2]) and [r["k"] for r in t.sort("k", False)] == ["c", "b", "b", "a", "a", "a", None, None]
    assert [r["id"] for r in t.sort([("k", False), ("id", True)])] == [7, 1, 4, 0, 3, 5, 2, 6]
    both = t.append(t[["x", "k", "id"]].sort("id", False))
    assert [r["id"] for r in both] == [*range(8), *range(7, -1, -1)]
    assert both[["id"]].unique().num_rows() == 8
    with pytest.raises(RuntimeError):
        t.append(t[["id"]])


def test_group_aggregators(t):
    assert t.groupby("k", {"n": agg.COUNT()}).num_rows() == 4
    g = {r["k"]: r for r in t.groupby("k", {
        "n": agg.COUNT(), "s": agg.SUM("x"), "m": agg.AVG("id"), "lo": agg.MIN("x"), "hi": agg.MAX("x"), "v": agg.VAR("id"), "sd": agg.STD("id"), "at": agg.ARGMAX("x", "id"), "low": agg.ARGMIN("x", "id"),
        "ids": agg.CONCAT("id"), "d": agg.CONCAT("id", "x"), "q": agg.QUANTILE("id", 0, 1), "u": agg.COUNT_DISTINCT("x"), "f": agg.FREQ_COUNT("id"), "one": agg.SELECT_ONE("id"), "nn": agg.NONNULL_COUNT("x"),
    })}
    a = g["a"]
    assert (a["n"], a["s"], a["lo"], a["hi"], a["at"], a["low"], list(a["ids"]), a["u"], a["nn"]) == (3, 7.0, 2.0, 5.0, 0, 5, [0, 3, 5], 3, 2)
    assert abs(a["m"] - 8 / 3) < 1e-12 and abs(a["v"] - statistics.pvariance([0, 3, 5])) < 1e-12 and list(a["q"]) == [0.0, 5.0]
    assert a["d"] == {0: 5.0, 3: None, 5: 2.0} and [tuple(e) for e in a["f"]] == [(0, 1), (3, 1), (5, 1)] and a["one"] in (0, 3, 5)
    assert g[None]["at"] == 2 and g["c"]["v"] == 0.0 and g["b"]["hi"] == 1.0
    assert set(t.groupby("k", [agg.SUM("id"), agg.COUNT()]).column_names()) == {"k", "Sum of id", "Count"}
    assert t.groupby([], {"n": agg.COUNT()}).num_rows() == 1 and t[t["id"] < 0].groupby([], {"n": agg.COUNT()}).num_rows() == 0
    assert sorted(rows(t.groupby("k", {})), key=str) == [("a",), ("b",), ("c",), (None,)]
    assert sorted(map(str, t.groupby([], {"d": agg.DISTINCT("k")})[0]["d"])) == ["None", "a", "b", "c"]


def test_group_vectors(spark):
    v = Table.of(spark, {"k": [1, 1, 2, 2, 3], "v": [array.array("d", x) for x in ([1, 2], [3, 4], [1, 2], [1], [])]})
    got = {r["k"]: (r["s"], r["m"]) for r in v.groupby("k", {"s": agg.SUM("v"), "m": agg.AVG("v")})}
    assert got[1] == ([4.0, 6.0], [2.0, 3.0]) and got[2] == (None, None)
    with pytest.raises(TypeError):
        v.groupby("k", {"s": agg.MIN("v")}).num_rows()


def test_joins(spark):
    a = Table.of(spark, {"last": ["r", "j", "h", "n", "s", "w"], "dep": [31, 33, 33, None, 34, 36]})
    b = Table.of(spark, {"dep": [31, 33, None, 35], "name": ["sales", "eng", "none", "mark"]})
    assert sorted(rows(a.join(b)), key=str) == sorted([("r", 31, "sales"), ("j", 33, "eng"), ("h", 33, "eng"), ("n", None, "none")], key=str)
    assert a.join(b, on="dep", how="left").num_rows() == 6 and a.join(b, how="right").num_rows() == 5 and a.join(b, how="outer").num_rows() == 7
    assert {r["dep"] for r in a.join(b, how="outer")} == {31, 33, 34, 35, 36, None}
    c = b.copy().rename({"dep": "id", "name": "last"})
    assert a.join(c, on={"dep": "id"}).column_names() == ["last", "dep", "last.1"]
    with pytest.raises(TypeError):
        a.join(b, on={"last": "dep"})


def test_reshape(spark):
    t = Table.of(spark, {"i": [1, 2, 3, 4], "l": [[1, 2], [], None, [3]], "d": [{"a": 1}, {"a": 2, "b": 3}, None, {}]})
    assert sorted(rows(t[["i", "l"]].stack("l", "e")), key=str) == sorted([(1, 1.0), (1, 2.0), (2, None), (3, None), (4, 3.0)], key=str)
    assert rows(t[["i", "l"]].stack("l", "e", drop_na=True)) == [(1, 1), (1, 2), (4, 3)]
    pairs = t[["i", "d"]].stack("d", ["k", "v"], drop_na=True)
    assert sorted(rows(pairs)) == [(1, "a", 1), (2, "a", 2), (2, "b", 3)]
    assert {r["i"]: r["d"] for r in pairs.unstack(["k", "v"], "d")} == {1: {"a": 1}, 2: {"a": 2, "b": 3}}
    u = t[["i", "d"]].unpack("d")
    assert u.column_names() == ["i", "d.a", "d.b"] and rows(u) == [(1, 1, None), (2, 2, 3), (3, None, None), (4, None, None)]
    assert u.pack_columns(column_prefix="d", dtype=dict, new_column_name="p")[1]["p"] == {"a": 2, "b": 3}
    assert rows(u.pack_columns(["d.a", "d.b"], dtype=array.array, new_column_name="v"))[0][1][0] == 1.0
    assert t[["i", "l"]].unpack("l", "x").column_names() == ["i", "x.0", "x.1"]
    clash = Table.of(spark, {"d.a": [0], "d": [{"a": 1, "c": 2}]}).unpack("d")
    assert clash.column_names() == ["d.a", "d.a.1", "d.c.1"]
    out = t[["i"]].flat_map(["a", "b"], lambda r: [[r["i"], str(j)] for j in range(r["i"] - 1)])
    assert out.num_rows() == 6 and out.column_types() == [int, str]


def test_functions_in_python(t):
    check(t["x"].apply(lambda v: v > 2), [1, 0, 1, None, 0, 0, 1, 1])
    check(t["k"].apply(lambda v: v is None, int, skip_undefined=False), [0, 0, 1, 0, 0, 0, 1, 0])
    check(t["id"].filter(lambda v: v % 3 == 0), [0, 3, 6])
    check(t.apply(lambda r: f"{r['id']}{r['k']}"), ["0a", "1b", "2None", "3a", "4b", "5a", "6None", "7c"])


def test_positions_of_other_rows(t, spark):
    other = Col.of(spark, [10 * i for i in range(8)])
    check(t["id"] + other, [11 * i for i in range(8)])
    t["o"] = other
    assert t[3]["o"] == 30
    a, b = t["x"].fillna(0.0).cumulative_sum(), t["id"].rolling_sum(-1, 0, 1)
    check(a + b, [5.0, 7.0, 16.0, 18.0, 20.0, 24.0, 33.0, 38.0][:1] + [v for v in (6 + 1, 13 + 3, 13 + 5, 13 + 7, 15 + 9, 22 + 11, 25 + 13)])


def test_plans_agree_however_rows_are_dealt(spark):
    data = spark.range(200).selectExpr("id", "id % 7 as k", "cast(id as double) / 3 as x")
    want = None
    for df in (data.repartition(1), data.repartition(6), data.repartition(3).cache()):
        t = Table.from_spark(df, "id")
        got = (rows(t.groupby("k", {"s": agg.SUM("x"), "l": agg.CONCAT("id")}).sort("k")), list(t["x"].rolling_mean(-3, 1)), rows(t[5:60:9]))
        assert want is None or same(got, want)
        want = got
    none = Table.from_spark(data.limit(0), "id")
    assert none.groupby("k", {"s": agg.SUM("x")}).num_rows() == 0 and list(none["x"].cumulative_sum()) == [] and none.sort("k").num_rows() == 0 and list(none["x"].rolling_sum(-1, 0)) == []


def test_builders(spark):
    b = ColBuilder(spark, int, 2)
    b.append_multiple([3, 4], 1)
    b.append(1)
    assert b.read_history(1, 1) == [4]
    check(b.close(), [1, 3, 4])
    with pytest.raises(RuntimeError):
        b.append(2)
    f = TableBuilder(spark, [int, str], ["i", "s"])
    f.append_multiple([(1, "a"), (2, None)])
    assert rows(f.close()) == [(1, "a"), (2, None)]


def test_generators(spark):
    check(Col.from_sequence(spark, 3, 6), [3, 4, 5])
    check(Col.from_const(spark, "x", 2), ["x", "x"])
    assert len(Col.date_range(spark, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2), 3600)) == 25
    assert list(Col.random_integers(spark, 3, 1)) == list(Col.random_integers(spark, 3, 1))
