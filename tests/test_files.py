import datetime as dt
import json
import sqlite3

import pytest

from millrace.functions.literals import parse
from millrace.sources import readers, sinks
from millrace.table import Table


def rows(table):
    return [tuple(r.values()) for r in table]


def put(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("delimiter,end", [(",", "\n"), ("\t", "\n"), ("|", "\r\n"), (" ", "\n")])
def test_csv_of_each_kind(spark, tmp_path, delimiter, end):
    lines = [["i", "f", "s", "v", "d"], ["1", "1.5", "ab", '"[1;2.5]"', '"{a:1}"'], ["2", "2", '"c d"', '"[3]"', '"{a:2;b:3}"'], ["", "", "", "", ""]]
    url = put(tmp_path / "x.csv", end.join(delimiter.join(r) for r in lines) + end)
    t = readers.read_csv(spark, url, delimiter=delimiter)
    assert t.column_names() == ["i", "f", "s", "v", "d"] and [x.__name__ for x in t.column_types()] == ["int", "float", "str", "array", "dict"]
    assert rows(t)[:2] == [(1, 1.5, "ab", [1.0, 2.5], {"a": 1}), (2, 2.0, "c d", [3.0], {"a": 2, "b": 3})]
    assert rows(t)[2:] in ([], [(None,) * 5])


def test_csv_settings(spark, tmp_path):
    url = put(tmp_path / "a.csv", "skip me\n# note\na,a,b\n1,2,x\n3,NA,y\nbad,4,z\n5,6,'q'\n")
    t = readers.read_csv(spark, url, comment_char="#", skiprows=1, column_type_hints={"a": int, "a.1": int})
    assert t.column_names() == ["a", "a.1", "b"] and rows(t) == [(1, 2, "x"), (3, None, "y"), (5, 6, "'q'")]
    good, bad = readers.read_csv_with_errors(spark, url, comment_char="#", skiprows=1, column_type_hints={"a": int, "a.1": int})
    assert good.num_rows() == 3 and list(bad[url]) == ["bad,4,z"]
    with pytest.raises(ValueError, match="bad"):
        readers.read_csv(spark, url, comment_char="#", skiprows=1, column_type_hints={"a": int, "a.1": int}, error_bad_lines=True)
    url = put(tmp_path / "b.csv", "1,x\n2,y\n3,z\n")
    t = readers.read_csv(spark, url, header=False, usecols=["X2"], nrows=2)
    assert rows(t) == [("x",), ("y",)]
    url = put(tmp_path / "c.csv", 'a,b\n"x ""y""",1\n"two\nlines",2\n')
    assert rows(readers.read_csv(spark, url))[0] == ('x "y"', 1)


def test_csv_skips_by_position(spark, tmp_path):
    url = put(tmp_path / "s.csv", "1,2\na,b\n3,4\n1,2\na,b\n5,6\n")
    t, bad = readers.read_csv_with_errors(spark, url, skiprows=1, column_type_hints={"a": int, "b": int})
    assert rows(t) == [(3, 4), (1, 2), (5, 6)] and {f: list(c) for f, c in bad.items()} == {url: ["a,b"]}
    url = put(tmp_path / "h.csv", "a,b\n1,2\na,b\n3,4\n")
    assert rows(readers.read_csv(spark, url, column_type_hints=str)) == [("1", "2"), ("a", "b"), ("3", "4")]
    url = put(tmp_path / "t.csv", "trash\njunk\nnumbers\n" + "".join(f"{i}\n" for i in range(50)))
    assert rows(readers.read_csv(spark, url, skiprows=2, column_type_hints={"numbers": int})) == [(i,) for i in range(50)]
    assert readers.read_csv(spark, url, skiprows=2, column_type_hints={"numbers": list}).num_rows() == 0
    url = put(tmp_path / "c.csv", "x\n# note\n\n# more\nn,m\n# inside\n7,8\n")
    assert rows(readers.read_csv(spark, url, skiprows=1, comment_char="#")) == [(7, 8)]


def test_csv_of_several_files(spark, tmp_path):
    (tmp_path / "many").mkdir()
    sizes = [3, 40, 1, 17]
    for k, n in enumerate(sizes):  # Spark packs files by size; rows come by file
        put(tmp_path / "many" / f"{k}.csv", "note\nk,i\n" + "".join(f"{k},{i}\n" for i in range(n)) + ("wrong,x\n" if k % 2 else ""))
    t, bad = readers.read_csv_with_errors(spark, str(tmp_path / "many"), skiprows=1)
    assert rows(t) == [(k, i) for k, n in enumerate(sizes) for i in range(n)]
    assert {f: list(c) for f, c in bad.items()} == {str(tmp_path / "many" / f"{k}.csv"): ["wrong,x"] for k in (1, 3)}
    assert rows(readers.read_csv(spark, str(tmp_path / "many"), skiprows=1, nrows=5)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:  # parts of a few lines each, so that the lines to skip run over several
        url = put(tmp_path / "parts.csv", "".join(f"skip {i}\n" for i in range(30)) + "i\n" + "".join(f"{i}\n" for i in range(200)))
        assert rows(readers.read_csv(spark, url, skiprows=30)) == [(i,) for i in range(200)]
        wide = Table.from_spark(spark.range(300).repartition(4).toDF("i"), "i")
        wide.export_csv(str(tmp_path / "out"), file_header="top")
        assert rows(readers.read_csv(spark, str(tmp_path / "out"), skiprows=1)) == [(i,) for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_literals():
    assert parse("[1, [2, 'a b'], {x: 3}]") == [1, [2, "a b"], {"x": 3}]
    assert parse("{'k': [1.5, None]}") == {"k": [1.5, None]}
    assert parse("[1, 2") == "[1, 2" and parse("12abc") == "12abc" and parse("-3e2") == -300.0 and parse("[]") == []


@pytest.fixture
def t(spark):
    return Table.of(spark, {"i": [3, 1, 2], "s": ["a,b", 'q"q', None], "x": [1.5, None, 2.0], "v": [[1.0, 2.0], [], None]})


def test_csv_out(t, spark, tmp_path):
    folder = str(tmp_path / "out")
    t[["i", "s", "x"]].export_csv(folder, file_header="top", file_footer="end", line_prefix="> ", na_rep="-")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == 'top\n> "i","s","x"\n> 3,"a,b",1.5\n> 1,"q""q",-\n> 2,-,2.0\nend\n'
    for level, want in ((0, '3,"a,b"'), (1, '"3","a,b"'), (3, "3,a,b")):
        t[["i", "s"]].head(1).export_csv(folder, quote_level=level, header=False)
        assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == want + "\n"
    t[["i", "s"]].export_csv(folder)
    assert rows(readers.read_csv(spark, folder).sort("i")) == [(1, 'q"q'), (2, None), (3, "a,b")]


def test_json(t, spark, tmp_path):
    for orient in ("records", "lines"):
        folder = str(tmp_path / orient)
        t[["i", "s"]].export_json(folder, orient)
        text = "".join(p.read_text() for p in sorted((tmp_path / orient).glob("part-*")))
        data = json.loads(text) if orient == "records" else [json.loads(x) for x in text.splitlines()]
        assert data == [{"i": 3, "s": "a,b"}, {"i": 1, "s": 'q"q'}, {"i": 2}]
    assert rows(readers.read_json(spark, str(tmp_path / "lines"), "lines").sort("i")) == [(1, 'q"q'), (2, None), (3, "a,b")]
    assert rows(readers.read_json(spark, put(tmp_path / "r.json", '[{"a": 1}, {"a": 2, "b": "x"}]'))) == [(1, None), (2, "x")]
    assert rows(readers.read_json(spark, put(tmp_path / "w.json", "plain\nwords\n"), "lines")) == [("plain",), ("words",)]


def test_saved_order(t, spark, tmp_path):
    t.sort("i", False).save(str(tmp_path / "bin"))
    back = readers.load_table(spark, str(tmp_path / "bin"))
    assert [r["i"] for r in back] == [3, 2, 1] and back.column_names() == t.column_names()
    t["s"].save(str(tmp_path / "txt"), "text")
    assert sorted(map(str, readers.read_text(spark, str(tmp_path / "txt")))) == ["", 'a,b', 'q"q']


def test_databases(t, spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE out (i INTEGER, s TEXT, x REAL)")
    t[["i", "s", "x"]].to_sql(db, "out")
    back = readers.from_sql(spark, db, "SELECT i, s, x FROM out WHERE i < ? ORDER BY i", (3,), cursor_arraysize=1)
    assert rows(back) == [(1, 'q"q', None), (2, None, 2.0)] and back.column_types() == [int, str, float]
    assert readers.from_sql(spark, db, "SELECT i FROM out", column_type_hints={"i": str}).column_types() == [str]
    held, readers._HELD = readers._HELD, 7
    try:
        Table.of(spark, {"i": list(range(40)), "s": [f"s{i}" for i in range(40)], "x": [None] * 40}).to_sql(db, "out")
        back = readers.from_sql(spark, db, "SELECT i, s FROM out WHERE x IS NULL AND s LIKE ? ORDER BY i DESC", ("s%",), type_inference_rows=5, cursor_arraysize=3)
        assert [r["i"] for r in back] == list(range(39, -1, -1))
    finally:
        readers._HELD = held


def test_other_sources(spark):
    r = readers.random_table(spark, 50, "nuzbsv", 3)
    assert r.shape == (50, 6) and rows(r)[:3] == rows(readers.random_table(spark, 50, "nuzbsv", 3))[:3]
    assert rows(readers.from_rdd(spark, spark.sparkContext.parallelize([1, 2]))) == [(1,), (2,)]
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), True, 1.5)], "a int, b date, c boolean, d float")
    t = Table.from_spark(df)
    assert [x.__name__ for x in t.column_types()] == ["int", "datetime", "int", "float"] and t.to_pandas().shape == (1, 4)
    assert sinks.to_odbc is sinks.to_jdbc and readers.from_odbc is readers.from_jdbc
