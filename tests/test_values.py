import array
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import images, jsonio
from millrace.operators import dataflow
from millrace.table import Col, Table


def test_json_of_values(spark):
    value = {"a": [1, 2.5, None, "x"], 3: dt.datetime(2020, 1, 2, 3), "v": array.array("d", [1, 2]), "b": b"\x00\xff", "i": [float("inf")]}
    assert jsonio.loads(jsonio.dumps(value)) == value
    t = Table.of(spark, {"i": [1, None], "s": ["a", "b"], "l": [["x"], []]})
    back = jsonio.loads(jsonio.dumps({"t": t, "c": t["i"]}), spark)
    assert [tuple(r.values()) for r in back["t"]] == [(1, "a", ["x"]), (None, "b", [])] and list(back["c"]) == [1, None]


def test_json_of_cells(spark):
    c = Col.of(spark, [{"a": 1}, {}, None])
    assert list(c.to_json()) == ['{"a":1}', "{}", "null"]
    assert list(c.to_json().from_json(c.kind)) == [{"a": 1}, {}, None]
    assert list(Col.of(spark, ["[1,2]", "no"]).from_json(array.array)) == [[1.0, 2.0], None]


def test_images(spark):
    cells = [array.array("d", [i * 10 + k for k in range(12)]) for i in range(3)] + [None, array.array("d", [1])]
    c = Col.of(spark, cells).pixel_array_to_image(2, 2, 3)
    assert [None if v is None else list(v) for v in c.image_to_vector()] == [list(x) for x in cells[:3]] + [None, None]
    small = list(c.resize(1, 1, 1))
    assert (small[0].height, small[0].width, small[0].nChannels, bytes(small[0].data)) == (1, 1, 1, b"\x01") and small[3] is None
    h, w, n, data = images.mean_image(c.frame("image").where("image is not null"))
    assert (h, w, n) == (2, 2, 3) and data == bytes(range(10, 22))
    assert images.mean_image(c.frame("image").limit(0)) is None


def test_dealing(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    assert dataflow.shuffled(df, 5, F.col("k")).rdd.getNumPartitions() == 5
    for part in dataflow.adjacent(df, "k").rdd.map(lambda r: r.k).glom().collect():
        assert part == sorted(part)
    a, b = dataflow.split(df, F.col("k") > 2)
    assert a.count() + b.count() == 100 and dataflow.reduced(df, s=F.sum("id")).first().s == 4950
    groups = Table.from_spark(df, "id").group("k")
    assert groups.num_groups() == 7 and [k for k, _ in groups] == [(i,) for i in range(7)] and [r["id"] for r in groups.get_group(3)][:2] == [3, 10]


def test_pandas(spark):
    t = Table.of(spark, pd.DataFrame({"a": [1, 2], "s": ["x", None]}))
    assert t.column_types() == [int, str] and [tuple(r.values()) for r in t] == [(1, "x"), (2, None)]
