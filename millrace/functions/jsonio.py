"""Typed values as JSON and back: of cells in a plan, and of Python values with whole tables among them."""

from __future__ import annotations

import array
import base64
import datetime as dt
import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_json(c: Column, kind: T.DataType) -> Column:
    """A cell as JSON text; NaN and infinities as the words that from_json() reads back."""
    wrapped = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1)


def from_json(c: Column, kind: T.DataType) -> Column:
    """JSON text as a cell of the type; null if it isn't one."""
    return F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), T.StructType([T.StructField("v", kind)]), {"allowNonNumericNumbers": "true"})["v"]


def dumps(value) -> str:
    """A Python value as JSON that keeps what JSON has no type for: times, vectors, bytes, tables and columns."""
    from millrace.table import Col, Table

    def tagged(v):
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return {"type": "float", "value": repr(v)}
        if isinstance(v, dict):
            return {"type": "dict", "value": [[tagged(k), tagged(x)] for k, x in v.items()]}
        if isinstance(v, (list, tuple)):
            return {"type": "list", "value": [tagged(x) for x in v]}
        if isinstance(v, array.array):
            return {"type": "vector", "value": [tagged(float(x)) for x in v]}
        if isinstance(v, dt.datetime):
            return {"type": "datetime", "value": v.isoformat()}
        if isinstance(v, (bytes, bytearray)):
            return {"type": "bytes", "value": base64.b64encode(v).decode()}
        if isinstance(v, Table):
            return {"type": "table", "schema": {n: k.json() for n, k in v.kinds.items()}, "value": [tagged(list(r.values())) for r in v]}
        if isinstance(v, Col):
            return {"type": "column", "schema": v.kind.json(), "value": tagged(list(v))}
        return v

    return json.dumps(tagged(value))


def loads(text: str, spark: SparkSession | None = None):
    """The value that dumps() wrote; tables and columns need a session."""
    from millrace.table import Col, Table

    def back(v):
        if not isinstance(v, dict):
            return v
        kind, x = v["type"], v["value"]
        if kind == "dict":
            return {back(a): back(b) for a, b in x}
        if kind == "list":
            return [back(y) for y in x]
        if kind == "vector":
            return array.array("d", map(back, x))
        if kind == "table":
            table, rows = Table.of(spark), [back(r) for r in x]
            for i, (n, schema) in enumerate(v["schema"].items()):
                c = Col.of(spark, [r[i] for r in rows], T._parse_datatype_json_string(schema))
                table = c.to_table(n) if i == 0 else table.add_column(c, n)
            return table
        if kind == "column":
            return Col.of(spark, back(x), T._parse_datatype_json_string(v["schema"]))
        return {"float": float, "datetime": dt.datetime.fromisoformat, "bytes": base64.b64decode}[kind](x)

    return back(json.loads(text))
