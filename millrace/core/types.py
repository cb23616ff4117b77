"""Column types: int, float, str, vector (array.array), list, dict, datetime and images, as Spark types."""

from __future__ import annotations

import array
import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, FLOAT, STR, VECTOR, TIME = T.LongType(), T.DoubleType(), T.StringType(), T.ArrayType(T.DoubleType()), T.TimestampType()


def is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType)


def is_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and not is_vector(kind)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.LongType, T.DoubleType))


def is_dict(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType)


def python_type(kind: T.DataType) -> type:
    """The Python type that stands for a column's type."""
    if is_vector(kind):
        return array.array
    for spark, python in ((T.LongType, int), (T.DoubleType, float), (T.StringType, str), (T.TimestampType, dt.datetime), (T.ArrayType, list), (T.MapType, dict)):
        if isinstance(kind, spark):
            return python
    return object


def spark_type(kind) -> T.DataType:
    """The column type for a Python type, a Spark type or its name."""
    if isinstance(kind, T.DataType):
        return standard_type(kind)
    if isinstance(kind, str):
        return standard_type(T._parse_datatype_string(kind))
    known = {int: INT, float: FLOAT, str: STR, array.array: VECTOR, dt.datetime: TIME, bool: INT, list: T.ArrayType(STR), dict: T.MapType(STR, STR)}
    if kind not in known:
        raise TypeError(f"no column type for {kind!r}")
    return known[kind]


def standard_type(kind: T.DataType) -> T.DataType:
    """The nearest of the engine's types: whole numbers and booleans are 64-bit, other numbers double."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return TIME
    if isinstance(kind, (T.CharType, T.VarcharType)):
        return STR
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(standard_type(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(standard_type(kind.keyType), standard_type(kind.valueType))
    return kind


def standardised(df: DataFrame) -> DataFrame:
    """The same columns in the engine's types; columns that have them already are left as they are."""
    out = []
    for field in df.schema:
        kind = standard_type(field.dataType)
        c = F.col(f"`{field.name}`")
        out.append(c if kind.simpleString() == field.dataType.simpleString() else c.cast(kind).alias(field.name))
    return df.select(out)


def infer(values: Iterable) -> T.DataType:
    """The type that holds all values: int and float give float, vector and list give list, nulls any, others str."""
    kind: T.DataType | None = None
    for v in values:
        if v is not None:
            kind = merged(kind, value_type(v))
    return _settled(kind) if kind is not None else FLOAT


def _settled(kind: T.DataType) -> T.DataType:
    """Elements of which no value tells the type are text."""
    if isinstance(kind, T.NullType):
        return STR
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_settled(kind.elementType))
    return T.MapType(_settled(kind.keyType), _settled(kind.valueType)) if is_dict(kind) else kind


def value_type(v) -> T.DataType:
    if isinstance(v, (bool, int)) or type(v).__name__.startswith(("int", "uint")):
        return INT
    if isinstance(v, float) or type(v).__name__ in ("Decimal", "float32", "float64"):
        return FLOAT
    if isinstance(v, dt.timedelta):
        return FLOAT
    if isinstance(v, dt.date):
        return TIME
    if isinstance(v, array.array) or type(v).__name__ == "ndarray":
        return VECTOR
    if isinstance(v, (list, tuple)):
        inner = infer(v) if any(x is not None for x in v) else T.NullType()
        return VECTOR if v and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v) else T.ArrayType(inner)
    if isinstance(v, dict):
        return T.MapType(infer(v) if v else T.NullType(), infer(v.values()) if any(x is not None for x in v.values()) else T.NullType())
    return STR


def merged(a: T.DataType | None, b: T.DataType) -> T.DataType:
    if a is None or a == b or isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if is_number(a) and is_number(b):
        return FLOAT
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if is_dict(a) and is_dict(b):
        return T.MapType(merged(a.keyType, b.keyType), merged(a.valueType, b.valueType))
    return STR


def converted(v, kind: T.DataType):
    """A Python value as createDataFrame takes it for a column of the type."""
    if v is None:
        return None
    if isinstance(kind, T.LongType):
        return int(v)
    if isinstance(kind, T.DoubleType):
        return v.total_seconds() if isinstance(v, dt.timedelta) else float(v)
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else str(v)
    if isinstance(kind, T.ArrayType):
        return [converted(x, kind.elementType) for x in v]
    if isinstance(kind, T.MapType):
        return {converted(k, kind.keyType): converted(x, kind.valueType) for k, x in v.items()}
    if isinstance(kind, T.TimestampType) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    return v


def literal(v, kind: T.DataType | None = None) -> Column:
    """A constant as a column expression of its type."""
    kind = kind or (infer([v]) if v is not None else STR)
    if v is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*(literal(x, kind.elementType) for x in v)).cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*(x for k, w in v.items() for x in (literal(k, kind.keyType), literal(w, kind.valueType)))).cast(kind)
    return F.lit(converted(v, kind)).cast(kind)
