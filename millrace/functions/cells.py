"""Lists, vectors and dictionaries: slices, trimming, packing and unpacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.types import FLOAT, VECTOR, converted, is_dict, literal, spark_type
from millrace.functions.semantics import as_int, is_na


def vector_slice(c: Column, kind: T.DataType, start: int, end: int | None) -> tuple[Column, T.DataType]:
    if end is None:
        return F.get(c, F.lit(start)), kind.elementType
    return F.when(F.size(c) >= end, F.slice(c, F.lit(start + 1), F.lit(max(0, end - start)))), kind


def subslice(c: Column, kind: T.DataType, start: int | None, stop: int | None, step: int | None) -> Column:
    """Python's slices of texts, lists and vectors."""
    step = 1 if step is None else step
    if step == 0:
        raise ValueError("a slice's step must not be 0")
    text = isinstance(kind, T.StringType)
    n = F.length(c) if text else F.size(c)

    def bound(b: int | None, default: Column) -> Column:
        if b is None:
            return default
        low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
        return F.least(F.greatest(F.lit(b) + (n if b < 0 else F.lit(0)), low), high)

    first = bound(start, F.lit(0) if step > 0 else n - 1)
    after = bound(stop, n if step > 0 else F.lit(-1))
    if text and step == 1:
        return F.substr(c, first + 1, F.greatest(after - first, F.lit(0)))
    last = after - 1 if step > 0 else after + 1
    some = (first <= last) if step > 0 else (first >= last)
    places = F.when(some, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    if text:
        return F.when(c.isNotNull(), F.array_join(F.transform(places, lambda i: F.substr(c, i + 1, F.lit(1))), ""))
    return F.when(c.isNotNull(), F.transform(places, lambda i: F.get(c, i)))


def _in(k: Column, keys: Sequence) -> Column:
    return k.isin(*keys) if keys else F.lit(False)


def trim_keys(c: Column, keys: Sequence, exclude: bool) -> Column:
    return F.map_filter(c, lambda k, _: ~_in(k, keys) if exclude else _in(k, keys))


def trim_values(c: Column, kind: T.MapType, lower, upper) -> Column:
    """Entries with values between the bounds, both included; values that can't be compared with them stay."""

    def keep(v: Column) -> Column:
        out = F.lit(True)
        for bound, ok in ((lower, lambda v, b: v >= b), (upper, lambda v, b: v <= b)):
            if bound is not None and isinstance(kind.valueType, T.StringType) == isinstance(bound, str):
                out = out & F.coalesce(ok(v, F.lit(bound)), F.lit(True))
        return out

    return F.map_filter(c, lambda _, v: keep(v))


def has_any(c: Column, keys: Sequence) -> Column:
    return as_int(F.exists(F.map_keys(c), lambda k: _in(k, keys)))


def has_all(c: Column, keys: Sequence) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & F.array_contains(F.map_keys(c), F.lit(k))
    return F.when(c.isNotNull(), as_int(found))


def packed(columns: dict[str, tuple[Column, T.DataType]], keys: dict[str, str], dtype: type, fill_na) -> tuple[Column, T.DataType]:
    """Columns as one cell: a dictionary leaves nulls out unless fill_na is given; a vector has NaN for them."""
    import array

    kinds = {k.simpleString(): k for _, k in columns.values()}
    numbers = all(isinstance(k, (T.LongType, T.DoubleType)) for k in kinds.values())
    kind = next(iter(kinds.values())) if len(kinds) == 1 else FLOAT if numbers else T.StringType()
    cells = {n: e.cast(kind) for n, (e, _) in columns.items()}
    if fill_na is not None:
        cells = {n: F.when(is_na(e, kind), literal(converted(fill_na, kind), kind)).otherwise(e) for n, e in cells.items()}
    if dtype is dict:
        entries = F.array(*(F.struct(F.lit(keys[n]).alias("k"), e.alias("v")) for n, e in cells.items()))
        return F.map_from_entries(F.filter(entries, lambda s: s["v"].isNotNull())), T.MapType(T.StringType(), kind)
    if dtype is array.array:
        if not numbers:
            raise TypeError("a vector holds numbers")
        return F.array(*(F.coalesce(e.cast("double"), F.lit(float("nan"))) for e in cells.values())), VECTOR
    return F.array(*cells.values()), T.ArrayType(kind)


#: Columns that a dictionary may be unpacked to without naming them.
MOST_KEYS = 10_000


def unpacked(df: DataFrame, c: Column, kind: T.DataType, prefix: str, column_types, na_value, limit: Sequence | None) -> dict[str, tuple[Column, T.DataType]]:
    """A column for each key, in order, or each place. The width of lists is that of the longest; keys are those of all rows."""
    if is_dict(kind):
        keys = list(limit) if limit is not None else sorted(r[0] for r in df.select(F.explode(F.map_keys(c)).alias("k")).distinct().limit(MOST_KEYS + 1).collect())
        if limit is None and len(keys) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} keys would each be a column; name the ones wanted by limit, or stack the column")
        cells = {str(k): F.get(F.filter(F.map_entries(c), lambda e: e["key"] == literal(k, kind.keyType)), 0)["value"] for k in keys}
        inner = kind.valueType
    else:
        places = list(limit) if limit is not None else list(range(df.agg(F.max(F.size(c))).first()[0] or 0))
        cells, inner = {str(k): F.get(c, F.lit(k)) for k in places}, kind.elementType
    kinds = [spark_type(t) for t in column_types] if isinstance(column_types, (list, tuple)) else [spark_type(column_types.get(k, inner)) if column_types else inner for k in cells]
    out = {}
    for (key, e), to in zip(cells.items(), kinds):
        if na_value is not None:
            e = F.when(e != literal(na_value, inner), e)
        out[f"{prefix}.{key}" if prefix else key] = (e.cast(to), to)
    return out
