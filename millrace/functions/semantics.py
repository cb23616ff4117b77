"""Scalar rules: truth, equality, arithmetic, comparison, membership and bounds.

Each function takes expressions with their types and gives an expression; comparisons
and logic give 0 or 1 as a long. Null cells propagate but for == and !=.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.types import FLOAT, INT, STR, VECTOR, is_dict, is_list, is_number, is_vector, literal


def as_int(c: Column) -> Column:
    return c.cast("long")


def is_na(c: Column, kind: T.DataType) -> Column:
    """Null, or NaN in a float column."""
    return c.isNull() | F.isnan(c) if isinstance(kind, T.DoubleType) else c.isNull()


def truthy(c: Column, kind: T.DataType) -> Column:
    """False for 0, 0.0, empty text, empty cells and null; true for all else, NaN included."""
    if is_number(kind):
        found = c != 0
    elif isinstance(kind, T.StringType):
        found = F.length(c) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        found = F.size(c) > 0
    elif isinstance(kind, T.BooleanType):
        found = c
    else:
        found = c.isNotNull()
    return F.coalesce(found, F.lit(False))


def equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Null equals null and NaN equals NaN; values of types that can't be compared differ."""
    alike = (is_number(ta) or isinstance(ta, T.TimestampType)) and (is_number(tb) or isinstance(tb, T.TimestampType)) or ta.simpleString() == tb.simpleString()
    if not alike:
        return a.isNull() & b.isNull()
    if is_dict(ta):
        return (a.isNull() & b.isNull()) | F.coalesce(_entries(a).eqNullSafe(_entries(b)) & a.isNotNull() & b.isNotNull(), F.lit(False))
    if isinstance(ta, T.TimestampType) != isinstance(tb, T.TimestampType):
        a, b = _seconds(a, ta), _seconds(b, tb)
    return a.eqNullSafe(b)


def _entries(c: Column) -> Column:
    return F.sort_array(F.map_entries(c))


def _seconds(c: Column, kind: T.DataType) -> Column:
    return F.unix_micros(c) / 1e6 if isinstance(kind, T.TimestampType) else c.cast("double")


def compare(op: Callable, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    text = isinstance(ta, T.StringType), isinstance(tb, T.StringType)
    if any(text) and not all(text) or any(not is_number(t) and not isinstance(t, (T.StringType, T.TimestampType)) for t in (ta, tb)):
        raise TypeError(f"{ta.simpleString()} and {tb.simpleString()} have no order")
    if isinstance(ta, T.TimestampType) != isinstance(tb, T.TimestampType):
        a, b = _seconds(a, ta), _seconds(b, tb)
    return as_int(op(a, b))


def both(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Truth of both sides; null if either cell is null."""
    return F.when(a.isNotNull() & b.isNotNull(), as_int(truthy(a, ta) & truthy(b, tb)))


def either(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), as_int(truthy(a, ta) | truthy(b, tb)))


def _over(a: Column, b: Column) -> Column:
    """IEEE division."""
    a, b = a.cast("double"), b.cast("double")
    none = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, none).otherwise(a / b)


def _floor_over(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    if isinstance(ta, T.LongType) and isinstance(tb, T.LongType):
        n = F.nullif(b, F.lit(0).cast("long"))
        return F.call_function("div", a - _mod(a, b), n)  # whole, so nothing is rounded
    exact = _over(a, b)
    return F.when(F.abs(exact) < float("inf"), F.floor(exact).cast("double")).otherwise(exact)


def _mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null for a divisor of 0."""
    n = F.nullif(b, F.lit(0).cast("long"))
    return ((a % n) + n) % n


_NUMBERS: dict[str, Callable] = {
    "+": lambda a, ta, b, tb: a + b,
    "-": lambda a, ta, b, tb: a - b,
    "*": lambda a, ta, b, tb: a * b,
    "/": lambda a, ta, b, tb: _over(a, b),
    "//": _floor_over,
    "%": lambda a, ta, b, tb: _mod(a, b),
    "**": lambda a, ta, b, tb: F.pow(a.cast("double"), b.cast("double")),
}


def _result(op: str, ta: T.DataType, tb: T.DataType) -> T.DataType:
    return INT if op not in ("/", "**") and isinstance(ta, T.LongType) and isinstance(tb, T.LongType) else FLOAT


def arithmetic(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, T.DataType]:
    """a op b with its type: numbers, text + text, vectors by element, and times with seconds."""
    if is_number(ta) and is_number(tb):
        if op == "%" and not (isinstance(ta, T.LongType) and isinstance(tb, T.LongType)):
            raise TypeError("% needs whole numbers")
        return _NUMBERS[op](a, ta, b, tb).cast(_result(op, ta, tb)), _result(op, ta, tb)
    if op == "+" and isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
        return F.concat(a, b), STR
    f = _NUMBERS[op]
    if is_vector(ta) and is_vector(tb):
        return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: f(x, FLOAT, y, FLOAT))), VECTOR
    if is_vector(ta) and is_number(tb):
        return F.when(b.isNotNull(), F.transform(a, lambda x: f(x, FLOAT, b.cast("double"), FLOAT))), VECTOR
    if is_number(ta) and is_vector(tb):
        return F.when(a.isNotNull(), F.transform(b, lambda x: f(a.cast("double"), FLOAT, x, FLOAT))), VECTOR
    time = T.TimestampType
    if isinstance(ta, time) and isinstance(tb, time) and op == "-":
        return (F.unix_micros(a) - F.unix_micros(b)) / 1e6, FLOAT
    if isinstance(ta, time) and is_number(tb) and op in "+-":
        moved = F.unix_micros(a) + F.round(b.cast("double") * (1e6 if op == "+" else -1e6)).cast("long")
        return F.timestamp_micros(moved), ta
    raise TypeError(f"{ta.simpleString()} {op} {tb.simpleString()} isn't defined")


def negated(c: Column, kind: T.DataType) -> Column:
    return F.transform(c, lambda x: -x) if is_vector(kind) else -c


def absolute(c: Column, kind: T.DataType) -> Column:
    return F.transform(c, F.abs) if is_vector(kind) else F.abs(c)


def contains(c: Column, kind: T.DataType, item) -> Column:
    """1 if the text has the part, the list or vector the element, the dictionary the key; 0 for null."""
    if isinstance(kind, T.StringType):
        found = F.contains(c, F.lit(str(item)))
    elif isinstance(kind, T.ArrayType):
        found = F.exists(c, lambda x: x.eqNullSafe(literal(item, kind.elementType)))
    elif is_dict(kind):
        found = F.map_contains_key(c, literal(item, kind.keyType))
    else:
        raise TypeError(f"{kind.simpleString()} cells hold nothing to look for")
    return as_int(F.coalesce(found, F.lit(False)))


def is_in(c: Column, kind: T.DataType, values) -> Column:
    """1 if the cell is an element of the list, or a part of the text."""
    if isinstance(values, str):
        return as_int(F.coalesce(F.contains(F.lit(values), c), F.lit(False)))
    found = F.lit(False)
    if plain := [v for v in values if v is not None]:
        found = F.coalesce(c.isin(*plain), F.lit(False))
    return as_int(found | c.isNull() if None in values else found)


def where(mask: Column, tm: T.DataType, a: Column, b: Column) -> Column:
    return F.when(truthy(mask, tm), a).otherwise(b)


def clip(c: Column, kind: T.DataType, lower: float | None, upper: float | None) -> tuple[Column, T.DataType]:
    """Values held within the bounds; a float bound makes an int column float; NaN and null stay."""
    if lower is not None and upper is not None and lower > upper:
        raise ValueError("the lower bound is above the upper one")

    def held(x: Column, to: str) -> Column:
        out = x.cast(to)
        if lower is not None:
            out = F.when(x < lower, F.lit(lower).cast(to)).otherwise(out)
        if upper is not None:
            out = F.when((x > upper) & ~F.isnan(x.cast("double")), F.lit(upper).cast(to)).otherwise(out)
        return out

    if is_vector(kind):
        return F.transform(c, lambda x: held(x, "double")), kind
    if not is_number(kind):
        raise TypeError("only numbers and vectors have bounds")
    to = INT if isinstance(kind, T.LongType) and all(b is None or isinstance(b, int) for b in (lower, upper)) else FLOAT
    return held(c, to.simpleString()), to


_DATETIME = "yyyy-MM-dd'T'HH:mm:ss"


def cast(c: Column, kind: T.DataType, to: T.DataType, lenient: bool) -> Column:
    """A cell as another type; text that isn't one is an error, or null if lenient."""
    if kind.simpleString() == to.simpleString():
        return c
    change = (lambda x, t: x.try_cast(t)) if lenient else (lambda x, t: x.cast(t))
    if isinstance(to, T.StringType):
        if is_list(kind) or is_vector(kind) or is_dict(kind):
            return F.to_json(c)
        return F.date_format(c, _DATETIME) if isinstance(kind, T.TimestampType) else c.cast("string")
    if isinstance(kind, T.TimestampType) and is_number(to):
        return change(_seconds(c, kind), to)
    if is_number(kind) and isinstance(to, T.TimestampType):
        return F.timestamp_micros(F.round(c * 1e6).cast("long"))
    if isinstance(kind, T.DoubleType) and isinstance(to, T.LongType):
        return change(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)), to)
    if isinstance(kind, T.StringType) and isinstance(to, (T.ArrayType, T.MapType)):
        read = F.from_json(F.regexp_replace(F.trim(c), r"'", '"'), to.json())
        return read if lenient else F.when(c.isNotNull() & read.isNull(), F.raise_error(F.concat(F.lit("not a list or dictionary: "), c)).cast(to)).otherwise(read)
    if isinstance(kind, T.StringType) and is_number(to):
        return change(F.trim(c), to)
    if isinstance(kind, T.ArrayType) and isinstance(to, T.ArrayType):
        return F.transform(c, lambda x: cast(x, kind.elementType, to.elementType, lenient))
    return change(c, to)
