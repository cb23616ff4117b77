"""Aggregators and grouping.

Nulls are skipped but where said; the sum of nothing is 0, variance that of the
population and 0.0 for one value or none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.types import INT, is_dict, is_number, is_vector


@dataclass(frozen=True)
class Agg:
    """An aggregator over columns; extra holds its parameters."""

    op: str
    columns: tuple = ()
    extra: tuple = ()


def SUM(c):
    """Sum of numbers, or of vectors of one length by element (null if lengths differ)."""
    return Agg("Sum", (c,))


def AVG(c):
    """Mean of numbers, or of vectors of one length by element."""
    return Agg("Avg", (c,))


def MIN(c):
    return Agg("Min", (c,))


def MAX(c):
    return Agg("Max", (c,))


def COUNT(*_):
    """Number of rows, nulls included."""
    return Agg("Count")


def NONNULL_COUNT(c):
    return Agg("NonnullCount", (c,))


def VAR(c):
    return Agg("Var", (c,))


def STD(c):
    return Agg("Stdv", (c,))


def ARGMAX(agg, out):
    """out where agg is greatest, in the first such row in order. Both may be lists of equal length."""
    return Agg("Argmax", (agg, out))


def ARGMIN(agg, out):
    return Agg("Argmin", (agg, out))


def SELECT_ONE(c):
    """Some value."""
    return Agg("Select", (c,))


def CONCAT(c, value=None):
    """All values in order as a list (a vector for floats), or a dictionary of the first value for each key."""
    return Agg("Concat", (c,) if value is None else (c, value))


def QUANTILE(c, *q):
    """A vector of quantiles, each within 1/10000 in rank."""
    wanted = tuple(float(x) for y in q for x in (y if isinstance(y, (list, tuple)) else [y]))
    if any(not 0 <= x <= 1 for x in wanted):
        raise ValueError("a quantile must be between 0 and 1")
    return Agg("Quantile", (c,), wanted)


def COUNT_DISTINCT(c):
    """Number of different values, null being one."""
    return Agg("CountDistinct", (c,))


def DISTINCT(c):
    """List of different values, null being one."""
    return Agg("Distinct", (c,))


def FREQ_COUNT(c):
    """Entries (key, count) for each value, null being one; as a list, for a dictionary can't have a null key in Spark."""
    return Agg("FreqCount", (c,))


def USER(f, *columns):
    """An aggregate of the caller's own: f makes an aggregated expression of the columns', from Spark's functions or registered ones."""
    return Agg("User", columns, (f,))


MEAN, VARIANCE, STDV = AVG, VAR, STD

#: Aggregators of one column that stay as they are when each row of a group is repeated equally often.
EVEN = ("Min", "Max", "Avg", "Var", "Stdv", "CountDistinct", "Distinct")


def _numbers(c: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if isinstance(kind, T.DoubleType) else c


def _plain(a: Agg, kinds: dict[str, T.DataType], order: list[str]) -> Column | None:
    """The aggregator as one expression, if it is one."""
    c = F.col(f"`{a.columns[0]}`") if a.columns else None
    kind = kinds[a.columns[0]] if a.columns else None
    if a.op in ("Sum", "Avg", "Var", "Stdv", "Quantile") and not is_number(kind) and not (is_vector(kind) and a.op in ("Sum", "Avg")):
        raise TypeError(f"{a.op} isn't defined for {kind.simpleString()}")
    if a.op in ("Min", "Max", "Argmax", "Argmin") and not (is_number(kind) or isinstance(kind, T.TimestampType)):
        raise TypeError(f"{a.op} isn't defined for {kind.simpleString()}")
    if a.op == "User":
        return a.extra[0](*(F.col(f"`{n}`") for n in a.columns))
    simple: dict[str, Callable[[], Column]] = {
        "Sum": lambda: F.coalesce(F.sum(c), F.lit(0).cast(kind)),
        "Avg": lambda: F.avg(c),
        "Min": lambda: F.min(_numbers(c, kind)),
        "Max": lambda: F.max(_numbers(c, kind)),
        "Count": lambda: F.count(F.lit(1)),
        "NonnullCount": lambda: F.count(c),
        "Var": lambda: F.coalesce(F.var_pop(c), F.lit(0.0)),
        "Stdv": lambda: F.coalesce(F.stddev_pop(c), F.lit(0.0)),
        "Select": lambda: F.any_value(c),
        "Quantile": lambda: F.percentile_approx(c, F.array(*map(F.lit, a.extra)), F.lit(10000)).cast("array<double>"),
        "CountDistinct": lambda: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0)),
        "Distinct": lambda: F.concat(F.collect_set(c), F.when(F.max(c.isNull()), F.array(F.lit(None).cast(kind))).otherwise(F.array().cast(T.ArrayType(kind)))),
    }
    if a.op in ("Sum", "Avg") and is_vector(kind):
        return None
    if a.op in ("Argmax", "Argmin"):
        pick = F.max_by if a.op == "Argmax" else F.min_by
        value = _numbers(c, kind)
        sign = -1 if a.op == "Argmax" else 1
        numeric = [o for o in order if is_number(kinds.get(o, INT))]
        by = F.when(value.isNotNull(), F.struct(value.alias("a"), *((F.col(f"`{o}`") * sign).alias(f"o{k}") for k, o in enumerate(numeric))))
        return pick(F.struct(F.col(f"`{a.columns[1]}`").alias("v")), by)["v"]
    if a.op == "Concat" and len(a.columns) == 1:
        if order:
            both = F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(*(F.col(f"`{o}`").alias(f"o{k}") for k, o in enumerate(order)), c.alias("v")))))
            return F.transform(both, lambda s: s["v"])
        return F.collect_list(c)
    return simple[a.op]() if a.op in simple else None


def _special(df: DataFrame, keys: list[str], a: Agg, name: str, kinds: dict[str, T.DataType], order: list[str]) -> DataFrame:
    """An aggregator of two steps, as a table of keys and name. Each step is pre-aggregated before its shuffle."""
    c = F.col(f"`{a.columns[0]}`")
    cols = [F.col(f"`{k}`") for k in keys]
    entries = lambda e: F.sort_array(F.collect_list(e))
    if a.op == "FreqCount":
        counts = df.groupBy(*cols, c.alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
        return counts.groupBy(*cols).agg(entries(F.struct(F.col("__key").alias("key"), F.col("__n").alias("count"))).alias(name))
    if a.op == "Concat":
        v = F.col(f"`{a.columns[1]}`")
        first = F.min_by(F.struct(v.alias("v")), F.struct(*(F.col(f"`{o}`") for o in order))) if order else F.first(F.struct(v.alias("v")))
        pairs = df.groupBy(*cols, c.alias("__key")).agg(first.alias("__v"))
        filled = F.collect_list(F.when(F.col("__key").isNotNull(), F.struct(F.col("__key"), F.col("__v.v").alias("__value"))))
        return pairs.groupBy(*cols).agg(F.map_from_entries(filled).alias(name))
    cells = df.select(*cols, F.size(c).alias("__size"), F.posexplode_outer(c).alias("__pos", "__x"))
    sums = cells.groupBy(*cols, "__pos").agg(F.sum("__x").alias("__s"), F.count(F.when(F.col("__pos").isNotNull(), 1)).alias("__n"), F.min("__size").alias("__lo"), F.max("__size").alias("__hi"))
    value = F.col("__s") / F.col("__n") if a.op == "Avg" else F.col("__s")
    packed = sums.groupBy(*cols).agg(entries(F.when(F.col("__pos").isNotNull(), F.struct("__pos", value.alias("x")))).alias("__e"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    return packed.select(*cols, F.when(F.col("__lo") == F.col("__hi"), F.transform("__e", lambda s: s["x"])).alias(name))


def named(aggs) -> dict[str, Agg]:
    """Output names of aggregators given as a dictionary, a list, or one: '<Op> of <column>' where no name is given."""
    out: dict[str, Agg] = {}

    def put(name: str, a: Agg) -> None:
        k, given = 1, name
        while name in out:
            name, k = f"{given}.{k}", k + 1
        out[name] = a

    def auto(a: Agg) -> None:
        if a.op in ("Argmax", "Argmin"):
            pairs = list(zip(*a.columns)) if isinstance(a.columns[0], (list, tuple)) else [a.columns]
            for agg, res in pairs:
                put(f"{res} for {a.op} of {agg}", Agg(a.op, (agg, res)))
        else:
            put(f"{a.op} of {a.columns[0]}" if a.columns else a.op, a)

    def flat(x):
        return [y for z in x for y in flat(z)] if isinstance(x, (list, tuple)) else [x]

    for item in flat(aggs):
        if isinstance(item, dict):
            for name, a in item.items():
                a = a if isinstance(a, Agg) else a()
                if isinstance(name, (list, tuple)):
                    for one, agg, res in zip(name, *a.columns):
                        put(one, Agg(a.op, (agg, res)))
                else:
                    put(name, a)
        else:
            auto(item if isinstance(item, Agg) else item())
    return out


def grouped(df: DataFrame, keys: list[str], aggs: dict[str, Agg], kinds: dict[str, T.DataType], order: list[str]) -> DataFrame:
    """A row for each group, null being a key like others; without keys one row, or none for no rows."""
    for k in keys:
        if is_dict(kinds[k]):
            raise TypeError("a dictionary can't be a key")
    cols = [F.col(f"`{k}`") for k in keys]
    plain = {n: e for n, a in aggs.items() if (e := _plain(a, kinds, order)) is not None}
    out = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__rows"), *(e.alias(n) for n, e in plain.items())).where("__rows > 0").drop("__rows")
    for name, a in aggs.items():
        if name in plain:
            continue
        part = _special(df, keys, a, name, kinds, order)
        if keys:
            right = part.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), f"`{name}`")
            match = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
            on = match[0]
            for m in match[1:]:
                on = on & m
            out = out.join(right, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))
        else:
            right = part.withColumn("__one", F.lit(1))
            out = out.withColumn("__one", F.lit(1)).join(right, "__one").drop("__one")
    return out.select(*cols, *(F.col(f"`{n}`") for n in aggs))
