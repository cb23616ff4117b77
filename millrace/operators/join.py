"""Equi-joins by name in which null keys match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def key_pairs(left_kinds: dict[str, T.DataType], right_kinds: dict[str, T.DataType], on) -> dict[str, str]:
    """The right key for each left one."""
    if on is None:
        pairs = {n: n for n in left_kinds if n in right_kinds}
    elif isinstance(on, str):
        pairs = {on: on}
    elif isinstance(on, dict):
        pairs = dict(on)
    else:
        pairs = {n: n for n in on}
    if not pairs:
        raise ValueError("there are no columns to join on")
    for a, b in pairs.items():
        if left_kinds[a].simpleString() != right_kinds[b].simpleString():
            raise TypeError(f"{a} and {b} have different types")
    return pairs


def right_names(left_kinds: dict[str, T.DataType], right_kinds: dict[str, T.DataType], pairs: dict[str, str]) -> dict[str, str]:
    """What right columns that aren't keys are called in the join, by their own name."""
    out, names = {}, set(left_kinds)
    for n in right_kinds:
        if n in pairs.values():
            continue
        new = n
        while new in names:
            new += ".1"
        names.add(new)
        out[n] = new
    return out


def joined(left: DataFrame, left_kinds: dict[str, T.DataType], right: DataFrame, right_kinds: dict[str, T.DataType], on, how: str) -> tuple[DataFrame, dict[str, T.DataType]]:
    """The left columns, then the right ones that aren't keys, renamed to name.1 where names clash.

    A key has the value of whichever side is there. Spark chooses how to join.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}")
    pairs = key_pairs(left_kinds, right_kinds, on)
    l = left.select(*(F.col(f"`{n}`").alias(f"l{i}") for i, n in enumerate(left_kinds)))
    r = right.select(*(F.col(f"`{n}`").alias(f"r{i}") for i, n in enumerate(right_kinds)))
    at_l, at_r = {n: f"l{i}" for i, n in enumerate(left_kinds)}, {n: f"r{i}" for i, n in enumerate(right_kinds)}
    match = None
    for a, b in pairs.items():
        one = F.col(at_l[a]).eqNullSafe(F.col(at_r[b]))
        match = one if match is None else match & one
    both = l.join(r, match, HOW[how])
    there = F.coalesce if how in ("right", "outer") else (lambda x, _: x)
    out = [(there(F.col(at_l[n]), F.col(at_r[pairs[n]])) if n in pairs else F.col(at_l[n])).alias(n) for n in left_kinds]
    kinds = dict(left_kinds)
    for n, new in right_names(left_kinds, right_kinds, pairs).items():
        kinds[new] = right_kinds[n]
        out.append(F.col(at_r[n]).alias(new))
    return both.select(*out), kinds


def apart(df: DataFrame, key: str) -> DataFrame:
    """The same rows, a few for each key at most, for the small side of a join on a key that may be hot in the other.

    Rows fresh from an aggregation by the key would be joined in the aggregation's own
    stage, where adaptive execution can't split a hot key. Here the key, of whole
    numbers or bytes, passes through an expression that keeps its value but hides how
    the rows lie, so that the join has an exchange right below it on both sides.
    """
    long = isinstance(df.schema[key].dataType, T.LongType)
    return df.withColumn(key, F.bitwise_not(F.bitwise_not(key)) if long else F.substring(F.col(key), F.lit(1), F.lit(2**31 - 1)))
