"""Array expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(value: Column, use) -> Column:
    """use(value), with value computed once: inside a lambda, an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def ends(lengths: Column) -> Column:
    """Running sums of an array of lengths.

    Sums are taken over blocks of about sqrt(n), so a text with very many matches costs n^1.5 steps, not n^2.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(lengths).cast("double"))).cast("int"))

    def blocks(b: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(b["lengths"]) - 1) / b["width"]).cast("int"))
        sums = F.transform(starts, lambda k: total(F.slice(b["lengths"], k * b["width"] + 1, b["width"])))
        return F.struct(b["lengths"].alias("lengths"), b["width"].alias("width"), sums.alias("sums"))

    def offsets(b: Column) -> Column:
        before = F.transform(b["sums"], lambda _, k: total(F.slice(b["sums"], F.lit(1), k)))
        return F.struct(b["lengths"].alias("lengths"), b["width"].alias("width"), before.alias("before"))

    def upto(b: Column) -> Column:
        block = lambda i: (i / b["width"]).cast("int")
        return F.transform(b["lengths"], lambda _, i: F.get(b["before"], block(i)) + total(F.slice(b["lengths"], block(i) * b["width"] + 1, i % b["width"] + 1)))

    return given(given(given(F.struct(lengths.alias("lengths"), width.alias("width")), blocks), offsets), upto)
