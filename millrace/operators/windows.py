"""Rolling and running aggregates over all rows in order, without moving all rows to one task.

Rows with dense numbers are dealt out to blocks of consecutive ones. A rolling frame
gets the rows that it needs of neighbouring blocks; a running aggregate is that of the
row's block so far joined to that of all blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rows import RID

BLOCK = 1 << 18




def rolling(df: DataFrame, c: Column, name: str, how: str, start: int, end: int, least: int | None, vector: bool, block: int = BLOCK) -> DataFrame:
    """df with a column name: the aggregate of c over rows number + start to number + end.

    Nulls and rows outside of the table don't count. least None: all rows of the frame
    must be there; 0: none need be.
    """
    if start > end:
        raise ValueError("a frame's start must not be after its end")
    size = max(block, 4 * (max(end, 0) - min(start, 0) + 1))
    needs = end - start + 1 if least is None else min(least, end - start + 1)
    low, high = F.floor((F.col(RID) - max(end, 0)) / size).cast("long"), F.floor((F.col(RID) - min(start, 0)) / size).cast("long")
    spread = df.withColumn("__c", c).withColumn("__block", F.explode(F.sequence(low, high)))
    w = Window.partitionBy("__block").orderBy(RID).rowsBetween(start, end)
    x = F.col("__c")
    n = F.count(x).over(w)
    if vector:
        cells = F.collect_list(x).over(w)
        sizes = F.array_distinct(F.transform(cells, lambda v: F.size(v)))
        add = F.aggregate(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), F.get(cells, 0), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
        total = F.when(F.size(sizes) == 1, add)
        value = {"sum": total, "mean": F.transform(total, lambda v: v / n)}[how]
    else:
        value = {
            "sum": lambda: F.coalesce(F.sum(x).over(w), F.lit(0)), "mean": lambda: F.avg(x).over(w), "min": lambda: F.min(x).over(w), "max": lambda: F.max(x).over(w),
            "var": lambda: F.var_pop(x).over(w), "stdv": lambda: F.stddev_pop(x).over(w), "count": lambda: n,
        }[how]()
    guarded = F.when(n >= needs, value) if needs > 0 and how != "count" else value
    out = spread.withColumn(name, guarded)
    return out.where(F.col("__block") == F.floor(F.col(RID) / size)).drop("__block", "__c")


def running(df: DataFrame, c: Column, name: str, how: str, block: int = BLOCK, by: list[str] | None = None) -> DataFrame:
    """df with a column name: the aggregate of c from the first row to this one; null until there is a value."""
    by = by or []
    x = F.col("__c").cast("double") if how in ("mean", "var", "stdv") else F.col("__c")
    dealt = df.withColumn("__c", c).withColumn("__block", F.floor(F.col(RID) / block).cast("long"))
    shift = F.lit(0.0)
    if how in ("var", "stdv"):  # squares about a value near the mean keep their digits
        middle = df.agg(F.avg(c.cast("double"))).first()[0]
        shift = F.lit(float(middle or 0.0))
    parts = {"n": F.count(x), "s": F.sum(x - shift) if how in ("var", "stdv") else F.sum(x)} if how in ("sum", "mean", "var", "stdv") else {"n": F.count(x)}
    if how in ("var", "stdv"):
        parts["q"] = F.sum((x - shift) * (x - shift))
    if how in ("min", "max"):
        parts["m"] = (F.min if how == "min" else F.max)(x)
    merge = {"n": F.sum, "s": F.sum, "q": F.sum, "m": F.min if how == "min" else F.max}
    totals = dealt.groupBy(*by, "__block").agg(*(e.alias(f"__b_{k}") for k, e in parts.items()))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block only
    prior = totals.select(*by, "__block", *(merge[k](f"__b_{k}").over(before).alias(f"__p_{k}") for k in parts))
    here = Window.partitionBy(*by, "__block").orderBy(RID).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(prior, [*by, "__block"])
    joined = joined.withColumns({f"__h_{k}": e.over(here) for k, e in parts.items()})

    def whole(k: str) -> Column:
        a, b = F.col(f"__p_{k}"), F.col(f"__h_{k}")
        if k == "m":
            return (F.least if how == "min" else F.greatest)(a, b)
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    n = whole("n")
    if how == "sum":
        value = whole("s")
    elif how == "mean":
        value = whole("s") / F.nullif(n, F.lit(0))
    elif how in ("min", "max"):
        value = whole("m")
    else:
        m = F.nullif(n, F.lit(0))
        var = F.greatest(whole("q") / m - (whole("s") / m) * (whole("s") / m), F.lit(0.0))
        value = var if how == "var" else F.sqrt(var)
    out = joined.withColumn(name, F.when(n > 0, value))
    return out.drop("__block", "__c", *(f"__{p}_{k}" for k in parts for p in "ph"))


def running_vectors(df: DataFrame, c: Column, name: str, how: str, block: int = BLOCK) -> DataFrame:
    """As running() for sums and means of vectors of one length, element by element."""
    cells = df.select(RID, F.posexplode(c).alias("__pos", "__v"))
    done = running(cells, F.col("__v"), "__r", how, block, ["__pos"])
    back = done.groupBy(RID).agg(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "__r"))), lambda s: s["__r"]).alias("__cell"))
    joined = df.join(back, RID, "left")
    # rows with null repeat the last value: the last cell before, by blocks as above
    dealt = joined.withColumn("__block", F.floor(F.col(RID) / block).cast("long"))
    ends = dealt.groupBy("__block").agg(F.max_by("__cell", F.when(F.col("__cell").isNotNull(), F.col(RID))).alias("__e"))
    prior = ends.select("__block", F.last("__e", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__p"))
    here = F.last("__cell", ignorenulls=True).over(Window.partitionBy("__block").orderBy(RID).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(prior, "__block").withColumn(name, F.coalesce(here, F.col("__p"))).drop("__block", "__cell", "__p")
