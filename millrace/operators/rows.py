"""Rows with an order, and the dense row numbers that positional operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core.durable import cut

RID = "__rid"


class Rows:
    """A DataFrame, the names of hidden columns that order it, and the rows it was made from by adding columns.

    Without an order, rows are in the order in which Spark reads them.
    """

    def __init__(self, df: DataFrame, order: list[str] | None = None, dense: bool = False, below: Rows | None = None):
        self.df, self.order, self.dense = df, order or [], dense
        self.lineage: set[int] = {id(self)} | (below.lineage if below else set())
        self._below = below  # keeps the ids of the lineage in use
        self._numbered: DataFrame | None = df if dense else None

    def extends(self, other: Rows) -> bool:
        """Whether expressions over the other rows hold on these."""
        return id(other) in self.lineage

    def sorted(self, descending: bool = False) -> DataFrame:
        if not self.order:
            return self.df
        return self.df.orderBy(*(F.desc(c) if descending else F.asc(c) for c in self.order))

    def numbered(self) -> DataFrame:
        """The rows with a dense number from 0 in the column RID.

        The sorted rows are checkpointed, as a second sort could cut its ranges
        elsewhere; each partition then adds the number of rows before it. The table of
        offsets has one row for each partition, so it can be broadcast.
        """
        if self._numbered is None:
            fixed = cut(self.sorted().drop(RID)).withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
            offsets, total = [], 0
            for pid, n in sorted((r[0], r[1]) for r in fixed.groupBy("__pid").count().collect()):
                offsets.append((pid, total))
                total += n
            table = self.df.sparkSession.createDataFrame(offsets, "__pid int, __before long")
            self._numbered = fixed.join(F.broadcast(table), "__pid").withColumn(RID, F.col("__before") + F.col("__at")).drop("__pid", "__at", "__before")
        return self._numbered

    def by_number(self) -> Rows:
        """The same rows, numbered and in order of the number."""
        return self if self.dense else Rows(self.numbered(), [RID], True, self)


def zipped(a: Rows, b: Rows) -> tuple[Rows, dict[str, Column]]:
    """Rows side by side by position, with the right side's columns under other names; lengths must agree."""
    left, right = a.numbered(), b.numbered()
    kin = a.dense and b.dense and a.lineage & b.lineage  # columns added to the same numbered rows
    if not kin and left.count() != right.count():
        raise ValueError("columns have different lengths")
    names = {c: f"__z{k}_{c}" for k, c in enumerate(right.columns) if c != RID}
    names = {c: n if n not in left.columns else n + "_" for c, n in names.items()}
    joined = left.join(right.select(RID, *(F.col(f"`{c}`").alias(n) for c, n in names.items())), RID)
    return Rows(joined, [RID], True, a), {c: F.col(f"`{n}`") for c, n in names.items()}
