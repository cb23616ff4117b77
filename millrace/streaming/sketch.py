"""Summaries of a column from one pass of aggregation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core import types as K
from millrace.table import Col

#: Relative error of the number of different values: 2^16 registers have 0.4 %.
RSD = 0.00406
#: Quantiles kept, and so their error in rank.
PERCENTS = 1000
#: Values whose counts are kept for frequent_items.
ITEMS = 1000


def _value(c: Column, key: Column) -> Column:
    return F.get(F.filter(F.map_entries(c), lambda e: e["key"] == key), 0)["value"]


class Sketch:
    """Exact size, missing cells and moments; approximate number of values, quantiles and frequent items.

    In the background the pass runs in a thread of its own under a job group, which cancel() ends.
    """

    def __init__(self, column: Col, background: bool = False, sub_sketch_keys: Sequence | None = None):
        self._column, self._keys, self._error = column, list(sub_sketch_keys or []), None
        self._group = f"sketch-{uuid.uuid4().hex}"
        self._row = None
        self._frequent: dict | None = None
        self._subs: dict = {}
        self._done = threading.Event()
        if background:
            threading.Thread(target=self._run, daemon=True).start()
        else:
            self._run()

    def _run(self) -> None:
        spark = self._column.rows.df.sparkSession
        try:
            spark.addTag(self._group)
            c, kind = F.col("c"), self._column.kind
            exprs = {"size": F.count(F.lit(1)), "missing": F.count_if(c.isNull())}
            plain = c if not isinstance(kind, (T.ArrayType, T.MapType)) else F.to_json(c)
            exprs["unique"] = F.approx_count_distinct(plain, RSD)
            if K.is_number(kind):
                exprs |= {"min": F.min(c), "max": F.max(c), "sum": F.coalesce(F.sum(c), F.lit(0).cast(kind)), "mean": F.avg(c), "var": F.var_pop(c)}
                exprs["quantiles"] = F.percentile_approx(c, F.array(*(F.lit(i / PERCENTS) for i in range(PERCENTS + 1))), F.lit(10_000))
            self._row = self._column.frame("c").agg(*(e.alias(n) for n, e in exprs.items())).first().asDict()
        except Exception as error:  # noqa: BLE001  told to whoever asks for a result
            self._error = error
        finally:
            spark.removeTag(self._group)
            self._done.set()

    def _get(self, name: str):
        self._done.wait()
        if self._error is not None:
            raise RuntimeError("the sketch was cancelled or failed") from self._error
        if name not in self._row:
            raise RuntimeError(f"a column of {self._column.kind.simpleString()} has no {name}")
        return self._row[name]

    def size(self) -> int:
        return self._get("size")

    def num_undefined(self) -> int:
        return self._get("missing")

    def num_unique(self) -> int:
        return self._get("unique")

    def min(self):
        return self._get("min")

    def max(self):
        return self._get("max")

    def sum(self):
        return self._get("sum")

    def mean(self) -> float:
        return 0.0 if self._get("mean") is None else self._get("mean")

    def var(self) -> float:
        return 0.0 if self._get("var") is None else self._get("var")

    def std(self) -> float:
        return self.var() ** 0.5

    def quantile(self, q: float):
        if not 0 <= q <= 1:
            raise ValueError("a quantile must be between 0 and 1")
        found = self._get("quantiles")
        return None if found is None else found[round(q * PERCENTS)]

    def frequent_items(self) -> dict:
        """The most frequent values that aren't null, with exact counts: a pre-aggregated count and a top-k."""
        if self._frequent is None:
            self._get("size")
            counts = self._column.frame("c").where("c is not null").groupBy("c").count()
            self._frequent = {r[0]: r[1] for r in counts.orderBy(F.desc("count"), "c").limit(ITEMS).collect()}
        return self._frequent

    def frequency_count(self, element) -> int:
        self._get("size")
        kind = self._column.kind
        return self._column.frame("c").where(F.col("c").eqNullSafe(K.literal(element, kind))).count()

    def element_length_summary(self, background: bool = False) -> Sketch:
        return Sketch(self._column.item_length(), background)

    def _exploded(self, expr, kind: T.DataType) -> Col:
        from millrace.operators.rows import Rows

        return Col(Rows(self._column.rows.df.select(F.explode(expr).alias("c"))), F.col("c"), kind)

    def element_summary(self, background: bool = False) -> Sketch:
        return Sketch(self._exploded(self._column.expr, self._column.kind.elementType), background)

    def dict_key_summary(self, background: bool = False) -> Sketch:
        return Sketch(self._exploded(F.map_keys(self._column.expr), self._column.kind.keyType), background)

    def dict_value_summary(self, background: bool = False) -> Sketch:
        return Sketch(self._exploded(F.map_values(self._column.expr), self._column.kind.valueType), background)

    def element_sub_sketch(self, keys=None) -> dict:
        """A sketch of the values of each key, or of each place."""
        wanted = self._keys if keys is None else keys if isinstance(keys, (list, tuple)) else [keys]
        c, kind = self._column, self._column.kind
        for k in wanted:
            if k not in self._subs:
                e = _value(c.expr, K.literal(k, kind.keyType)) if K.is_dict(kind) else F.get(c.expr, F.lit(k))
                self._subs[k] = Sketch(Col(c.rows, e, kind.valueType if K.is_dict(kind) else kind.elementType))
        return {k: self._subs[k] for k in wanted}

    def sketch_ready(self) -> bool:
        return self._done.is_set()

    def num_elements_processed(self) -> int:
        return self.size() if self.sketch_ready() else 0

    def cancel(self) -> None:
        self._column.rows.df.sparkSession.interruptTag(self._group)


class CountMin:
    """A table of hashed counts of a column's cells, built in one pass and of fixed size: estimates are never below the real count.

    With probability confidence an estimate is above by eps of all cells at most. Cells
    are whole numbers or text; nulls don't count.
    """

    def __init__(self, column: Col, eps: float = 0.001, confidence: float = 0.99, seed: int = 1):
        if not isinstance(column.kind, (T.LongType, T.StringType)):
            raise TypeError("cells must be whole numbers or text")
        df = column.frame("c").where("c is not null")
        found = df.agg(F.count_min_sketch("c", F.lit(eps), F.lit(confidence), F.lit(seed))).first()[0]
        self._sketch = None if found is None else df.sparkSession._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytes(found))

    def estimate(self, element) -> int:
        if self._sketch is None:
            return 0
        return self._sketch.estimateCount(element) if isinstance(element, str) else self._sketch.estimateCount(int(element))

    def density(self) -> float:
        """Cells counted, relative to the width of the table."""
        return 0.0 if self._sketch is None else self._sketch.totalCount() / self._sketch.width()
