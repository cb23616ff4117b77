"""Tables and their columns.

A Table is a set of Rows with named expressions over them. Editing columns only
changes the expressions; Spark sees one projection. A Col is an expression bound to
its rows: columns of the same rows combine as expressions, others by position.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core import types as K
from millrace.core.durable import cut
from millrace.core.deploy import ship
from millrace.functions import cells, dates, images as I, jsonio as J, semantics as S, text as X
from millrace.operators import group as G
from millrace.operators import windows as W
from millrace.operators.rows import RID, Rows, zipped

#: A literal list of at most so many values is a predicate that the scan can use; longer ones are joined.
_INLINE = 1000


def _fn(f: Callable, kind: T.DataType) -> Callable:
    def call(v):
        return K.converted(f(v), kind)

    return F.udf(call, kind, useArrow=True)


class Col:
    """An immutable column of one type in the order of its rows."""

    def __init__(self, rows: Rows, expr: Column, kind: T.DataType):
        self.rows, self.expr, self.kind = rows, expr, kind

    # sources ---------------------------------------------------------------
    @classmethod
    def of(cls, spark: SparkSession, values: Iterable, dtype=None, ignore_cast_failure: bool = False) -> Col:
        """A column of Python values; dtype None infers it."""
        values = list(values)
        kind = K.infer(values) if dtype is None else K.spark_type(dtype)
        if dtype in (list, dict):
            kind = K.infer(values)

        def one(v):
            try:
                return K.converted(v, kind)
            except (TypeError, ValueError):
                if ignore_cast_failure:
                    return None
                raise

        data = [(i, one(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(data, T.StructType([T.StructField(RID, T.LongType()), T.StructField("c", kind)]))
        return cls(Rows(df, [RID], True), F.col("c"), kind)

    @classmethod
    def from_const(cls, spark: SparkSession, value, size: int, dtype=None) -> Col:
        kind = K.spark_type(dtype) if dtype else K.infer([value])
        return cls(Rows(spark.range(size).toDF(RID), [RID], True), K.literal(value, kind), kind)

    @classmethod
    def from_sequence(cls, spark: SparkSession, start: int, stop: int | None = None) -> Col:
        """Whole numbers from start (0 if only one bound is given) up to, not with, stop."""
        start, stop = (0, start) if stop is None else (start, stop)
        return cls(Rows(spark.range(max(0, stop - start)).toDF(RID), [RID], True), F.col(RID) + start, K.INT)

    @classmethod
    def date_range(cls, spark: SparkSession, start, end, seconds: float) -> Col:
        """Times from start to end, both included, by a step in seconds."""
        n = int((end - start).total_seconds() // seconds) + 1
        step = F.col(RID) * int(round(seconds * 1e6))
        return cls(Rows(spark.range(max(0, n)).toDF(RID), [RID], True), F.timestamp_micros(F.unix_micros(F.lit(start)) + step), K.TIME)

    @classmethod
    def random_integers(cls, spark: SparkSession, size: int, seed: int = 0) -> Col:
        """Numbers that depend on the seed and the position only."""
        return cls(Rows(spark.range(size).toDF(RID), [RID], True), F.xxhash64(RID, F.lit(seed)), K.INT)

    @staticmethod
    def where(condition: Col, istrue, isfalse, dtype=None) -> Col:
        """istrue where the condition is true, else isfalse; a null condition is false."""
        rows, (m, a, b) = _aligned(condition, istrue, isfalse)
        if a[1].simpleString() != b[1].simpleString():
            if not (K.is_number(a[1]) and K.is_number(b[1])):
                raise TypeError("both choices must have one type")
            a, b = (a[0].cast("double"), K.FLOAT), (b[0].cast("double"), K.FLOAT)
        return Col(rows, S.where(*m, a[0], b[0]), a[1])

    # plumbing --------------------------------------------------------------
    def _with(self, expr: Column, kind: T.DataType) -> Col:
        return Col(self.rows, expr, kind)

    @property
    def dtype(self) -> type:
        return K.python_type(self.kind)

    def to_table(self, name: str = "X1") -> Table:
        return Table(self.rows, {name: (self.expr, self.kind)})

    def frame(self, name: str = "X1") -> DataFrame:
        return self.rows.df.select(self.expr.alias(name))

    def __len__(self) -> int:
        return self.rows.df.count()

    size = __len__

    def __iter__(self):
        return (r[0] for r in self.rows.sorted().select(self.expr).toLocalIterator())

    def to_list(self) -> list:
        return list(self)

    def to_numpy(self):
        import numpy as np

        return np.array(self.to_list())

    def __getitem__(self, at):
        """A position, a slice, or a mask."""
        if isinstance(at, Col):
            return self.to_table("c").filter(at)["c"]
        got = self.to_table("c")[at]
        return got["c"] if isinstance(got, Table) else None if got is None else got["c"]

    # scalar operators ------------------------------------------------------
    def _arith(self, op: str, other, turned: bool = False) -> Col:
        rows, (a, b) = _aligned(self, other)
        return Col(rows, *S.arithmetic(op, *(b + a if turned else a + b)))

    __add__, __radd__ = (lambda s, o: s._arith("+", o)), (lambda s, o: s._arith("+", o, True))
    __sub__, __rsub__ = (lambda s, o: s._arith("-", o)), (lambda s, o: s._arith("-", o, True))
    __mul__, __rmul__ = (lambda s, o: s._arith("*", o)), (lambda s, o: s._arith("*", o, True))
    __truediv__, __rtruediv__ = (lambda s, o: s._arith("/", o)), (lambda s, o: s._arith("/", o, True))
    __floordiv__, __rfloordiv__ = (lambda s, o: s._arith("//", o)), (lambda s, o: s._arith("//", o, True))
    __mod__, __rmod__ = (lambda s, o: s._arith("%", o)), (lambda s, o: s._arith("%", o, True))
    __pow__, __rpow__ = (lambda s, o: s._arith("**", o)), (lambda s, o: s._arith("**", o, True))

    def __neg__(self) -> Col:
        return self._with(S.negated(self.expr, self.kind), self.kind)

    def __pos__(self) -> Col:
        return self

    def __abs__(self) -> Col:
        return self._with(S.absolute(self.expr, self.kind), self.kind)

    def _compare(self, op: Callable, other) -> Col:
        rows, (a, b) = _aligned(self, other)
        return Col(rows, S.compare(op, *a, *b), K.INT)

    __lt__, __le__ = (lambda s, o: s._compare(operator.lt, o)), (lambda s, o: s._compare(operator.le, o))
    __gt__, __ge__ = (lambda s, o: s._compare(operator.gt, o)), (lambda s, o: s._compare(operator.ge, o))

    def __eq__(self, other) -> Col:
        rows, (a, b) = _aligned(self, other)
        return Col(rows, S.as_int(S.equal(*a, *b)), K.INT)

    def __ne__(self, other) -> Col:
        rows, (a, b) = _aligned(self, other)
        return Col(rows, S.as_int(~S.equal(*a, *b)), K.INT)

    __hash__ = None

    def __and__(self, other) -> Col:
        rows, (a, b) = _aligned(self, other)
        return Col(rows, S.both(*a, *b), K.INT)

    def __or__(self, other) -> Col:
        rows, (a, b) = _aligned(self, other)
        return Col(rows, S.either(*a, *b), K.INT)

    def contains(self, item) -> Col:
        return self._with(S.contains(self.expr, self.kind, item), K.INT)

    def is_in(self, values) -> Col:
        return self._with(S.is_in(self.expr, self.kind, values), K.INT)

    def clip(self, lower=None, upper=None) -> Col:
        return self._with(*S.clip(self.expr, self.kind, lower, upper))

    def clip_lower(self, threshold) -> Col:
        return self.clip(lower=threshold)

    def clip_upper(self, threshold) -> Col:
        return self.clip(upper=threshold)

    def astype(self, dtype, undefined_on_failure: bool = False) -> Col:
        kind = K.spark_type(dtype)
        return self._with(S.cast(self.expr, self.kind, kind, undefined_on_failure), kind)

    def hash(self, seed: int = 0) -> Col:
        return self._with(F.xxhash64(self.expr, F.lit(seed)), K.INT)

    def fillna(self, value) -> Col:
        return self._with(F.when(S.is_na(self.expr, self.kind), K.literal(value, self.kind)).otherwise(self.expr), self.kind)

    def item_length(self) -> Col:
        return self._with(F.size(self.expr).cast("long"), K.INT)

    def vector_slice(self, start: int, end: int | None = None) -> Col:
        """Elements from start up to, not with, end; null for cells too short; without end one element."""
        return self._with(*cells.vector_slice(self.expr, self.kind, start, end))

    def subslice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> Col:
        return self._with(cells.subslice(self.expr, self.kind, start, stop, step), self.kind)

    # text, dictionaries, times ----------------------------------------------
    def count_words(self, to_lower: bool = True, delimiters: Sequence[str] = ("\r", "\v", "\n", "\f", "\t", " ")) -> Col:
        return self._with(X.count_words(self.expr, to_lower, delimiters), T.MapType(K.STR, K.INT))

    def count_ngrams(self, n: int = 2, method: str = "word", to_lower: bool = True, ignore_space: bool = True) -> Col:
        ship(self.rows.df.sparkSession)
        return self._with(X.count_ngrams(self.expr, n, method, to_lower, ignore_space), T.MapType(K.STR, K.INT))

    def dict_keys(self) -> Col:
        return self._with(F.map_keys(self.expr), T.ArrayType(self.kind.keyType))

    def dict_values(self) -> Col:
        return self._with(F.map_values(self.expr), T.ArrayType(self.kind.valueType))

    def dict_trim_by_keys(self, keys: Sequence, exclude: bool = True) -> Col:
        return self._with(cells.trim_keys(self.expr, keys, exclude), self.kind)

    def dict_trim_by_values(self, lower=None, upper=None) -> Col:
        return self._with(cells.trim_values(self.expr, self.kind, lower, upper), self.kind)

    def dict_has_any_keys(self, keys: Sequence) -> Col:
        return self._with(cells.has_any(self.expr, keys), K.INT)

    def dict_has_all_keys(self, keys: Sequence) -> Col:
        return self._with(cells.has_all(self.expr, keys), K.INT)

    def str_to_datetime(self, format: str = "ISO") -> Col:
        return self._with(dates.parsed(self.expr, format), K.TIME)

    def datetime_to_str(self, format: str = "ISO") -> Col:
        return self._with(dates.written(self.expr, format), K.STR)

    def split_datetime(self, prefix: str = "X", limit: Sequence[str] | None = None, tzone: bool = False) -> Table:
        return Table(self.rows, dates.fields(self.expr, prefix, limit, tzone))

    def to_json(self) -> Col:
        """Each cell as JSON text."""
        return self._with(J.to_json(self.expr, self.kind), K.STR)

    def from_json(self, dtype) -> Col:
        """JSON text as cells of a type; null where it isn't one."""
        kind = K.spark_type(dtype)
        return self._with(J.from_json(self.expr, kind), kind)

    def pixel_array_to_image(self, width: int, height: int, channels: int) -> Col:
        return self._with(I.from_vector(self.expr, width, height, channels), I.IMAGE)

    def image_to_vector(self) -> Col:
        return self._with(I.to_vector(self.expr), K.VECTOR)

    def resize(self, width: int, height: int, channels: int | None = None) -> Col:
        ship(self.rows.df.sparkSession)
        return self._with(I.resized(self.expr, width, height, channels), I.IMAGE)

    # functions of Spark's and in Python --------------------------------------
    def call(self, f: Callable[..., Column], *others) -> Col:
        """f over the cells of this column and others, as an expression: a function of Spark's, or a registered one by F.call_function."""
        rows, parts = _aligned(self, *others)
        expr = f(*(e for e, _ in parts))
        found = rows.df.select(expr.alias("c")).schema["c"].dataType
        kind = K.standard_type(found)
        return Col(rows, expr if kind.simpleString() == found.simpleString() else expr.cast(kind), kind)

    def apply(self, fn: Callable, dtype=None, skip_undefined: bool = True) -> Col:
        """fn of each cell; its type is that of up to 100 results unless given."""
        ship(self.rows.df.sparkSession)
        if dtype is None:
            kind = K.infer(fn(r[0]) for r in self.rows.df.select(self.expr).where(self.expr.isNotNull()).limit(100).collect())
        else:
            kind = K.spark_type(dtype)
        call = _fn((lambda v: None if v is None else fn(v)) if skip_undefined else fn, kind)
        return self._with(call(self.expr), kind)

    def filter(self, fn: Callable, skip_undefined: bool = True) -> Col:
        keep = self.apply(lambda v: int(bool(fn(v))), int, skip_undefined)
        return self[keep]

    # rows ------------------------------------------------------------------
    def head(self, n: int = 10) -> Col:
        return self.to_table("c").head(n)["c"]

    def tail(self, n: int = 10) -> Col:
        return self.to_table("c").tail(n)["c"]

    def dropna(self) -> Col:
        return self.to_table("c").dropna()["c"]

    def append(self, other: Col) -> Col:
        return self.to_table("c").append(other.to_table("c"))["c"]

    def unique(self) -> Col:
        return self.to_table("c").unique()["c"]

    def sort(self, ascending: bool = True) -> Col:
        return self.to_table("c").sort("c", ascending)["c"]

    def sample(self, fraction: float, seed: int = 0) -> Col:
        return self.to_table("c").sample(fraction, seed)["c"]

    def topk_index(self, topk: int = 10, reverse: bool = False) -> Col:
        """1 for each of the topk largest (smallest if reverse) cells, earlier rows first, else 0."""
        rows = self.rows.by_number()
        value = F.when(~S.is_na(self.expr, self.kind), self.expr)
        best = rows.df.select(F.col(RID), value.alias("v")).where("v is not null").orderBy(F.asc("v") if reverse else F.desc("v"), RID).limit(topk).select(F.col(RID), F.lit(1).alias("__top"))
        marked = Rows(rows.df.join(best, RID, "left"), [RID], True, rows)
        return Col(marked, F.coalesce("__top", F.lit(0)).cast("long"), K.INT)

    def unpack(self, column_name_prefix: str = "X", column_types=None, na_value=None, limit: Sequence | None = None) -> Table:
        return Table(self.rows, cells.unpacked(self.rows.df, self.expr, self.kind, column_name_prefix, column_types, na_value, limit))

    # reductions ------------------------------------------------------------
    def _reduce(self, *exprs: Column):
        return self.rows.df.select(self.expr.alias("c")).agg(*exprs).first()

    def all(self) -> bool:
        return bool(self._reduce(F.coalesce(F.bool_and(S.truthy(F.col("c"), self.kind)), F.lit(True)))[0])

    def any(self) -> bool:
        return bool(self._reduce(F.coalesce(F.bool_or(S.truthy(F.col("c"), self.kind)), F.lit(False)))[0])

    def _extreme(self, f: Callable):
        if not (K.is_number(self.kind) or isinstance(self.kind, T.TimestampType)):
            raise TypeError("only numbers and times have extremes")
        return self._reduce(f(G._numbers(F.col("c"), self.kind)))[0]

    def max(self):
        return self._extreme(F.max)

    def min(self):
        return self._extreme(F.min)

    def _vectors(self, mean: bool):
        got = G.grouped(self.rows.df.select(self.expr.alias("c")), [], {"v": (G.AVG if mean else G.SUM)("c")}, {"c": self.kind}, []).collect()
        return got[0].v if got else None

    def sum(self):
        if K.is_vector(self.kind):
            return self._vectors(False)
        return self._reduce(F.coalesce(F.sum("c"), F.lit(0).cast(self.kind)))[0]

    def mean(self):
        return self._vectors(True) if K.is_vector(self.kind) else self._reduce(F.avg("c"))[0]

    def var(self, ddof: int = 0):
        n, rows, v = self._reduce(F.count("c"), F.count(F.lit(1)), F.var_pop("c"))
        if ddof >= rows:
            raise ValueError("ddof must be less than the length")
        return None if not n else v * n / (n - ddof)

    def std(self, ddof: int = 0):
        v = self.var(ddof)
        return None if v is None else v**0.5

    def _arg(self, largest: bool):
        """The place of the best cell: with an order, a top-1 and then a count of the rows before it; else by number."""
        value = G._numbers(self.expr, self.kind).alias("v")
        if not self.rows.order:
            rows = Rows(self.rows.df.select(value)).by_number()
            t = rows.df.where("v is not null").orderBy(F.desc("v") if largest else F.asc("v"), RID).first()
            return None if t is None else t[RID]
        cells = self.rows.df.select(F.struct(*self.rows.order).alias("at"), value)
        best = cells.where("v is not null").orderBy(F.desc("v") if largest else F.asc("v"), "at").limit(1).select("at")
        before, known = cells.agg(F.count_if(F.col("at") < best.scalar()), F.count("v")).first()
        return before if known else None

    def argmax(self):
        return self._arg(True)

    def argmin(self):
        return self._arg(False)

    def num_missing(self) -> int:
        return self._reduce(F.count_if(F.col("c").isNull()))[0]

    def nnz(self) -> int:
        return self._reduce(F.count_if(S.truthy(F.col("c"), self.kind)))[0]

    def sketch_summary(self, background: bool = False, sub_sketch_keys: Sequence | None = None):
        from millrace.streaming.sketch import Sketch

        return Sketch(self, background, sub_sketch_keys)

    # windows over row order -------------------------------------------------
    def _rolling(self, how: str, start: int, end: int, least: int | None, kind: T.DataType) -> Col:
        vector = K.is_vector(self.kind)
        if how != "count" and not K.is_number(self.kind) and not (vector and how in ("sum", "mean")) and not (isinstance(self.kind, T.TimestampType) and how in ("min", "max")):
            raise TypeError(f"rolling {how} isn't defined for {self.kind.simpleString()}")
        name = f"__w{next(_fresh)}"
        rows = self.rows.by_number()
        df = W.rolling(rows.df, self.expr, name, how, start, end, least, vector and how != "count")
        return Col(Rows(df, [RID], True, rows), F.col(name).cast(kind), kind)

    def rolling_mean(self, window_start: int, window_end: int, min_observations: int | None = None) -> Col:
        return self._rolling("mean", window_start, window_end, min_observations, self.kind if K.is_vector(self.kind) else K.FLOAT)

    def rolling_sum(self, window_start: int, window_end: int, min_observations: int | None = None) -> Col:
        return self._rolling("sum", window_start, window_end, min_observations, self.kind)

    def rolling_max(self, window_start: int, window_end: int, min_observations: int | None = None) -> Col:
        return self._rolling("max", window_start, window_end, min_observations, self.kind)

    def rolling_min(self, window_start: int, window_end: int, min_observations: int | None = None) -> Col:
        return self._rolling("min", window_start, window_end, min_observations, self.kind)

    def rolling_var(self, window_start: int, window_end: int, min_observations: int | None = None) -> Col:
        return self._rolling("var", window_start, window_end, min_observations, K.FLOAT)

    def rolling_stdv(self, window_start: int, window_end: int, min_observations: int | None = None) -> Col:
        return self._rolling("stdv", window_start, window_end, min_observations, K.FLOAT)

    def rolling_count(self, window_start: int, window_end: int) -> Col:
        return self._rolling("count", window_start, window_end, 0, K.INT)

    def _running(self, how: str, kind: T.DataType) -> Col:
        name = f"__w{next(_fresh)}"
        rows = self.rows.by_number()
        f = W.running_vectors if K.is_vector(self.kind) else W.running
        return Col(Rows(f(rows.df, self.expr, name, how), [RID], True, rows), F.col(name).cast(kind), kind)

    def cumulative_sum(self) -> Col:
        return self._running("sum", self.kind)

    def cumulative_mean(self) -> Col:
        return self._running("mean", self.kind if K.is_vector(self.kind) else K.FLOAT)

    def cumulative_min(self) -> Col:
        return self._running("min", self.kind)

    def cumulative_max(self) -> Col:
        return self._running("max", self.kind)

    def cumulative_var(self) -> Col:
        return self._running("var", K.FLOAT)

    def cumulative_std(self) -> Col:
        return self._running("stdv", K.FLOAT)

    def save(self, path: str, format: str = "binary") -> None:
        from millrace.sources import sinks

        sinks.save_column(self, path, format)


_fresh = itertools.count()


def _aligned(first: Col, *others) -> tuple[Rows, list[tuple[Column, T.DataType]]]:
    """Columns and constants over common rows: by expression where the rows allow it, else by position."""
    rows, out = first.rows, [(first.expr, first.kind)]
    for o in others:
        if not isinstance(o, Col):
            kind = K.infer([o]) if o is not None else out[0][1]
            out.append((K.literal(o, kind), kind))
        elif rows.extends(o.rows):
            out.append((o.expr, o.kind))
        elif o.rows.extends(rows):
            rows = o.rows
            out.append((o.expr, o.kind))
        else:
            named = Rows(o.rows.numbered().select(RID, o.expr.alias("c")), [RID], True, o.rows)
            rows, names = zipped(rows, named)
            out.append((names["c"], o.kind))
    return rows, out


class Table:
    """Named columns of equal length over ordered rows. Editing methods change the table and return it."""

    def __init__(self, rows: Rows, columns: dict[str, tuple[Column, T.DataType]]):
        self.rows, self._columns = rows, dict(columns)

    # sources ---------------------------------------------------------------
    @classmethod
    def from_spark(cls, df: DataFrame, order: str | Sequence[str] | None = None) -> Table:
        """A DataFrame as a table; order names columns that give the order of rows."""
        df = K.standardised(df)
        names = [order] if isinstance(order, str) else list(order or [])
        columns = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
        keyed = df.withColumns({f"__o{k}": F.col(f"`{n}`") for k, n in enumerate(names)}) if names else df
        return cls(Rows(keyed, [f"__o{k}" for k in range(len(names))]), columns)

    @classmethod
    def of(cls, spark: SparkSession, data: dict[str, Iterable] | Sequence[dict] | None = None) -> Table:
        """A table of Python values: columns by name, rows as dictionaries, or a pandas DataFrame."""
        if hasattr(data, "itertuples"):
            data = {str(n): [None if v is None or str(v) in ("NaT", "<NA>") else v for v in data[n].tolist()] for n in data.columns}
        if not data:
            return cls(Rows(spark.range(0).toDF(RID), [RID], True), {})
        if not isinstance(data, dict):
            names = list(dict.fromkeys(k for row in data for k in row))
            data = {n: [row.get(n) for row in data] for n in names}
        values = {n: list(v) for n, v in data.items()}
        if len({len(v) for v in values.values()}) > 1:
            raise RuntimeError("columns have different lengths")
        return cls.of_rows(spark, list(values), [K.infer(v) for v in values.values()], zip(*values.values()))

    @classmethod
    def of_rows(cls, spark: SparkSession, names: Sequence[str], kinds: Sequence[T.DataType], rows: Iterable[Sequence], start: int = 0) -> Table:
        """A table of Python rows, numbered from start on."""
        data = [(i, *(K.converted(x, k) for x, k in zip(r, kinds))) for i, r in enumerate(rows, start)]
        schema = T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(f"c{i}", k) for i, k in enumerate(kinds))])
        return cls(Rows(spark.createDataFrame(data, schema), [RID], True), {n: (F.col(f"c{i}"), k) for i, (n, k) in enumerate(zip(names, kinds))})

    # plumbing --------------------------------------------------------------
    @property
    def spark(self) -> SparkSession:
        return self.rows.df.sparkSession

    def frame(self) -> DataFrame:
        """The table as a DataFrame; to_spark() under a shorter name."""
        return self.rows.df.select(*(e.alias(n) for n, (e, _) in self._columns.items()))

    to_spark = frame

    def _plain(self, numbered: bool = False) -> tuple[DataFrame, list[str]]:
        """A DataFrame of this table's columns by name with its order columns, and their names."""
        rows = self.rows.by_number() if numbered else self.rows
        return rows.df.select(*(e.alias(n) for n, (e, _) in self._columns.items()), *(F.col(o) for o in rows.order)), rows.order

    def _settled(self, df: DataFrame, order: list[str], dense: bool = False, kinds: dict[str, T.DataType] | None = None) -> Table:
        kinds = kinds or {f.name: f.dataType for f in df.schema if f.name not in order}
        return Table(Rows(df, order, dense), {n: (F.col(f"`{n}`"), k) for n, k in kinds.items()})

    @property
    def kinds(self) -> dict[str, T.DataType]:
        return {n: k for n, (_, k) in self._columns.items()}

    def column_names(self) -> list[str]:
        return list(self._columns)

    def column_types(self) -> list[type]:
        return [K.python_type(k) for k in self.kinds.values()]

    def num_columns(self) -> int:
        return len(self._columns)

    def num_rows(self) -> int:
        return self.rows.df.count() if self._columns else 0

    __len__ = num_rows

    @property
    def shape(self) -> tuple[int, int]:
        return self.num_rows(), self.num_columns()

    def materialize(self) -> Table:
        """Compute the table once, into a checkpoint."""
        df, order = self._plain()
        done = self._settled(cut(df), order, self.rows.dense, self.kinds)
        self.rows, self._columns = done.rows, done._columns
        self._done = True
        return self

    def is_materialized(self) -> bool:
        return getattr(self, "_done", False)

    def query_plan(self) -> str:
        return self.frame()._jdf.queryExecution().toString()

    def copy(self) -> Table:
        return Table(self.rows, self._columns)

    __copy__ = copy

    def __deepcopy__(self, _) -> Table:
        return self.copy()

    def __iter__(self):
        df, order = self._plain()
        names = self.column_names()
        return (dict(zip(names, r)) for r in (df.orderBy(*order) if order else df).toLocalIterator())

    def to_pandas(self):
        df, order = self._plain()
        return (df.orderBy(*order) if order else df).drop(*order).toPandas()

    to_dataframe = to_pandas

    def to_numpy(self):
        return self.to_pandas().to_numpy()

    def to_rdd(self):
        return self.frame().rdd

    def print_rows(self, num_rows: int = 10) -> None:
        self.head(num_rows).frame().show(num_rows)

    # projection and editing -----------------------------------------------
    def select_column(self, name: str) -> Col:
        if name not in self._columns:
            raise KeyError(name)
        return Col(self.rows, *self._columns[name])

    def select_columns(self, wanted: Sequence) -> Table:
        """Columns by name and by type, in the order asked for, each once."""
        names: list[str] = []
        for w in wanted:
            hits = [n for n, k in self.kinds.items() if K.python_type(k) is w] if isinstance(w, type) else [w]
            names += [n for n in hits if n not in names]
        return Table(self.rows, {n: self._columns[n] for n in names})

    def __getitem__(self, at):
        if isinstance(at, str):
            return self.select_column(at)
        if isinstance(at, Col):
            return self.filter(at)
        if isinstance(at, type):
            return self.select_columns([at])
        if isinstance(at, slice):
            return self._slice(at)
        if isinstance(at, int):
            n = at if at >= 0 else self.num_rows() + at
            rows = list(self._slice(slice(n, n + 1))) if n >= 0 else []
            if not rows:
                raise IndexError("no such row")
            return rows[0]
        return self.select_columns(list(at))

    def _slice(self, s: slice) -> Table:
        df, order = self._plain(numbered=True)
        start, stop, step = s.start, s.stop, s.step or 1
        if step < 1:
            raise ValueError("a step must be positive")
        if (start or 0) < 0 or (stop or 0) < 0:
            n = df.count()
            start, stop = (max(0, n + x) if x is not None and x < 0 else x for x in (start, stop))
        start = start or 0
        keep = (F.col(RID) >= start) & ((F.col(RID) - start) % step == 0)
        if stop is not None:
            keep = keep & (F.col(RID) < stop)
        return self._settled(df.where(keep), order, kinds=self.kinds)

    def add_column(self, data, name: str | None = None) -> Table:
        """Append or replace a column: one of these rows, another of equal length, values, or a constant."""
        name = name or next(n for k in itertools.count(len(self._columns) + 1) if (n := f"X{k}") not in self._columns)
        if not isinstance(data, (Col, str, dict)) and isinstance(data, Iterable) and self._columns:
            data = Col.of(self.spark, data)
        if not isinstance(data, Col):
            kind = K.infer([data])
            self._columns[name] = (K.literal(data, kind), kind)
        elif not self._columns or self.rows.extends(data.rows):
            self.rows = self.rows if self._columns else data.rows
            self._columns[name] = (data.expr, data.kind)
        elif data.rows.extends(self.rows):
            self.rows = data.rows
            self._columns[name] = (data.expr, data.kind)
        else:
            rows, (_, got) = _aligned(Col(self.rows, F.lit(1), K.INT), data)
            self.rows = rows
            self._columns[name] = got
        return self

    __setitem__ = lambda self, name, data: self.add_column(data, name) and None

    def add_columns(self, data, names: Sequence[str] | None = None) -> Table:
        pairs = [(n, data[n]) for n in data.column_names()] if isinstance(data, Table) else list(zip(names or [], data))
        if isinstance(data, Table) and (clash := set(data._columns) & set(self._columns)):
            raise RuntimeError(f"columns exist already: {sorted(clash)}")
        for n, c in pairs:
            self.add_column(c, n)
        return self

    def remove_column(self, name: str) -> Table:
        del self._columns[name]
        return self

    def remove_columns(self, names: Iterable[str]) -> Table:
        for n in list(names):
            self.remove_column(n)
        return self

    __delitem__ = lambda self, name: self.remove_column(name) and None

    def swap_columns(self, a: str, b: str) -> Table:
        names = [{a: b, b: a}.get(n, n) for n in self._columns]
        self._columns = {n: self._columns[n] for n in names}
        return self

    def rename(self, names: dict[str, str]) -> Table:
        if missing := set(names) - set(self._columns):
            raise KeyError(sorted(missing))
        self._columns = {names.get(n, n): c for n, c in self._columns.items()}
        return self

    # filters ---------------------------------------------------------------
    def filter(self, mask: Col) -> Table:
        """Rows where the mask is true; it may be of any type."""
        rows, (one, m) = _aligned(Col(self.rows, F.lit(1), K.INT), mask)
        t = Table(rows, self._columns)
        df = rows.df.where(S.truthy(*m)).select(*(e.alias(n) for n, (e, _) in t._columns.items()), *(F.col(o) for o in rows.order))
        return self._settled(df, rows.order, kinds=self.kinds)

    def filter_by(self, values, column_name: str, exclude: bool = False) -> Table:
        """Rows whose cell is, or with exclude isn't, one of the values."""
        expr, kind = self._columns[column_name]
        df, order = self._plain()
        if not isinstance(values, Col):
            values = list(values) if isinstance(values, (list, tuple, set)) else [values]
            if len(values) <= _INLINE:
                found = S.is_in(F.col(f"`{column_name}`"), kind, values) == 1
                return self._settled(df.where(~found if exclude else found), order, kinds=self.kinds)
            values = Col.of(self.spark, values, kind)
        if values.kind.simpleString() != kind.simpleString():
            raise TypeError("values must have the column's type")
        right = values.frame("__v").distinct()
        out = df.join(right, F.col(f"`{column_name}`").eqNullSafe(F.col("__v")), "left_anti" if exclude else "left_semi")
        return self._settled(out, order, kinds=self.kinds)

    def _na(self, columns, how: str) -> Column:
        if how not in ("any", "all"):
            raise ValueError("how must be 'any' or 'all'")
        names = self.column_names() if columns is None else [columns] if isinstance(columns, str) else list(columns)
        found = [S.is_na(*self._columns[n]) for n in names]
        if not found:
            return F.lit(False)
        out = found[0]
        for f in found[1:]:
            out = out | f if how == "any" else out & f
        return out

    def dropna(self, columns=None, how: str = "any") -> Table:
        """Rows without null or NaN in any, or not in all, of the columns; an empty list of columns drops nothing."""
        return self.dropna_split(columns, how)[0]

    def dropna_split(self, columns=None, how: str = "any") -> tuple[Table, Table]:
        drop = S.as_int(self._na(columns, how))
        return self.filter(Col(self.rows, 1 - drop, K.INT)), self.filter(Col(self.rows, drop, K.INT))

    def fillna(self, column: str, value) -> Table:
        out = self.copy()
        c = out[column].fillna(value)
        out._columns[column] = (c.expr, c.kind)
        return out

    def head(self, n: int = 10) -> Table:
        df, order = self._plain()
        return self._settled((df.orderBy(*order) if order else df).limit(n), order, kinds=self.kinds)

    def tail(self, n: int = 10) -> Table:
        df, order = self._plain(numbered=not self.rows.order)
        return self._settled(df.orderBy(*(F.desc(o) for o in order)).limit(n), order, kinds=self.kinds)

    def add_row_number(self, column_name: str = "id", start: int = 0) -> Table:
        """The position of each row, from start, as first column."""
        if column_name in self._columns:
            raise RuntimeError("the column exists already")
        rows = self.rows.by_number()
        return Table(rows, {column_name: (F.col(RID) + start, K.INT), **self._columns})

    def _lot(self, fraction: float, seed: int) -> tuple[Table, Column]:
        """A row is in the lot if a hash of its place in the order, or else of its number, and the seed is small enough."""
        if not 0 <= fraction <= 1:
            raise ValueError("a fraction is between 0 and 1")
        rows = self.rows if self.rows.order else self.rows.by_number()
        lot = F.pmod(F.xxhash64(*rows.order, F.lit(seed)), F.lit(1 << 30)) < int(fraction * (1 << 30))
        return Table(rows, self._columns), lot

    def sample(self, fraction: float, seed: int = 0) -> Table:
        t, lot = self._lot(fraction, seed)
        return t.filter(Col(t.rows, S.as_int(lot), K.INT))

    def random_split(self, fraction: float, seed: int = 0) -> tuple[Table, Table]:
        t, lot = self._lot(fraction, seed)
        return t.filter(Col(t.rows, S.as_int(lot), K.INT)), t.filter(Col(t.rows, S.as_int(~lot), K.INT))

    def topk(self, column_name: str, k: int = 10, reverse: bool = False) -> Table:
        """The k rows with the largest (smallest if reverse) cells, sorted by them; null and NaN aren't ranked."""
        df, order = self._plain()
        c = F.col(f"`{column_name}`")
        keys = [F.asc(c) if reverse else F.desc(c)]
        best = df.where(~S.is_na(c, self.kinds[column_name])).orderBy(*keys, *order).limit(k)
        return Table.from_sorted(best.drop(*order), [(column_name, reverse)], self.kinds)

    @classmethod
    def from_sorted(cls, df: DataFrame, by: Sequence[tuple[str, bool]], kinds: dict[str, T.DataType]) -> Table:
        """A table in the order of some of its columns."""
        keyed, order = df, []
        for k, (name, ascending) in enumerate(by):
            c = F.col(f"`{name}`")
            if not ascending:  # hidden keys are sorted up: a descending one is turned about
                rank = F.struct(c.isNull().alias("n"), _turned(c, kinds[name]).alias("v"))
            else:
                rank = c
            keyed = keyed.withColumn(f"__o{k}", rank)
            order.append(f"__o{k}")
        return cls(Rows(keyed, order), {n: (F.col(f"`{n}`"), kind) for n, kind in kinds.items()})

    def sort(self, key_columns, ascending: bool = True) -> Table:
        """Rows in order of columns: a name, names, or (name, ascending) pairs. Nulls are first in ascending order."""
        keys = [key_columns] if isinstance(key_columns, (str, tuple)) else list(key_columns)
        by = [k if isinstance(k, tuple) else (k, ascending) for k in keys]
        for name, _ in by:
            if isinstance(self.kinds[name], (T.ArrayType, T.MapType)):
                raise TypeError(f"{name} has no order")
        df, order = self._plain()
        return Table.from_sorted(df.drop(*order), by, self.kinds)

    # several tables ----------------------------------------------------------
    def append(self, other: Table) -> Table:
        """The rows of this table, then those of the other; same names and types."""
        if not self._columns or not other._columns:
            return (other if not self._columns else self).copy()
        if set(self._columns) != set(other._columns):
            raise RuntimeError("column names differ")
        for n, k in self.kinds.items():
            if k.simpleString() != other.kinds[n].simpleString():
                raise RuntimeError(f"types of {n} differ")
        parts = []
        same = [f.dataType.simpleString() for f in self._plain()[0].schema[len(self._columns):]] == [f.dataType.simpleString() for f in other._plain()[0].schema[len(self._columns):]]
        for side, t in enumerate((self, other.select_columns(self.column_names()))):
            df, order = t._plain(numbered=not same or not t.rows.order)
            parts.append(df.select(*(f"`{n}`" for n in self._columns), F.lit(side).alias("__side"), *(F.col(o).alias(f"__s{k}") for k, o in enumerate(order))))
        order = parts[0].columns[len(self._columns):]
        return self._settled(parts[0].unionByName(parts[1]), order, kinds=self.kinds)

    def unique(self) -> Table:
        return self._settled(self.frame().distinct(), [], kinds=self.kinds) if not any(K.is_dict(k) for k in self.kinds.values()) else self._unique_cells()

    def _unique_cells(self) -> Table:
        df = self.frame()
        keys = [F.to_json(F.array_sort(F.map_entries(f"`{n}`"))) if K.is_dict(k) else F.col(f"`{n}`") for n, k in self.kinds.items()]
        first = df.groupBy(*(e.alias(f"__k{i}") for i, e in enumerate(keys))).agg(*(F.first(f"`{n}`").alias(n) for n in self._columns))
        return self._settled(first.select(*(f"`{n}`" for n in self._columns)), [], kinds=self.kinds)

    def join(self, right: Table, on=None, how: str = "inner") -> Table:
        """Equi-join; null keys match null keys. on: common names by default, a name, names, or left: right names."""
        from millrace.operators.join import joined

        df, kinds = joined(self.frame(), self.kinds, right.frame(), right.kinds, on, how)
        return self._settled(df, [], kinds=kinds)

    def groupby(self, key_columns, operations=None, *more) -> Table:
        keys = [key_columns] if isinstance(key_columns, str) else list(key_columns)
        aggs = G.named([a for a in ([operations] if operations is not None else []) + list(more)])
        for a in aggs.values():
            for c in a.columns:
                if c not in self._columns:
                    raise KeyError(c)
        df, order = self._plain()
        return self._settled(G.grouped(df, keys, aggs, self.kinds, order), [])

    def join_groupby(self, right: Table, on, operations) -> Table:
        """The rows of join(right, on).groupby(left keys, operations), but for rounding, without the pairs of a key's rows.

        Each side is grouped by the keys first, so a key with a rows on the left and b on the right
        takes a + b steps, not a times b. Each of a side's rows would be repeated as often as the
        other side has the key: sums and counts are multiplied by that, what G.EVEN lists stays.
        Operations are over columns by their names in the join; others than these need the join itself.
        """
        from millrace.operators.join import key_pairs, right_names

        pairs = key_pairs(self.kinds, right.kinds, on)
        of_right = {new: n for n, new in right_names(self.kinds, right.kinds, pairs).items()}
        found: tuple[dict[str, G.Agg], dict[str, G.Agg]] = {"__rows0": G.COUNT()}, {"__rows1": G.COUNT()}
        aggs, sides = G.named(operations), {}
        for k, (name, a) in enumerate(aggs.items()):
            if a.op == "Count":
                continue
            c = a.columns[0]
            if c not in self.kinds and c not in of_right:
                raise KeyError(c)
            sides[name] = side = int(c in of_right)
            kind = right.kinds[of_right[c]] if side else self.kinds[c]
            if a.op not in G.EVEN and a.op not in ("Sum", "NonnullCount") or a.op == "Sum" and not K.is_number(kind):
                raise ValueError(f"{a.op} of {c} needs the joined rows: join, then group")
            found[side][f"__{k}"] = G.Agg(a.op, (of_right.get(c, c),), a.extra)
        both = self.groupby(list(pairs), found[0]).join(right.groupby(list(dict.fromkeys(pairs.values())), found[1]), on=pairs)
        out = both[list(pairs)]
        for k, (name, a) in enumerate(aggs.items()):
            if a.op == "Count":
                out[name] = both["__rows0"] * both["__rows1"]
            else:
                out[name] = both[f"__{k}"] if a.op in G.EVEN else both[f"__{k}"] * both[f"__rows{1 - sides[name]}"]
        return out

    def group(self, key_columns):
        """The groups of rows with equal keys, each a table when asked for."""
        from millrace.operators.dataflow import Groups

        return Groups(self, [key_columns] if isinstance(key_columns, str) else list(key_columns))

    # reshape ------------------------------------------------------------------
    def pack_columns(self, columns=None, column_prefix: str | None = None, dtype: type = list, fill_na=None, remove_prefix: bool = True, new_column_name: str | None = None) -> Table:
        """Columns, or those whose names begin with a prefix, as one list, vector or dictionary."""
        names = [n for n in self._columns if column_prefix is None or n.startswith(column_prefix)] if columns is None else list(columns)
        keys = {n: n[len(column_prefix):].lstrip(".") if column_prefix and remove_prefix else n for n in names}
        expr, kind = cells.packed({n: self._columns[n] for n in names}, keys, dtype, fill_na)
        rest = {n: c for n, c in self._columns.items() if n not in names}
        name = new_column_name or column_prefix or next(n for k in itertools.count(len(rest) + 1) if (n := f"X{k}") not in rest)
        return Table(self.rows, {**rest, name: (expr, kind)})

    def _free(self, found: dict[str, tuple], without: str) -> dict[str, tuple]:
        rest = set(self._columns) - {without}
        while rest & set(found):
            found = {f"{n}.1": c for n, c in found.items()}
        return found

    def unpack(self, column: str, column_name_prefix: str | None = None, column_types=None, na_value=None, limit: Sequence | None = None) -> Table:
        """A list, vector or dictionary column as one column for each element or key."""
        prefix = column if column_name_prefix is None else column_name_prefix
        found = self[column].unpack(prefix, column_types, na_value, limit)._columns
        rest = {n: c for n, c in self._columns.items() if n != column}
        return Table(self.rows, {**rest, **self._free(found, column)})

    def split_datetime(self, column: str, prefix: str | None = None, limit: Sequence[str] | None = None, tzone: bool = False) -> Table:
        found = dates.fields(self._columns[column][0], column if prefix is None else prefix, limit, tzone)
        rest = {n: c for n, c in self._columns.items() if n != column}
        return Table(self.rows, {**rest, **self._free(found, column)})

    def stack(self, column: str, new_column_name=None, drop_na: bool = False) -> Table:
        """A row for each element, or key and value; null and empty cells give one row of null, or none with drop_na."""
        kind = self.kinds[column]
        n = 2 if K.is_dict(kind) else 1
        names = [new_column_name] if isinstance(new_column_name, str) else list(new_column_name or [])
        rest = [c for c in self._columns if c != column]
        names = names or [f"X{len(rest) + k + 1}" for k in range(n)]
        df, order = self._plain()
        f = F.posexplode if drop_na else F.posexplode_outer
        out = df.select(*(f"`{c}`" for c in rest), *order, f(f"`{column}`").alias("__at", *names))
        kinds = {c: self.kinds[c] for c in rest} | dict(zip(names, (kind.keyType, kind.valueType) if n == 2 else (kind.elementType,)))
        if drop_na and n == 1:
            out = out.where(~S.is_na(F.col(f"`{names[0]}`"), kinds[names[0]]))
        return self._settled(out, [*order, "__at"] if order else [], kinds=kinds)

    def unstack(self, column, new_column_name: str | None = None) -> Table:
        """Rows with equal other columns as one row with a list, or with a dictionary of two columns."""
        names = [column] if isinstance(column, str) else list(column)
        keys = [n for n in self._columns if n not in names]
        return self.groupby(keys, {new_column_name or next(n for k in itertools.count(len(keys) + 1) if (n := f"X{k}") not in keys): G.CONCAT(*names)})

    # functions in Python ---------------------------------------------------
    def apply(self, fn: Callable, dtype=None) -> Col:
        """fn of each row as a dictionary."""
        ship(self.spark)
        names = self.column_names()
        row = F.struct(*(e.alias(f"c{i}") for i, (e, _) in enumerate(self._columns.values())))
        call = lambda r: fn(dict(zip(names, r)))
        kind = K.infer(call(r[0]) for r in self.rows.df.select(row).limit(100).collect()) if dtype is None else K.spark_type(dtype)
        return Col(self.rows, _fn(call, kind)(row), kind)

    def flat_map(self, column_names: Sequence[str], fn: Callable, column_types: Sequence | str = "auto") -> Table:
        """The rows that fn gives for each row; None gives none."""
        ship(self.spark)
        names, own = list(column_names), self.column_names()
        row = F.struct(*(e.alias(f"c{i}") for i, (e, _) in enumerate(self._columns.values())))
        call = lambda r: fn(dict(zip(own, r))) or []
        if column_types == "auto":
            first = [out for r in self.rows.df.select(row).limit(10).collect() for out in call(r[0])]
            kinds = [K.infer(c) for c in zip(*first)] if first else [K.STR] * len(names)
        else:
            kinds = [K.spark_type(t) for t in column_types]
        inner = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])
        many = F.udf(lambda r: [tuple(K.converted(x, k) for x, k in zip(out, kinds)) for out in call(r)], T.ArrayType(inner), useArrow=True)
        df = self.rows.df.select(*self.rows.order, F.posexplode(many(row)).alias("__at", "__out"))
        out = df.select(*self.rows.order, "__at", *(F.col(f"__out.c{i}").alias(n) for i, n in enumerate(names)))
        return self._settled(out, [*self.rows.order, "__at"] if self.rows.order else [], kinds=dict(zip(names, kinds)))

    def save(self, path: str, format: str | None = None) -> None:
        from millrace.sources import sinks

        sinks.save(self, path, format)

    def save_reference(self, path: str) -> None:
        from millrace.sources import sinks

        sinks.save_reference(self, path)

    def export_csv(self, path: str, **settings) -> None:
        from millrace.sources import sinks

        sinks.export_csv(self, path, **settings)

    def export_json(self, path: str, orient: str = "records") -> None:
        from millrace.sources import sinks

        sinks.export_json(self, path, orient)

    def to_sql(self, connection, table: str, **settings) -> None:
        from millrace.sources import sinks

        sinks.to_sql(self, connection, table, **settings)


def _turned(c: Column, kind: T.DataType) -> Column:
    """A key whose ascending order is the descending one of c."""
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(kind, T.StringType):
        flipped = F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210")
        return F.concat(flipped, F.lit("~"))
    return -c
