"""Tables and columns from files, databases and generators."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core import types as K
from millrace.core.deploy import ship
from millrace.core.durable import ensure_checkpoint_dir
from millrace.functions.literals import parse
from millrace.operators.rows import RID, Rows
from millrace.table import Col, Table

_BAD = "__bad"


def _unique(names: Sequence[str]) -> list[str]:
    """Names with .1, .2 and so on after those that came before; X1, X2 for empty ones."""
    out: list[str] = []
    for i, n in enumerate(names):
        n, k, given = n or f"X{i + 1}", 1, n or f"X{i + 1}"
        while n in out:
            n, k = f"{given}.{k}", k + 1
        out.append(n)
    return out


_ORDER = ["__file", "__block", "__line"]


def _placed(df: DataFrame) -> DataFrame:
    """Rows of text files with their file, where their part of it begins, and a number that grows along the part."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))


def _without_first(lines: DataFrame, skip: int) -> DataFrame:
    """Placed lines without the first so many of each file, whatever they hold.

    Parts of files are counted first, so a file's first lines are told by number even
    where they run over several parts; it costs one more look at the lines.
    """
    parts = lines.groupBy("__file", "__block").agg(F.min("__line").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = parts.withColumn("__before", before).where(F.col("__before") < skip).select("__file", "__block", (F.col("__first") + skip - F.col("__before")).alias("__from"))
    return lines.join(cuts, ["__file", "__block"], "left").where(F.col("__from").isNull() | (F.col("__line") >= F.col("__from"))).drop("__from")


def _csv(spark, url, delimiter, header, comment_char, escape_char, double_quote, quote_char, skip_initial_space, column_type_hints, na_values, line_terminator, usecols, nrows, skiprows, nrows_to_infer):
    """(table, bad lines with their files): every cell is read as text and parsed by the type of its column.

    skiprows lines and then the header are taken off each file by position.
    """
    ship(spark)
    options = {"sep": delimiter, "quote": quote_char or "", "escape": quote_char if double_quote and not escape_char else escape_char or "\\", "ignoreLeadingWhiteSpace": skip_initial_space, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "emptyValue": "", "nullValue": "\0"}
    if comment_char:
        options["comment"] = comment_char
    if line_terminator not in ("\n", "\r\n", "\r", None):
        options["lineSep"] = line_terminator
    text = spark.read.options(recursiveFileLookup=True, **({"lineSep": options["lineSep"]} if "lineSep" in options else {}))
    files = sorted(text.text(url).inputFiles())
    wanted = skiprows + 1 + nrows_to_infer
    top = [r[0].rstrip("\r") for r in text.text(files[0]).limit(wanted + (nrows_to_infer if comment_char else 0)).collect()][skiprows:] if files else []
    top = [x for x in top if x.strip() and not (comment_char and x.startswith(comment_char))]
    split = lambda x: next(csv.reader([x], delimiter=delimiter, quotechar=quote_char or None, doublequote=double_quote, escapechar=escape_char or None, skipinitialspace=skip_initial_space, quoting=csv.QUOTE_MINIMAL if quote_char else csv.QUOTE_NONE), [])
    first = split(top[0]) if top else []
    width = len(first)
    names = _unique(first if header else [""] * width)
    schema = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(width)), T.StructField(_BAD, T.StringType())])
    if skiprows:
        lines = _without_first(_placed(text.text(url)), skiprows).where(F.length(F.trim("value")) > 0)
        if comment_char:
            lines = lines.where(~F.col("value").startswith(comment_char))
        if header:  # of what is left of a file, the header is the line of the least place
            heads = lines.groupBy("__file").agg(F.min(F.struct("__block", "__line")).alias("__head"))
            lines = lines.join(heads, "__file").where(F.struct("__block", "__line") != F.col("__head")).drop("__head")
        parsed = F.from_csv(F.rtrim("value", F.lit("\r")), ", ".join(f"{c.name} string" for c in schema), {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "lineSep"})
        df = lines.select(parsed.alias("__row"), *_ORDER).select("__row.*", *_ORDER)
    else:
        df = _placed(spark.read.options(recursiveFileLookup=True, header=header, enforceSchema=True, **options).schema(schema).csv(url))
    missing = [v for v in ([na_values] if isinstance(na_values, str) else na_values or []) if isinstance(v, str)]
    for i in range(width):
        c = F.col(f"c{i}")
        df = df.withColumn(f"c{i}", F.when(c.isin("", *missing), F.lit(None)).otherwise(c))
    hints = {n: column_type_hints for n in names} if isinstance(column_type_hints, type) else dict(zip(names, column_type_hints)) if isinstance(column_type_hints, (list, tuple)) else dict(column_type_hints or {})
    sample = [(r + [""] * width)[:width] for r in map(split, top[1 if header else 0 :][:nrows_to_infer])]
    sample = [[None if x in ("", *missing) else x for x in r] for r in sample]
    kinds: dict[str, T.DataType] = {}
    for i, n in enumerate(names):
        values = [parse(r[i]) for r in sample if r[i] is not None]
        inferred = K.infer(values) if values else K.STR
        hint = hints.get(n)
        kinds[n] = inferred if hint in (list, dict) and isinstance(inferred, (T.ArrayType, T.MapType)) else K.spark_type(hint) if hint is not None else inferred
    cells, failed = [], F.col(_BAD).isNotNull()
    for i, (n, kind) in enumerate(kinds.items()):
        c = F.col(f"c{i}")
        if isinstance(kind, (T.ArrayType, T.MapType)):
            value = F.udf(lambda s, kind=kind: _as(s, kind), kind)(c)
        elif isinstance(kind, T.StringType):
            value = c
        else:
            value = F.trim(c).try_cast(kind)
        cells.append(value.alias(n))
        failed = failed | (c.isNotNull() & value.isNull())
    good = df.where(~failed).select(*cells, *_ORDER)
    line = F.coalesce(_BAD, F.concat_ws(delimiter, *(F.coalesce(f"c{i}", F.lit("")) for i in range(width))))
    bad = df.where(failed).select(line.alias("line"), *_ORDER)
    if nrows is not None:
        good = good.orderBy(*_ORDER).limit(nrows)
    shown = {n: (F.col(f"`{n}`"), k) for n, k in kinds.items() if usecols is None or n in usecols}
    return Table(Rows(good, list(_ORDER)), shown), bad


def _as(text: str | None, kind: T.DataType):
    try:
        value = parse(text) if text is not None else None
        return None if value is None or isinstance(value, str) else K.converted(value, kind)
    except (TypeError, ValueError, AttributeError):
        return None


_DEFAULTS = {
    "delimiter": ",", "header": True, "comment_char": "", "escape_char": "", "double_quote": True, "quote_char": '"', "skip_initial_space": True, "column_type_hints": None,
    "na_values": ("NA",), "line_terminator": "\n", "usecols": None, "nrows": None, "skiprows": 0, "nrows_to_infer": 100,
}


def read_csv(spark: SparkSession, url: str, error_bad_lines: bool = False, **settings) -> Table:
    """A table from CSV files, a folder or a pattern. Lines that don't parse are left out, or an error."""
    table, bad = _csv(spark, url, **(_DEFAULTS | settings))
    if error_bad_lines and (first := bad.first()) is not None:
        raise ValueError(f"a line can't be parsed: {first[0]}")
    return table


def read_csv_with_errors(spark: SparkSession, url: str, **settings) -> tuple[Table, dict[str, Col]]:
    """The table, and for each file with lines that don't parse these lines in order."""
    table, bad = _csv(spark, url, **(_DEFAULTS | settings))
    found = sorted(r[0] for r in bad.select("__file").distinct().collect())
    plain = "://" not in url and not url.startswith("file:")
    name = lambda f: unquote(urlparse(f).path) if plain else f
    return table, {name(f): Col(Rows(bad.where(F.col("__file") == f), list(_ORDER)), F.col("line"), K.STR) for f in found}


def read_json(spark: SparkSession, url: str, orient: str = "records") -> Table:
    """A table from a JSON array of records, or of one record a line; lines that aren't records give a column X1."""
    if orient == "records":
        return Table.from_spark(spark.read.option("multiLine", True).json(url))
    if orient != "lines":
        raise ValueError("orient must be 'records' or 'lines'")
    df = spark.read.json(url)
    return Table.from_spark(spark.read.text(url).toDF("X1")) if "_corrupt_record" in df.columns else Table.from_spark(df)


def read_text(spark: SparkSession, url: str) -> Col:
    return Table.from_spark(spark.read.text(url).toDF("X1"))["X1"]


def read_avro(spark: SparkSession, url: str) -> Table:
    """Avro records; Spark's Avro package must be on the class path."""
    return Table.from_spark(spark.read.format("avro").load(url))


def load_table(spark: SparkSession, path: str) -> Table:
    """A table saved in the binary format."""
    df = spark.read.parquet(path)
    return Table.from_spark(df.drop(RID), None) if RID not in df.columns else _ordered(df)


def _ordered(df: DataFrame) -> Table:
    kinds = {f.name: f.dataType for f in df.schema if f.name != RID}
    return Table(Rows(df, [RID], True), {n: (F.col(f"`{n}`"), k) for n, k in kinds.items()})


def from_sql(spark: SparkSession, connection, statement: str, params=None, type_inference_rows: int = 100, column_type_hints: dict | None = None, cursor_arraysize: int = 128) -> Table:
    """A table from a DB-API connection, fetched in lots of cursor_arraysize.

    Types are those of the first type_inference_rows rows unless given. The connection
    is the driver's, so rows pass through it, at most two lots of 100,000 at a time.
    """
    cursor = connection.cursor()
    cursor.arraysize = cursor_arraysize
    cursor.execute(statement, params) if params is not None else cursor.execute(statement)
    names = _unique([d[0] for d in cursor.description])
    hints = {n: K.spark_type(t) for n, t in (column_type_hints or {}).items()}
    lots = _lots(cursor, max(_HELD, type_inference_rows))
    rows = next(lots, [])
    kinds = [hints.get(n) or K.infer([r[i] for r in rows[:type_inference_rows]]) for i, n in enumerate(names)]
    table, more = Table.of_rows(spark, names, kinds, rows), next(lots, None)
    if more is None:
        return table
    folder, start = f"{ensure_checkpoint_dir(spark)}/fetched-{uuid.uuid4().hex}", 0
    while rows:  # one lot at a time is on the driver, the others in the shared folder
        Table.of_rows(spark, names, kinds, rows, start).rows.df.write.mode("append").parquet(folder)
        start, rows, more = start + len(rows), more, next(lots, None) if more else None
    return Table(Rows(spark.read.parquet(folder), [RID], True), table._columns)


#: Rows of a database that the driver holds at once.
_HELD = 100_000


def _lots(cursor, size: int):
    rows: list = []
    while lot := cursor.fetchmany():
        rows += lot
        if len(rows) >= size:
            yield rows
            rows = []
    if rows:
        yield rows


def from_jdbc(spark: SparkSession, url: str, query: str, **options) -> Table:
    """A table from a database with a JDBC (or ODBC bridge) driver on the class path."""
    return Table.from_spark(spark.read.format("jdbc").options(url=url, query=query, **options).load())


connect_odbc, from_odbc = from_jdbc, from_jdbc


def from_rdd(spark: SparkSession, rdd) -> Table:
    """An RDD of rows, or of values as column X1."""
    first = rdd.take(1)
    if first and isinstance(first[0], (dict, tuple, list)):
        return Table.from_spark(spark.createDataFrame(rdd))
    return Table.from_spark(spark.createDataFrame(rdd.map(lambda v: (v,)), ["X1"]))


def random_table(spark: SparkSession, size: int, column_types: str, seed: int = 0) -> Table:
    """Random columns by letter: n normal, u uniform, z whole, b 0 or 1, s text of few values, v vector of 4. Each cell depends on the seed and its position only."""
    df = spark.range(size).toDF(RID)
    unit = lambda k: (F.pmod(F.xxhash64(RID, F.lit(seed), F.lit(k)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    normal = lambda k: F.sqrt(-2 * F.log(unit(k))) * F.cos(2 * 3.141592653589793 * unit(k + 5000))
    kinds = {
        "n": (normal, K.FLOAT), "u": (unit, K.FLOAT), "z": (lambda k: F.floor(unit(k) * 100).cast("long"), K.INT), "b": (lambda k: F.floor(unit(k) * 2).cast("long"), K.INT),
        "s": (lambda k: F.concat(F.lit("s"), F.floor(unit(k) * 20).cast("string")), K.STR), "v": (lambda k: F.array(*(normal(k * 10 + j + 20000) for j in range(4))), K.VECTOR),
    }
    return Table(Rows(df, [RID], True), {f"X{k + 1}-{t}": (kinds[t][0](k + 1), kinds[t][1]) for k, t in enumerate(column_types)})


def load_images(spark: SparkSession, url: str, format: str = "auto", with_path: bool = True, recursive: bool = True, ignore_failure: bool = True, random_order: bool = False) -> Table:
    """Image files as a column of structs (height, width, nChannels, mode, data); files that aren't images are left out."""
    reader = spark.read.format("image").option("dropInvalid", ignore_failure).option("recursiveFileLookup", recursive)
    if format != "auto":
        reader = reader.option("pathGlobFilter", f"*.{format.lower()}")
    df = reader.load(url)
    df = df.orderBy(F.rand(0)) if random_order else df.orderBy("image.origin")
    return Table.from_spark(df.select(*([F.col("image.origin").alias("path")] if with_path else []), "image"))
