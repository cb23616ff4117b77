"""Tables and columns to files and databases."""

from __future__ import annotations

import itertools
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core import types as K
from millrace.operators.rows import RID


def save(table, path: str, format: str | None = None) -> None:
    """binary keeps the order of rows; csv and json are chosen by the path's ending too."""
    format = format or ("csv" if path.endswith((".csv", ".csv.gz")) else "json" if path.endswith(".json") else "binary")
    if format == "binary":
        df, order = table._plain(numbered=bool(table.rows.order))
        df.write.mode("overwrite").parquet(path)
    elif format == "csv":
        export_csv(table, path)
    elif format == "json":
        export_json(table, path)
    else:
        raise ValueError("format must be 'binary', 'csv' or 'json'")


def save_reference(table, path: str) -> None:
    """Save a table of columns that are kept elsewhere; tables here are plans over their sources, so all rows are written and the result stands alone."""
    save(table, path, "binary")


def save_column(column, path: str, format: str = "binary") -> None:
    if format == "text":
        column.to_table("value").frame().select(F.col("value").cast("string")).write.mode("overwrite").text(path)
    else:
        save(column.to_table("X1"), path, "binary")


def _cell(c: Column, kind: T.DataType, quote_level: int, quote: str, escape: str, double: bool, na: str) -> Column:
    """A cell as CSV: quote_level 0 quotes what needs it, 1 all, 2 all but numbers, 3 none."""
    text = F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(kind, T.TimestampType) else c.cast("string")
    marked = F.concat(F.lit(quote), F.replace(F.replace(text, F.lit(escape), F.lit(escape * 2)) if escape and not double else text, F.lit(quote), F.lit(quote * 2 if double else escape + quote)), F.lit(quote))
    if quote_level == 3 or quote_level in (0, 2) and K.is_number(kind):
        shown = text
    elif quote_level == 0:
        shown = F.when(text.rlike('[,\\s"\']'), marked).otherwise(text)
    else:
        shown = marked
    return F.coalesce(shown, F.lit(na))


def export_csv(
    table, path: str, delimiter: str = ",", line_terminator: str = "\n", header: bool = True, quote_level: int = 2, double_quote: bool = True, escape_char: str = "\\",
    quote_char: str = '"', na_rep: str = "", file_header: str = "", file_footer: str = "", line_prefix: str = "",
) -> None:
    """A folder of CSV files in order of rows, each with the file header and the header, so that each can be read by itself.

    Prefix, headers and footer are lines of their own; the footer is the last file's
    last line. Without rows there is one file with the headers only.
    """
    df, order = table._plain(numbered=True)
    cells = [_cell(F.col(f"`{n}`"), k, quote_level, quote_char, escape_char, double_quote, na_rep) for n, k in table.kinds.items()]
    line = F.concat(F.lit(line_prefix), F.array_join(F.array(*cells), delimiter))
    body = df.select(F.col(RID), line.alias("value"))
    top = [file_header] if file_header else []
    if header:
        mark = lambda n: n if quote_level == 3 else quote_char + n + quote_char
        top.append(line_prefix + delimiter.join(map(mark, table.column_names())))
    if file_footer:
        body = body.unionByName(table.spark.createDataFrame([(2**62, file_footer)], f"{RID} long, value string"))
    lines = body.orderBy(RID).select("value")

    def headed(batches):
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array(top, pa.string())], schema=batch.schema)
            yield batch

    if top:
        if body.isEmpty():
            lines = table.spark.createDataFrame([(x,) for x in top], "value string").coalesce(1)
        else:
            lines = lines.mapInArrow(headed, "value string")
    lines.write.mode("overwrite").option("lineSep", line_terminator).text(path)


def export_json(table, path: str, orient: str = "records") -> None:
    """Records one a line, or as one array; null fields are left out."""
    if orient == "lines":
        df, order = table._plain()
        (df.orderBy(*order) if order else df).drop(*order).write.mode("overwrite").json(path)
    elif orient == "records":
        df, order = table._plain(numbered=True)
        last = df.agg(F.max(RID)).first()[0]
        row = F.to_json(F.struct(*(f"`{n}`" for n in table.column_names())))
        text = F.concat(F.when(F.col(RID) == 0, "[").otherwise(""), row, F.when(F.col(RID) == last, "]").otherwise(","))
        out = df.orderBy(RID).select(text.alias("value")) if last is not None else table.spark.createDataFrame([("[]",)], "value string")
        out.write.mode("overwrite").text(path)
    else:
        raise ValueError("orient must be 'records' or 'lines'")


def to_sql(table, connection, name: str, paramstyle: str = "qmark") -> None:
    """Append the rows to a table of a DB-API connection, fetched partition by partition and inserted in lots of 10,000.

    The connection is the driver's, so rows pass through it; to_jdbc() writes from the tasks.
    """
    marks = {"qmark": "?", "format": "%s"}[paramstyle]
    statement = f"INSERT INTO {name} ({', '.join(table.column_names())}) VALUES ({', '.join([marks] * table.num_columns())})"
    cursor, rows = connection.cursor(), iter(table)
    while lot := [[json.dumps(v) if isinstance(v, (list, dict)) else v for v in row.values()] for row in itertools.islice(rows, 10_000)]:
        cursor.executemany(statement, lot)
    connection.commit()


def to_jdbc(table, url: str, name: str, append_if_exists: bool = True, **options) -> None:
    table.frame().write.format("jdbc").options(url=url, dbtable=name, **options).mode("append" if append_if_exists else "error").save()


to_odbc = to_jdbc
