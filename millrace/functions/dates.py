"""Times as text and as fields, in UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.types import FLOAT, INT

#: Format letters and Spark's patterns for them.
LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "F": ".SSSSSS", "f": "SSSSSS", "q": "XXX", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "p": "a", "I": "hh"}
ISO = "%Y-%m-%dT%H:%M:%S"
FIELDS = ("year", "month", "day", "hour", "minute", "second", "weekday", "isoweekday", "tmweekday", "us")


def pattern(format: str) -> str:
    """A format as a pattern of Spark's; letters that have no counterpart are an error."""
    out, i = "", 0
    format = ISO if format == "ISO" else format.replace("%ZP", "%q")
    while i < len(format):
        if format[i] == "%":
            letter = format[i + 1 : i + 2]
            if letter != "%" and letter not in LETTERS:
                raise ValueError(f"%{letter} isn't supported in a time format")
            out += "'%'" if letter == "%" else LETTERS[letter]
            i += 2
        else:
            run = i
            while run < len(format) and (format[run].isalpha() or format[run] == "'"):
                run += 1
            if run == i:
                out, i = out + format[i], i + 1
            else:  # letters stand for themselves within quotes
                out, i = out + "'" + format[i:run].replace("'", "''") + "'", run
    return out


def parsed(c: Column, format: str) -> Column:
    """Text as a time; text that doesn't fit is an error."""
    return F.to_timestamp(c, pattern(format))


def written(c: Column, format: str) -> Column:
    return F.date_format(c, pattern(format))


def fields(c: Column, prefix: str, limit: Sequence[str] | None, tzone: bool) -> dict[str, tuple[Column, T.DataType]]:
    """Calendar fields: weekday counts from Monday 0, isoweekday from Monday 1, tmweekday from Sunday 0."""
    known = {
        "year": F.year(c), "month": F.month(c), "day": F.day(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c),
        "weekday": F.weekday(c), "isoweekday": F.weekday(c) + 1, "tmweekday": F.dayofweek(c) - 1, "us": F.unix_micros(c) % 1_000_000,
    }
    wanted = list(limit) if limit is not None else ["year", "month", "day", "hour", "minute", "second"]
    if unknown := set(wanted) - set(known):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    name = lambda f: f"{prefix}.{f}" if prefix else f
    out = {name(f): (known[f].cast("long"), INT) for f in wanted}
    if tzone:
        out[name("tzone")] = (F.when(c.isNotNull(), F.lit(0.0)), FLOAT)
    return out
