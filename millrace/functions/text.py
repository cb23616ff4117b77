"""Bags of words and n-grams of texts, without leaving the row."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words in n-grams, with the white space of Java's patterns.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = " \t\n\x0b\f\r"
#: Characters that are counted at once; a longer text is counted by itself.
CHARACTERS = 1 << 17
#: Longest runs of characters that are counted in Python: the keys of an Arrow batch, some n times its texts, must stay under 2 GB.
LONGEST = 8


def _counted(items: Column) -> Column:
    """Counts of an array's items as a dictionary: sorted, each run's length is the distance of its ends."""
    given = F.array(F.sort_array(items))

    def count(a: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == F.size(a)) | (F.get(a, i - 1) != F.get(a, i)))
        entries = F.transform(F.array(ends), lambda e: F.transform(e, lambda i, k: F.struct(F.get(a, i - 1), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long"))))
        return F.when(F.size(a) > 0, F.map_from_entries(F.get(entries, 0))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))

    return F.get(F.transform(given, count), 0)


def count_words(c: Column, to_lower: bool, delimiters: Sequence[str]) -> Column:
    """Words between delimiters, with their counts."""
    text = F.lower(c) if to_lower else c
    pattern = "[" + "".join(re.escape(d) for d in delimiters) + "]+"
    return F.when(c.isNotNull(), _counted(F.filter(F.split(text, pattern), lambda w: w != "")))


def _numbered(parts: Sequence[tuple[np.ndarray, int]]) -> np.ndarray:
    """One number for each tuple of numbers below the given bounds, in the order of the tuples."""
    code, size = parts[0]
    for part, bound in parts[1:]:
        if size * bound >= 2**63:
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        code, size = code * bound + part, size * bound
    return code


def _lot(texts: list[str], n: int, drop: str) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The number of different n-grams by text, then in one order their bytes, lengths in bytes and counts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([0, *map(len, texts)])
    bound = int(points.max(initial=127)) + 1
    keep = np.ones(bound, bool)
    keep[[ord(c) for c in drop]] = False
    kept = keep[points]
    ends = np.concatenate(([0], np.cumsum(kept)))[ends]
    points = points[kept]
    grams = np.maximum(np.diff(ends) - n + 1, 0)
    row = np.repeat(np.arange(len(texts)), grams)
    start = np.arange(len(row)) + (ends[:-1] - np.cumsum(grams) + grams)[row]
    known = np.zeros(bound, bool)
    known[points] = True
    rank, alphabet = np.cumsum(known) - 1, int(known.sum())
    unit = rank[points]
    # sorted together with where they are, equal n-grams of a text are neighbours
    code = np.sort(_numbered([(row, len(texts)), *((unit[start + k], alphabet) for k in range(n)), (np.arange(len(row)), len(row))]))
    gram, at = np.divmod(code, max(len(row), 1))
    first = np.flatnonzero(np.concatenate((np.ones(min(len(gram), 1), bool), gram[1:] != gram[:-1])))
    at = at[first]
    keys = points[start[at][:, None] + np.arange(n)]
    width = n + sum((keys >= least).sum(axis=1) for least in (0x80, 0x800, 0x10000))
    return np.bincount(row[at], minlength=len(texts)), keys.tobytes().decode("utf-32-le").encode(), width, np.diff(np.append(first, len(gram)))


def _offsets(lengths: list[np.ndarray]) -> pa.Buffer:
    ends = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
    if ends[-1] >= 2**31:
        raise ValueError("the n-grams of one Arrow batch take more than 2 GB; spark.sql.execution.arrow.maxRecordsPerBatch must be lower")
    return pa.py_buffer(ends.astype(np.int32))


def character_bags(column: pa.Array, n: int, drop: str) -> pa.Array:
    """Dictionaries of counts, in the order of keys, of the runs of n characters that are left without those to drop."""
    texts = [t or "" for t in column.to_pylist()]
    cuts, total = [0], 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHARACTERS:
            cuts.append(i)
            total = 0
        total += len(t)
    sizes, keys, widths, counts = zip(*(_lot(texts[a:b], n, drop) for a, b in zip(cuts, [*cuts[1:], len(texts)])))
    ends = pa.Array.from_buffers(pa.int32(), len(texts) + 1, [None, _offsets(sizes)])
    values = pa.array(np.concatenate(counts), pa.int64())
    return pa.MapArray.from_arrays(ends, pa.StringArray.from_buffers(len(values), _offsets(widths), pa.py_buffer(b"".join(keys))), values)


def count_ngrams(c: Column, n: int, method: str, to_lower: bool, ignore_space: bool) -> Column:
    """Runs of n words, split at white space and punctuation, or of n characters other than punctuation, with their counts.

    Up to LONGEST characters are counted in Python, lots of rows at a time.
    """
    if n < 1:
        raise ValueError("n must be positive")
    text = F.lower(c) if to_lower else c
    marks = re.escape(PUNCTUATION)
    if method == "word":
        items, between = F.filter(F.split(text, rf"[\s{marks}]+"), lambda w: w != ""), " "
    elif method == "character":
        if n <= LONGEST:
            drop = PUNCTUATION + SPACE * ignore_space

            @F.arrow_udf("map<string,bigint>")
            def run(column: pa.Array) -> pa.Array:
                return character_bags(column, n, drop)

            return F.when(c.isNotNull(), run(F.make_valid_utf8(text)))
        # a text is split into characters first, for its n-th character is found by counting from the start
        items, between = F.split(F.regexp_replace(text, rf"[{marks}{chr(92) + 's' if ignore_space else ''}]", ""), ""), ""
    else:
        raise ValueError("method must be 'word' or 'character'")
    grams = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.array_join(F.slice(a, i, F.lit(n)), between))
    found = F.transform(F.array(items), lambda a: F.when(F.size(a) >= n, grams(a)).otherwise(F.array().cast("array<string>")))
    return F.when(c.isNotNull(), _counted(F.get(found, 0)))
