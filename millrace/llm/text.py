"""Word and shingle hashing shared by the operators on shingles.

Words are maximal runs of bytes other than space and 09-0D, with A-Z lower-cased;
bytes.split and bytes.lower follow exactly these rules on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_digest = xxhash.xxh3_64_intdigest


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer; wraps around silently on arrays."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def words(text: str | None) -> list[bytes]:
    """The words of a text; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest, found), dtype=np.uint64, count=len(found))


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long columns, in which order counts."""
    out = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for column in columns:
        out = mix((out + _GOLDEN) ^ column)
    return out


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words in order; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    return fold([hashes[i : n - width + 1 + i] for i in range(width)])


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about limit bytes of text, so that no step holds a large batch taken apart."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
