"""Stupid-backoff scores of documents under the n-gram counts of all the others.

Relationally: documents are exploded to their n-grams, which are pre-aggregated and
partitioned by hash; a partition's sums are its part of the count table; the exploded
n-grams are joined to it, and the logarithms of what comes back are summed by document.

The tables are columnar: a row holds, as sorted arrays, all n-grams of one hash range
(bucket) that one block of a few megabytes of documents has, with their counts. Rows
without n-grams aren't made, so there are never more rows than distinct n-grams of the
blocks, however many blocks and buckets there are. The join sends back one count for
each n-gram, in the order in which they came.

An n-gram that all blocks have is one entry a block. Blocks are therefore summed in
groups of so many (salt) first, and a bucket's sums over the groups after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.core.deploy import ship
from millrace.llm.text import fold, mix, text_slices, word_hashes

#: The n-gram of no words, whose count is the number of words.
_ROOT = np.uint64(0)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, compressed by bytes of equal significance, as those of small ones are alike."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as the first and the differences."""
    return np.diff(x, prepend=np.uint64(0))


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """(block, ids, lengths, texts) with the compressed texts of consecutive rows; length -1 for null."""
    id_type = texts.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, pack = pa.list_(to_arrow_type(id_type)), zstandard.ZstdCompressor(level=6)
        first, n = TaskContext.get().partitionId() << 32, 0
        ids, held, total = [], [], 0

        def block() -> pa.RecordBatch:
            lengths = [-1 if t is None else len(t) for t in held]
            blob = pack.compress(b"".join(t for t in held if t))
            return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([ids], kind), pa.array([lengths], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["block", "ids", "lengths", "texts"])

        for part in text_slices(batches, "text", size // 4):
            new = [None if t is None else t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            ids += part.column("id").to_pylist()
            held += new
            total += sum(len(t) for t in new if t)
            if total >= size:
                yield block()
                ids, held, total, n = [], [], 0, n + 1
        if held:
            yield block()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())])
    return texts.mapInArrow(run, schema)


def _words(lengths: list[int], blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block's documents one after the other, and how many each has."""
    data, start, hashes = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for n in lengths:
        n = max(n, 0)
        hashes.append(word_hashes(data[start : start + n].lower().split()))
        start += n
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    return np.concatenate(hashes) if len(hashes) else np.zeros(0, np.uint64), counts


def _grams(hashes: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the places where an n-gram of it ends, and their hashes."""
    within = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = []
    for n in range(1, order + 1):
        at = np.flatnonzero(within >= n - 1)
        out.append((at, fold([hashes[at - k] for k in range(n - 1, -1, -1)])))
    return out


def _distinct(grams: list[tuple[np.ndarray, np.ndarray]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's n-grams in order of their hashes, with their counts; the root first."""
    every = np.sort(np.concatenate([g for _, g in grams])) if grams else np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return np.concatenate([[_ROOT], every[starts]]), np.concatenate([[words], np.diff(np.append(starts, len(every)))]).astype(np.uint64)


def _exploded(blocks: DataFrame, order: int, bits: int, salts: int) -> DataFrame:
    """(bucket, salt, block, grams, counts): the distinct n-grams of each block with their counts, a row for each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "lengths", "texts"))):
                hashes, counts = _words(lengths, blob)
                grams, totals = _distinct(_grams(hashes, counts, order), len(hashes))
                buckets = grams >> np.uint64(64 - bits) if bits else np.zeros(len(grams), np.uint64)
                starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
                salt = int(mix(np.array([block], np.uint64))[0] % np.uint64(salts))
                for at in range(0, len(starts), 4096):
                    some = starts[at : at + 4096]
                    ends = np.append(starts[at + 1 : at + 4097], len(grams))[: len(some)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(buckets[some].astype(np.int64)),
                            pa.array([salt] * len(some), pa.int64()),
                            pa.array([block] * len(some), pa.int64()),
                            pa.array([_packed(_steps(grams[s:e])) for s, e in zip(some.tolist(), ends.tolist())], pa.binary()),
                            pa.array([_packed(totals[s:e]) for s, e in zip(some.tolist(), ends.tolist())], pa.binary()),
                        ],
                        ["bucket", "salt", "block", "grams", "counts"],
                    )

    return blocks.mapInArrow(run, "bucket long, salt long, block long, grams binary, counts binary")


def _sums(grams: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams in order, their sums, for each n-gram that came its place among them)."""
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    return every[new], np.add.reduceat(counts[order], np.flatnonzero(new)), place


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    grams = [np.cumsum(_numbers(b), dtype=np.uint64) for b in table.column("grams").to_pylist()]
    return grams, np.concatenate([_numbers(b) for b in table.column("counts").to_pylist()])


def _joined(table: pa.Table, totals: np.ndarray | None) -> pa.Table:
    """What other blocks have of each n-gram of one bucket and salt, in the order in which blocks sent them.

    totals are the count table's entries of the distinct n-grams; without, these rows are all there are.
    """
    grams, counts = _unpacked(table)
    _, sums, place = _sums(grams, counts)
    others = (sums if totals is None else totals)[place] - counts
    parts = np.split(others, np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "others": pa.array([_packed(p) for p in parts], pa.binary())})


def _told(exploded: DataFrame, salts: int) -> DataFrame:
    """(block, bucket, others): the exploded n-grams joined to the count table."""
    told = "block long, bucket long, others binary"
    if salts == 1:  # a bucket's rows are in one task as they are, which is all of its count table
        return exploded.groupBy("bucket").applyInArrow(lambda table: _joined(table, None), told)

    def part(table: pa.Table) -> pa.Table:
        known, sums, _ = _sums(*_unpacked(table))
        return pa.table([table.column("bucket")[:1], table.column("salt")[:1], pa.array([_packed(_steps(known))], pa.binary()), pa.array([_packed(sums)], pa.binary())], ["bucket", "salt", "grams", "counts"])

    def whole(table: pa.Table) -> pa.Table:
        grams, counts = _unpacked(table)
        _, sums, place = _sums(grams, counts)
        parts = np.split(sums[place], np.cumsum([len(g) for g in grams])[:-1])
        return pa.table([table.column("bucket"), table.column("salt"), pa.array([_packed(p) for p in parts], pa.binary())], ["bucket", "salt", "totals"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        return _joined(left, _numbers(right.column("totals")[0].as_py()))

    parts = exploded.groupBy("bucket", "salt").applyInArrow(part, "bucket long, salt long, grams binary, counts binary")
    table = parts.groupBy("bucket").applyInArrow(whole, "bucket long, salt long, totals binary")
    return exploded.groupBy("bucket", "salt").cogroup(table.groupBy("bucket", "salt")).applyInArrow(join, told)


def _without_own(at: np.ndarray, grams: np.ndarray, docs: np.ndarray, known: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each place the count, in all other documents, of the n-gram of one order that ends there; 0 where none does."""
    order = np.argsort(grams, kind="stable")  # places of one n-gram stay in order, so those of a document are together
    every, own = grams[order], docs[at[order]]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    starts = np.flatnonzero(new)
    sums = totals[np.searchsorted(known, every[starts])].astype(np.int64)
    runs = np.flatnonzero(new | np.concatenate([[True], own[1:] != own[:-1]]))
    lengths = np.diff(np.append(runs, len(order)))
    counts = np.zeros(len(docs), np.int64)
    counts[at[order]] = np.repeat(sums, np.diff(np.append(starts, len(order)))) - np.repeat(lengths, lengths)
    return counts


def _scored(lengths: list[int], blob: bytes, elsewhere: np.ndarray, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, log scores and words scored at each order (0: not seen elsewhere) of each document of a block."""
    hashes, counts = _words(lengths, blob)
    sums, hits = np.zeros(len(counts)), np.zeros((len(counts), order + 1), np.int64)
    if not len(hashes):
        return counts, sums, hits
    docs = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = _grams(hashes, counts, order)
    known, here = _distinct(grams, len(hashes))
    totals = elsewhere + here
    others = (int(totals[0]) - counts)[docs]
    seen = [_without_own(a, g, docs, known, totals) if len(a) else np.zeros(len(docs), np.int64) for a, g in grams]
    most = np.minimum(within + 1, order)
    level, score = np.zeros(len(hashes), np.int64), most * math.log(backoff) - np.log(np.maximum(others, 1))
    for n in range(1, order + 1):
        found = seen[n - 1] > 0
        before = others if n == 1 else np.concatenate([[0], seen[n - 2][:-1]])
        score[found] = (most[found] - n) * math.log(backoff) + np.log(seen[n - 1][found]) - np.log(before[found])
        level[found] = n
    np.add.at(hits, (docs, level), 1)
    return counts, np.bincount(docs, score, len(counts)), hits


def stupid_backoff(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, backoff: float = 0.4, block: int = 6_500_000, entries: int = 2_000_000, together: int = 4096
) -> DataFrame:
    """Score every document with n-gram counts of all documents but itself.

    Words are those of millrace.llm.text. With c the counts over all documents less the
    document's own, a word after its context of up to order - 1 words of the document
    scores c(context word) / c(context) if that n-gram was seen elsewhere; else backoff
    times the score after the context without its first word; a word not seen elsewhere
    scores backoff / N after the empty context, N the number of words elsewhere (1 at least).

    Returns one row for each input row: id_col, n_words, log_score (sum of the natural
    logarithms) and hits, an array with the numbers of words scored at each order from 0
    (not seen elsewhere) on. Null, empty and blank texts have 0 words and a log_score of
    0. Null or repeated ids pass through: each row is a document of its own. Other
    columns aren't read. An empty table gives an empty result.

    Rows are sorted within their partition before blocks are cut, so a task that runs
    again makes the same blocks as long as its partition has the same rows, in whatever
    order they come.

    block is the text of a block in bytes, entries the number of n-grams that a bucket
    is to hold; the number of buckets follows the length of all texts. Up to together
    blocks are summed at once: with more, each group of about so many blocks is summed
    before the count table is, which gives the same counts.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total * order / 6 / entries))))
    salts = max(1, math.ceil(total / block / together))
    blocks = _blocks(texts.sortWithinPartitions("id", "text"), block)
    blocks = blocks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    told = _told(_exploded(blocks, order, bits, salts), salts)
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        ids, words, sums, hits = [], [], [], []
        if own.num_rows:
            parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("others").to_pylist()))
            elsewhere = np.concatenate([_numbers(t) for _, t in parts])
            ids = own.column("ids")[0].as_py()
            words, sums, hits = _scored(own.column("lengths")[0].as_py(), own.column("texts")[0].as_py(), elsewhere, order, backoff)
        return pa.table([pa.array(ids, kind), pa.array(words, pa.int64()), pa.array(sums, pa.float64()), pa.array(list(hits), pa.list_(pa.int64()))], ["id", "n_words", "log_score", "hits"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.LongType()))])
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema).withColumnRenamed("id", id_col)
