"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all raw
text, give each document a log ratio for each n-gram; documents are sampled without
replacement in proportion to their weights by taking the k largest after adding Gumbel
noise. The n-grams are words, pairs of words, and runs of three word shapes (case,
digits, punctuation, repetition), which tell apart what is said and how.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.deploy import ship
from millrace.core.durable import cut
from millrace.llm.kept import kept, tidy
from millrace.llm.text import fold, text_slices

_WORD = re.compile(r"\w+|[^\w\s]+")
_SHAPES = 16**3
#: Places whose counts travel as one row.
_BLOCK = 512
#: Marks a block that is sent as places and counts.
_PLACES = 16
_REMEMBER = 200_000


def _shape(word: str) -> int:
    if word.isalpha():
        return 0 if word.islower() else 1 if len(word) == 1 or word[1:].islower() else 2 if word.isupper() else 3
    return 4 if word.isdigit() else 5 if word.isalnum() else 6 if len(word) == 1 else 7


class _Codes(dict):
    """A word's hash with its shape in the lowest three bits; starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBER:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) & ~7 | _shape(word)
        if len(word) <= 64:
            self[word] = value
        return value


@dataclass(frozen=True)
class Family:
    """n-grams of one kind: what is added to their counts, and how far a log ratio has to be from 0 to count, beyond that only."""

    smoothing: float
    margin: float


#: Words, pairs of words, shapes. The README tells how these were chosen.
FAMILIES = (Family(0.5, 1.0), Family(2.0, 3.0), Family(1.0, 1.0))


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of each family as places in one table: buckets for words, buckets for pairs, one for each run of shapes."""
    found = _WORD.findall(text or "")
    codes = np.fromiter(map(kept("codes", _Codes).__getitem__, found), np.uint64, len(found))
    hashes = codes >> np.uint64(3)
    spoken = (hashes % np.uint64(buckets)).astype(np.int64)
    pairs = (fold([hashes[:-1], hashes[1:]]) % np.uint64(buckets)).astype(np.int64) + buckets
    shapes = (codes & np.uint64(7)).astype(np.int64) * 2
    shapes[1:] += codes[1:] == codes[:-1]
    return spoken, pairs, shapes[:-2] * 256 + shapes[1:-1] * 16 + shapes[2:] + 2 * buckets


def _size(buckets: int) -> int:
    return 2 * buckets + _SHAPES


def identity(value, text: str | None) -> int:
    """64 bits for a row: of its id, or of its text if it has none."""
    return xxhash.xxh3_64_intdigest((f"={text}" if value is None else str(value)).encode("utf-8", "surrogatepass"))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles."""
    bits = x.astype(np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


@dataclass
class Labels:
    """Known rows by identity: clean or not, sorted for lookup."""

    keys: np.ndarray
    clean: np.ndarray
    folds: int

    def of(self, key: int) -> int:
        """0: not known; 1: clean, to fit on; 2: clean, to calibrate on; 3: known as not clean."""
        at = int(np.searchsorted(self.keys, np.uint64(key)))
        if at == len(self.keys) or int(self.keys[at]) != key:
            return 0
        return 3 if not self.clean[at] else 2 if xxhash.xxh3_64_intdigest(key.to_bytes(8, "little")) % self.folds == 0 else 1


@dataclass
class Model:
    """n-gram counts of the target and of all rows, and how weights come from them.

    Counts are in single precision, exact up to 2^24 and within 6e-8 beyond, as each task gets them.
    """

    raw: np.ndarray
    target: np.ndarray
    buckets: int
    temperature: float

    def score(self, text: str | None, within: bool) -> float:
        """Log ratio of the two models over the text's n-grams, by length, with the text itself left out of both.

        A log ratio counts as far as it is beyond its family's margin, so that the many
        n-grams about as frequent in both don't add up to noise that hides the few that
        aren't. The length is the number of words and runs of shapes.
        """
        found = features(text, self.buckets)
        if not len(found[0]):
            return -np.inf
        words, total = len(found[0]), 0.0
        share = max(self._targets - words * within, 0.0) / max(self._raws - words, 1.0)
        for family, each in zip(FAMILIES, found):
            places, own = np.unique(each, return_counts=True)
            target = np.maximum(self.target[places] - own * within, 0)
            expected = np.maximum(self.raw[places] - own, 0) * share
            ratio = np.log((target + family.smoothing) / (expected + family.smoothing))
            total += float((np.sign(ratio) * np.maximum(np.abs(ratio) - family.margin, 0) * own).sum())
        return total / (words + len(found[2]))

    def __post_init__(self):
        self._targets, self._raws = (float(x[: self.buckets].sum(dtype=np.float64)) for x in (self.target, self.raw))
        self.target, self.raw = self.target.astype(np.float32), self.raw.astype(np.float32)

    def noisy(self, score: float, key: int) -> float:
        """The log weight with the row's own Gumbel noise."""
        u = (xxhash.xxh3_64_intdigest(key.to_bytes(8, "little"), seed=1) + 0.5) / 2**64
        return score / self.temperature - float(np.log(-np.log(min(u, 1 - 1e-16))))


def known_labels(labels: DataFrame, id_col: str, most: int, folds: int) -> Labels:
    """At most most labelled ids, those of the least hashes; an id is clean if all its rows say so."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(good.cast("int")).alias("clean"))
    found = rows.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    keys = np.array([identity(v, None) for v in found.column("id").to_pylist()], dtype=np.uint64)
    order = np.argsort(keys)
    return Labels(keys[order], np.array(found.column("clean").to_pylist(), dtype=bool)[order], folds)


def _pack(counts: np.ndarray) -> bytes:
    """A block of counts in the narrowest of 1, 2, 4 and 8 bytes each, only those in use with their places if that is shorter; nothing if all are 0."""
    used = np.flatnonzero(counts)
    if not len(used):
        return b""
    kind = np.min_scalar_type(int(counts.max()))
    if len(used) * (2 + kind.itemsize) < _BLOCK * kind.itemsize:
        return bytes([kind.itemsize | _PLACES]) + used.astype("u2").tobytes() + counts[used].astype(kind).tobytes()
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros(_BLOCK, np.int64)
    if packed:
        width = packed[0] & ~_PLACES
        if packed[0] & _PLACES:
            n = (len(packed) - 1) // (2 + width)
            out[np.frombuffer(packed, "u2", n, 1)] = np.frombuffer(packed, f"u{width}", n, 1 + 2 * n)
        else:
            out[:] = np.frombuffer(packed, f"u{width}", _BLOCK, 1)
    return out


def _packed(blocks: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A row for each block with any counts; 1,000 rows are 8 MB at most."""
    rows = ((block, _pack(raw), _pack(target)) for block, raw, target in blocks if raw.any())
    while lot := list(itertools.islice(rows, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*lot), (pa.int32(), pa.binary(), pa.binary()))], ["block", "raw", "target"])


def _counts(texts: DataFrame, labels: Labels, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each n-gram over all rows and over the clean ones to fit on.

    Each task adds up its own rows first and sends a row for each block of places with
    any counts, not for each place: Spark then neither hashes nor sorts millions of rows
    a task. Tasks that get the blocks add them up as they come; the driver gets a row a block.
    """
    blocks = -(-_size(buckets) // _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(blocks * _BLOCK, np.int64), np.zeros(blocks * _BLOCK, np.int64)
        for part in text_slices(batches, "text"):
            for value, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                places = np.concatenate(features(text, buckets))
                np.add.at(raw, places, 1)
                if labels.of(identity(value, text)) == 1:
                    np.add.at(target, places, 1)
        yield from _packed(zip(range(blocks), raw.reshape(blocks, _BLOCK), target.reshape(blocks, _BLOCK)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((2, _BLOCK), np.int64))
        for part in batches:
            for block, *packed in zip(*(part.column(name).to_pylist() for name in ("block", "raw", "target"))):
                for total, own in zip(sums[block], packed):
                    total += _unpack(own)
        yield from _packed((block, *both) for block, both in sums.items())

    schema = "block int, raw binary, target binary"
    table = texts.mapInArrow(tidy(run), schema).repartition("block").mapInArrow(tidy(add), schema).toArrow()
    raw, target = np.zeros((blocks, _BLOCK)), np.zeros((blocks, _BLOCK))
    for block, a, b in zip(*(table.column(name).to_pylist() for name in ("block", "raw", "target"))):
        raw[block], target[block] = _unpack(a), _unpack(b)
    return raw.ravel()[: _size(buckets)], target.ravel()[: _size(buckets)]


def _scored(texts: DataFrame, fitted: Broadcast) -> DataFrame:
    """(id, score, bits, known) of each row; bits are in the order of the noisy log weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, labels = fitted.value
        for part in text_slices(batches, "text"):
            ids, rows = part.column("id"), part.column("text").to_pylist()
            keys = [identity(v, t) for v, t in zip(ids.to_pylist(), rows)]
            known = [labels.of(k) for k in keys]
            scores = [model.score(t, k == 1) for t, k in zip(rows, known)]
            bits = ordered_bits(np.array([model.noisy(s, k) for s, k in zip(scores, keys)]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64()), pa.array(bits, pa.int64()), pa.array(known, pa.int32())], ["id", "score", "bits", "known"])

    schema = T.StructType([texts.schema["id"]]).add("score", "double").add("bits", "long").add("known", "integer")
    return texts.mapInArrow(tidy(run), schema)


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of longs, by four counts of 16 bits each; null if there are fewer rows."""
    prefix = None
    for shift in (48, 32, 16, 0):
        part = F.shiftright(column, shift)
        inside = rows if prefix is None else rows.where(F.shiftright(column, shift + 16) == prefix)
        for value, n in sorted(inside.groupBy(part.alias("part")).count().collect(), reverse=True):
            if k <= n:
                prefix = value
                break
            k -= n
        else:
            return None
    return prefix


@dataclass
class Selection:
    """A fitted sampler: rows whose bits reach least are kept; scores has all rows (id, score, bits, known).

    fitted holds the Model and the Labels; their sizes come from the settings buckets and most_labels.
    """

    fitted: Broadcast
    scores: DataFrame
    least: int


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 2**20,
    clean_share: float = 0.99,
    temperature: float = 0.002,
    most_labels: int = 300_000,
    folds: int = 5,
) -> Selection:
    """Fit the two models and find how many documents to sample, and so the least noisy weight of the sample.

    The target is the text of rows labelled quality 1 and not toxic: at most
    most_labels labelled ids, the only sampled part. The raw model counts all rows. A
    row's weight is exp(score / temperature), with its own counts left out of both
    models; sampling k rows without replacement in proportion to the weights takes the k
    largest of log weight plus Gumbel noise, which is a hash of the id; ties at the k-th
    stay. One fold of the clean labelled rows is left out of the target to calibrate: k
    is the number of rows whose noisy weight is at least that of clean_share of them.

    Rows without text or words have weight 0 and aren't sampled. A null id takes its
    noise from the text. Repeated rows all count. Without clean labels on both sides
    nothing can be fitted and every row with words is kept. Other columns aren't read.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = known_labels(labels, id_col, most_labels, folds)
    model = Model(*_counts(texts, known, buckets), buckets, temperature)
    fitted = docs.sparkSession.sparkContext.broadcast((model, known))
    scores = cut(_scored(texts, fitted))
    ok = F.col("score") > float("-inf")
    line = scores.where((F.col("known") == 2) & ok).agg(F.expr(f"percentile_disc({1 - clean_share!r}) WITHIN GROUP (ORDER BY bits)")).first()[0]
    if line is None or not model.target.any():
        line = -(2**63)
    k = scores.where(ok & (F.col("bits") >= line)).count()
    least = kth_largest(scores.where(ok), "bits", k) if k else None
    return Selection(fitted, scores, 2**63 - 1 if least is None else least)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id_col, log_ratio) of the sampled rows; see fit() for the settings and the cases."""
    chosen = fit(docs, labels, id_col, text_col, **settings)
    kept = chosen.scores.where((F.col("bits") >= chosen.least) & (F.col("score") > float("-inf")))
    return kept.select(F.col("id").alias(id_col), F.col("score").alias("log_ratio"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The sampled rows with all their columns; see fit() for the settings and the cases.

    Weights are computed again where the rows are, so that nothing of a large table is shuffled.
    """
    chosen = fit(docs, labels, id_col, text_col, **settings)
    fitted, least = chosen.fitted, chosen.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = fitted.value
        for part in text_slices(batches, text_col):
            rows = part.column(text_col).to_pylist()
            keys = [identity(v, t) for v, t in zip(part.column(id_col).to_pylist(), rows)]
            scores = np.array([model.score(t, known.of(k) == 1) for t, k in zip(rows, keys)])
            bits = ordered_bits(np.array([model.noisy(s, k) for s, k in zip(scores, keys)]))
            yield part.filter(pa.array((bits >= least) & (scores > -np.inf)))

    return docs.mapInArrow(tidy(run), docs.schema)
