"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact weighted shingles.

The steps, each on what the one before leaves: windows that share a shingle with some
item (others have a similarity of 0 with all); items whose fingerprint is within the
radius of the window's, by blocks of their bits; the exact similarity.

Items are prepared by tasks and written to the shared folder in lots. A task reads the
documents once; with one lot it loads it once, with more it holds some megabytes of
documents against one lot after the other. The driver has neither items nor documents.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.core.deploy import ship
from millrace.core.durable import ensure_checkpoint_dir
from millrace.llm.files import place
from millrace.llm.kept import kept, tidy
from millrace.llm.text import fold, mix, shingle_hashes, text_slices, word_hashes, words

#: Bits of a fingerprint, and the most of them that may differ. Two sets with a weighted similarity of 0.8 differ in
#: 19.4 bits of 128 on average with a deviation of 4.1, so 31 leave out about one pair in 500 there, fewer above.
BITS, RADIUS = 128, 31
_LANES = BITS // 64
#: Bits of a block. If two fingerprints differ in RADIUS bits at most, some block differs in _NEAR at most.
_BLOCK = 16
_NEAR = RADIUS // (BITS // _BLOCK)
_MASKS = np.array([sum(1 << b for b in bits) for n in range(_NEAR + 1) for bits in itertools.combinations(range(_BLOCK), n)], dtype=np.uint16)
#: Text of the documents that are held against one lot after the other, where there is more than one.
_HELD = 32_000_000


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    lanes = np.stack([mix(shingles ^ np.uint64(0xA5A5 + lane)) for lane in range(_LANES)], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a bag of shingles, each weighted by its number of occurrences, as bytes."""
    return np.packbits(_signs(shingles).sum(axis=0) > 0)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two bags: sums of least over sums of most occurrences."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(na[ia], nb[ib]).sum())
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


class HammingIndex:
    """Fingerprints filed under the value of each block of their bits.

    A search looks up, for each block, all values within _NEAR bits of its own: 697 of
    65,536, so a block of random bits meets 1.1 % of the fingerprints.
    """

    def __init__(self, prints: np.ndarray):
        self.lanes = np.ascontiguousarray(prints).view(np.uint64).reshape(len(prints), -1)
        values = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), -1)
        self.order = [np.argsort(v, kind="stable").astype(np.int32) for v in values.T]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << _BLOCK))]).astype(np.int32) for v in values.T]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among prints, place in the index) of all pairs within the radius, in order."""
        lanes = np.ascontiguousarray(prints).view(np.uint64).reshape(len(prints), -1)
        values = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), -1)
        found = [np.zeros(0, np.int64)]
        for low in range(0, len(prints), 512):
            for own, order, starts in zip(values[low : low + 512].T, self.order, self.starts):
                asked = (own[:, None] ^ _MASKS).astype(np.int32)
                first = starts[asked]
                n = starts[asked + 1] - first
                at = np.flatnonzero(n)
                if len(at):
                    n, first = n.ravel()[at], first.ravel()[at]
                    items = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    found.append(np.repeat(at // len(_MASKS) + low, n) * len(self.lanes) + items)
        w, i = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.lanes)))
        close = np.bitwise_count(lanes[w] ^ self.lanes[i]).sum(axis=1) <= RADIUS
        return w[close], i[close]


class Matcher:
    """Finds a bounded lot of items, as prepared() has them, in texts given as word hashes."""

    _MARKS = 1 << 22

    def __init__(self, items: pa.Table, width: int, least: float):
        self.width, self.least = width, least
        self.ids = items.column("item").to_pylist()
        self.sizes = items.column("n").to_numpy()
        self.bags = [np.frombuffer(b, np.uint64) for b in items.column("bag").to_pylist()]
        prints = np.frombuffer(b"".join(items.column("print").to_pylist()), np.uint8).reshape(len(self.bags), BITS // 8)
        self.index = HammingIndex(prints) if len(self.bags) else None
        grams = np.concatenate([np.zeros(0, np.uint64), *self.bags])
        sizes = np.repeat(self.sizes, [len(b) for b in self.bags]).astype(np.int64)
        order = np.lexsort([sizes, grams])
        grams, sizes = grams[order], sizes[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (sizes[1:] != sizes[:-1])
        grams, self.owners = grams[new], sizes[new]
        self.known, starts = np.unique(grams, return_index=True)
        self.starts = np.append(starts, len(grams))
        self.marks = np.zeros(self._MARKS, bool)
        self.marks[(self.known % np.uint64(self._MARKS)).astype(np.int64)] = True
        self.short = sorted({int(n) for n in self.sizes if n < width})

    def _anchors(self, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """For each item size the starts of all windows that hold one of its items' shingles.

        A text of fewer words than the item is one window, if its shingles are enough to come to least. Other windows have nothing in common with any item, so their similarity is 0.
        """
        out: dict[int, list[np.ndarray]] = defaultdict(list)
        for width in [self.width, *self.short]:
            n = len(hashes) - width + 1
            if n <= 0 or not len(self.known):
                continue
            grams = shingle_hashes(hashes, width)
            places = np.flatnonzero(self.marks[(grams % np.uint64(self._MARKS)).astype(np.int64)])
            at = np.searchsorted(self.known, grams[places])
            at[at == len(self.known)] = 0
            hit = self.known[at] == grams[places]
            at, places = at[hit], places[hit]
            counts = self.starts[at + 1] - self.starts[at]
            sizes = self.owners[np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            places = np.repeat(places, counts)
            for size in np.unique(sizes).tolist():
                if size > len(hashes):
                    if n >= self.least * (size - self.width + 1) - 1e-9:
                        out[size].append(np.zeros(1, dtype=np.int64))
                elif min(size, self.width) == width:
                    own, covered = places[sizes == size], np.zeros(len(hashes) - size + 2, np.int64)
                    np.add.at(covered, np.maximum(0, own - size + width), 1)
                    np.add.at(covered, np.minimum(own, len(hashes) - size) + 1, -1)
                    out[size].append(np.flatnonzero(np.cumsum(covered)[:-1] > 0))
        return {size: np.unique(np.concatenate(starts)) for size, starts in out.items()}

    def find(self, hashes: np.ndarray) -> list[tuple]:
        """(item id, first word, number of words, similarity) of the best window of each item that is similar enough."""
        best: dict[int, tuple[float, int]] = {}
        for size, starts in self._anchors(hashes).items():
            long = min(size, len(hashes))
            span = max(1, long - self.width + 1)
            for part in _runs(starts):
                grams = shingle_hashes(hashes[part[0] : part[-1] + long], min(long, self.width))
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(grams), axis=0, dtype=np.int32)])
                windows, items = self.index.near(np.packbits(sums[span:] - sums[:-span] > 0, axis=1))
                same = self.sizes[items] == size
                for w, i in zip(windows[same].tolist(), items[same].tolist()):
                    score, start = weighted_similarity(grams[w : w + span], self.bags[i]), int(part[w])
                    if score >= self.least and (score, -start) > best.get(i, (-1.0, 0)):
                        best[i] = (score, -start)
        return sorted(((self.ids[i], -start, min(int(self.sizes[i]), len(hashes)), score) for i, (score, start) in best.items()), key=lambda r: (r[1], str(r[0])))


def _runs(starts: np.ndarray) -> list[np.ndarray]:
    """Consecutive starts together, in pieces of at most 4096."""
    runs = np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1)
    return [r[k : k + 4096] for r in runs for k in range(0, len(r), 4096)]


def prepared(items: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """(item, n, bag, print): each item with words, their number, its shingles in order and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            found = [word_hashes(words(t)) for t in part.column("text").to_pylist()]
            some = np.array([len(h) > 0 for h in found], bool)
            bags = [shingle_hashes(h, width) for h in found if len(h)]
            yield pa.RecordBatch.from_arrays(
                [part.column("item").filter(pa.array(some)), pa.array([len(h) for h in found if len(h)], pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary()), pa.array([fingerprint(b).tobytes() for b in bags], pa.binary())],
                ["item", "n", "bag", "print"],
            )

    own = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    schema = T.StructType([own.schema["item"]]).add("n", "long").add("bag", "binary").add("print", "binary")
    return own.mapInArrow(tidy(run), schema)


class Lots:
    """Prepared items as Parquet in the shared folder, read by tasks; a worker keeps the lot that it used last."""

    def __init__(self, items: DataFrame, item_id: str, item_text: str, width: int, least: float, at_once: int):
        spark = items.sparkSession
        self.width, self.least = width, least
        self.folder = f"{ensure_checkpoint_dir(spark)}/items-{uuid.uuid4().hex}"
        table = prepared(items, item_id, item_text, width)
        self.n = max(1, -(-items.count() // at_once))
        lot = F.pmod(F.xxhash64("bag"), F.lit(self.n)).cast("int")
        table.withColumn("lot", lot).repartition(self.n, "lot").write.partitionBy("lot").parquet(self.folder)
        self.schema = pa.schema([("item", to_arrow_type(items.schema[item_id].dataType)), ("n", pa.int64()), ("bag", pa.binary()), ("print", pa.binary())])

    def matcher(self, lot: int) -> Matcher:
        def load() -> Matcher:
            system, root = place(self.folder)
            found = system.get_file_info(pa.fs.FileSelector(f"{root}/lot={lot}", allow_not_found=True))
            parts = [pq.ParquetFile(system.open_input_file(f.path)).read().select(self.schema.names) for f in found if f.path.endswith(".parquet")]
            return Matcher(pa.concat_tables([p.cast(self.schema) for p in parts]) if parts else self.schema.empty_table(), self.width, self.least)

        return kept(("lot", self.folder, lot), load)

    def search(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        """Batches with what each row's text holds, of all lots."""
        held, size = [], 0
        for part in text_slices(batches, column):
            hashes = [word_hashes(words(t)) for t in part.column(column).to_pylist()]
            held.append((part, hashes, [[] for _ in hashes]))
            size += sum(8 * len(h) for h in hashes)
            if self.n == 1 or size >= _HELD:
                yield from self._matched(held)
                held, size = [], 0
        yield from self._matched(held)

    def _matched(self, held: list[tuple]) -> Iterator[tuple]:
        for lot in range(self.n) if held else ():
            matcher = self.matcher(lot)
            for _, hashes, found in held:
                for h, rows in zip(hashes, found):
                    rows += matcher.find(h)
        yield from ((part, found) for part, _, found in held)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, least: float = 0.8, at_once: int = 20_000
) -> DataFrame:
    """Find benchmark items in documents, wherever they stand.

    Every window of as many words as an item (a document of fewer words is one window as
    a whole) that shares a shingle of width words with one gets a SimHash; the Hamming
    index gives all items within the radius, and those whose weighted shingle similarity
    with the window is at least least are found.

    Returns (id_col, item_id, first_word, n_words, similarity), n_words being the
    window's, one row for each input row and item found in it, with the best window (the
    first of equals). Items shorter than width count as one shingle; null or empty texts
    and items match nothing; null or repeated ids pass through. Repeated items are each
    reported. Other columns aren't read. Without rows on either side the result is empty.

    Items are held by tasks in lots of about at_once rows, so memory is bounded whatever
    their number; the documents are read once. The lots stay in the folder of checkpoints.
    """
    ship(docs.sparkSession)
    lots = Lots(items, item_id, item_text, width, least, at_once)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("item", items.schema[item_id].dataType)]).add("first_word", "long").add("n_words", "long").add("similarity", "double")
    kind = lots.schema.field("item").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in lots.search(batches, "text"):
            rows = [r for own in found for r in own]
            if rows:
                item, first, n, score = zip(*rows)
                ids = part.column("id").take(pa.array(np.repeat(np.arange(len(found)), [len(own) for own in found])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, kind), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["id", "item", "first_word", "n_words", "similarity"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "first_word", "n_words", "similarity")


def uncontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, least: float = 0.8, at_once: int = 20_000
) -> DataFrame:
    """The rows of docs, with all their columns, in which contaminated() would find no item.

    Rows with null or empty texts stay, as do all rows if there are no items; equal rows
    stay or go together. An empty table stays empty. No document is shuffled.
    """
    ship(docs.sparkSession)
    lots = Lots(items, item_id, item_text, width, least, at_once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in lots.search(batches, text_col):
            yield part.filter(pa.array([not own for own in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
