"""Byte-pair encoding and decoding with a byte-level vocabulary file.

Each pre-token is merged with a heap of merge ranks over a doubly linked list of
symbols; entries whose pair has changed since they were pushed are skipped.
Decoding concatenates the bytes that the vocabulary strings stand for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.deploy import ship
from millrace.llm.kept import kept, tidy
from millrace.llm.text import text_slices

#: White space as Unicode's White_Space property has it (Python's own class has four control characters more).
_WS = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the published split pattern of byte-level BPE vocabularies, with its white space spelt out.
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: A token never crosses the place before a space that something other than white space follows.
_SEAM = rf" (?=[^{_WS}])"
#: Entries that a worker remembers of each kind before it starts anew.
_REMEMBER = 400_000
_SHIFT = 40


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class _Memo(dict):
    """A dictionary that computes what it lacks and starts anew when full, so memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        if len(self) >= _REMEMBER:
            self.clear()
        value = self._make(key)
        if len(key) <= 64:
            self[key] = value
        return value


class ByteBPE:
    """One vocabulary, ready to encode and decode.

    encode() gives ids as little-endian unsigned 32-bit integers, as the tokenizers
    library has them without special tokens added; special tokens written in the
    text are recognised. decode() replaces invalid UTF-8.
    """

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, pre = data["model"], data.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer or prefix space is needed")
        vocab: dict[str, int] = model["vocab"]
        symbols = _byte_symbols()
        self._of_byte = [vocab.get(symbols[b]) for b in range(256)]
        self._ranks: dict[int, int] = {}
        self._merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self._ranks.setdefault(vocab[left] << 20 | vocab[right], rank)
            self._merged.append(vocab[left + right])
        back = {s: b for b, s in symbols.items()}
        self._bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self._special = {}
        for token in data.get("added_tokens", []):
            if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
                raise ValueError("added tokens that take neighbouring text aren't supported")
            self._special[token["content"]] = token["id"]
            self._bytes[token["id"]] = token["content"].encode()
        found = sorted(self._special, key=len, reverse=True)
        self._cutter = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
        self._split, self._seam = regex.compile(_SPLIT), re.compile(_SEAM)
        self._piece = _Memo(lambda s: self._pack(self.merge(s.encode("utf-8", "surrogatepass"))))
        self._inner = _Memo(lambda s: self._chunk(" " + s))

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self._of_byte[b] for b in piece]
        if None in ids:
            ids = [i for i in ids if i is not None]  # as the library does without an unknown token
        n = len(ids)
        if n < 2:
            return ids
        ranks, merged = self._ranks, self._merged
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [r << _SHIFT | i for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            rank, at = entry >> _SHIFT, entry & ((1 << _SHIFT) - 1)
            right = after[at]
            if ids[at] < 0 or right < 0 or ranks.get(ids[at] << 20 | ids[right]) != rank:
                continue  # stale: one of its symbols has gone into another merge
            ids[at], ids[right] = merged[rank], -1
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
                if (r := ranks.get(ids[at] << 20 | ids[after[at]])) is not None:
                    heapq.heappush(heap, r << _SHIFT | at)
            if (left := before[at]) >= 0 and (r := ranks.get(ids[left] << 20 | ids[at])) is not None:
                heapq.heappush(heap, r << _SHIFT | left)
        return [i for i in ids if i >= 0]

    def _chunk(self, text: str) -> bytes:
        return b"".join([self._piece[s] for s in self._split.findall(text)])

    def _segment(self, text: str) -> bytes:
        first, *rest = self._seam.split(text)
        return self._chunk(first) + b"".join(map(self._inner.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if not self._cutter or not self._cutter.search(text):
            return self._segment(text)
        parts = self._cutter.split(text)
        return b"".join(self._special[p].to_bytes(4, "little") if k % 2 else self._segment(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self._bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def tokenizer(spec: str) -> ByteBPE:
    """The tokenizer of a vocabulary file's text; a worker builds it once."""
    return kept(("bpe", hashlib.sha256(spec.encode()).hexdigest()), lambda: ByteBPE(spec))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row for each input row, in any order: id_col, ids (binary: the token
    ids as little-endian unsigned 32-bit integers), n_tokens and decoded. A null text
    counts as empty: no ids and an empty decoded text. Ids may be null or repeated,
    other columns are not read. vocabulary is the path of the file on the driver,
    which sends its text along.
    """
    ship(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    out = pa.schema([("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec)
        for part in text_slices(batches, "text"):
            ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
            columns = [pa.array(ids, out.field(0).type), pa.array(map(bpe.decode, ids), out.field(1).type)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", *out.names])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    coded = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
    return coded.select(F.col("id").alias(id_col), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "decoded")
