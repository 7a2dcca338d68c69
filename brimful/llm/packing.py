"""Packing token ids into fixed windows by best-fit decreasing.

Tokenizing cuts every document into full windows and one rest. Pieces are dealt by the hash of
their columns to shards of a fixed number of tokens, so a shard's size does not grow with the input
and a very long document is spread. In a shard the rests go, longest first, each into the open window
with the least remaining room that still takes it; a segment tree over remaining capacities finds it.

Defined cases: a null or empty text is the end id alone; equal rows give equal pieces, each placed once;
a null doc_id is kept, and pieces without one are dealt by their other columns; a very long text is cut like any
other; an empty table gives no pieces; further columns of the documents are ignored, those of the pieces travel along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimful.llm.common import text_blocks, texts
from brimful.llm.tokens import default_path, word_ids

WINDOW = 4096
#: Bytes of text whose tokens make one shard: some hundred windows, so the last open one hardly counts.
SHARD_TEXT_BYTES = 8 << 20
#: Texts whose words are looked up together.
BLOCK_TEXT_BYTES = 2 << 20


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): every document's ids cut into full windows and a rest."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for whole in batches:
            for batch in text_blocks(whole, BLOCK_TEXT_BYTES):
                ends, ids = known.texts(batch.column("text"), end_id)
                size = np.diff(ends)
                parts = -(-size // window)
                doc = np.repeat(np.arange(len(size)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                bounds = np.append(ends[doc] + start, len(ids)).astype(np.int32) * 4
                cuts = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
                columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(np.minimum(window, size[doc] - start)), pa.array(size[doc]), cuts]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return texts(docs).mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


class RoomTree:
    """Segment tree over the remaining capacities 0..window-1: how many open windows have each."""

    def __init__(self, window: int) -> None:
        self.size = 1 << max(1, math.ceil(math.log2(window)))
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for `need`."""
        if need >= self.size:
            return None
        at = self.size + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) for each length, which comes in descending order."""
    tree, rooms = RoomTree(window), 0
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        found = tree.take(need) if need < window else None
        room, which = found or (window, rooms)
        rooms += found is None
        numbers[i], offsets[i] = which, window - room
        if room > need:
            tree.put(room - need, which)
    return numbers, offsets


def place(cut: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `window` tokens, in place of columns of these names."""
    cut = cut.drop("sequence_id", "offset")

    def fit(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        numbers, shard["offset"] = best_fit_decreasing(shard["length"].to_numpy(), window)
        shard["sequence_id"] = (int(key[0]) << 32) + numbers
        return shard

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    dealt = cut.groupBy(F.pmod(F.xxhash64(*cut.columns), F.lit(shards)).cast("int"))
    return dealt.applyInPandas(fit, f"{schema}, offset long, sequence_id long")


def shard_count(docs: DataFrame) -> int:
    """Shards for the whole table, from its bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(size / SHARD_TEXT_BYTES))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """Packed pieces with their ids (little-endian unsigned 32-bit), sequence_id and offset."""
    return place(pieces(docs, path, window, end_id), shard_count(docs), window)
