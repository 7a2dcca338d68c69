"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text with its spaces shown as the vocabulary's space mark is cut before each run of spaces, and where none comes
for LONGEST characters, as in scripts without spaces, after so many; no piece crosses such a cut, so the lattice of
a text is the row of its segments' lattices. Forward sums over a
segment's lattice are computed once for every distinct segment while a bounded cache holds it; backward sampling
then runs over all segments of a block at once, one piece a round. The random numbers are hashes of (seed, row key, segment
number, round) and choices are made in integers, so a row's segmentation depends on nothing else.

Pieces of the BPE vocabulary are weighed by rank: log weight = -log(2 + rank) / temperature. A character
without a piece, and a literal space mark, is spelled in byte pieces, so decoding gives back every text.

Defined cases: a null or empty text is the segment of the leading space alone; a null key counts as an
own fixed key; rows with the same key and text are sampled alike; a very long text is a block of its own; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from brimful.llm.common import blocks, mix64, texts, utf8

MARK = "▁"
TOP = 0x110000  # above every character
LITERAL_MARK = "\udc81"  # cannot occur in decoded UTF-8
#: Nodes in a worker's cache; beyond it the cache starts anew, and the next blocks fill it again.
MAX_NODES = 1_200_000
BLOCK_BYTES = 1 << 20
#: Characters of a segment at most; all segments of a block advance together, so this also bounds the rounds.
LONGEST = 256
#: A bound above every draw.
ALWAYS = np.uint32((1 << 32) - 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _pieces(path: str) -> tuple[list[bytes], dict[int, int], list[tuple[str, int]]]:
    """(bytes of every id, id of every byte, pieces from the best to the worst with their ids)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw, of_byte, scores = [b""] * model.get_piece_size(), {}, []
    for i in range(len(raw)):
        if model.is_byte(i):
            of_byte[int(model.id_to_piece(i)[3:5], 16)] = i
            raw[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            scores.append((-model.get_score(i), i))
            raw[i] = model.id_to_piece(i).replace(MARK, " ").encode()
    return raw, of_byte, [(model.id_to_piece(i), i) for _, i in sorted(scores)]


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.whole, self.size = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        while len(self.whole) < self.size + len(values):
            self.whole = np.concatenate([self.whole, np.zeros_like(self.whole)])
        self.whole[self.size : self.size + len(values)] = values
        self.size += len(values)


class Lattices:
    """Lattices of distinct segments in flat arrays: a node's incoming edges stand in a row from `edge`.

    An edge has its token, how many nodes it goes back, and the draws below which it is taken. A segment's
    units are its characters, and the bytes of characters without a piece (as codes above all characters), so
    every edge is one token. A trie over the pieces, walked from all units at once, finds the edges.
    """

    def __init__(self, path: str, temperature: float) -> None:
        _, of_byte, best = _pieces(path)
        self.pieces = {piece: (i, -math.log(2 + rank) / temperature) for rank, (piece, i) in enumerate(best)}
        steps: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for codes, found in [*((list(map(ord, p)), f) for p, f in self.pieces.items()), *(([TOP + b], (i, 0.0)) for b, i in of_byte.items())]:
            state = 0
            for code in codes:
                state = steps.setdefault(state << 21 | code, len(steps) + 1)
            ends[state] = found
        self.steps = pd.Index(np.fromiter(steps, np.int64, len(steps)))  # step k leads to state k + 1
        self.ends = np.full(len(steps) + 1, -1, np.int32)
        self.weight = np.zeros(len(steps) + 1)
        for state, (i, w) in ends.items():
            self.ends[state], self.weight[state] = i, w
        self.single = np.zeros(TOP + 256, bool)
        self.single[[ord(p) for p in self.pieces if len(p) == 1]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.head, self.tail = Column(np.int64), Column(np.int64)  # nodes of a segment
        self.edge = Column(np.int64)
        self.below, self.back, self.token = Column(np.uint32), Column(np.int16), Column(np.int32)

    def _units(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(units of all segments in a row, units of each)."""
        shown = [s.replace(MARK, LITERAL_MARK).replace(" ", MARK) for s in segments]
        codes = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, shown), np.int64, len(shown))
        strange = np.flatnonzero(~self.single[codes])
        if not len(strange):
            return codes, size
        spelled = [(MARK if c == ord(LITERAL_MARK) else chr(c)).encode("utf-8", "replace") for c in codes[strange].tolist()]
        takes = np.ones(len(codes), np.int64)
        takes[strange] = list(map(len, spelled))
        units, at = np.repeat(codes, takes), np.cumsum(takes) - takes
        for i, own in zip(at[strange].tolist(), spelled, strict=True):
            units[i : i + len(own)] = [TOP + b for b in own]
        return units, np.add.reduceat(takes, np.cumsum(size) - size)

    def add(self, segments: list[bytes]) -> None:
        units, size = self._units([s.decode("utf-8", "replace") for s in segments])
        begin = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        limit = (begin + size)[segment]
        begins, lengths, states = [], [], []
        at, state, length = np.arange(len(units)), np.zeros(len(units), np.int64), 0
        while len(at):
            step = self.steps.get_indexer(state << 21 | units[at + length])
            hit = step >= 0
            at, state, length = at[hit], step[hit] + 1, length + 1
            whole = self.ends[state] >= 0
            begins.append(at[whole])
            states.append(state[whole])
            lengths.append(np.full(int(whole.sum()), length))
            inside = at + length < limit[at]
            at, state = at[inside], state[inside]
        start, state = np.concatenate(begins), np.concatenate(states)
        end = start + np.concatenate(lengths)
        own = segment[start]
        depth = end - begin[own]
        order = np.lexsort((start, own, depth))
        start, end, own, depth, state = (x[order] for x in (start, end, own, depth, state))
        origin, target = start + own, end + own  # a segment has one node more than units
        forward = np.full(len(units) + len(size), -np.inf)
        forward[begin + np.arange(len(size))] = 0.0
        below = np.zeros(len(start), np.uint32)
        levels = np.append(np.flatnonzero(np.diff(depth, prepend=0)), len(depth))
        for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            goes, value = target[lo:hi], forward[origin[lo:hi]] + self.weight[state[lo:hi]]
            heads = np.flatnonzero(np.diff(goes, prepend=-1))
            sizes = np.diff(np.append(heads, hi - lo))
            top = np.maximum.reduceat(value, heads)
            weight = np.exp(value - np.repeat(top, sizes))
            total = np.add.reduceat(weight, heads)
            forward[goes[heads]] = top + np.log(total)
            done = np.cumsum(weight)
            done -= np.repeat(done[heads] - weight[heads], sizes)
            part = np.minimum(done / np.repeat(total, sizes) * 2.0**32, ALWAYS)
            part[np.append(heads[1:], hi - lo) - 1] = ALWAYS
            below[lo:hi] = part.astype(np.uint32)
        order = np.lexsort((origin, target))
        edges = np.bincount(target, minlength=len(forward))
        heads = begin + np.arange(len(size)) + self.edge.size
        self.number.update(zip(segments, range(self.head.size, self.head.size + len(segments)), strict=True))
        self.head.append(heads)
        self.tail.append(heads + size)
        self.edge.append(np.cumsum(edges) - edges + self.token.size)
        self.below.append(below[order])
        self.back.append((target - origin)[order])
        self.token.append(self.ends[state[order]])

    def sample(self, texts: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): sampled ids of the texts in a row; keys are unsigned 64-bit seeds."""
        if self.edge.size > MAX_NODES:
            self.clear()
        ends = offsets - offsets[0]
        shown = np.insert(texts[offsets[0] : offsets[-1]], ends[:-1], ord(" "))  # each text with a leading space
        ends = ends + np.arange(len(ends))
        space = shown == ord(" ")
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[ends[:-1]] = True
        cuts = np.flatnonzero(cut)
        if len(cuts) and np.diff(cuts, append=len(shown)).max() > LONGEST:
            begins = (shown & 0xC0) != 0x80
            place = np.cumsum(begins) - 1
            place -= np.repeat(place[cuts], np.diff(cuts, append=len(shown)))  # of a character in its segment
            cuts = np.flatnonzero(cut | begins & (place % LONGEST == 0))
        bounds = np.append(cuts, len(shown)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(shown)])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            self.add([distinct[i] for i in new.tolist()])
            number[new] = [self.number[distinct[i]] for i in new.tolist()]
        number = number[coded.indices.to_numpy()]
        first = np.searchsorted(cuts, ends)  # of the segments of each text
        within = (np.arange(len(cuts)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
        seed = mix64(np.repeat(keys, np.diff(first)) + within * np.uint64(0x9E3779B97F4A7C15))
        head, node = self.head.whole[number], self.tail.whole[number]
        below, taken, own, turn = self.below.whole, [], np.arange(len(cuts)), 0
        while len(own):
            draw = mix64(seed + np.uint64((turn + 1) * 0xD1342543DE82EF95 % (1 << 64))) >> np.uint64(32)
            draw = np.minimum(draw, ALWAYS - 1).astype(np.uint32)
            edge = self.edge.whole[node]
            beyond = np.flatnonzero(draw >= below[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[draw[beyond] >= below[edge[beyond]]]
            taken.append((own, self.token.whole[edge]))
            node = node - self.back.whole[edge]
            live = node > head
            own, node, head, seed = own[live], node[live], head[live], seed[live]
            turn += 1
        sizes = np.zeros(len(cuts), np.int64)
        for k, (own, _) in enumerate(taken):
            sizes[own] = k + 1
        done = np.append(0, np.cumsum(sizes))
        out = np.zeros(done[-1], np.int32)
        for k, (own, ids) in enumerate(taken):
            out[done[own + 1] - 1 - k] = ids
        return done[first], out


_open: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, temperature: float) -> Lattices:
    if (path, temperature) not in _open:
        _open[path, temperature] = Lattices(path, temperature)
    return _open[path, temperature]


def sample_pieces(docs: DataFrame, path: str | None = None, seed: int = 0, temperature: float = 0.25) -> DataFrame:
    """(doc_id, ids array) for every row of docs."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lattices(path, temperature)
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            keys = mix64(batch.column("doc_id").fill_null(-1).to_numpy().astype(np.uint64) ^ mix64(np.array([seed + 1], np.uint64)))
            for lo, hi in blocks(offsets, BLOCK_BYTES):
                ends, ids = known.sample(data, offsets[lo : hi + 1], keys[lo:hi])
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), column], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def joined_pieces(raw: pa.Array, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Texts of rows of ids: their pieces in a row without the leading space."""
    pieces = raw.take(pa.array(ids))
    at = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1][ends]
    whole = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: at[-1]]
    led = at[1:] > at[:-1]
    at, whole = at - np.append(0, np.cumsum(led)), np.delete(whole, at[:-1][led])
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(led), [None, pa.py_buffer(at), pa.py_buffer(whole)])
    try:
        return rows.cast(pa.string())
    except pa.ArrowInvalid:  # ids that no encoder gave may spell half a character
        return pa.array([row.decode("utf-8", "replace") for row in rows.to_pylist()], pa.string())


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text) from (doc_id, ids); null ids are no ids, and no ids are the empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pa.array(_pieces(path)[0], pa.large_binary())
        for batch in batches:
            column = batch.column("ids")
            flat = column.flatten().to_numpy().astype("<u4")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(sizes))
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(crcs, pa.int64()), joined_pieces(raw, ends, flat)], names=["doc_id", "n_pieces", "ids_crc32", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text string")
