"""Removal of passages that also occur in an earlier document, by distributed suffix sorting.

A position is removed if it is covered by a string of `width` bytes that also starts in a document with
a smaller doc_id. Two equal windows of that width choose the same anchor inside them (the least hash of
all their `gram`-byte substrings, leftmost on ties), so windows can only be equal within an anchor's
bucket, and only there they are sorted:

1. Every document's windows are cut into runs that share an anchor. An anchor is dealt to its bucket as
   two hashes: of its gram and of the whole run's bytes.
2. A bucket answers for each run: unique gram, nothing to do; the same run stands in an earlier document,
   all its windows go; or first of its kind beside other runs of that gram, its bytes are needed. So
   copies are collapsed to one run each before any text is dealt.
3. The bytes of those runs go to the bucket, whose suffixes are sorted deep-shallow; in each group of
   equal windows all but those of the smallest doc_id go. Where more than HOT_RUNS different runs share a
   gram (the edges of a passage that many documents have), their windows are dealt one by one instead, by a
   hash of their bytes; equal ones of a chunk are first collapsed to those of its smallest doc_id.
4. The ranges return to their documents and are cut out.

Documents are handled in chunks dealt by the hash of doc_id; the number of buckets grows with the input, so that
their usual size does not, and so does that of chunks up to MOST_CHUNKS: messages between them grow no faster than the input. In step 2 all runs of one gram meet in one bucket, 20 bytes
each; in step 3 a window that every chunk has comes once from each chunk. Hashes of runs (64 bits within one gram's bucket)
stand for their bytes in step 2.

Defined cases: a null or empty text has no windows; a null doc_id is smaller than every other; rows with
the same doc_id never remove from each other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimful.llm.common import mix64, texts, utf8
from brimful.llm.suffix_sort import sort_windows

WIDTH, GRAM = 50, 24
CHUNK_TEXT_BYTES, BUCKET_TEXT_BYTES = 2 << 20, 4 << 20
#: Every chunk has a message for nearly every bucket. So beyond so many chunks they grow, up to a size that a task holds with ease.
MOST_CHUNKS, MOST_CHUNK_BYTES = 1024, 32 << 20
SEGMENT = 1 << 19
#: Different runs of one gram above which their windows are dealt one by one.
HOT_RUNS = 1024
#: An odd multiplier of the rolling hash, and a fixed random value for each byte.
BASE = 0x9E3779B97F4A7C15 | 1
VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
NO_ID = np.iinfo(np.int64).min

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 4 * WIDTH)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64))) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


class Runs:
    """Runs of windows with one anchor: doc (index), start (in the document), count (windows), gram and run hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> None:
        parts = []
        lo, n = 0, len(offsets) - 1
        while lo < n:  # rows together up to a segment; a longer document in overlapping segments
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SEGMENT, "right")) - 1)
            hi = min(hi, n)
            for at in range(int(offsets[lo]), max(int(offsets[hi]) - width + 1, int(offsets[lo]) + 1), SEGMENT):
                end = min(at + SEGMENT + width - 1, int(offsets[hi]))
                if end - at >= width:
                    parts.append(_runs_of(data[at:end], at, offsets[lo : hi + 1], lo, width, gram))
            lo = hi
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        self.doc, self.start, self.count, self.gram, self.run = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else none


def _runs_of(data: np.ndarray, at: int, offsets: np.ndarray, first_doc: int, width: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUES[data] * power[:n], out=sums[1:])
    least = mix64((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    shift = np.zeros(len(least), np.uint8)
    span, need = 1, width - gram + 1
    while span < need:
        step = min(span, need - span)
        right = least[step:] < least[:-step]
        shift = np.where(right, shift[step:] + np.uint8(step), shift[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    begins = np.arange(len(least), dtype=np.int64)  # of windows
    doc = np.searchsorted(offsets, begins + at, "right") - 1
    good = begins + at + width <= offsets[doc + 1]
    begins, doc = begins[good], doc[good]
    if not len(begins):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    anchor = begins + shift[good]
    cut = np.ones(len(begins), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(begins)))
    lo, doc = begins[first], doc[first]
    hi = lo + count - 1 + width
    run = mix64((sums[hi] - sums[lo]) * inverse[lo] + count.astype(np.uint64))
    return doc + first_doc, lo + at - offsets[doc], count, least[begins[first]], run


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _documents(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, offsets, bytes) of a chunk in a fixed order."""
    ids = chunk.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()
    text = chunk.column("text").combine_chunks()
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        every = text.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], every[i])))
    offsets, data = utf8(text.take(pa.array(order)))
    return ids[order], offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(bucket[own[0]]), own


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("codes", pa.binary())])
SEND = pa.schema([("goes_to", pa.int64()), ("is_text", pa.bool_()), ("chunk", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary()), ("doc_index", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()), ("bytes", pa.binary())])
CUTS = pa.schema([("chunk", pa.int64()), ("doc_index", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def answer(messages: pa.Table, hot_runs: int = HOT_RUNS) -> pa.Table:
    """Codes for the runs of one bucket: 0 nothing, 1 an earlier document has the same run, 2 its bytes are needed, 3 its windows are."""
    grams = [_unpack(x, "<u4") for x in messages.column("grams").to_pylist()]
    if not grams:
        return _table([], ANSWER)
    runs = np.concatenate([np.frombuffer(x, "<u8") for x in messages.column("runs").to_pylist()])
    docs = np.concatenate([np.cumsum(_unpack(x, "<i8")) for x in messages.column("docs").to_pylist()])
    ends = np.cumsum([len(g) for g in grams])
    gram = np.concatenate(grams)
    order = np.lexsort((docs, runs, gram))
    gram, runs, docs = gram[order], runs[order], docs[order]
    new_gram = np.append(True, gram[1:] != gram[:-1])
    new_run = new_gram | np.append(True, runs[1:] != runs[:-1])
    at_gram, at_run = np.flatnonzero(new_gram), np.flatnonzero(new_run)
    which_gram, which_run = np.cumsum(new_gram) - 1, np.cumsum(new_run) - 1
    several = np.maximum.reduceat(docs, at_gram) != np.minimum.reduceat(docs, at_gram)
    kinds = np.add.reduceat(new_run.astype(np.int64), at_gram)
    code = np.where(docs > docs[at_run][which_run], 1, np.where(kinds[which_gram] > hot_runs, 3, np.where(kinds[which_gram] > 1, 2, 0))) * several[which_gram]
    codes = np.zeros(len(order), np.uint8)
    codes[order] = code
    rows = []
    for chunk, bucket, lo, hi in zip(messages.column("chunk").to_pylist(), messages.column("bucket").to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
        if codes[lo:hi].any():
            rows.append((chunk, bucket, _pack(codes[lo:hi])))
    return _table(rows, ANSWER)


def single_windows(data: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, first, hashes of first) of the windows at `at`: those equal to one of a smaller id, the others, and a hash of their bytes."""
    padded = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    _, kind = np.unique(padded.view(f"V{padded.shape[1]}").ravel(), return_inverse=True)
    least = np.full(kind.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    later = ids > least[kind]
    first = np.flatnonzero(~later)
    hashes = np.zeros(len(first), np.uint64)
    for column in padded[first].view(np.uint64).T:
        hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + column)
    return np.flatnonzero(later), first, hashes


def sort_bucket(messages: pa.Table, width: int = WIDTH) -> pa.Table:
    """Ranges of windows that an earlier document has too, from the run texts of one bucket."""
    rows = messages.select(["chunk", "grams", "docs", "doc_index", "starts", "counts", "bytes"]).to_pylist()
    if not rows:
        return _table([], CUTS)
    docs, index, starts, counts = (np.concatenate([_unpack(r[k], "<i8") for r in rows]) for k in ("docs", "doc_index", "starts", "counts"))
    chunk = np.repeat([r["chunk"] for r in rows], [len(_unpack(r["docs"], "<i8")) for r in rows])
    data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["bytes"]) for r in rows), np.uint8)
    begins = np.concatenate([[0], np.cumsum(counts + width - 1)[:-1]])
    run = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, groups = sort_windows(data, begins[run] + within, width)
    owner = docs[run[order]]
    least = np.minimum.reduceat(owner, groups)
    later = owner > np.repeat(least, np.diff(np.append(groups, len(order))))
    gone = np.sort(order[later])
    run, within = run[gone], within[gone]
    cut = np.append(True, (run[1:] != run[:-1]) | (within[1:] != within[:-1] + 1))[: len(run)]
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(run)))
    run, lo = run[first], starts[run[first]] + within[first]
    out = [(int(c), _pack(index[run[own]]), _pack(lo[own]), _pack(size[own])) for c, own in _by_bucket(chunk[run])]
    return _table(out, CUTS)


def sent_runs(dealt: DataFrame, n_buckets: int, width: int = WIDTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Rows of SEND: what goes for certain, and what must be sorted in bucket goes_to; dealt has (doc_id, text, chunk)."""
    mod = np.uint64(n_buckets)

    def ask(key: tuple, chunk: pa.Table) -> pa.Table:
        ids, offsets, data = _documents(chunk)
        runs = Runs(data, offsets, width, gram)
        out = []
        for bucket, own in _by_bucket(((runs.gram >> np.uint64(32)) % mod).astype(np.int64)):
            out.append((bucket, key[0].as_py(), _pack(runs.gram[own].astype("<u4")), runs.run[own].tobytes(), _pack(np.diff(ids[runs.doc[own]], prepend=0))))
        return _table(out, ASK)

    def send(key: tuple, chunk: pa.Table, codes: pa.Table) -> pa.Table:
        found = {b: _unpack(c, "u1") for b, c in zip(codes.column("bucket").to_pylist(), codes.column("codes").to_pylist(), strict=True)}
        if not found or not len(chunk):
            return _table([], SEND)
        ids, offsets, data = _documents(chunk)
        runs, which = Runs(data, offsets, width, gram), int(chunk.column("chunk")[0].as_py())
        out, gone, hot = [], [], []
        for bucket, own in _by_bucket(((runs.gram >> np.uint64(32)) % mod).astype(np.int64)):
            if bucket not in found:
                continue
            code = found[bucket]
            gone.append(own[code == 1])
            hot.append(own[code == 3])
            own = own[code == 2]
            if len(own):
                lo = offsets[runs.doc[own]] + runs.start[own]
                parts = [data[a:b] for a, b in zip(lo, lo + runs.count[own] + width - 1, strict=True)]
                out.append((bucket, True, which, _pack(runs.gram[own].astype("<u4")), _pack(ids[runs.doc[own]]), _pack(runs.doc[own]), _pack(runs.start[own]), _pack(runs.count[own]), _pack(np.concatenate(parts))))
        gone = np.sort(np.concatenate(gone)) if gone else np.zeros(0, np.int64)
        if len(gone):
            out.append((which, False, which, b"", b"", _pack(runs.doc[gone]), _pack(runs.start[gone]), _pack(runs.count[gone]), b""))
        hot = np.concatenate(hot) if hot else np.zeros(0, np.int64)
        if len(hot):
            count = runs.count[hot]
            doc = np.repeat(runs.doc[hot], count)
            start = np.repeat(runs.start[hot] - np.cumsum(count) + count, count) + np.arange(count.sum())
            later, first, hashes = single_windows(data, offsets[doc] + start, ids[doc], width)
            if len(later):
                out.append((which, False, which, b"", b"", _pack(doc[later]), _pack(start[later]), _pack(np.ones(len(later), np.int64)), b""))
            for bucket, own in _by_bucket((hashes % mod).astype(np.int64)):
                own = first[own]
                parts = np.lib.stride_tricks.sliding_window_view(data, width)[offsets[doc[own]] + start[own]]
                out.append((bucket, True, which, b"", _pack(ids[doc[own]]), _pack(doc[own]), _pack(start[own]), _pack(np.ones(len(own), np.int64)), _pack(parts)))
        return _table(out, SEND)

    def codes_of(key: tuple, messages: pa.Table) -> pa.Table:
        return answer(messages, hot_runs)

    by_chunk = dealt.groupBy("chunk")
    codes = by_chunk.applyInArrow(ask, _ddl(ASK)).groupBy("bucket").applyInArrow(codes_of, _ddl(ANSWER))
    return by_chunk.cogroup(codes.groupBy("chunk")).applyInArrow(send, _ddl(SEND))


def whole_characters(gone: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of all UTF-8 characters that lose a byte; no character crosses the offsets."""
    if not len(data):
        return gone
    leads = (data & 0xC0) != 0x80
    leads[offsets[:-1][np.diff(offsets) > 0]] = True
    first = np.flatnonzero(leads)
    return np.repeat(np.logical_or.reduceat(gone, first), np.diff(np.append(first, len(data))))


def dealing(size: int) -> tuple[int, int]:
    """(chunks, buckets) of so many bytes of text."""
    chunk = min(MOST_CHUNK_BYTES, max(CHUNK_TEXT_BYTES, math.ceil(size / MOST_CHUNKS)))
    return max(8, math.ceil(size / chunk)), max(8, math.ceil(size / BUCKET_TEXT_BYTES))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS, characters: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs.

    With `characters`, a character that a removed passage cuts in two goes whole.
    """
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks, n_buckets = dealing(size)

    def cut(key: tuple, chunk: pa.Table, cuts: pa.Table) -> pa.Table:
        if not len(chunk):
            return _table([], KEPT)
        ids, offsets, data = _documents(chunk)
        covered = np.zeros(len(data) + 1, np.int32)
        for index, starts, counts in zip(*(cuts.column(c).to_pylist() for c in ("doc_index", "starts", "counts")), strict=True):
            lo = offsets[_unpack(index, "<i8")] + _unpack(starts, "<i8")
            np.add.at(covered, lo, 1)
            np.add.at(covered, lo + _unpack(counts, "<i8") + width - 1, -1)
        gone = np.cumsum(covered[:-1]) > 0
        gone = whole_characters(gone, data, offsets) if characters else gone
        out = []
        for doc_id, a, b in zip(ids.tolist(), offsets[:-1], offsets[1:], strict=True):
            mask = gone[a:b]
            spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) and mask[0]))
            removed = int(np.count_nonzero(mask))
            out.append((None if doc_id == NO_ID else doc_id, int(b - a), removed, spans, (data[a:b][~mask] if removed else data[a:b]).tobytes()))
        return _table(out, KEPT)

    def settle(key: tuple, messages: pa.Table) -> pa.Table:
        return sort_bucket(messages, width) if key[1].as_py() else messages.select(CUTS.names)

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks))).repartition("chunk")
    by_chunk = dealt.groupBy("chunk")
    sent = sent_runs(dealt, n_buckets, width, gram, hot_runs)
    cuts = sent.groupBy("goes_to", "is_text").applyInArrow(settle, _ddl(CUTS))
    return by_chunk.cogroup(cuts.groupBy("chunk")).applyInArrow(cut, _ddl(KEPT))
