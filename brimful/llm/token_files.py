"""Token ids in ORC files.

Documents are dealt to files by ranges of doc_id and sorted, so file and row order is the order of the
documents. Ids are an integer column (run-length encoded in stripes), with row indexes and a Bloom
filter on doc_id, so readers can take stripes in parallel and skip those without the documents wanted.
Each row carries its file's number and its ids' position in the file; a table of one row per file turns
that into a position in the whole output.

Defined cases: a null or empty text is the end id alone; rows with equal ids stand side by side; a null
doc_id comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brimful.llm.common import text_blocks, texts
from brimful.llm.packing import BLOCK_TEXT_BYTES
from brimful.llm.tokens import default_path, word_ids

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Rows of the files, in ranges of doc_id."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = word_ids(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in text_blocks(whole, BLOCK_TEXT_BYTES):
                ends, ids = known.texts(batch.column("text"), end_id)
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                columns = [batch.column("doc_id"), pa.array(np.full(len(batch), part, np.int32)), pa.array(at + ends[:-1]), pa.array(np.diff(ends)), column]
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "ids"])

    return texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, FILE_SCHEMA)


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000) -> None:
    options = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": row_index_stride, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    encode(docs, path, end_id).write.options(**options).orc(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows with `start`, the number of ids in all documents before."""
    rows = spark.read.schema(FILE_SCHEMA).orc(out)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; the filter reaches the files' statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(out).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read(): the ids are hashed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), counts, pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
