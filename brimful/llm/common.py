"""Shared pieces: scratch tables in the cluster's shared folder and Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; where that is unset, a local folder on a local master, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="brimful-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(tables: list[DataFrame]) -> None:
    """Deletes the files of tables of written() that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text becomes the empty text, other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_digest(text: F.Column) -> F.Column:
    """What tells unlike texts apart; a null text is the empty text."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def is_key(rows: DataFrame) -> bool:
    """Whether doc_id has no nulls and no repeats."""
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def keyed(rows: DataFrame, null_first: bool) -> DataFrame:
    """(key, doc_id, digest, text): one row for each distinct (doc_id, text) of `rows` of texts(), keys ascending by doc_id and digest."""
    once = rows.withColumn("digest", text_digest(F.col("text"))).groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
    by_id = F.col("doc_id").asc_nulls_first() if null_first else F.col("doc_id").asc_nulls_last()
    return written(once.orderBy(by_id, "digest").select(F.monotonically_increasing_id().alias("key"), "doc_id", "digest", "text"), "keyed")


def by_key(rows: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """rows (doc_id, digest, ...) with the columns `names` of values (doc_id, digest, ...); null doc_ids meet null doc_ids."""
    right = values.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), *names)
    return rows.join(right, rows["doc_id"].eqNullSafe(right["__id"]) & (rows["digest"] == right["__digest"])).drop("__id", "__digest")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls are empty."""
    kind = pa.large_binary()
    column = pc.fill_null(column.cast(kind), pa.scalar(b"", kind))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def text_blocks(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes each; a longer text stands alone."""
    for lo, hi in blocks(utf8(batch.column("text"))[0], limit):
        yield batch.slice(lo, hi - lo)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words of a text (split at ASCII white space) and a stable 64-bit hash of each."""
    import xxhash

    words = raw.split()
    return words, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out
