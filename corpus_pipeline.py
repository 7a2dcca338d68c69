"""From raw documents to packed training sequences: five stages, each written before the next one reads it.

Documents have doc_id, text, lang and n_chars; a column named source is used where there is one, others are kept as they are,
whatever their names. In every stage a null text is the empty text, texts of any length are read whole, and an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimful.llm.common import by_key, is_key, keyed, text_digest, texts, written
from brimful.llm.minhash_dedup import keep_one
from brimful.llm.packing import pieces, place, shard_count
from brimful.llm.pii import redact
from brimful.llm.quality_rules import keep_good
from brimful.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; rows with null, repeated or equal doc_ids are judged one by one, by their texts and lang alone."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; empty ones are no duplicates, unlike texts with one doc_id or none are documents of their own."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; characters that a passage cuts in two go whole.

    Unlike texts with one doc_id, or with none, are documents of their own, earlier or later by their digest; rows
    with equal texts and one doc_id are one document, so each of them stays.
    """
    rows = texts(docs)
    keys = None if is_key(rows) else keyed(rows, null_first=True)
    kept = remove_repeats(rows if keys is None else keys, id_col="doc_id" if keys is None else "key", characters=True)
    kept = kept.select("doc_id", F.col("kept").cast("string").alias("left"))
    if keys is None:
        joined = docs.drop("text").join(kept.select("doc_id", F.col("left").alias("text")), "doc_id")
    else:
        named = keys.select("key", "doc_id", "digest").join(kept.withColumnRenamed("doc_id", "key"), "key")
        boxed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
        return by_key(boxed, named, "left").select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; row by row, so ids do not matter."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences; an empty document is its end id alone, rows with one doc_id are packed each for itself."""
    cut = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(cut, shard_count(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("suffix dedup", suffix_dedup), ("personal data", private_data), ("packing", packing)]

#: Suffix sorting, signatures and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
