"""Writing catalogs (SNK1), and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimful.operators.catalog import coverage


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; where that is unset, a local folder on a local master, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="brimful-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read again, so that several uses compute it once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def catalog_meta(products: DataFrame, note: str = "") -> DataFrame:
    """One row about a catalog: counts, sources and a note."""
    sources = products.agg(F.array_sort(F.collect_set("source")).alias("sources"))  # the few names of the sources
    return coverage(products).withColumn("note", F.lit(note)).join(F.broadcast(sources))


def write_catalog(products: DataFrame, path: str, note: str = "") -> None:
    """Products by name in ranges, sorted within each file, and a one-row meta table beside them."""
    products.repartitionByRange(F.lower("name")).sortWithinPartitions(F.lower("name")).write.mode("overwrite").parquet(f"{path}/products")
    catalog_meta(products, note).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
