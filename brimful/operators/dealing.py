"""Dealing groups of rows to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """rows with equal keys together, in as many partitions as spark.sql.shuffle.partitions says.

    The number is stated because adaptive execution would merge partitions by their bytes, and reading lists and cutting
    pages takes far more time for a byte than other work. Windows and folds by the same keys need no other shuffle.
    Rows that will each become several take `times` as many partitions, so that what a task holds stays small.
    """
    return rows.repartition(times * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
