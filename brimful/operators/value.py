"""Ranking by value (VL3, VL5-VL7, ED4, JN13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brimful.functions.money import dollars, standard_drinks, value_of


def _ranked(df: DataFrame, keys: tuple[str, ...], k: int | None) -> DataFrame:
    """`rank` by value, then name, then item_no; with k only the best k, which Spark prunes before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "name", "item_no")
    out = df.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def split_offers(offers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rankable, needs price, excluded): disjoint, and together all rows."""
    alcoholic = F.coalesce(F.col("category") != "nonAlcoholic", F.lit(True))
    priced = F.coalesce(F.col("price_cents") > 0, F.lit(False))
    return offers.where(alcoholic & priced), offers.where(alcoholic & ~priced), offers.where(~alcoholic)


def rank_offers(offers: DataFrame, metric: str = "std", keys: tuple[str, ...] = ("list_id",), k: int | None = None) -> DataFrame:
    """Priced alcoholic offers with `value` and `rank`, 1 the best of its list."""
    rows = split_offers(offers)[0]
    return _ranked(rows.withColumn("value", value_of(F.col("size_oz"), F.col("abv"), F.col("price_cents"), metric)), keys, k)


def rank_packages(packages: DataFrame, keys: tuple[str, ...] = ("list_id",), k: int | None = None) -> DataFrame:
    """Priced packages with total_oz, drinks, value per dollar, dollars per drink (infinite without alcohol) and rank."""
    total = F.col("unit_oz") * F.greatest(F.lit(1), F.col("count"))
    rows = packages.where("price_cents > 0").withColumn("total_oz", total)
    drinks = standard_drinks(F.col("total_oz"), F.col("abv"))
    per_drink = F.when(F.col("drinks") > 0, dollars(F.col("price_cents")) / F.col("drinks")).otherwise(F.lit(float("inf")))
    rows = rows.withColumn("drinks", drinks).withColumn("value", value_of(F.col("total_oz"), F.col("abv"), F.col("price_cents"))).withColumn("dollars_per_drink", per_drink)
    return _ranked(rows, keys, k)


def share_of_best(ranked: DataFrame, keys: tuple[str, ...] = ("list_id",)) -> DataFrame:
    """`share` of the list's best value, from 0.04 to 1; 0 where the best is not positive."""
    best = F.max("value").over(Window.partitionBy(*keys))
    return ranked.withColumn("share", F.when(best > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.04), F.col("value") / best))).otherwise(0.0))
