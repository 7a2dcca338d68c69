"""Judging lists: implausible prices, categories, quality, spread (AG1-AG7, AG9, ST6, SNK5, SNK6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_references(items: DataFrame, min_sample: int = 4) -> DataFrame:
    """(list_id, category, reference): the median of the lower half, its middle price included.

    Prices are counted by value before any window, so a list with many items costs as many rows as it has
    distinct prices.
    """
    counts = items.where("price_cents is not null").groupBy("list_id", "category", "price_cents").agg(F.count("*").alias("n"))
    group = Window.partitionBy("list_id", "category")
    upto = F.sum("n").over(group.orderBy("price_cents"))
    half = F.floor((F.sum("n").over(group) + 1) / 2)
    rows = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(group)).withColumn("half", half)
    low, high = F.floor((F.col("half") + 1) / 2), F.floor((F.col("half") + 2) / 2)
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("price_cents")))
    return rows.groupBy("list_id", "category").agg(F.max("total").alias("total"), ((at(low) + at(high)) / 2).alias("reference")).where(F.col("total") >= min_sample).select("list_id", "category", "reference")


def doubt_prices(items: DataFrame, multiple: float = 20.0, min_sample: int = 4) -> DataFrame:
    """items with `reference` and `doubted`: the price exceeds so many times the reference of its list and category."""
    known = items.join(price_references(items, min_sample), ["list_id", "category"], "left")
    return known.withColumn("doubted", F.coalesce(F.col("price_cents") > multiple * F.col("reference"), F.lit(False)))


def withdraw_outliers(items: DataFrame, multiple: float = 20.0, min_sample: int = 4) -> DataFrame:
    """items whose doubted prices are NULL."""
    price = F.when(~F.col("doubted"), F.col("price_cents"))
    return doubt_prices(items, multiple, min_sample).withColumn("price_cents", price).select(*items.columns)


def infer_category(items: DataFrame, floor: int = 4, majority: float = 0.5) -> DataFrame:
    """Items of unknown category take the category of the list's majority, if there is one."""
    counts = items.where("category <> 'unknown'").groupBy("list_id", "category").agg(F.count("*").alias("n"))
    lists = counts.groupBy("list_id").agg(F.sum("n").alias("total"), F.max_by(F.struct("category", "n"), F.struct("n", "category")).alias("top"))
    winner = (F.col("total") >= floor) & (F.col("top.n") > majority * F.col("total")) & (F.col("top.category") != "nonAlcoholic")
    found = lists.where(winner).select("list_id", F.col("top.category").alias("inferred"))
    category = F.when((F.col("category") == "unknown") & F.col("inferred").isNotNull(), F.col("inferred")).otherwise(F.col("category"))
    return items.join(found, "list_id", "left").withColumn("category", category).select(*items.columns)


def quality_gate(items: DataFrame, min_items: int = 8, min_fraction: float = 0.25) -> DataFrame:
    """(list_id, items, priced, fraction, low_confidence)."""
    out = items.groupBy("list_id").agg(F.count("*").alias("items"), F.count("price_cents").alias("priced")).withColumn("fraction", F.col("priced") / F.col("items"))
    return out.withColumn("low_confidence", (F.col("items") >= min_items) & (F.col("fraction") < min_fraction))


def value_spread(ranked: DataFrame, worth: float = 1.25) -> DataFrame:
    """(list_id, best, worst, best_value, worst_value, ratio, worth_mentioning) of lists with two ranked items or more."""
    out = ranked.groupBy("list_id").agg(F.count("*").alias("n"), F.min_by(F.struct("name", "value"), "rank").alias("b"), F.max_by(F.struct("name", "value"), "rank").alias("w"))
    out = out.where((F.col("n") >= 2) & (F.col("b.value") > 0) & (F.col("w.value") > 0)).withColumn("ratio", F.col("b.value") / F.col("w.value"))
    return out.select("list_id", F.col("b.name").alias("best"), F.col("w.name").alias("worst"), F.col("b.value").alias("best_value"), F.col("w.value").alias("worst_value"), "ratio", (F.col("ratio") >= worth).alias("worth_mentioning"))


def provenance_counts(ranked: DataFrame) -> DataFrame:
    """(list_id, read, estimated, any_estimate) over `abv_estimated` and `size_estimated`."""
    return ranked.groupBy("list_id").agg(F.count_if(~F.col("abv_estimated")).alias("read"), F.count_if("abv_estimated").alias("estimated"), F.bool_or(F.col("abv_estimated") | F.col("size_estimated")).alias("any_estimate"))


def outcomes(resolved: DataFrame) -> DataFrame:
    """(list_id, ranked, needs_price, excluded): how many of each, and the names of the latter two in item order."""
    names = lambda status: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("item_no", "name")))), lambda x: x["name"])
    return resolved.groupBy("list_id").agg(F.count_if(F.col("status") == "ranked").alias("ranked"), names("needs_price").alias("needs_price"), names("excluded").alias("excluded"))


def number_text(x: Column) -> Column:
    """A number to four places without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", F.round(x, 4)), r"\.?0+$", "")


def session_headers(resolved: DataFrame) -> DataFrame:
    """(list_id, ranked, needs_price, excluded, priced, items, fraction, low_confidence, read, estimated) of every list.

    The last two split the ranked items by where their strength comes from.
    """
    ranked = F.col("status") == "ranked"
    counts = resolved.groupBy("list_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ranked", "needs_price", "excluded")), F.count_if(ranked & ~F.col("abv_estimated")).alias("read"), F.count_if(ranked & F.col("abv_estimated")).alias("estimated"))
    return counts.join(quality_gate(resolved), "list_id")


def session_report(ranked: DataFrame, resolved: DataFrame) -> DataFrame:
    """(list_id, kind, place, text): the header (see session_headers()), ranked rows with value, price, strength, size and category, then names without price, then excluded names."""
    mark = lambda flag: F.when(F.col(flag), " est").otherwise(" read")
    row = F.concat(F.col("name"), F.lit(" | "), number_text(F.col("value")), F.lit(" | $"), number_text(F.col("price_cents") / 100), F.lit(" | "), number_text(F.col("abv")), F.lit("%"), mark("abv_estimated"), F.lit(" | "), number_text(F.col("size_oz")), F.lit("oz"), mark("size_estimated"), F.lit(" | "), F.col("category"))
    rest = resolved.where("status <> 'ranked'").select("list_id", F.col("status").alias("kind"), F.col("item_no").cast("long").alias("place"), F.col("name").alias("text"))
    head = F.format_string("%d ranked, %d without price, %d excluded; %d of %d priced%s; strength %d read, %d estimated", "ranked", "needs_price", "excluded", "priced", "items", F.when(F.col("low_confidence"), " (few)").otherwise(""), "read", "estimated")
    heads = session_headers(resolved).select("list_id", F.lit("header").alias("kind"), F.lit(0).cast("long").alias("place"), head.alias("text"))
    return heads.unionByName(ranked.select("list_id", F.lit("ranked").alias("kind"), F.col("rank").cast("long").alias("place"), row.alias("text"))).unionByName(rest)
