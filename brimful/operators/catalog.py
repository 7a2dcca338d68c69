"""Building a catalog: union, fill by barcode, de-duplicate (JN1-JN5, JN11, AG7, SNK2, SNK3, CAT10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brimful.functions.text import lookup_upc

FIELDS = ("abv", "ml", "units")
COLUMNS = ("source", "source_rank", "row_seq", "name", "category", "abv", "ml", "units", "upc")


def _order() -> Column:
    """Place of a row in order of trust."""
    return F.struct("source_rank", "row_seq")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of sources that come in order of trust; each gets its place as source_rank."""
    ranked = [s.withColumn("source_rank", F.lit(i)).select(*COLUMNS) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked)


def enrich_by_upc(products: DataFrame) -> DataFrame:
    """Missing fields filled with the first stated value of the same barcode, in order of trust.

    Rows without a barcode stay out of the shuffle. First values are aggregates, which combine before it.
    """
    coded = products.where("upc is not null")
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), _order())).alias(f"first_{f}") for f in FIELDS]
    known = coded.groupBy("upc").agg(*first)
    filled = [F.coalesce(c, f"first_{c}").alias(c) if c in FIELDS else F.col(c) for c in products.columns]
    return coded.join(known, "upc").select(*filled).unionByName(products.where("upc is null"))


def dedupe(products: DataFrame) -> DataFrame:
    """One row for each barcode, or name and size without one: the row with most fields, the most trusted on ties."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    best = F.min_by(F.struct(*products.columns), F.struct((-filled).alias("missing"), "source_rank", "row_seq")).alias("r")
    coded = products.where("upc is not null").groupBy("upc").agg(best)
    named = products.where("upc is null").groupBy(F.lower("name").alias("k"), F.col("ml").alias("m")).agg(best)
    return coded.select("r.*").unionByName(named.select("r.*"))


def build_catalog(*sources: DataFrame) -> DataFrame:
    """union_sources, enrich_by_upc and dedupe in one.

    Once filled, all rows of a barcode state the same fields, so the most trusted row of each wins and one
    aggregation by barcode does both steps.
    """
    return fill_and_dedupe(union_sources(*sources))


def fill_and_dedupe(products: DataFrame) -> DataFrame:
    rest = [c for c in products.columns if c not in (*FIELDS, "upc")]
    kept = F.min_by(F.struct(*rest), _order()).alias("r")
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), _order())).alias(f) for f in FIELDS]
    coded = products.where("upc is not null").groupBy("upc").agg(kept, *first).select("r.*", "upc", *FIELDS)
    return coded.select(*products.columns).unionByName(dedupe(products.where("upc is null")))


def fill_report(before: DataFrame) -> DataFrame:
    """(filled_abv, filled_ml, filled_units): how many gaps a barcode fills."""
    coded = before.where("upc is not null")
    have = coded.groupBy("upc").agg(*(F.count(f).alias(f) for f in FIELDS), F.count("*").alias("n"))
    gaps = [F.coalesce(F.sum(F.when(F.col(f) > 0, F.col("n") - F.col(f))), F.lit(0)).alias(f"filled_{f}") for f in FIELDS]
    return have.agg(*gaps)


def coverage(products: DataFrame) -> DataFrame:
    """One row: products, and how many state each field, also in whole percent."""
    out = products.agg(F.count("*").alias("products"), *(F.count(c).alias(f"with_{c}") for c in ("abv", "ml", "upc", "units")))
    percents = [F.when(F.col("products") > 0, F.floor(F.col(f"with_{c}") * 100 / F.col("products"))).otherwise(0).cast("long").alias(f"percent_{c}") for c in ("abv", "ml", "upc", "units")]
    return out.select("*", *percents)


def require_abv(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a strength, one row with the number of those left out)."""
    return products.where("abv is not null"), products.agg(F.count_if(F.col("abv").isNull()).alias("dropped"))


def lookup(catalog: DataFrame, codes: DataFrame) -> DataFrame:
    """codes (upc) with the product of the same barcode; of several products the last one, NULL where none has it."""
    key = catalog.where("upc is not null").withColumn("code", lookup_upc(F.col("upc")))
    last = key.groupBy("code").agg(F.max_by(F.struct("name", "category", "abv", "ml", "units"), _order()).alias("product"))
    return codes.withColumn("code", lookup_upc(F.col("upc"))).join(last, "code", "left").drop("code")


def curated_catalog(brands: DataFrame) -> DataFrame:
    """A brand table as a catalog: the first brand of each label in priority order, no size or barcode."""
    first = brands.groupBy("label").agg(F.min_by(F.struct("category", "abv"), "priority").alias("b"))
    return first.select(F.col("label").alias("name"), "b.category", "b.abv", F.lit(None).cast("double").alias("ml"), F.lit(None).cast("int").alias("units"), F.lit(None).cast("string").alias("upc"))


def map_headers(columns: list[str], wanted: dict[str, list[str]]) -> tuple[dict[str, str], list[str]]:
    """({field: column}, fields without one): for each field the first phrase that some lower-cased header contains."""
    found: dict[str, str] = {}
    for field, phrases in wanted.items():
        hit = next((c for phrase in phrases for c in columns if phrase in c.lower()), None)
        if hit is not None:
            found[field] = hit
    return found, [f for f in wanted if f not in found]


def profile_source(rows: DataFrame, order: str = "row_seq") -> DataFrame:
    """(column, filled, total, first, second, rows): filled cells of each column, its first two samples and the cells of the first three rows, in row order."""
    columns = [c for c in rows.columns if c != order]
    cells = rows.select(F.col(order).alias("o"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("o", columns, "column", "value")
    stated = F.trim("value") != ""
    counts = cells.groupBy("column").agg(F.count_if(stated).alias("filled"), F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("o"))
    samples = cells.where(stated).withColumn("place", place).where("place <= 2").groupBy("column").agg(F.max(F.when(F.col("place") == 1, F.col("value"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("value"))).alias("second"))
    top = rows.orderBy(order).limit(3).select(F.col(order).alias("o"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("o", columns, "column", "value")
    heads = top.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda x: F.coalesce(x.value, F.lit(""))).alias("rows"))
    return counts.join(samples, "column", "left").join(heads, "column", "left").withColumn("rows", F.array_join("rows", " | "))
