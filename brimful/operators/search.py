"""Ranked name search and matching of lines to products (SR1-SR5, JN9, JN10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brimful.functions.text import fold, match_tier, words
from brimful.functions.vocabulary import GENERIC_WORDS

GRAM = 3


def index_catalog(catalog: DataFrame) -> DataFrame:
    """catalog with `folded`, the search form of its name; names that fold to nothing are not searchable."""
    return catalog.withColumn("folded", fold(F.col("name"))).where("folded <> ''")


def pieces(text: Column, width: int = GRAM) -> Column:
    """All distinct substrings of 1 to `width` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)))
    every = F.flatten(F.transform(at, lambda i: F.array(*(F.substring(text, i, F.lit(n)) for n in range(1, width + 1)))))
    return F.filter(F.array_distinct(every), lambda x: x != "")


def piece_index(texts: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(__text, __piece): which of the `wanted` pieces (__piece) each distinct text holds; pieces nobody wants never leave their task."""
    own = texts.select(F.col(text).alias("__text")).distinct()
    return own.select("__text", F.explode(pieces(F.col("__text"))).alias("__piece")).join(wanted, "__piece", "left_semi")


def substring_join(texts: DataFrame, text: str, keys: DataFrame, key: str) -> DataFrame:
    """Each row of texts beside each row of keys whose `key` is in its `text`; an empty key is in none.

    They meet by one piece of the key, of GRAM characters or the whole of a shorter key: the one that the fewest
    texts hold, so that common letters make no large group. Keys without such a piece in any text drop out at once.
    Only distinct texts and keys are compared; the rows' other columns join the pairs that are found.
    """
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - GRAM + 1))
    own = F.transform(at, lambda i: F.substring(F.col(key), i, F.lit(GRAM)))
    asked = keys.select(key).where(F.col(key) != "").distinct().select(F.col(key).alias("__key"), F.explode(F.array_distinct(own)).alias("__piece"))
    index = piece_index(texts, text, asked.select("__piece").distinct())
    rated = asked.join(index.groupBy("__piece").agg(F.count("*").alias("__held")), "__piece")
    rarest = rated.groupBy("__key").agg(F.min_by("__piece", F.struct("__held", "__piece")).alias("__piece"))
    pairs = index.join(rarest, "__piece").where(F.contains("__text", "__key")).select("__text", "__key")
    return texts.join(pairs, texts[text] == pairs["__text"]).join(keys, F.col("__key") == keys[key]).drop("__text", "__key")


def _longest(text: Column) -> Column:
    return F.array_max(F.transform(words(text), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def search(catalog: DataFrame, queries: DataFrame, limit: int = 40) -> DataFrame:
    """(query_id, place, tier, product columns): the best products of each query, by tier, length and name.

    `catalog` has product_id and name, `queries` query_id and query. An empty query finds nothing. Ties in
    all three end in product_id.
    """
    names = catalog if "folded" in catalog.columns else index_catalog(catalog)
    asked = queries.select("query_id", fold(F.col("query")).alias("asked")).where("asked <> ''").withColumn("first_word", _longest(F.col("asked")))
    # Whatever the tier, a name contains every word of the query. Products of one folded name share all but product_id, so
    # queries meet the distinct names, and of each name only the first `limit` products can be among the best.
    hits = substring_join(names.select("folded").distinct(), "folded", asked, "first_word").withColumn("tier", match_tier(F.col("folded"), F.col("asked"))).where("tier is not null")
    order = (F.col("tier"), F.length("folded"), F.col("folded"))
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= limit).drop("place", "first_word")
    among = F.row_number().over(Window.partitionBy("folded").orderBy("product_id"))
    kept = names.withColumn("__among", among).where(F.col("__among") <= limit).drop("__among")
    by_query = Window.partitionBy("query_id").orderBy(*order, "product_id")
    columns = [*names.columns, "query_id", "asked", "tier", "place"]
    ranked = kept.join(best, "folded").withColumn("place", F.row_number().over(by_query).cast("long")).where(F.col("place") <= limit).select(*columns)
    return ranked


def product_count(catalog: DataFrame) -> DataFrame:
    return index_catalog(catalog).agg(F.count("*").alias("products"))


def specific_match(lines: DataFrame, catalog: DataFrame, generic: list[str] = GENERIC_WORDS, depth: int = 12) -> DataFrame:
    """(query_id, product columns): the product that each line names.

    Of the `depth` best hits of a line's text, the first that has two words or more as the line has, whose words
    contain the line's or are contained in them, with a shared word that is not generic.
    """
    found = search(catalog, lines, depth)
    ours, theirs = F.array_distinct(words(F.col("asked"))), F.array_distinct(words(F.col("folded")))
    inside = (F.size(F.array_except(ours, theirs)) == 0) | (F.size(F.array_except(theirs, ours)) == 0)
    telling = F.size(F.array_except(F.array_intersect(ours, theirs), F.array(*map(F.lit, generic)))) > 0
    good = found.where((F.size(ours) >= 2) & (F.size(theirs) >= 2) & inside & telling)
    keep = [c for c in good.columns if c not in ("query_id", "place", "tier", "asked")]
    return good.groupBy("query_id").agg(F.min_by(F.struct(*keep), "place").alias("r")).select("query_id", "r.*")
