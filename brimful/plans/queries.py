"""Registered queries: each applies operators to whole tables, with the same result in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimful.functions import lines as L
from brimful.functions import money as M
from brimful.functions import sizes as S
from brimful.functions import text as T
from brimful.operators import catalog as C
from brimful.operators import evaluate as E
from brimful.operators import knowledge as K
from brimful.operators import lists as R
from brimful.operators import quality as Q
from brimful.operators import search as H
from brimful.operators import sessions as D
from brimful.operators import value as V
from brimful.plans.adapters import CATALOG, EDITS, LINES, OFFERS, PACKAGES, QUERIES, RAW, SESSIONS, adapt, sql_of
from brimful.sources.sinks import materialized

Query = Callable[[SparkSession, str], DataFrame]
QUERY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **tables: str) -> Callable[[Query], Query]:
    """Registers a query; `sql` may use the names in `tables`, which become its first WITH clauses."""

    def register(function: Query) -> Query:
        QUERY[function.__name__] = function
        if sql is not None:
            heads = ", ".join(f"{name} AS MATERIALIZED ({sql_of(text)})" for name, text in tables.items())
            own = sql.strip()
            word = "WITH RECURSIVE " if own.startswith("WITH RECURSIVE ") else "WITH "
            SQL[function.__name__] = (f"{word}{heads}" if heads else "") + (", " + own.removeprefix(word) if heads and own.startswith("WITH ") else " " + own)
        return function

    return register


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of price lists, written once, since reading lists takes them twice."""
    return materialized(adapt(spark, sf_dir, LINES), "lines")


VALUE = "CASE WHEN price_cents > 0 THEN greatest(0e0, size_oz) * (greatest(0e0, abv) / 100) / 0.6e0 / (price_cents / 100e0) ELSE 0e0 END"
RANKED = f"SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY value DESC, name, item_no) AS rank FROM (SELECT *, {VALUE} AS value FROM o WHERE category <> 'nonAlcoholic' AND price_cents > 0) v"


@query(RANKED, o=OFFERS)
def value_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VL1, VL2, VL3: offers of each list ranked by standard drinks per dollar."""
    return V.rank_offers(adapt(spark, sf_dir, OFFERS))


@query(f"SELECT * FROM ({RANKED}) r WHERE rank <= 3", o=OFFERS)
def value_podium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VL6: the best three of each list."""
    return V.rank_offers(adapt(spark, sf_dir, OFFERS), k=3)


@query(RANKED.replace("/ 0.6e0", "* (29.5735e0 * 0.789e0) * 7.1e0"), o=OFFERS)
def value_rank_calories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ED4: the same offers ranked under the other metric."""
    return V.rank_offers(adapt(spark, sf_dir, OFFERS), metric="cal")


@query(f"SELECT *, CASE WHEN max(value) OVER (PARTITION BY list_id) > 0 THEN least(1e0, greatest(0.04e0, value / max(value) OVER (PARTITION BY list_id))) ELSE 0e0 END AS share FROM ({RANKED}) r", o=OFFERS)
def value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VL7: each offer's share of its list's best value."""
    return V.share_of_best(V.rank_offers(adapt(spark, sf_dir, OFFERS)))


@query(
    """SELECT list_id, item_no, price_cents, greatest(0e0, size_oz) * (greatest(0e0, abv) / 100) AS ethanol, value * (price_cents / 100e0) AS drinks,
    CASE WHEN CAST(round(size_oz * 100) AS INT) > 0 THEN CAST(round(size_oz * 100) AS INT) END AS cents, TRY_CAST(trim(translate('$' || CAST(size_oz AS VARCHAR(30)), '$,', '')) AS DOUBLE) AS typed,
    size_oz / 29.5735e0 AS oz, size_oz * 29.5735e0 AS ml FROM (SELECT *, """ + VALUE + """ AS value FROM o) v""",
    o=OFFERS,
)
def value_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VL1, VL8, VL9, VL10, SZ3: the scalar conversions."""
    c, oz = F.col, F.col("size_oz")
    rows = adapt(spark, sf_dir, OFFERS).withColumn("value", M.value_of(oz, c("abv"), c("price_cents")))
    return rows.select("list_id", "item_no", "price_cents", M.ethanol_oz(oz, c("abv")).alias("ethanol"), M.drinks_from_value(c("value"), c("price_cents")).alias("drinks"), M.price_cents(oz).alias("cents"), M.parse_money(F.concat(F.lit("$"), oz.cast("string"))).alias("typed"), M.ml_to_oz(oz).alias("oz"), M.oz_to_ml(oz).alias("ml"))


@query(
    """SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY value DESC, name, item_no) AS rank FROM (
    SELECT *, CASE WHEN drinks > 0 THEN price_cents / 100e0 / drinks ELSE CAST('Infinity' AS DOUBLE) END AS dollars_per_drink, drinks / (price_cents / 100e0) AS value FROM (
    SELECT *, greatest(0e0, total_oz) * (greatest(0e0, abv) / 100) / 0.6e0 AS drinks FROM (SELECT *, unit_oz * greatest(1, count) AS total_oz FROM p WHERE price_cents > 0) a) b) c""",
    p=PACKAGES,
)
def package_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VL4, VL5: packages ranked, with dollars per standard drink; columns in the order of the SQL."""
    ranked = V.rank_packages(adapt(spark, sf_dir, PACKAGES))
    return ranked.select("list_id", "item_no", "name", "unit_oz", "count", "abv", "price_cents", "total_oz", "drinks", "dollars_per_drink", "value", "rank")


@query(
    """SELECT list_id, CAST(count(*) FILTER (category <> 'nonAlcoholic' AND price_cents > 0) AS BIGINT) AS ranked, CAST(count(*) FILTER (category <> 'nonAlcoholic' AND coalesce(price_cents, 0) <= 0) AS BIGINT) AS needs_price, CAST(count(*) FILTER (category = 'nonAlcoholic') AS BIGINT) AS excluded FROM o GROUP BY list_id""",
    o=OFFERS,
)
def offer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, AG9: every offer is ranked, lacks a price or is excluded."""
    parts = V.split_offers(adapt(spark, sf_dir, OFFERS))
    rows = [p.select("list_id", F.lit(name).alias("status")) for name, p in zip(("ranked", "needs_price", "excluded"), parts, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("list_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ranked", "needs_price", "excluded")))


RESOLVED = "SELECT list_id, item_no, name, price_cents, CASE WHEN category = 'nonAlcoholic' THEN 'excluded' WHEN price_cents > 0 THEN 'ranked' ELSE 'needs_price' END AS status, item_no % 3 = 0 AS abv_estimated FROM (" + OFFERS + ") o"


@query(
    "SELECT list_id, count(*) FILTER (status = 'ranked') AS ranked, coalesce(string_agg(name, '; ' ORDER BY item_no) FILTER (status = 'needs_price'), '') AS needs_price, coalesce(string_agg(name, '; ' ORDER BY item_no) FILTER (status = 'excluded'), '') AS excluded FROM r GROUP BY list_id",
    r=RESOLVED,
)
def session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, AG9: what becomes of the items of each list, with names in order."""
    named = Q.outcomes(adapt(spark, sf_dir, RESOLVED))
    return named.select("list_id", "ranked", *(F.array_join(c, "; ").alias(c) for c in ("needs_price", "excluded")))


@query(
    """SELECT list_id, count(*) FILTER (status = 'ranked') AS ranked, count(*) FILTER (status = 'needs_price') AS needs_price, count(*) FILTER (status = 'excluded') AS excluded, count(price_cents) AS priced, count(*) AS items,
      count(price_cents) / count(*) AS fraction, count(*) >= 8 AND count(price_cents) / count(*) < 0.25 AS low_confidence, count(*) FILTER (status = 'ranked' AND NOT abv_estimated) AS read, count(*) FILTER (status = 'ranked' AND abv_estimated) AS estimated FROM r GROUP BY list_id""",
    r=RESOLVED,
)
def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: the header of each list's report."""
    return Q.session_headers(adapt(spark, sf_dir, RESOLVED))


REFERENCE = """
p AS (SELECT list_id, category, list_sort(list(price_cents)) AS prices, (count(*) + 1) // 2 AS half FROM o WHERE price_cents IS NOT NULL GROUP BY list_id, category HAVING count(*) >= 4),
r AS (SELECT list_id, category, (prices[(half + 1) // 2] + prices[(half + 2) // 2]) / 2e0 AS reference FROM p)
"""


@query(f"WITH {REFERENCE} SELECT o.list_id, o.item_no, o.name, CASE WHEN o.price_cents > 20 * r.reference THEN NULL ELSE o.price_cents END AS price_cents, o.abv, o.size_oz, o.category FROM o LEFT JOIN r ON o.list_id = r.list_id AND o.category = r.category", o=OFFERS)
def price_withdraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1: prices over twenty times the lower quartile of their list and category are withdrawn."""
    return Q.withdraw_outliers(adapt(spark, sf_dir, OFFERS))


@query(f"WITH {REFERENCE} SELECT o.list_id, o.item_no, r.reference FROM o JOIN r ON o.list_id = r.list_id AND o.category = r.category WHERE o.price_cents > 4 * r.reference", o=OFFERS)
def price_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2: which rows the rule doubts, at a tighter multiple."""
    return Q.doubt_prices(adapt(spark, sf_dir, OFFERS), multiple=4.0).where("doubted").select("list_id", "item_no", "reference")


@query(
    """WITH c AS (SELECT list_id, category, count(*) AS n FROM o WHERE category <> 'unknown' GROUP BY list_id, category),
    t AS (SELECT list_id, sum(n) AS total, max(n) AS top FROM c GROUP BY list_id), w AS (SELECT c.list_id, c.category FROM c JOIN t ON c.list_id = t.list_id WHERE total >= 4 AND c.n > 0.5 * total AND c.n = top AND category <> 'nonAlcoholic')
    SELECT o.list_id, o.item_no, CASE WHEN o.category = 'unknown' AND w.category IS NOT NULL THEN w.category ELSE o.category END AS category FROM o LEFT JOIN w ON o.list_id = w.list_id""",
    o=OFFERS,
)
def list_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3: unknown items take their list's category."""
    return Q.infer_category(adapt(spark, sf_dir, OFFERS)).select("list_id", "item_no", "category")


@query("SELECT list_id, count(*) AS items, count(price_cents) AS priced, CAST(count(price_cents) AS DOUBLE) / count(*) AS fraction, count(*) >= 8 AND count(price_cents) < 0.25 * count(*) AS low_confidence FROM o GROUP BY list_id", o=OFFERS)
def list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4: how much of each list is priced."""
    return Q.quality_gate(adapt(spark, sf_dir, OFFERS))


@query(f"WITH r AS ({RANKED}) SELECT b.list_id, b.name AS best, w.name AS worst, b.value AS best_value, w.value AS worst_value, b.value / w.value AS ratio, b.value / w.value >= 1.25e0 AS worth_mentioning FROM r b JOIN (SELECT list_id, max(rank) AS n FROM r GROUP BY list_id) m ON b.list_id = m.list_id JOIN r w ON w.list_id = m.list_id AND w.rank = m.n WHERE b.rank = 1 AND m.n >= 2 AND b.value > 0 AND w.value > 0", o=OFFERS)
def list_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5: best and worst of each list."""
    return Q.value_spread(V.rank_offers(adapt(spark, sf_dir, OFFERS)))


@query("SELECT list_id, CAST(count(*) FILTER (item_no % 3 <> 0) AS BIGINT) AS read, CAST(count(*) FILTER (item_no % 3 = 0) AS BIGINT) AS estimated, bool_or(item_no % 3 = 0 OR item_no % 5 = 0) AS any_estimate FROM o GROUP BY list_id", o=OFFERS)
def list_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: how many strengths were read and how many estimated."""
    rows = adapt(spark, sf_dir, OFFERS).withColumn("abv_estimated", F.col("item_no") % 3 == 0).withColumn("size_estimated", F.col("item_no") % 5 == 0)
    return Q.provenance_counts(rows)


@query(
    r"""SELECT row_seq, CASE WHEN length(d) >= 1 AND ltrim(d, '0') <> '' THEN CASE WHEN length(d) < 12 THEN lpad(d, 12, '0') ELSE d END END AS upc,
    CASE WHEN length(d || '00000000000') > 12 THEN regexp_replace(d || '00000000000', '^0+', '') ELSE d || '00000000000' END AS code,
    CASE WHEN TRY_CAST(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE) > 0 AND TRY_CAST(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE) <= 1000 THEN TRY_CAST(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE) END AS amount,
    round(CAST(regexp_replace(proof, '[^0-9]', '', 'g') AS DOUBLE) / 2, 2) AS abv,
    CASE WHEN ml_n <> '' AND CAST(ml_n AS DOUBLE) > 0 THEN CAST(ml_n AS DOUBLE) * CASE WHEN lower(ml_u) = 'ml' THEN 1e0 WHEN lower(ml_u) = 'l' THEN 1000e0 ELSE 29.5735e0 END END AS ml
    FROM (SELECT *, regexp_replace(upc, '[^0-9]', '', 'g') AS d, regexp_extract(name, '([0-9]+(?:\.[0-9]+)?)\s*(ML|oz|L)\b', 1) AS ml_n, regexp_extract(name, '([0-9]+(?:\.[0-9]+)?)\s*(ML|oz|L)\b', 2) AS ml_u FROM raw) x""",
    raw=RAW,
)
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT1, CAT2, CAT3, CAT7, CAT11: barcodes, sizes, numbers and proofs of raw rows."""
    c = F.col
    return adapt(spark, sf_dir, RAW).select("row_seq", T.build_upc(c("upc")).alias("upc"), T.lookup_upc(F.concat(c("upc"), F.lit("00000000000"))).alias("code"), T.clean_float(c("price"), 0, 1000).alias("amount"), T.abv_from_proof(F.lit(None).cast("double"), c("proof")).alias("abv"), T.ml_from_size(c("name")).alias("ml"))


@query(
    r"""SELECT row_seq, CASE WHEN n <> '' AND TRY_CAST(n AS DOUBLE) > 0 THEN round(TRY_CAST(n AS DOUBLE) * CASE lower(u) WHEN 'ml' THEN 1e0 WHEN 'l' THEN 1000e0 ELSE 29.5735e0 END, 1) END AS ml,
    CASE WHEN n <> '' AND TRY_CAST(n AS DOUBLE) > 0 AND k <> '' AND TRY_CAST(k AS INT) BETWEEN 2 AND 48 THEN TRY_CAST(k AS INT) END AS units,
    CASE WHEN n <> '' AND TRY_CAST(n AS DOUBLE) > 0 THEN regexp_replace(regexp_replace(name, '[\s,/-]*\b(?:[0-9]+\s*[/xX*]\s*)?[0-9]+(?:\.[0-9]+)?\s*(ML|L|oz)\b\.?\s*$', ''), '[ ,/-]+$', '') ELSE name END AS cleaned
    FROM (SELECT *, regexp_extract(name, '\b(?:([0-9]+)\s*[/xX*]\s*)?([0-9]+(?:\.[0-9]+)?)\s*(ML|L|oz)\b\.?\s*$', 1) AS k, regexp_extract(name, '\b(?:([0-9]+)\s*[/xX*]\s*)?([0-9]+(?:\.[0-9]+)?)\s*(ML|L|oz)\b\.?\s*$', 2) AS n, regexp_extract(name, '\b(?:([0-9]+)\s*[/xX*]\s*)?([0-9]+(?:\.[0-9]+)?)\s*(ML|L|oz)\b\.?\s*$', 3) AS u FROM raw) x""",
    raw=RAW,
)
def clean_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT4: trailing sizes and multipacks of descriptions."""
    rows = adapt(spark, sf_dir, RAW).withColumn("d", T.size_from_description(F.col("name")))
    return rows.select("row_seq", "d.ml", "d.units", F.col("d.name").alias("cleaned"))


@query(
    """SELECT row_seq, CASE WHEN brand LIKE 'Brand#1%' THEN 'bottledBeer' WHEN lower(name) LIKE '%cider%' THEN 'cider' WHEN type = 'SMALL' THEN 'wineGlass' WHEN type = 'LARGE' THEN CASE WHEN lower(name) LIKE '%cocktail%' THEN 'cocktail' ELSE 'shot' END ELSE 'unknown' END AS category,
    CASE WHEN type = 'ECONOMY' THEN 'bottledBeer' WHEN type = 'PROMO' THEN 'shot' WHEN type = 'SMALL' THEN 'wineGlass' WHEN type = 'LARGE' THEN 'unknown' END AS tag_category FROM raw""",
    raw=RAW,
)
def clean_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT8, CAT9: taxonomies of the sources onto our categories."""
    c = F.col
    kind = F.when(c("brand").startswith("Brand#1"), "Beer").when(c("type") == "SMALL", "Wine").when(c("type") == "LARGE", "Spirits").otherwise("Other")
    tags = F.when(c("type") == "ECONOMY", F.array(F.lit("en:beers"))).when(c("type") == "PROMO", F.array(F.lit("en:vodka"), F.lit("x"))).when(c("type") == "SMALL", F.array(F.lit("en:wines"))).when(c("type") == "LARGE", F.array(F.lit("en:alcoholic"))).otherwise(F.array(F.lit("en:juice")))
    return adapt(spark, sf_dir, RAW).select("row_seq", T.bc_category(kind, c("name"), F.lit("")).alias("category"), T.tag_category(tags).alias("tag_category"))


@query(
    """SELECT row_seq, array_to_string(list_transform(string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS pretty FROM (SELECT row_seq, upper(regexp_replace(name, '[^A-Za-z ]', '', 'g')) AS name FROM raw) r""",
    raw=RAW,
)
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT5, CAT6: shouted names in title case."""
    return adapt(spark, sf_dir, RAW).select("row_seq", T.prettify(F.upper(F.regexp_replace("name", "[^A-Za-z ]", ""))).alias("pretty"))


FILLED = """
f AS (SELECT source, source_rank, row_seq, name, category, upc,
  coalesce(abv, first_value(abv IGNORE NULLS) OVER w) AS abv, coalesce(ml, first_value(ml IGNORE NULLS) OVER w) AS ml, coalesce(units, first_value(units IGNORE NULLS) OVER w) AS units
  FROM c WHERE upc IS NOT NULL WINDOW w AS (PARTITION BY upc ORDER BY source_rank, row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  UNION ALL SELECT source, source_rank, row_seq, name, category, upc, abv, ml, units FROM c WHERE upc IS NULL)
"""
KEPT = """
k AS (SELECT *, row_number() OVER (PARTITION BY upc, CASE WHEN upc IS NULL THEN lower(name) END, CASE WHEN upc IS NULL THEN ml END
  ORDER BY CAST(abv IS NOT NULL AS INT) + CAST(ml IS NOT NULL AS INT) + CAST(units IS NOT NULL AS INT) DESC, source_rank, row_seq) AS n FROM {0})
"""
CATALOG_COLUMNS = "source, source_rank, row_seq, name, category, abv, ml, units, upc"


@query(f"WITH {FILLED} SELECT {CATALOG_COLUMNS} FROM f", c=CATALOG)
def catalog_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: fields missing in a row come from the first row of its barcode."""
    return C.enrich_by_upc(adapt(spark, sf_dir, CATALOG)).select(*C.COLUMNS)


@query(f"WITH {KEPT.format('c')} SELECT {CATALOG_COLUMNS} FROM k WHERE n = 1", c=CATALOG)
def catalog_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: the fullest row of each product."""
    return C.dedupe(adapt(spark, sf_dir, CATALOG)).select(*C.COLUMNS)


@query(f"WITH {FILLED}, {KEPT.format('f')} SELECT {CATALOG_COLUMNS} FROM k WHERE n = 1", c=CATALOG)
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN4: sources united, filled and de-duplicated with one shuffle by barcode."""
    rows = adapt(spark, sf_dir, CATALOG)
    return C.build_catalog(*(rows.where(F.col("source") == s) for s in ("a", "b", "c"))).select(*C.COLUMNS)


@query("SELECT count(*) AS products, count(abv) AS with_abv, count(ml) AS with_ml, count(upc) AS with_upc, count(units) AS with_units, count(abv) * 100 // count(*) AS percent_abv, count(ml) * 100 // count(*) AS percent_ml, count(upc) * 100 // count(*) AS percent_upc, count(units) * 100 // count(*) AS percent_units FROM c", c=CATALOG)
def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7, SNK1: how many products state each field."""
    return C.coverage(adapt(spark, sf_dir, CATALOG))


@query(f"WITH {FILLED} SELECT CAST(count(*) FILTER (c.abv IS NULL AND f.abv IS NOT NULL) AS BIGINT) AS filled_abv, CAST(count(*) FILTER (c.ml IS NULL AND f.ml IS NOT NULL) AS BIGINT) AS filled_ml, CAST(count(*) FILTER (c.units IS NULL AND f.units IS NOT NULL) AS BIGINT) AS filled_units FROM c JOIN f ON c.source_rank = f.source_rank AND c.row_seq = f.row_seq", c=CATALOG)
def catalog_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: how many gaps barcodes fill."""
    return C.fill_report(adapt(spark, sf_dir, CATALOG))


@query("SELECT count(*) AS dropped FROM c WHERE abv IS NULL", c=CATALOG)
def catalog_require_abv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: rows without strength, left out and counted."""
    return C.require_abv(adapt(spark, sf_dir, CATALOG))[1]


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY upc ORDER BY source_rank DESC, row_seq DESC) AS n FROM c WHERE upc IS NOT NULL),
    q AS (SELECT o_orderkey, CAST(100000 + o_orderkey % 1500 AS VARCHAR(20)) AS upc FROM orders)
    SELECT q.o_orderkey, q.upc, l.name, l.abv FROM q LEFT JOIN l ON q.upc = l.upc AND l.n = 1""",
    c=CATALOG,
)
def barcode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, CAT2: products by barcode; the last product of a barcode wins."""
    codes = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit(""), (100000 + F.col("o_orderkey") % 1500).cast("string")).alias("upc"))
    return C.lookup(adapt(spark, sf_dir, CATALOG), codes).select("o_orderkey", "upc", "product.name", "product.abv")


@query(
    "SELECT name, category, abv FROM (SELECT p_brand AS name, p_type AS category, CAST(p_size AS DOUBLE) AS abv, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) b WHERE n = 1",
)
def curated_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: a brand table as a catalog."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("label"), F.col("p_type").alias("category"), F.col("p_size").cast("double").alias("abv"), F.col("p_partkey").alias("priority"))
    return C.curated_catalog(brands).select("name", "category", "abv")


FIRST_ROWS = "(SELECT string_agg(coalesce(CAST({0} AS VARCHAR), ''), ' | ' ORDER BY row_seq) FROM (SELECT * FROM c ORDER BY row_seq LIMIT 3) t)"


@query(
    f"""SELECT 'name' AS "column", count(*) AS filled, count(*) AS total, min_by(name, row_seq) AS "first", (SELECT name FROM c ORDER BY row_seq LIMIT 1 OFFSET 1) AS "second", {FIRST_ROWS.format('name')} AS rows FROM c
    UNION ALL SELECT 'abv', count(abv), count(*), (SELECT CAST(abv AS VARCHAR) FROM c WHERE abv IS NOT NULL ORDER BY row_seq LIMIT 1), (SELECT CAST(abv AS VARCHAR) FROM c WHERE abv IS NOT NULL ORDER BY row_seq LIMIT 1 OFFSET 1), {FIRST_ROWS.format('abv')} FROM c
    UNION ALL SELECT 'upc', count(upc), count(*), (SELECT upc FROM c WHERE upc IS NOT NULL ORDER BY row_seq LIMIT 1), (SELECT upc FROM c WHERE upc IS NOT NULL ORDER BY row_seq LIMIT 1 OFFSET 1), {FIRST_ROWS.format('upc')} FROM c""",
    c=CATALOG,
)
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: filled cells, samples and first rows of each column."""
    return C.profile_source(adapt(spark, sf_dir, CATALOG).select("row_seq", "name", "abv", "upc"))


PRODUCTS = "SELECT p_partkey AS product_id, p_name || ' ' || p_brand AS name, 'shot' AS category, CAST(p_size AS DOUBLE) AS abv FROM {part}"
FOLD = "trim(regexp_replace(replace(lower({0}), '.', ''), '[^a-z0-9]+', ' ', 'g'))"
TIERS = f"""
n AS (SELECT *, {FOLD.format('name')} AS folded FROM p), a AS (SELECT query_id, {FOLD.format('query')} AS asked FROM q),
t AS (SELECT query_id, asked, n.*, CASE WHEN folded = asked THEN 0 WHEN starts_with(folded, asked) THEN 1 WHEN contains(folded, ' ' || asked) THEN 2 WHEN contains(folded, asked) THEN 3
  WHEN contains(asked, ' ') AND len(list_filter(string_split(asked, ' '), lambda w: NOT contains(folded, w))) = 0 THEN 4 END AS tier FROM a, n WHERE asked <> ''),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(folded), folded, product_id) AS place FROM t WHERE tier IS NOT NULL)
"""


@query(f"WITH {TIERS} SELECT query_id, place, tier, product_id, name FROM h WHERE place <= 40", p=PRODUCTS, q=QUERIES)
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR1 to SR4, JN9: the best forty products of each query."""
    return H.search(adapt(spark, sf_dir, PRODUCTS), adapt(spark, sf_dir, QUERIES)).select("query_id", "place", "tier", "product_id", "name")


@query("SELECT count(*) AS products FROM p", p=PRODUCTS)
def product_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR5: searchable products."""
    return H.product_count(adapt(spark, sf_dir, PRODUCTS))


@query(
    f"""WITH {TIERS}, w AS (SELECT *, list_distinct(string_split(asked, ' ')) AS ours, list_distinct(string_split(folded, ' ')) AS theirs FROM h WHERE place <= 12),
    g AS (SELECT * FROM w WHERE len(ours) >= 2 AND len(theirs) >= 2 AND (len(list_filter(ours, lambda x: NOT list_contains(theirs, x))) = 0 OR len(list_filter(theirs, lambda x: NOT list_contains(ours, x))) = 0)
      AND len(list_filter(ours, lambda x: list_contains(theirs, x) AND x NOT IN ('red', 'old', 'brand'))) > 0)
    SELECT query_id, arg_min(product_id, place) AS product_id, arg_min(name, place) AS name FROM g GROUP BY query_id""",
    p=PRODUCTS, q=QUERIES,
)
def product_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: the product that a line names."""
    return H.specific_match(adapt(spark, sf_dir, QUERIES), adapt(spark, sf_dir, PRODUCTS), ["red", "old", "brand"]).select("query_id", "product_id", "name")


BRANDS = "SELECT lower(p_name) AS key, p_name AS label, CASE WHEN p_name LIKE 'old%' THEN 'nonAlcoholic' ELSE 'bottledBeer' END AS category, CAST(min(p_size) AS DOUBLE) AS abv, row_number() OVER (ORDER BY length(p_name) DESC, p_name) AS priority FROM {part} GROUP BY p_name"
STYLES = "SELECT row_number() OVER (ORDER BY word) AS priority, word AS label, 'wineGlass' AS natural_category, CAST(length(word) AS DOUBLE) AS abv, CASE WHEN length(word) > 4 THEN 3.5e0 END AS size_oz FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM {part}) w"
NAMES = "SELECT DISTINCT p_brand || ' ' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE 'x' END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'nonAlcoholic' WHEN p_partkey % 5 = 0 THEN 'cocktail' ELSE 'unknown' END AS section FROM {part}"
FIRST_BRAND = "bm AS (SELECT n.name, arg_min(b.label, b.priority) AS label, arg_min(b.category, b.priority) AS category, arg_min(b.abv, b.priority) AS abv FROM (SELECT DISTINCT name FROM n) n JOIN b ON contains(lower(n.name), b.key) GROUP BY n.name)"
FIRST_STYLE = "sm AS (SELECT n.name, arg_min(s.label, s.priority) AS label, arg_min(s.natural_category, s.priority) AS category, arg_min(s.abv, s.priority) AS abv, arg_min(CASE WHEN s.size_oz IS NULL THEN -1e0 ELSE s.size_oz END, s.priority) AS size_oz FROM (SELECT DISTINCT name FROM n) n JOIN s ON contains(lower(n.name), s.label) GROUP BY n.name)"


@query(f"WITH {FIRST_BRAND} SELECT * FROM bm", b=BRANDS, n=NAMES)
def brand_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: the brand in each name."""
    return K.brand_match(adapt(spark, sf_dir, NAMES), adapt(spark, sf_dir, BRANDS))


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, STYLES).withColumn("keywords", F.array("label"))


@query(f"WITH {FIRST_STYLE} SELECT name, label, category AS natural_category, abv, CASE WHEN size_oz >= 0 THEN size_oz END AS size_oz FROM sm", s=STYLES, n=NAMES)
def style_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8: the style in each name."""
    return K.style_match(adapt(spark, sf_dir, NAMES), _styles(spark, sf_dir))


DEFAULT_OZ = "CASE category WHEN 'draftBeer' THEN 16e0 WHEN 'wineGlass' THEN 5e0 WHEN 'sangria' THEN 6e0 WHEN 'cocktail' THEN 5e0 WHEN 'frozenCocktail' THEN 8e0 WHEN 'martini' THEN 3.5e0 WHEN 'shot' THEN 1.5e0 WHEN 'unknown' THEN 6e0 ELSE 12e0 END"
PROFILE = f"""
{FIRST_BRAND}, {FIRST_STYLE},
j AS (SELECT n.name, n.section, bm.label AS bl, bm.category AS bc, bm.abv AS ba, sm.label AS sl, sm.category AS sc, sm.abv AS sa, sm.size_oz AS so, n.section = 'nonAlcoholic' AS dry,
  n.section = 'nonAlcoholic' OR coalesce(bm.category = 'nonAlcoholic', false) AS sober FROM n LEFT JOIN bm ON n.name = bm.name LEFT JOIN sm ON n.name = sm.name),
x AS (SELECT *, CASE WHEN sober THEN 'nonAlcoholic' WHEN section <> 'unknown' THEN section WHEN bl IS NOT NULL THEN bc WHEN sl IS NOT NULL THEN sc ELSE 'unknown' END AS category,
  CASE WHEN dry THEN 'categoryFallback' WHEN bl IS NOT NULL THEN 'brandMatch' WHEN sl IS NOT NULL THEN 'styleChart' WHEN section <> 'unknown' THEN 'categoryFallback' ELSE 'unclassifiedFallback' END AS kind FROM j),
pr AS (SELECT name, section, category, CASE WHEN sober THEN 0e0 WHEN bl IS NOT NULL THEN ba WHEN sl IS NOT NULL THEN sa WHEN category = 'cocktail' THEN 12e0 ELSE 12e0 END AS typical_abv,
  CASE WHEN NOT sober AND bl IS NULL AND so >= 0 THEN so ELSE {DEFAULT_OZ} END AS typical_oz, kind, CASE kind WHEN 'brandMatch' THEN bl WHEN 'styleChart' THEN sl END AS matched FROM x)
"""


@query(f"WITH {PROFILE} SELECT * FROM pr", b=BRANDS, s=STYLES, n=NAMES)
def name_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN1, JN12: what each name tells, by brand, style and section."""
    return K.profile(adapt(spark, sf_dir, NAMES), adapt(spark, sf_dir, BRANDS), _styles(spark, sf_dir), glyphs=False).drop("note")


@query("SELECT DISTINCT name, replace(replace(replace(translate(regexp_replace(replace(replace(replace(replace(replace(replace(lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')), 'li', 'u'), 'fi', 'r'), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'ii', 'u'), ' ', '', 'g'), '0q1l5862', 'ooiisbgz'), '\x00', ''), '\x01', ''), '\x02', '') AS folded FROM n", n=NAMES)
def glyph_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR1, OCR2: names by the shape of their glyphs."""
    return adapt(spark, sf_dir, NAMES).select("name", T.glyph_fold(F.col("name")).alias("folded")).distinct()


RESOLVE_ITEMS = "SELECT CAST(list_id AS VARCHAR(20)) AS list_id, item_no, name, category, price_cents, CASE WHEN item_no % 2 = 0 THEN abv * 4 END AS read_abv, CASE WHEN item_no % 3 = 0 THEN size_oz END AS read_size_oz FROM (" + OFFERS + ") o"


@query(
    f"""WITH n AS (SELECT DISTINCT name, category AS section FROM i), {PROFILE}
    SELECT i.list_id, i.item_no, i.price_cents, pr.category, CASE WHEN i.category = 'nonAlcoholic' OR pr.category = 'nonAlcoholic' THEN 'excluded' WHEN i.price_cents > 0 THEN 'ranked' ELSE 'needs_price' END AS status,
    CASE WHEN read THEN i.read_abv ELSE pr.typical_abv END AS abv, NOT read AS abv_estimated, coalesce(i.read_size_oz, pr.typical_oz) AS size_oz, i.read_size_oz IS NULL AS size_estimated
    FROM (SELECT *, coalesce(read_abv > 0 AND (category = 'unknown' OR read_abv <= CASE category WHEN 'draftBeer' THEN 30 WHEN 'bottledBeer' THEN 30 WHEN 'wineGlass' THEN 30 WHEN 'cocktail' THEN 45 WHEN 'shot' THEN 96 ELSE 1 END), false) AS read FROM i) i JOIN pr ON i.name = pr.name AND i.category = pr.section""",
    b=BRANDS, s=STYLES, i=RESOLVE_ITEMS,
)
def item_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN4, EN5, EN6: items with strength and size, read or estimated, and whether they rank."""
    items = adapt(spark, sf_dir, RESOLVE_ITEMS)
    profiles = K.profile(items.select("name", F.col("category").alias("section")), adapt(spark, sf_dir, BRANDS), _styles(spark, sf_dir), glyphs=False)
    return K.resolve(items, profiles).select("list_id", "item_no", "price_cents", "category", "status", "abv", "abv_estimated", "size_oz", "size_estimated")


NEAR_ML = "(SELECT {0} FROM (VALUES ('12 oz', 12e0, 12e0 * 29.5735e0, 0), ('16 oz', 16e0, 16e0 * 29.5735e0, 1), ('19.2 oz', 19.2e0, 19.2e0 * 29.5735e0, 2), ('24 oz', 24e0, 24e0 * 29.5735e0, 3), ('25 oz', 25e0, 25e0 * 29.5735e0, 4), ('50 mL (nip)', 50e0 / 29.5735e0, 50e0, 5), ('187 mL (split)', 187e0 / 29.5735e0, 187e0, 6), ('200 mL', 200e0 / 29.5735e0, 200e0, 7), ('375 mL (half)', 375e0 / 29.5735e0, 375e0, 8), ('500 mL', 500e0 / 29.5735e0, 500e0, 9), ('750 mL', 750e0 / 29.5735e0, 750e0, 10), ('1 L', 1000e0 / 29.5735e0, 1000e0, 11), ('1.5 L (magnum)', 1500e0 / 29.5735e0, 1500e0, 12), ('1.75 L (handle)', 1750e0 / 29.5735e0, 1750e0, 13)) s(label, oz, size, k) ORDER BY abs(size - x.ml), k LIMIT 1)"


@query(
    f"""WITH x AS (SELECT DISTINCT CAST(p_size * 25 + p_partkey % 3 AS DOUBLE) AS ml FROM part),
    n AS (SELECT ml, {NEAR_ML.format('label')} AS label, {NEAR_ML.format('oz')} AS oz, {NEAR_ML.format('abs(size - x.ml)')} AS gap FROM x)
    SELECT ml, CASE WHEN gap <= ml * 0.01e0 THEN label WHEN ml >= 1000 THEN CASE WHEN abs(ml / 1000 - round(ml / 1000)) < 0.01 THEN CAST(CAST(round(ml / 1000) AS INT) AS VARCHAR) ELSE CAST(ml / 1000 AS VARCHAR) END || ' L' ELSE CAST(CAST(round(ml) AS INT) AS VARCHAR) || ' mL' END AS label, CASE WHEN gap <= ml * 0.01e0 THEN oz ELSE ml / 29.5735e0 END AS oz FROM n""",
)
def size_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SZ1: the package sizes that stated volumes mean."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") * 25 + F.col("p_partkey") % 3).cast("double").alias("ml")).distinct()
    return rows.withColumn("s", S.nearest_ml(F.col("ml"))).select("ml", "s.label", "s.oz")


@query(
    """SELECT row_seq, CASE WHEN s % 3 = 0 THEN '12 oz' WHEN s % 3 = 1 THEN '750 mL' ELSE '1.75 L (handle)' END AS label, CASE WHEN s % 3 = 0 THEN CASE WHEN s % 2 = 0 THEN 24 ELSE 6 END WHEN s % 3 = 1 THEN CASE WHEN s % 2 = 0 THEN 24 ELSE 1 END ELSE CASE WHEN s % 2 = 0 THEN 24 ELSE 1 END END AS count,
    CASE WHEN s % 4 = 0 THEN '60 oz pitcher' WHEN s % 4 = 1 THEN '3 oz double' WHEN s % 4 = 2 THEN '16 oz' ELSE '12 oz' END AS pour FROM (SELECT p_partkey AS row_seq, p_size AS s FROM part) x""",
)
def size_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PK1 to PK6, SZ2, EN7, EN8: packages and pours that names suggest."""
    s, name = F.col("p_size"), F.col("p_name")
    stated = F.concat(name, F.when(s % 3 == 0, " 12 OZ").when(s % 3 == 1, " 750").otherwise(" Handle"), F.when(s % 2 == 0, " 24 pack").otherwise(""))
    pour = F.concat(name, F.when(s % 4 == 0, " Pitcher").when(s % 4 == 1, " double").when(s % 4 == 2, " 16oz").otherwise(""))
    none = F.lit(None)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_seq"), S.suggest_package(stated, F.lit("bottledBeer"), none.cast("double"), none.cast("int")).alias("p"), S.suggest_pour(pour, F.lit("draftBeer"), F.lit(12.0)).alias("d"))
    return rows.select("row_seq", "p.label", "p.count", F.col("d.label").alias("pour"))


@query(
    """SELECT list_id, item_no, CASE WHEN count > 1 THEN CAST(count AS VARCHAR) || ' × ' || CAST(CAST(unit_oz AS INT) AS VARCHAR) || ' oz' ELSE CAST(CAST(unit_oz AS INT) AS VARCHAR) || ' oz' END AS package, CAST(CAST(unit_oz * greatest(1, count) AS INT) AS VARCHAR) || ' oz' AS total FROM p""",
    p=PACKAGES,
)
def size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SZ4, SZ5: sizes of packages as text."""
    return adapt(spark, sf_dir, PACKAGES).select("list_id", "item_no", S.package_text(F.col("count"), F.col("unit_oz")).alias("package"), S.total_text(F.col("count"), F.col("unit_oz")).alias("total"))


DOC_LINES = "SELECT doc_id AS list_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) d"


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("list_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(
    f"""SELECT list_id, count(*) AS lines, CAST(count(*) FILTER (regexp_matches(line, '[$£€][$£€ ]*[0-9]')) AS BIGINT) AS anchored, CAST(count(*) FILTER (regexp_matches(line, '\\.\\.')) AS BIGINT) AS leaders,
    CAST(count(*) FILTER (regexp_matches(line, '[•·]') OR regexp_matches(line, ',.*,') OR len(list_filter(string_split(line, ' '), lambda t: t <> '')) > 6) AS BIGINT) AS descriptions,
    CAST(count(*) FILTER (contains(lower(line), 'www.') OR contains(lower(line), '.com') OR contains(lower(line), '.net') OR contains(lower(line), '://') OR contains(lower(line), '.org')) AS BIGINT) AS urls,
    CAST(sum(length(trim(regexp_replace(translate(line, '•·…|/_', '      '), '\\.{{2,}}', ' ', 'g'), ' '))) AS BIGINT) AS plain_chars FROM ({DOC_LINES}) l GROUP BY list_id""",
)
def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN1, LN4, LN13, LN15: tests of single lines, over the lines of all documents."""
    line = F.col("line")
    plain = F.length(F.trim(L.without_dot_runs(L.without_separators(line))))
    return _document_lines(spark, sf_dir).groupBy("list_id").agg(F.count("*").alias("lines"), F.count_if(L.has_anchored_price(line)).alias("anchored"), F.count_if(L.has_dot_leader(line)).alias("leaders"), F.count_if(L.is_description(line)).alias("descriptions"), F.count_if(L.is_url(line)).alias("urls"), F.sum(plain).alias("plain_chars"))


@query(
    r"""SELECT list_id, line_no, CASE WHEN a <> '' AND CAST(a AS DOUBLE) > 0 AND CAST(a AS DOUBLE) <= 100 THEN CAST(a AS DOUBLE) END AS read_abv, CASE WHEN contains(lower(line), 'oz') AND s <> '' AND CAST(s AS DOUBLE) > 0 THEN CAST(s AS DOUBLE) WHEN contains(lower(line), 'pint') THEN 16e0 END AS read_size_oz,
    CASE WHEN d <> '' THEN CAST(round(CAST(d AS DOUBLE) * 100) AS INT) END AS price_cents
    FROM (SELECT *, regexp_extract(line, '([0-9.]+)%', 1) AS a, regexp_extract(lower(line), '([0-9.]*) *oz', 1) AS s, regexp_extract(line, '\$([0-9]+\.[0-9]+)', 1) AS d FROM l WHERE NOT regexp_matches(line, '^(WINES|DRAFT|KITCHEN|REDS|COCKTAILS|\(HOUSE)')) x""",
    l=LINES,
)
def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN2, LN3, LN5 to LN8: strength, size and price of item lines."""
    rows = adapt(spark, sf_dir, LINES).where(~F.col("line").rlike(r"^(WINES|DRAFT|KITCHEN|REDS|COCKTAILS|\(HOUSE)"))
    item = L.parse_item(F.col("line"))
    priced = F.when(F.contains("line", F.lit("$")), M.price_cents(item.dollars))
    return rows.select("list_id", "line_no", L.detect_abv(F.col("line")).alias("read_abv"), L.detect_size(F.col("line")).alias("read_size_oz"), priced.alias("price_cents"))


#: What the lines of LINES are to a reader, in SQL: the running section and, from it, the gate that takes each line.
STATES = """WITH f AS (SELECT *, CASE WHEN line = 'WINES' THEN 'wineGlass' WHEN line = 'DRAFT BEER' THEN 'draftBeer' WHEN line LIKE 'REDS $%' THEN 'wineGlass' WHEN line LIKE 'COCKTAILS...%' THEN 'cocktail' END AS section,
      CASE WHEN line LIKE 'REDS $%' THEN CAST(replace(line, 'REDS $', '') AS INT) * 100 WHEN line LIKE 'COCKTAILS...%' THEN 1200 END AS cents, line = 'KITCHEN' AS food FROM l),
    g AS (SELECT *, sum(CASE WHEN section IS NOT NULL THEN 1 ELSE 0 END) OVER w AS h, sum(CASE WHEN section IS NOT NULL OR food THEN 1 ELSE 0 END) OVER w AS m FROM f WINDOW w AS (PARTITION BY list_id ORDER BY line_no)),
    s AS (SELECT list_id, line_no, line, section, food, coalesce(max(section) OVER (PARTITION BY list_id, h), 'unknown') AS category, coalesce(bool_or(food) OVER (PARTITION BY list_id, m), false) AS in_food, max(cents) OVER (PARTITION BY list_id, h) AS header_cents FROM g)"""
GATES = f"""{STATES},
    t AS (SELECT *, CASE WHEN food THEN 'food_header' WHEN starts_with(line, '(') AND NOT in_food THEN 'attribute' WHEN section IS NOT NULL THEN 'section' WHEN in_food THEN 'in_food' ELSE 'item' END AS gate,
      nullif(TRY_CAST(regexp_extract(line, '([0-9.]+)%', 1) AS DOUBLE), 0) AS stated, nullif(CAST(round(TRY_CAST(regexp_extract(line, '\\$([0-9.]+)$', 1) AS DOUBLE) * 100) AS INT), 0) AS own_cents FROM s)"""


@query(f"{STATES} SELECT list_id, line_no, category, in_food, header_cents FROM s", l=LINES)
def section_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2, ST3, LN11, LN12: the running section, its price and food regions, by windows."""
    return R.section_state(written_lines(spark, sf_dir)).drop("line")


@query(
    f"""{GATES}, n AS (SELECT *, sum(CASE WHEN gate = 'item' THEN 1 ELSE 0 END) OVER (PARTITION BY list_id ORDER BY line_no) - 1 AS item_no FROM t WHERE gate IN ('item', 'attribute'))
    SELECT list_id, CAST(item_no AS INT) AS item_no, max(regexp_replace(regexp_replace(line, ' \\$[0-9.]+$', ''), ' [0-9.]+% ABV$', '')) FILTER (gate = 'item') AS name, max(coalesce(own_cents, header_cents)) FILTER (gate = 'item') AS price_cents,
      arg_min(stated, line_no) FILTER (stated IS NOT NULL) AS read_abv, max(CASE WHEN gate = 'attribute' THEN 12e0 END) AS read_size_oz, max(category) FILTER (gate = 'item') AS category,
      string_agg(line, ' ' ORDER BY line_no) FILTER (gate = 'attribute') AS description, max(line_no) FILTER (gate = 'item') AS line_no
    FROM n WHERE item_no >= 0 GROUP BY list_id, item_no""",
    l=LINES,
)
def list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, LN7, LN9, LN10, LN14, LN16: items of price lists read in order."""
    return R.parse_lists(written_lines(spark, sf_dir))


@query(f"{GATES} SELECT list_id, line_no, gate FROM t", l=LINES)
def list_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: what the reader took every line for."""
    return R.trace_lists(written_lines(spark, sf_dir))


@query("SELECT list_id, count(*) AS lines, CAST(count(*) FILTER (contains(line, '$') AND regexp_matches(line, '[A-Za-z]')) AS BIGINT) AS priced_rows, CAST(count(*) FILTER (contains(line, '$') AND contains(line, 'ABV')) AS BIGINT) AS complete_rows FROM l GROUP BY list_id", l=LINES)
def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LN19, ST6: priced and complete lines of each list."""
    return R.price_line_counts(adapt(spark, sf_dir, LINES))


ADOPT = "SELECT *, NOT starts_with(line, '(') AS is_item, starts_with(line, '(') AS is_attribute FROM ({0}) l"


@query(
    """WITH n AS (SELECT *, starts_with(line, '(') AS attr, sum(CASE WHEN starts_with(line, '(') THEN 0 ELSE 1 END) OVER (PARTITION BY list_id ORDER BY line_no) - 1 AS item_no FROM l)
    SELECT list_id, CAST(item_no AS BIGINT) AS item_no, arg_min(line, line_no) AS name, TRY_CAST(arg_min(regexp_extract(line, '([0-9.]+)%', 1), line_no) FILTER (regexp_matches(line, '[0-9.]+%') AND TRY_CAST(regexp_extract(line, '([0-9.]+)%', 1) AS DOUBLE) > 0) AS DOUBLE) AS read_abv, max(CASE WHEN attr THEN 12e0 END) AS read_size_oz, string_agg(line, ' ' ORDER BY line_no) FILTER (attr) AS description FROM n WHERE item_no >= 0 GROUP BY list_id, item_no""",
    l=LINES,
)
def attribute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: items with what the lines below them state."""
    line = F.col("line")
    rows = adapt(spark, sf_dir, LINES).select("list_id", "line_no", (~line.startswith("(")).alias("is_item"), line.startswith("(").alias("is_attribute"), line.alias("name"), L.detect_abv(line).alias("read_abv"), L.detect_size(line).alias("read_size_oz"), line.alias("text"))
    return R.adopt_attributes(rows).withColumn("item_no", F.col("item_no").cast("long"))


#: What a log of edits leaves of items, in SQL; `s` holds the items at the start.
EDITED = """WITH v AS (SELECT *, CAST(round(CASE kind WHEN 'add' THEN price ELSE value END * 100) AS INT) AS cents FROM e WHERE CASE kind WHEN 'add' THEN trim(name) <> '' WHEN 'set_price' THEN round(value * 100) > 0 WHEN 'remove' THEN true WHEN 'set_package' THEN true ELSE value IS NOT NULL END),
    r AS (SELECT session_id, item_id, max(seq) AS removed FROM v WHERE kind = 'remove' GROUP BY session_id, item_id),
    l AS (SELECT v.* FROM v LEFT JOIN r ON v.session_id = r.session_id AND v.item_id = r.item_id WHERE v.kind <> 'remove' AND v.seq > coalesce(r.removed, -1)),
    b AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.session_id = s.session_id AND r.item_id = s.item_id)),
    a AS (SELECT *, row_number() OVER (PARTITION BY session_id, item_id ORDER BY seq) AS k FROM l WHERE kind = 'add'),
    t AS (SELECT session_id, item_id, -1 AS start, name, category, price_cents, abv, abv_estimated, size_oz, size_estimated, count FROM b
      UNION ALL SELECT session_id, item_id, seq, trim(name), CASE WHEN category = 'nonAlcoholic' THEN 'unknown' ELSE category END, CASE WHEN cents > 0 THEN cents END, abv, false, size_oz, false, greatest(1, count) FROM a WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.session_id = a.session_id AND b.item_id = a.item_id))
    SELECT t.session_id, t.item_id, t.name, t.category, coalesce(arg_max(l.cents, l.seq) FILTER (l.kind = 'set_price'), t.price_cents) AS price_cents, coalesce(arg_max(l.value, l.seq) FILTER (l.kind = 'correct_abv'), t.abv) AS abv,
      t.abv_estimated AND count(*) FILTER (l.kind = 'correct_abv') = 0 AS abv_estimated,
      coalesce(arg_max(CASE WHEN l.kind = 'set_package' THEN l.size_oz ELSE l.value END, l.seq) FILTER (l.kind = 'correct_size' OR (l.kind = 'set_package' AND l.size_oz IS NOT NULL)), t.size_oz) AS size_oz,
      t.size_estimated AND count(*) FILTER (l.kind = 'correct_size' OR (l.kind = 'set_package' AND l.size_oz IS NOT NULL)) = 0 AS size_estimated,
      coalesce(arg_max(greatest(1, l.count), l.seq) FILTER (l.kind = 'set_package'), t.count) AS count
    FROM t LEFT JOIN l ON t.session_id = l.session_id AND t.item_id = l.item_id AND l.seq > t.start AND l.kind <> 'add'
    GROUP BY t.session_id, t.item_id, t.name, t.category, t.price_cents, t.abv, t.abv_estimated, t.size_oz, t.size_estimated, t.count"""
BASE = "SELECT session_id, item_id, 'base' AS name, 'wineGlass' AS category, CAST(500 AS INT) AS price_cents, 5e0 AS abv, true AS abv_estimated, CASE WHEN item_id = 0 THEN 12e0 END AS size_oz, item_id = 0 AS size_estimated, CAST(2 AS INT) AS count FROM (" + SESSIONS + ") b"


@query(EDITED, e=EDITS, s=BASE)
def session_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ED1, ED2: live items of sessions after all their edits."""
    return D.apply_edits(adapt(spark, sf_dir, BASE), adapt(spark, sf_dir, EDITS))


@query(
    """WITH RECURSIVE o AS (SELECT session_id, CAST(seq % 9 AS INT) AS item_id, kind, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM e WHERE kind = 'remove' OR (kind = 'add' AND trim(name) <> '')),
    k AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS live FROM o
      UNION ALL SELECT k.session_id, o.n, CASE WHEN o.kind = 'remove' THEN list_filter(k.live, lambda i: i <> o.item_id) WHEN len(k.live) < 5 AND NOT list_contains(k.live, o.item_id) THEN list_append(k.live, o.item_id) ELSE k.live END FROM k JOIN o ON o.session_id = k.session_id AND o.n = k.n + 1)
    SELECT session_id, unnest(arg_max(live, n)) AS item_id FROM k GROUP BY session_id""",
    e=EDITS,
)
def session_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ED3: sessions that hold five items at most."""
    return D.capped_adds(adapt(spark, sf_dir, EDITS).withColumn("item_id", F.col("seq") % 9))


@query(f"WITH d AS (SELECT list_id, avg(CASE WHEN len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda w: w <> '')) <= 2 AND NOT regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END) AS fragments FROM ({DOC_LINES}) l GROUP BY list_id) SELECT list_id, fragments FROM d")
def line_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV5: the share of fragments among the lines of each document."""
    return E.fragment_score(_document_lines(spark, sf_dir))


@query(
    "WITH r AS (SELECT list_id, line_no, CASE WHEN line_no % 9 = 0 THEN line || '!' ELSE line END AS line FROM l WHERE line_no % 31 <> 0) SELECT l.list_id AS page_id, CAST(count(*) FILTER (r.line IS NULL OR r.line <> l.line) AS BIGINT) AS differing, count(*) FILTER (r.line IS NULL OR r.line <> l.line) = 0 AS exact FROM l LEFT JOIN r ON l.list_id = r.list_id AND l.line_no = r.line_no GROUP BY l.list_id",
    l=LINES,
)
def compare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV1: lines against a recorded reading."""
    ours = adapt(spark, sf_dir, LINES).withColumnRenamed("list_id", "page_id")
    recorded = ours.where("line_no % 31 <> 0").withColumn("line", F.when(F.col("line_no") % 9 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return E.compare_lines(ours, recorded)[0]


@query(
    "WITH h AS (SELECT list_id, line_no, CASE WHEN line = 'DRAFT BEER' THEN 'draftBeer' WHEN line LIKE 'COCK%' THEN 'cocktail' ELSE 'wineGlass' END AS section FROM l WHERE line IN ('WINES', 'DRAFT BEER') OR line LIKE 'REDS%' OR line LIKE 'COCKTAILS%') SELECT list_id, CASE WHEN line_no % 5 = 0 THEN 'new' WHEN section <> 'wineGlass' AND line_no % 3 = 0 THEN 'category' ELSE 'kept' END AS change, count(*) AS n FROM h GROUP BY 1, 2",
    l=LINES,
)
def compare_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV2, EV3: section headers against those of another rule."""
    lines = written_lines(spark, sf_dir)
    ours = materialized(R.features(lines).where("section is not null").select("list_id", "line_no", "line", "section"), "headers")
    other = ours.where("line_no % 5 <> 0").withColumn("section", F.when(F.col("line_no") % 3 == 0, "wineGlass").otherwise(F.col("section")))
    return E.compare_headers(ours, other).groupBy("list_id", "change").agg(F.count("*").alias("n"))
