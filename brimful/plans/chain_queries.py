"""Registered queries of the whole way from lines to rankings and reports, in batch and as a stream, and of filled forms (AG8, SNK5, SNK6, SM2, EN7, EN8).

The SQL stacks what the single steps have: reading lists, withdrawn prices, the list's category, what names tell, and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimful.functions.vocabulary import BRANDS, CATEGORIES, STYLES
from brimful.operators import knowledge as K
from brimful.operators.knowledge import brand_table, style_table
from brimful.operators.quality import session_report
from brimful.plans import pipeline as P
from brimful.plans.adapters import adapt
from brimful.plans.name_queries import GLYPH_BEST
from brimful.plans.queries import BRANDS as PART_BRANDS
from brimful.plans.queries import DEFAULT_OZ, FIRST_BRAND, FIRST_STYLE, PROFILE, REFERENCE, SQL, VALUE, query, written_lines
from brimful.plans.queries import STYLES as PART_STYLES
from brimful.sources.sinks import shared_path
from brimful.streaming import streams as Z


def _values(rows: list[tuple], columns: str) -> str:
    """A table of constants in SQL."""
    shown = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({columns})"


SEED_BRANDS = _values([(key, label, category, float(abv), i) for i, (_, (key, label, category, abv)) in enumerate(sorted(enumerate(BRANDS), key=lambda r: (-len(r[1][0]), r[0])))], "key, label, category, abv, priority")
SEED_STYLES = _values([(i, keyword, label, natural, float(abv), None if oz is None else float(oz)) for i, (keywords, label, natural, abv, oz) in enumerate(STYLES) for keyword in keywords], "priority, keyword, label, natural_category, abv, size_oz")
BY_CATEGORY = lambda field, column: f"CASE {column} " + " ".join(f"WHEN '{c}' THEN CAST({row[field]} AS DOUBLE)" for c, row in CATEGORIES.items() if row[field] is not None) + " END"
TELLS = PROFILE.replace(FIRST_BRAND, FIRST_BRAND.replace("bm AS", "em AS", 1) + ", " + GLYPH_BEST + ", bm AS (SELECT * FROM em UNION ALL SELECT * FROM gb WHERE NOT EXISTS (SELECT 1 FROM em WHERE em.name = gb.name))")
TELLS = TELLS.replace(FIRST_STYLE, FIRST_STYLE.replace("contains(lower(n.name), s.label)", "contains(lower(n.name), s.keyword)")).replace("WHEN category = 'cocktail' THEN 12e0 ELSE 12e0 END AS typical_abv", f"ELSE {BY_CATEGORY(1, 'category')} END AS typical_abv")
NOTE = """CASE kind WHEN 'brandMatch' THEN 'matched ' || matched || ' (brand, ~' || CAST(typical_abv AS VARCHAR) || '% ABV)' WHEN 'styleChart' THEN 'matched ' || matched || ' (style, ~' || CAST(typical_abv AS VARCHAR) || '% ABV)'
  WHEN 'categoryFallback' THEN 'typical ' || pr.category || ' (~' || CAST(typical_abv AS VARCHAR) || '% ABV)' ELSE 'unclassified (~' || CAST(typical_abv AS VARCHAR) || '% ABV)' END"""
#: i: items of the lists, b: brands, s: styles; gives `resolved` and `ranked`.
CHAIN = f"""WITH o AS (SELECT * FROM i), {REFERENCE},
  wd AS (SELECT i.* REPLACE (CASE WHEN i.price_cents > 20 * r.reference THEN NULL ELSE i.price_cents END AS price_cents) FROM i LEFT JOIN r ON i.list_id = r.list_id AND i.category = r.category),
  kc AS (SELECT list_id, category, count(*) AS k FROM wd WHERE category <> 'unknown' GROUP BY list_id, category), kt AS (SELECT list_id, sum(k) AS total FROM kc GROUP BY list_id),
  kw AS (SELECT kc.list_id, kc.category FROM kc JOIN kt ON kc.list_id = kt.list_id WHERE total >= 4 AND k > 0.5 * total AND category <> 'nonAlcoholic'),
  jd AS (SELECT wd.* REPLACE (CASE WHEN wd.category = 'unknown' AND kw.category IS NOT NULL THEN kw.category ELSE wd.category END AS category) FROM wd LEFT JOIN kw ON wd.list_id = kw.list_id),
  n AS (SELECT DISTINCT name, category AS section FROM jd), {TELLS},
  rd AS (SELECT jd.*, pr.category AS told, typical_abv, typical_oz, {NOTE} AS note, coalesce(read_abv > 0 AND ({BY_CATEGORY(3, 'jd.category')} IS NULL OR read_abv <= {BY_CATEGORY(3, 'jd.category')}), false) AS reads FROM jd JOIN pr ON jd.name = pr.name AND jd.category = pr.section),
  resolved AS (SELECT list_id, item_no, name, price_cents, told AS category, CASE WHEN category = 'nonAlcoholic' OR told = 'nonAlcoholic' THEN 'excluded' WHEN price_cents > 0 THEN 'ranked' ELSE 'needs_price' END AS status,
    CASE WHEN reads THEN read_abv ELSE typical_abv END AS abv, NOT reads AS abv_estimated, CASE WHEN NOT reads THEN note END AS abv_note, coalesce(read_size_oz, typical_oz) AS size_oz, read_size_oz IS NULL AS size_estimated,
    CASE WHEN read_size_oz IS NULL THEN 'assumed ' || CAST(typical_oz AS VARCHAR) || ' oz for ' || told END AS size_note FROM rd),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY value DESC, name, item_no) AS rank FROM (SELECT *, {VALUE} AS value FROM resolved WHERE status = 'ranked') v)"""
ITEMS = SQL["list_parse"]
RANKED = f"{CHAIN} SELECT * FROM ranked"


@query(RANKED, i=ITEMS, b=SEED_BRANDS, s=SEED_STYLES)
def rank_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8: lists from their lines to the ranking."""
    return P.rank_lists(written_lines(spark, sf_dir), brand_table(spark), style_table(spark)).ranked


NUMBER = lambda x: f"regexp_replace(printf('%.4f', round({x}, 4)), '\\.?0+$', '')"


@query(
    f"""{CHAIN},
    hd AS (SELECT list_id, count(*) AS items, count(price_cents) AS priced, count(*) FILTER (status = 'ranked') AS n_ranked, count(*) FILTER (status = 'needs_price') AS n_open, count(*) FILTER (status = 'excluded') AS n_excluded,
      count(*) FILTER (status = 'ranked' AND NOT abv_estimated) AS n_read, count(*) FILTER (status = 'ranked' AND abv_estimated) AS n_estimated FROM resolved GROUP BY list_id)
    SELECT list_id, 'header' AS kind, CAST(0 AS BIGINT) AS place, n_ranked || ' ranked, ' || n_open || ' without price, ' || n_excluded || ' excluded; ' || priced || ' of ' || items || ' priced' || CASE WHEN items >= 8 AND priced < 0.25 * items THEN ' (few)' ELSE '' END
      || '; strength ' || n_read || ' read, ' || n_estimated || ' estimated' AS text FROM hd
    UNION ALL SELECT list_id, 'ranked', rank, name || ' | ' || {NUMBER('value')} || ' | $' || {NUMBER('price_cents / 100e0')} || ' | ' || {NUMBER('abv')} || '%' || CASE WHEN abv_estimated THEN ' est' ELSE ' read' END || ' | ' || {NUMBER('size_oz')} || 'oz'
      || CASE WHEN size_estimated THEN ' est' ELSE ' read' END || ' | ' || category FROM ranked
    UNION ALL SELECT list_id, status, CAST(item_no AS BIGINT), name FROM resolved WHERE status <> 'ranked'""",
    i=ITEMS, b=SEED_BRANDS, s=SEED_STYLES,
)
def session_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5, SNK6, AG9: the report of each list, line by line."""
    done = P.rank_lists(written_lines(spark, sf_dir), brand_table(spark), style_table(spark))
    return session_report(done.ranked, done.resolved)


#: Lines in a file of the stream of lists, whose number grows with the input.
LINES_PER_FILE = 50_000
#: Files that a batch takes for each task: planning and jobs of a batch cost as much as some hundred thousand lines.
FILES_PER_TASK = 16


@query(RANKED, i=ITEMS, b=SEED_BRANDS, s=SEED_STYLES)
def stream_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM2: lists ranked as their files arrive; each list is in one file. A batch takes several files for each task, since a batch costs its planning and its jobs however few lines it has."""
    folder = shared_path(spark, "lists")
    lines = written_lines(spark, sf_dir)
    lines.repartition(lines.count() // LINES_PER_FILE + 1, "list_id").write.parquet(f"{folder}/lines")
    stream = spark.readStream.schema("list_id string, line_no int, line string").option("maxFilesPerTrigger", FILES_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))).parquet(f"{folder}/lines")
    keep = lambda ranked, epoch: Z.write_epoch(ranked, f"{folder}/ranked", epoch)
    Z.stream_lists(stream, brand_table(spark), style_table(spark), keep, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/ranked").drop("epoch")


#: Products with a stated size and, three times in four, a strength; drinks whose names say how they are poured, half of them typed.
OWN_NAME = "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'x' END || ' ' || p_brand"
FORM_PRODUCTS = f"SELECT p_partkey AS product_id, {OWN_NAME} AS name, CASE WHEN p_partkey % 2 = 0 THEN 'shot' ELSE 'cider' END AS category, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS abv, CAST(p_size * 25 + p_partkey % 3 AS DOUBLE) AS ml, CAST(p_partkey % 5 + 1 AS INT) AS units FROM {{part}}"
FORM_DRINKS = f"SELECT DISTINCT {OWN_NAME} || CASE p_size % 3 WHEN 0 THEN ' pitcher' WHEN 1 THEN ' double' ELSE ' pint' END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'cocktail' END AS category, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS abv, CAST(p_size % 3 AS INT) AS pour FROM {{part}}"
PLAIN = PROFILE.replace("WHEN category = 'cocktail' THEN 12e0 ELSE 12e0 END AS typical_abv", f"ELSE {BY_CATEGORY(1, 'category')} END AS typical_abv").replace(DEFAULT_OZ, BY_CATEGORY(2, "category"))


def _profiles(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    names = asked.select("name", F.coalesce("category", F.lit("unknown")).alias("section")).distinct()
    return K.profile(names, adapt(spark, sf_dir, PART_BRANDS), adapt(spark, sf_dir, PART_STYLES).withColumn("keywords", F.array("label")), glyphs=False)


@query(
    f"""WITH n AS (SELECT DISTINCT name, category AS section FROM p), {PLAIN}
    SELECT p.product_id, p.name, coalesce(p.abv, typical_abv) AS abv, true AS abv_estimated, CASE WHEN p.abv IS NOT NULL THEN p.name || ' at its typical label strength, not read off this package' ELSE {NOTE} END AS note, z.label, z.oz, p.units AS count
    FROM p JOIN pr ON p.name = pr.name AND p.category = pr.section JOIN z ON p.ml = z.ml""",
    b=PART_BRANDS, s=PART_STYLES, p=FORM_PRODUCTS, z=SQL["size_nearest"],
)
def package_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN7, PK1: forms filled in from catalog products."""
    products = adapt(spark, sf_dir, FORM_PRODUCTS)
    return K.prefilled_packages(products, _profiles(spark, sf_dir, products))


@query(
    f"""WITH n AS (SELECT DISTINCT name, coalesce(category, 'unknown') AS section FROM d), {PLAIN}
    SELECT d.name, coalesce(d.abv, typical_abv) AS abv, true AS abv_estimated, CASE WHEN d.abv IS NOT NULL THEN d.name || ' at its typical strength, not read off the menu' ELSE {NOTE} END AS note,
      CASE pour WHEN 0 THEN '60 oz pitcher' WHEN 1 THEN '3 oz double' ELSE '16 oz' END AS label, CASE pour WHEN 0 THEN 60e0 WHEN 1 THEN 3e0 ELSE 16e0 END AS oz
    FROM d JOIN pr ON d.name = pr.name AND coalesce(d.category, 'unknown') = pr.section""",
    b=PART_BRANDS, s=PART_STYLES, d=FORM_DRINKS,
)
def drink_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN8, PK2: forms filled in from drinks, and from names that were typed."""
    drinks = adapt(spark, sf_dir, FORM_DRINKS).drop("pour")
    return K.prefilled_drinks(drinks, _profiles(spark, sf_dir, drinks))
