"""Registered queries on misread names, with every name compared with every brand in SQL (JN7, OCR1-OCR6, EN1-EN3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimful.functions.text import glyph_tokens
from brimful.operators import knowledge as K
from brimful.plans.adapters import adapt
from brimful.plans.queries import BRANDS, FIRST_BRAND, NAMES, PRODUCTS, PROFILE, STYLES, TIERS, query

#: Names with letters misread, left out, cut off at the end, and run together.
MISREAD = f"""
SELECT DISTINCT CASE length(name) % 5 WHEN 0 THEN translate(name, 'OLISolis', '01l501l5') WHEN 1 THEN substr(name, 1, 9) || substr(name, 11) WHEN 2 THEN substr(name, 1, length(name) - 2)
  WHEN 3 THEN 'the ' || lower(name) || ' ale' ELSE replace(replace(lower(name), 'd', 'cl'), ' ', CASE WHEN length(name) % 2 = 0 THEN '' ELSE ' ' END) END AS name, section FROM ({NAMES}) n
"""
#: Fixed values of the glyph fold, in SQL.
GLYPHS = "translate(replace(replace(replace(replace(replace(replace(regexp_replace(lower(w), '[^a-z0-9]', '', 'g'), 'li', 'u'), 'fi', 'r'), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'ii', 'u'), '0q1l5862', 'ooiisbgz')"
TOKENS = "list_filter(list_transform(string_split_regex(lower({0}), '[ \\-/\\t\\n]'), lambda w: " + GLYPHS + "), lambda w: w <> '' AND w <> 'and')"
GLYPH_BEST = f"""
gn AS (SELECT *, {TOKENS.format('name')} AS m FROM (SELECT DISTINCT name FROM n) d), gt AS (SELECT *, {TOKENS.format('key')} AS t FROM b),
gp AS (SELECT *, length(array_to_string(t, '')) AS letters, least(len(m), len(t)) AS k, len(t) <= len(m) AS stands FROM gn, gt WHERE len(m) > 0 AND length(array_to_string(t, '')) >= 5),
gw AS (SELECT *, unnest(range(0, abs(len(m) - len(t)) + 1)) AS s FROM gp),
gx AS (SELECT *, CASE WHEN stands THEN m[s + 1:s + k] ELSE m END AS r, CASE WHEN stands THEN t ELSE t[s + 1:s + k] END AS o FROM gw),
gc AS (SELECT *, list_transform(range(1, k + 1), lambda i: CASE WHEN i = k AND k > 1 AND length(r[i]) >= 3 AND length(o[i]) > length(r[i]) AND starts_with(o[i], r[i]) THEN 0 ELSE levenshtein(r[i], o[i]) END) AS e FROM gx),
gl AS (SELECT *, len(list_filter(range(1, k + 1), lambda i: e[i] > CASE WHEN greatest(length(r[i]), length(o[i])) < 5 THEN 0 WHEN greatest(length(r[i]), length(o[i])) < 9 THEN 1 ELSE 2 END)) AS over, len(list_filter(range(1, k + 1), lambda i: r[i] = o[i])) AS exact FROM gc),
go AS (SELECT name, label, category, abv, priority, letters, CAST(list_sum(e) AS BIGINT) AS edits, CASE WHEN stands THEN 0 ELSE 1 END AS tier, CASE WHEN stands THEN -letters ELSE letters END AS size FROM gl
    WHERE (over = 0 OR exact > 0) AND (stands OR (len(m) >= 2 AND 2 * length(array_to_string(o, '')) >= letters))
  UNION ALL SELECT name, label, category, abv, priority, letters, levenshtein(word, array_to_string(t, '')), 2, -letters FROM (SELECT *, unnest(m) AS word FROM gp) u WHERE levenshtein(word, array_to_string(t, '')) <= 2),
gb AS (SELECT name, label, category, abv FROM go WHERE edits <= CASE WHEN letters < 12 THEN 1 WHEN letters < 20 THEN 2 ELSE 3 END QUALIFY row_number() OVER (PARTITION BY name ORDER BY edits, tier, size, priority) = 1)
"""


@query(f"WITH {GLYPH_BEST} SELECT * FROM gb", b=BRANDS, n=MISREAD)
def misread_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7, OCR1 to OCR6: the brand that each misread name most likely is."""
    return K.glyph_match(adapt(spark, sf_dir, MISREAD), adapt(spark, sf_dir, BRANDS))


@query(f"SELECT name, array_to_string({TOKENS.format('name')}, ' ') AS tokens FROM (SELECT DISTINCT name FROM n) d", n=MISREAD)
def glyph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR1, OCR2: the words of each name by the shape of their glyphs."""
    return adapt(spark, sf_dir, MISREAD).select("name").distinct().select("name", F.array_join(glyph_tokens(F.col("name")), " ").alias("tokens"))


#: PROFILE with misread brands where no brand stands in the name as it is; then the tier of catalog products.
ALL_TIERS = f"""{PROFILE.replace(FIRST_BRAND, FIRST_BRAND.replace('bm AS', 'em AS', 1) + ', ' + GLYPH_BEST + ', bm AS (SELECT * FROM em UNION ALL SELECT * FROM gb WHERE NOT EXISTS (SELECT 1 FROM em WHERE em.name = gb.name))')},
q AS (SELECT DISTINCT name AS query_id, name AS query FROM pr WHERE kind <> 'brandMatch'),
{TIERS.replace('n AS', 'cn AS', 1).replace('FROM a, n ', 'FROM a, cn ').replace('n.*', 'cn.*')},
w AS (SELECT *, list_distinct(string_split(asked, ' ')) AS ours, list_distinct(string_split(folded, ' ')) AS theirs FROM h WHERE place <= 12),
g AS (SELECT * FROM w WHERE len(ours) >= 2 AND len(theirs) >= 2 AND (len(list_filter(ours, lambda x: NOT list_contains(theirs, x))) = 0 OR len(list_filter(theirs, lambda x: NOT list_contains(ours, x))) = 0)
  AND len(list_filter(ours, lambda x: list_contains(theirs, x) AND x NOT IN ({{generic}}))) > 0),
pm AS (SELECT query_id AS name, arg_min(name, place) AS product, arg_min(category, place) AS product_category, arg_min(abv, place) AS product_abv FROM g GROUP BY query_id),
u AS (SELECT pr.*, product, product_category, product_abv, kind <> 'brandMatch' AND product IS NOT NULL AND (product_category = 'nonAlcoholic' OR product_abv > 0) AS use FROM pr LEFT JOIN pm ON pr.name = pm.name)
"""


def _generic() -> str:
    from brimful.functions.vocabulary import GENERIC_WORDS

    return ", ".join("'" + w.replace("'", "''") + "'" for w in GENERIC_WORDS)


@query(
    f"""WITH {ALL_TIERS.replace("{generic}", _generic())}, z AS (
      SELECT name, section, CASE WHEN NOT use THEN category WHEN category = 'unknown' THEN product_category ELSE category END AS category, CASE WHEN use THEN product_abv ELSE typical_abv END AS typical_abv, typical_oz,
        CASE WHEN use THEN 'brandMatch' ELSE kind END AS kind, CASE WHEN use THEN product ELSE matched END AS matched FROM u)
    SELECT *, CASE kind WHEN 'brandMatch' THEN 'matched ' || matched || ' (brand, ~' || CAST(typical_abv AS VARCHAR) || '% ABV)' WHEN 'styleChart' THEN 'matched ' || matched || ' (style, ~' || CAST(typical_abv AS VARCHAR) || '% ABV)'
      WHEN 'categoryFallback' THEN 'typical ' || category || ' (~' || CAST(typical_abv AS VARCHAR) || '% ABV)' ELSE 'unclassified (~' || CAST(typical_abv AS VARCHAR) || '% ABV)' END AS note FROM z""",
    b=BRANDS, s=STYLES, n=MISREAD, p=PRODUCTS,
)
def name_profiles_misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN1 to EN3, JN7: names with misread letters through all tiers, with glyph repair, catalog and note."""
    styles = adapt(spark, sf_dir, STYLES).withColumn("keywords", F.array("label"))
    return K.profile_with_catalog(adapt(spark, sf_dir, MISREAD), adapt(spark, sf_dir, BRANDS), styles, adapt(spark, sf_dir, PRODUCTS))
