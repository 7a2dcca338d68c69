"""Registered queries of page layout, the whole ranking, catalogs from files and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brimful.operators import evaluate as E
from brimful.operators import layout as Y
from brimful.operators.catalog import require_abv
from brimful.operators.dealing import dealt
from brimful.operators.lists import features
from brimful.plans import pipeline as P
from brimful.plans.adapters import CATALOG, EDITS, LINES, adapt
from brimful.plans.queries import BASE, EDITED, query, written_lines
from brimful.sources.readers import brand_dimension, export_boxes, log_blocks, read_bc, read_catalog, read_exports, read_facts, read_wholesale, recorded_lines, relevant_facts
from brimful.sources.sinks import materialized, shared_path, write_catalog
from brimful.streaming import streams as Z


def _boxes(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Words of price-list lines, 40 lines to a page, at places that follow from line and word.

    Pages are dealt to tasks as lines, before their words become boxes; steps by page and by row of a page need no other shuffle.
    With `placed` the lines are sorted too, so that the boxes of a page come one after the other, by box_id.
    """
    lines = adapt(spark, sf_dir, LINES)
    pages = dealt(lines.select(F.concat(F.col("list_id"), F.lit("-"), F.floor(F.col("line_no") / 40).cast("string")).alias("page_id"), (F.col("line_no") % 40).alias("row_no"), "line"), "page_id", times=4)
    pages = pages.sortWithinPartitions("page_id", "row_no") if placed else pages
    words = pages.select("page_id", "row_no", F.posexplode(F.split("line", " ")).alias("k", "text"))
    x0 = F.when(F.col("text").startswith("$"), 180).otherwise(10 + 12 * F.col("k"))
    y = 1000 - F.col("row_no") * 24
    return words.select("page_id", "row_no", (F.col("row_no") * 100 + F.col("k")).cast("long").alias("box_id"), "text", (x0 / 200).alias("min_x"), ((y - 10) / 1000).alias("min_y"), ((x0 + 8) / 200).alias("max_x"), (y / 1000).alias("max_y"))


DUCK_BOXES = f"""SELECT list_id || '-' || CAST(line_no // 40 AS VARCHAR) AS page_id, line_no % 40 AS row_no, CAST((line_no % 40) * 100 + k - 1 AS BIGINT) AS box_id, word AS text, x0 / 200 AS min_x, (x0 + 8) / 200 AS max_x, (990 - (line_no % 40) * 24) / 1000 AS min_y, (1000 - (line_no % 40) * 24) / 1000 AS max_y
FROM (SELECT *, CASE WHEN word LIKE '$%' THEN 180 ELSE 10 + 12 * (k - 1) END AS x0 FROM (SELECT list_id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS k FROM ({LINES}) l) w) x"""


@query("SELECT page_id, CAST(bin AS INT) AS bin, count(*) AS boxes FROM (SELECT page_id, unnest(range(greatest(0, CAST(trunc(min_x * 100) AS INT)), least(99, CAST(trunc(max_x * 100) AS INT)) + 1)) AS bin FROM b WHERE greatest(0, CAST(trunc(min_x * 100) AS INT)) <= least(99, CAST(trunc(max_x * 100) AS INT))) x GROUP BY page_id, bin", b=DUCK_BOXES)
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY4: how many boxes cover each column of a page."""
    return Y.coverage_histogram(_boxes(spark, sf_dir))


VOTES = "v AS (SELECT *, lead(min_x) OVER (PARTITION BY page_id, row_no ORDER BY min_x, box_id) AS after FROM b)"


@query(f"WITH {VOTES} SELECT page_id, row_no, (max_x + after) / 2 AS x, after - max_x AS width FROM v WHERE after - max_x >= 0.045e0", b=DUCK_BOXES)
def page_gutter_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY6: wide gaps between the boxes of a row."""
    return Y.gutter_votes(_boxes(spark, sf_dir))


@query(
    f"""WITH {VOTES}, c AS (SELECT page_id, row_no, coalesce(bool_or(max_x <= 0.5e0 AND 0.5e0 <= after AND after - max_x >= 0.045e0), false) AS votes, bool_or(min_x < 0.5e0 AND 0.5e0 < max_x) AS spans, bool_or(max_x <= 0.5e0) AND bool_or(min_x >= 0.5e0) AS sides FROM v GROUP BY page_id, row_no)
    SELECT page_id, 0.5e0 AS x, CAST(count(*) FILTER (votes) AS BIGINT) AS voters, CAST(count(*) FILTER (NOT votes AND (spans OR sides)) AS BIGINT) AS crossers FROM c GROUP BY page_id""",
    b=DUCK_BOXES,
)
def page_gutter_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY7: rows that leave the middle of a page free, and rows that run across it."""
    boxes = _boxes(spark, sf_dir)
    return Y.gutter_support(boxes, boxes.select("page_id", F.lit(0.5).alias("x")).distinct())


@query(
    """SELECT page_id, 0.5e0 AS x, side, count(*) AS boxes, max(max_x) - min(min_x) AS span, avg(CASE WHEN named THEN 1 ELSE 0 END) AS names
    FROM (SELECT *, CASE WHEN (min_x + max_x) / 2 < 0.5e0 THEN 'left' ELSE 'right' END AS side, regexp_matches(text, '[A-Za-z].*[A-Za-z]') AND text NOT IN ('ABV', '12oz') AS named FROM b WHERE text <> '') s GROUP BY page_id, side""",
    b=DUCK_BOXES,
)
def page_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY8, LY11: boxes, span and names on both sides of the middle."""
    boxes = _boxes(spark, sf_dir)
    return Y.column_sides(boxes, boxes.select("page_id", F.lit(0.5).alias("x")).distinct())


@query("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY row_no) - 1 AS INT) AS line_no, string_agg(text, ' ' ORDER BY min_x, box_id) AS line FROM b WHERE text <> '' GROUP BY page_id, row_no", b=DUCK_BOXES)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY1 to LY3, LY5, LY9, LY10: boxes assembled to lines."""
    return Y.assemble(_boxes(spark, sf_dir, placed=True), placed=True)


@query(
    f"""WITH {VOTES}, r AS (SELECT page_id, row_no, count(*) FILTER (text <> '') AS words, bool_or(regexp_matches(text, '[0-9]')) AS digit, coalesce(bool_or(after - max_x >= 0.045e0), false) AS wide FROM v GROUP BY page_id, row_no),
    s AS (SELECT page_id, avg(CASE WHEN words <= 2 AND NOT digit THEN 1 ELSE 0 END) AS orphans, avg(CASE WHEN wide THEN 1 ELSE 0 END) AS fused FROM r GROUP BY page_id),
    p AS (SELECT page_id, count(*) AS boxes, round(quantile_cont(max_y - min_y, 0.5), 9) AS median_height, min(min_x) AS "left", max(max_x) AS "right", min(min_y) AS bottom, max(max_y) AS top FROM b GROUP BY page_id)
    SELECT s.page_id, orphans, fused, orphans + fused AS bad, boxes, median_height, "left", "right", bottom, top FROM s JOIN p ON s.page_id = p.page_id""",
    b=DUCK_BOXES,
)
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV4, EV9: orphans, fused rows and measures of each page; the median to nine decimals."""
    boxes = _boxes(spark, sf_dir)
    return E.layout_score(boxes).join(E.page_summary(boxes).withColumn("median_height", F.round("median_height", 9)), "page_id")


@query(
    """WITH d AS (SELECT page_id, string_agg('"' || text || '" @ ' || printf('%.4f', (min_x + max_x) / 2) || ',' || printf('%.4f', (min_y + max_y) / 2) || '  ' || printf('%.4f', max_x - min_x) || 'x' || printf('%.4f', max_y - min_y), chr(10) ORDER BY min_y + max_y DESC, min_x, box_id) AS shown FROM b GROUP BY page_id),
    r AS (SELECT page_id, row_no, string_agg(text, ' ' ORDER BY box_id) AS line FROM b GROUP BY page_id, row_no),
    o AS (SELECT page_id, 'lines (' || CAST(count(*) AS VARCHAR) || '):' || chr(10) || string_agg(line, chr(10) ORDER BY row_no) AS own FROM r GROUP BY page_id)
    SELECT d.page_id, shown || chr(10) || chr(10) || own AS dump FROM d JOIN o ON d.page_id = o.page_id""",
    b=DUCK_BOXES,
)
def page_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: boxes of each page as text, and its lines."""
    boxes = _boxes(spark, sf_dir)
    return E.box_dump(boxes, boxes.groupBy("page_id", F.col("row_no").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "text"))), lambda b: b.text), " ").alias("line")))


@query(
    """SELECT source, row_seq, name, CASE WHEN category = 'shot' THEN 'unknown' ELSE category END AS category, abv, ml, units, upc FROM (SELECT *, trim(name) AS t FROM c) x WHERE t <> ''""",
    c=CATALOG,
)
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4, SNK1: a catalog written, then read; a category that the library lacks becomes unknown."""
    folder = shared_path(spark, "catalog")
    rows = adapt(spark, sf_dir, CATALOG)
    write_catalog(rows.withColumn("category", F.when(F.col("category") == "shot", "firewater").otherwise(F.col("category"))), folder)
    return read_catalog(spark, f"{folder}/products", rows.limit(0)).select("source", "row_seq", "name", "category", "abv", "ml", "units", "upc")


#: A shouted name of a part in title case, in SQL.
TITLED = "array_to_string(list_transform(string_split(p_name || ' ' || p_brand, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
PRODUCT = ("source", "name", "category", "abv", "ml", "units", "upc")


def _shouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a name in capitals, a barcode and a key, as raw material of source files."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.upper(F.concat_ws(" ", "p_name", "p_brand")).alias("name"), (F.lit(100000000000) + F.col("p_partkey")).cast("string").alias("code"))


@query(
    f"""SELECT 'bc' AS source, {TITLED} AS name, CASE p_partkey % 4 WHEN 0 THEN 'bottledBeer' WHEN 1 THEN 'wineGlass' WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN 'cocktail' ELSE 'shot' END ELSE 'seltzer' END AS category,
    p_size * 2e0 AS abv, p_size * 250e0 AS ml, CAST(nullif(p_partkey % 7, 0) AS INT) AS units, CAST(100000000000 + p_partkey AS VARCHAR) AS upc FROM part WHERE p_partkey % 10 <> 0""",
)
def source_price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: a provincial price list, written from parts; every tenth row has no name."""
    folder, k = shared_path(spark, "price-list"), F.col("k")
    kind = F.when(k % 4 == 0, "Beer").when(k % 4 == 1, "Wine").when(k % 4 == 2, "Spirits").otherwise("Refreshment Beverage")
    rows = _shouted(spark, sf_dir).select(
        kind.alias("ITEM_CATEGORY_NAME"), F.when(k % 8 == 2, "Liqueur").alias("ITEM_SUBCATEGORY_NAME"), F.when(k % 10 != 0, F.col("name")).alias("PRODUCT_LONG_NAME"), F.col("code").alias("PRODUCT_BASE_UPC_NO"),
        (F.col("size") * 0.25).alias("PRODUCT_LITRES_PER_CONTAINER"), (k % 7).alias("PRD_CONTAINER_PER_SELL_UNIT"), (F.col("size") * 2).alias("PRODUCT_ALCOHOL_PERCENT"),
    )
    rows.write.csv(folder, header=True)
    return read_bc(spark, folder).select(*PRODUCT)


@query(f"SELECT 'wholesale-wine' AS source, {TITLED} AS name, 'wineGlass' AS category, CAST(p_size AS DOUBLE) AS abv, p_size * 25e0 AS ml, CAST(p_partkey % 3 + 2 AS INT) AS units, CAST(100000000000 + p_partkey AS VARCHAR) AS upc FROM part")
def source_wholesale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, CAT10: a wholesale sheet, written from parts, with sizes in its descriptions and strength as proof."""
    folder = shared_path(spark, "wholesale")
    described = F.concat("name", F.lit(" "), (F.col("k") % 3 + 2).cast("string"), F.lit("/"), (F.col("size") * 25).cast("string"), F.lit("ML"))
    _shouted(spark, sf_dir).select(described.alias("Item Description"), F.col("code").alias("UPC"), (F.col("size") * 2).alias("Proof")).write.csv(folder, header=True)
    return read_wholesale(spark, folder, "wine").select(*PRODUCT)


@query(
    f"""SELECT 'facts' AS source, {TITLED} AS name, CASE p_partkey % 4 WHEN 0 THEN 'bottledBeer' WHEN 1 THEN 'wineGlass' ELSE 'shot' END AS category, CAST(p_size AS DOUBLE) AS abv, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10e0 ELSE p_size * 25e0 END AS ml,
    CAST(NULL AS INT) AS units, CAST(100000000000 + p_partkey AS VARCHAR) AS upc FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 AND p_partkey % 49 <> 0""",
)
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: a product dump in gzip, written from parts; some lines are broken, no drinks, or of other countries."""
    folder, k = shared_path(spark, "facts"), F.col("k")
    tag = F.when(k % 4 == 0, "en:beers").when(k % 4 == 1, "en:wines").when(k % 4 == 2, "en:vodka").otherwise("en:juices")
    land = F.when(k % 5 == 0, "en:france").when(k % 5 == 1, "united-states").otherwise("en:canada")
    size = F.col("size")
    row = F.struct(
        "code", F.col("name").alias("product_name"), F.array(tag).alias("categories_tags"), F.array(land).alias("countries_tags"), F.concat((size * 25).cast("string"), F.lit(" ml")).alias("quantity"),
        F.when(k % 2 == 0, (size * 10).cast("string")).alias("product_quantity"), F.create_map(F.lit("alcohol_100g"), size.cast("string")).alias("nutriments"),
    )
    _shouted(spark, sf_dir).select(F.when(k % 49 == 0, "{broken").otherwise(F.to_json(row)).alias("value")).write.option("compression", "gzip").text(folder)
    return read_facts(spark, folder).select(*PRODUCT)


@query("SELECT lower(label) AS key, label, 'cocktail' AS category, abv, CAST(row_number() OVER (ORDER BY length(label) DESC, label) - 1 AS INT) AS priority FROM (SELECT p_name || ' ' || p_brand AS label, CAST(max(p_size) AS DOUBLE) AS abv FROM part GROUP BY 1) b")
def source_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: a brand file, written from the names of parts, as a table of brands."""
    folder = shared_path(spark, "brands")
    named = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.max("p_size").cast("double").alias("abv"))
    brand = F.struct("name", F.lit("cocktail").alias("category"), "abv")
    named.agg(F.array_sort(F.collect_list(brand)).alias("brands")).write.json(folder)  # one file of a dimension
    return brand_dimension(spark, folder).select("key", "label", "category", "abv", "priority")


@query("SELECT CAST(100000000000 + p_partkey AS VARCHAR) AS code, CAST(p_size AS VARCHAR) AS strength, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS INT) AS stated FROM part WHERE p_partkey % 4 <> 3 ORDER BY code LIMIT 8")
def facts_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: the first eight drinks of a product dump, with the nutriments that are stated."""
    k = F.col("k")
    tag = F.when(k % 4 == 0, "en:beers").when(k % 4 == 1, "en:wines").when(k % 4 == 2, "en:alcoholic-beverages").otherwise("en:juices")
    nutriments = F.create_map(F.lit("alcohol_100g"), F.col("size").cast("string"), F.lit("sugars"), F.when(k % 3 != 0, "1"), F.lit("salt"), F.lit(""))
    found = relevant_facts(_shouted(spark, sf_dir).select("code", F.array(tag).alias("categories_tags"), nutriments.alias("nutriments")))
    return found.select("code", F.col("nutriments")["alcohol_100g"].alias("strength"), F.size("nutriments").alias("stated"))


def _logs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Log files of pages: their boxes and lines as exports, the lines again as a ranking, noise between; some blocks never end.

    Compressed, as logs that are put away are; a file is then one split, and there are as many files as tasks that deal pages.
    """
    boxes = _boxes(spark, sf_dir)
    rows = boxes.groupBy("page_id", F.col("row_no").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "text"))), lambda b: b.text), " ").alias("line"))
    dumps = E.box_dump(boxes, rows)
    body = F.regexp_replace("dump", r"\n\nlines \(", "\n# lines (").alias("body")
    own = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r.line), "\n").alias("ranking"))
    text = F.concat(F.lit("noise\n12:00 === EXPORT ===\n# page "), "page_id", F.lit("\n"), F.regexp_replace(body, r"# lines \(([0-9]+)\):", "# lines ($1)"), F.lit("\n=== END EXPORT ===\n=== RANKING ===\n"), F.lit("page "), "page_id", F.lit("\n"), "ranking", F.lit("\n=== END RANKING ===\n=== END RANKING ===\n"))
    dumps.join(own, "page_id").select(text.alias("value")).write.option("compression", "gzip").text(folder)


def _page() -> Column:
    """Which page a block of a log belongs to, by its first line."""
    return F.regexp_extract("body", r"^#? ?page (\S+)", 1)


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, body) of the exports in log files of pages; page_id is the page's own, which each has once."""
    folder = shared_path(spark, "exports")
    _logs(spark, sf_dir, folder)
    return read_exports(spark, folder, "=== EXPORT ===", "=== END EXPORT ===").withColumn("page_id", _page())


@query(
    """SELECT page_id, text, count(*) AS boxes, min(CAST(round(min_x * 200) AS BIGINT)) AS left_side, max(CAST(round(max_x * 200) AS BIGINT)) AS right_side,
      min(CAST(round(min_y * 1000) AS BIGINT)) AS bottom_side, max(CAST(round(max_y * 1000) AS BIGINT)) AS top_side FROM b GROUP BY page_id, text""",
    b=DUCK_BOXES,
)
def source_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: boxes of pages, dumped into log files and read from them."""
    boxes = export_boxes(dealt(_exports(spark, sf_dir), "page_id", times=4))
    side = lambda c, n: F.round(F.col(c) * n).cast("long")
    return boxes.groupBy("page_id", "text").agg(F.count("*").alias("boxes"), F.min(side("min_x", 200)).alias("left_side"), F.max(side("max_x", 200)).alias("right_side"), F.min(side("min_y", 1000)).alias("bottom_side"), F.max(side("max_y", 1000)).alias("top_side"))


@query("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY row_no) - 1 AS INT) AS line_no, string_agg(text, ' ' ORDER BY box_id) AS line FROM b GROUP BY page_id, row_no", b=DUCK_BOXES)
def source_recorded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: the lines that an export recorded, checked against the number it states."""
    return recorded_lines(_exports(spark, sf_dir))


@query(
    """WITH r AS (SELECT page_id, row_no, count(*) AS n, string_agg(text, ' ' ORDER BY box_id) AS line FROM b GROUP BY page_id, row_no), p AS (SELECT page_id, sum(n) AS boxes, count(*) AS rows, string_agg(line, chr(10) ORDER BY row_no) AS lines FROM r GROUP BY page_id)
    SELECT page_id, 'EXPORT' AS kind, CAST(boxes + rows + 2 AS BIGINT) AS n_lines, NULL AS body_sha256 FROM p UNION ALL SELECT page_id, 'RANKING', CAST(rows + 1 AS BIGINT), sha256('page ' || page_id || chr(10) || lines) FROM p""",
    b=DUCK_BOXES,
)
def source_log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: all blocks of console logs, by kind."""
    folder = shared_path(spark, "logs")
    _logs(spark, sf_dir, folder)
    blocks = log_blocks(spark, folder)
    return blocks.select(_page().alias("page_id"), "kind", F.size(F.split("body", "\n")).cast("long").alias("n_lines"), F.when(F.col("kind") == "RANKING", F.sha2("body", 256)).alias("body_sha256"))


@query("SELECT doc_id AS page_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\r\\f\\v]+', ' ', 'g')) AS line FROM documents) d WHERE line <> '' GROUP BY doc_id")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY12: structured text as lines."""
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page_id"), "text")
    return Y.text_lines(pages).groupBy("page_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query(
    "SELECT list_id AS page_id, line_no, CASE WHEN regexp_matches(line, '\\$ *[0-9]') OR line_no % 4 <> 0 THEN line ELSE 'Special $' || CAST(line_no AS VARCHAR) END AS line FROM l",
    l=LINES,
)
def promoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY13: the reading of each line that has an anchored price."""
    first = written_lines(spark, sf_dir).withColumnRenamed("list_id", "page_id").withColumn("candidate_no", F.lit(0))
    other = first.where("line_no % 4 = 0").withColumn("line", F.concat(F.lit("Special $"), F.col("line_no").cast("string"))).withColumn("candidate_no", F.lit(2))
    return Y.promote_candidate(first.unionByName(other))


@query("SELECT list_id AS photo_id, line_no, line, CAST(max(CASE WHEN line_no % 3 = 0 AND contains(line, '$') THEN 1 ELSE 0 END) OVER (PARTITION BY list_id) AS INT) AS candidate_no FROM l", l=LINES)
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY14: of two readings of each list, the better one."""
    lines = written_lines(spark, sf_dir).withColumnRenamed("list_id", "photo_id")
    torn = lines.withColumn("line", F.when(F.col("line_no") % 3 == 0, F.substring_index("line", "$", 1)).otherwise(F.col("line")))
    return P.best_reading(torn.withColumn("candidate_no", F.lit(0)).unionByName(lines.withColumn("candidate_no", F.lit(1))))


@query(
    """WITH r AS (SELECT list_id, line_no, CASE WHEN line_no % 9 = 0 THEN line || '!' ELSE line END AS line FROM l WHERE line_no % 31 <> 0 UNION ALL SELECT list_id, line_no + 10000, line FROM l WHERE line_no % 50 = 1),
    d AS (SELECT coalesce(l.list_id, r.list_id) AS page_id, coalesce(l.line_no, r.line_no) AS line_no, l.line AS ours, r.line AS recorded FROM l FULL OUTER JOIN r ON l.list_id = r.list_id AND l.line_no = r.line_no WHERE l.line IS DISTINCT FROM r.line)
    SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS INT) AS place FROM d QUALIFY place <= 12""",
    l=LINES,
)
def compare_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV1: the first twelve places of each page where two readings differ, with both lines."""
    ours = written_lines(spark, sf_dir).withColumnRenamed("list_id", "page_id")
    changed = ours.where("line_no % 31 <> 0").withColumn("line", F.when(F.col("line_no") % 9 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    recorded = changed.unionByName(ours.where("line_no % 50 = 1").withColumn("line_no", F.col("line_no") + 10000))
    return E.compare_lines(ours, recorded)[1]


@query(
    """WITH h AS (SELECT *, CASE WHEN line = 'DRAFT BEER' THEN 'draftBeer' WHEN line LIKE 'COCK%' THEN 'cocktail' WHEN line = 'WINES' OR line LIKE 'REDS%' THEN 'wineGlass' END AS section FROM l)
    SELECT list_id, line_no, line, CASE WHEN section IS NULL THEN 'dropped' WHEN line_no % 5 = 0 THEN 'new' WHEN section <> 'wineGlass' AND line_no % 3 = 0 THEN 'category' ELSE 'kept' END AS change FROM h
    WHERE section IS NOT NULL OR (line LIKE '%Brand#%' AND line_no % 11 = 3)""",
    l=LINES,
)
def header_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV2, EV3: every header that two rules see alike, in another category, or only one of them."""
    lines = written_lines(spark, sf_dir)
    ours = materialized(features(lines).where("section is not null").select("list_id", "line_no", "line", "section"), "headers")
    other = ours.where("line_no % 5 <> 0").withColumn("section", F.when(F.col("line_no") % 3 == 0, "wineGlass").otherwise(F.col("section")))
    wrong = lines.where("line like '%Brand#%' and line_no % 11 = 3").withColumn("section", F.lit("shot"))
    return E.compare_headers(ours, other.unionByName(wrong))


@query("SELECT source, row_seq, name, category, abv, ml, units, upc FROM c WHERE abv IS NOT NULL", c=CATALOG)
def catalog_with_abv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: the rows of a catalog that state a strength."""
    return require_abv(adapt(spark, sf_dir, CATALOG))[0].select("source", "row_seq", "name", "category", "abv", "ml", "units", "upc")


def _edits_in_parts(spark: SparkSession, sf_dir: str, folder: str, then: Callable[[DataFrame], None], parts: int = 4) -> None:
    """Lays the edit log down in four parts, each of which `then` has to take in as a stream before the next one comes."""
    edits = materialized(adapt(spark, sf_dir, EDITS).withColumn("seq", F.col("seq").cast("long")), "edits")
    longest = edits.agg(F.max("seq")).first()[0] or 0
    for part in range(parts):
        edits.where((F.col("seq") > part * longest / parts) & (F.col("seq") <= (part + 1) * longest / parts)).write.mode("append").parquet(f"{folder}/events")
        then(spark.readStream.schema(edits.schema).parquet(f"{folder}/events"))


@query(EDITED, e=EDITS, s=BASE + " WHERE false")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM1: live items of sessions after their edit stream; state is carried from one part to the next."""
    folder = shared_path(spark, "sessions")
    keep = lambda batch, epoch: Z.write_epoch(batch, f"{folder}/live", epoch)
    _edits_in_parts(spark, sf_dir, folder, lambda events: Z.started(Z.stream_sessions(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True), spark).awaitTermination())
    return Z.current_rankings(spark, f"{folder}/live").drop("seq", "late")


@query(
    """SELECT session_id, item_id, name, unit_oz, count, abv, price_cents, total_oz, drinks, drinks / (price_cents / 100e0) AS value,
      CASE WHEN drinks > 0 THEN price_cents / 100e0 / drinks ELSE CAST('Infinity' AS DOUBLE) END AS dollars_per_drink,
      row_number() OVER (PARTITION BY session_id ORDER BY drinks / (price_cents / 100e0) DESC, name, item_id) AS rank FROM (
    SELECT *, greatest(0e0, total_oz) * (greatest(0e0, abv) / 100) / 0.6e0 AS drinks FROM (SELECT session_id, item_id, name, size_oz AS unit_oz, count, abv, price_cents, size_oz * greatest(1, count) AS total_oz FROM d WHERE price_cents > 0) a) b""",
    e=EDITS, s=BASE + " WHERE false", d=EDITED,
)
def stream_session_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM1, VL5: the ranking of each session's packages that the stream gave last."""
    folder = shared_path(spark, "sessions")
    _edits_in_parts(spark, sf_dir, folder, lambda events: Z.stream_session_rankings(events, f"{folder}/ranked", f"{folder}/state").awaitTermination())
    return Z.current_rankings(spark, f"{folder}/ranked").drop("seq", "late")
