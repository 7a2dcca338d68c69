"""Registered queries on pages whose right lines are known by construction: columns, sections, bands and variants (LY1-LY10, EV6-EV8).

Every twelve or fourteen parts make a page; its kind says where the boxes of a row stand. The last page may have fewer
rows, so that too few agree for a cut; the SQL says what is right for any number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimful.operators import evaluate as E
from brimful.operators import layout as Y
from brimful.plans.adapters import adapt
from brimful.plans.queries import SQL, query


def rows_of(rows: int, kinds: int) -> str:
    """Parts as rows of pages: page, kind, row_no, and how many rows the page has."""
    return f"""SELECT *, CAST(count(*) OVER (PARTITION BY page) AS INT) AS n_rows FROM (
      SELECT CAST(floor(p_partkey / {rows}.0) AS BIGINT) AS page, CAST(floor(p_partkey / {rows}.0) AS BIGINT) % {kinds} AS kind, p_partkey % {rows} AS row_no, p_name AS a, p_brand AS b, split_part(p_name, ' ', 1) AS first_word, p_size
      FROM {{part}}) p"""


def boxes_of(rows: str, specs: list[tuple[str, str, str, str]], y: str) -> str:
    """Boxes from (condition, text, min_x, max_x) in SQL; y is the upper side in thousandths."""
    parts = [f"SELECT page, row_no, {k} AS k, {text} AS text, {x0} AS min_x, {x1} AS max_x, {y} AS top FROM r WHERE {where}" for k, (where, text, x0, x1) in enumerate(specs)]
    return f"""WITH r AS ({rows}), b AS ({" UNION ALL ".join(parts)})
    SELECT CAST(page AS VARCHAR(20)) AS page_id, row_no, CAST(row_no * 10 + k AS BIGINT) AS box_id, text, CAST(min_x AS DOUBLE) / 1000 AS min_x, CAST(max_x AS DOUBLE) / 1000 AS max_x, CAST(top - 10 AS DOUBLE) / 1000 AS min_y, CAST(top AS DOUBLE) / 1000 AS max_y FROM b"""


def across(where: str) -> list[tuple[str, str, str, str]]:
    """A row of four words that leaves no gutter free."""
    return [(where, "first_word", "60", "280"), (where, "'Garden'", "285", "530"), (where, "'Herb'", "535", "760"), (where, "'Punch'", "765", "940")]


def halves(where: str) -> list[tuple[str, str, str, str]]:
    """A row of two columns."""
    return [(where, "a || ' of the house'", "50", "400"), (where, "b || ' on the side'", "600", "950")]


ACROSS, LEFT, RIGHT = "first_word || ' Garden Herb Punch'", "a || ' of the house'", "b || ' on the side'"
PRICE = "'$' || CAST(p_size AS VARCHAR(9)) || '.50'"
RAGGED = ("CASE WHEN row_no % 2 = 0 THEN 850 ELSE 700 END", "CASE WHEN row_no % 2 = 0 THEN 920 ELSE 770 END")

#: Two columns; three columns; a section of whole rows over one of two columns; names with ragged prices; two items in a row.
SPLIT_ROWS = rows_of(12, 5)
SPLIT_BOXES = boxes_of(
    SPLIT_ROWS,
    [
        *halves("kind = 0 OR (kind = 2 AND row_no >= 6)"),
        ("kind = 1", "a", "20", "260"), ("kind = 1", "b", "370", "610"), ("kind = 1", "first_word || ' cup'", "720", "960"),
        *across("kind = 2 AND row_no < 6"),
        ("kind = 3", "a", "50", "250 + 50 * (p_size % 4)"), ("kind = 3", PRICE, *RAGGED),
        ("kind = 4 AND row_no % 3 = 0", "a", "50", "260"), ("kind = 4 AND row_no % 3 = 0", PRICE, "265", "330"), ("kind = 4 AND row_no % 3 = 0", "b", "600", "810"), ("kind = 4 AND row_no % 3 = 0", PRICE, "815", "880"),
        ("kind = 4 AND row_no % 3 <> 0", "a", "300", "720"),
    ],
    "980 - row_no * 20 - CASE WHEN kind = 2 AND row_no >= 6 THEN 80 ELSE 0 END",
)


@query(
    f"""WITH c AS (SELECT *, count(*) FILTER (kind = 2 AND row_no >= 6) OVER (PARTITION BY page) AS n_low FROM r),
    x AS (
      SELECT page, 0 AS part, row_no, 0 AS k, a || ' of the house' AS line FROM c WHERE kind = 0 AND n_rows >= 3 UNION ALL SELECT page, 1, row_no, 0, {RIGHT} FROM c WHERE kind = 0 AND n_rows >= 3
      UNION ALL SELECT page, 0, row_no, 0, {LEFT} || ' ' || {RIGHT} FROM c WHERE kind = 0 AND n_rows < 3
      UNION ALL SELECT page, CASE WHEN n_rows >= 3 THEN k ELSE 0 END, row_no, k, cell FROM (SELECT *, unnest([0, 1, 2]) AS k, unnest([a, b, first_word || ' cup']) AS cell FROM c WHERE kind = 1) t WHERE n_rows >= 3
      UNION ALL SELECT page, 0, row_no, 0, a || ' ' || b || ' ' || first_word || ' cup' FROM c WHERE kind = 1 AND n_rows < 3
      UNION ALL SELECT page, 0, row_no, 0, {ACROSS} FROM c WHERE kind = 2 AND row_no < 6
      UNION ALL SELECT page, 1, row_no, 0, {LEFT} FROM c WHERE kind = 2 AND row_no >= 6 AND n_low >= 3 UNION ALL SELECT page, 2, row_no, 0, {RIGHT} FROM c WHERE kind = 2 AND row_no >= 6 AND n_low >= 3
      UNION ALL SELECT page, 1, row_no, 0, {LEFT} || ' ' || {RIGHT} FROM c WHERE kind = 2 AND row_no >= 6 AND n_low < 3
      UNION ALL SELECT page, 0, row_no, 0, a || ' ' || {PRICE} FROM c WHERE kind = 3
      UNION ALL SELECT page, 0, row_no, 0, a || ' ' || {PRICE} FROM c WHERE kind = 4 AND row_no % 3 = 0 UNION ALL SELECT page, 0, row_no, 1, b || ' ' || {PRICE} FROM c WHERE kind = 4 AND row_no % 3 = 0
      UNION ALL SELECT page, 0, row_no, 0, a FROM c WHERE kind = 4 AND row_no % 3 <> 0)
    SELECT CAST(page AS VARCHAR) AS page_id, CAST(row_number() OVER (PARTITION BY page ORDER BY part, row_no, k) - 1 AS INT) AS line_no, line FROM x""",
    r=SPLIT_ROWS,
)
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY1 to LY3, LY5 to LY10: pages of two and three columns, of sections, of prices that are no column, and of two items in a row."""
    return Y.assemble(adapt(spark, sf_dir, SPLIT_BOXES))


#: A block of two columns between whole rows; names with strengths and ragged prices.
BAND_ROWS = rows_of(14, 2)
BLOCK = "row_no BETWEEN 4 AND 9"
BAND_BOXES = boxes_of(
    BAND_ROWS,
    [*across(f"kind = 0 AND NOT {BLOCK}"), *halves(f"kind = 0 AND {BLOCK}"), ("kind = 1", "a || CASE WHEN p_size % 2 = 0 THEN ' 5.0% ABV' ELSE '' END", "50", "450"), ("kind = 1", PRICE, *RAGGED)],
    "980 - row_no * 20",
)
BAND_COUNTS = f"c AS (SELECT *, count(*) FILTER ({BLOCK}) OVER (PARTITION BY page) AS n_block, count(*) FILTER (NOT {BLOCK}) OVER (PARTITION BY page) AS n_across FROM r)"


@query(
    f"""WITH {BAND_COUNTS}, x AS (
      SELECT page, CASE WHEN row_no < 4 OR n_block < 3 THEN 0 ELSE 3 END AS part, row_no, {ACROSS} AS line FROM c WHERE kind = 0 AND NOT {BLOCK}
      UNION ALL SELECT page, 0, row_no, {LEFT} || ' ' || {RIGHT} FROM c WHERE kind = 0 AND {BLOCK} AND n_block < 3
      UNION ALL SELECT page, 1, row_no, {LEFT} FROM c WHERE kind = 0 AND {BLOCK} AND n_block >= 3
      UNION ALL SELECT page, 2, row_no, {RIGHT} FROM c WHERE kind = 0 AND {BLOCK} AND n_block >= 3
      UNION ALL SELECT page, 0, row_no, a || CASE WHEN p_size % 2 = 0 THEN ' 5.0% ABV' ELSE '' END || ' ' || {PRICE} FROM c WHERE kind = 1)
    SELECT CAST(page AS VARCHAR) AS page_id, CAST(row_number() OVER (PARTITION BY page ORDER BY part, row_no) - 1 AS INT) AS line_no, line FROM x""",
    r=BAND_ROWS,
)
def page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV8: a block of two columns between whole rows is cut out and split; the whole rows stay whole."""
    alone = spark.createDataFrame([("isolate", True)], "param_id string, isolate boolean").withColumn("min_names", F.lit(0.2))
    return Y.assemble(adapt(spark, sf_dir, BAND_BOXES), alone).drop("param_id")


@query(
    f"""WITH {BAND_COUNTS}, v AS (SELECT unnest(['base', 'veto', 'isolate', 'price_gutter', 'chaining', 'both', 'usual']) AS param_id),
    p AS (SELECT page, kind, n_rows, n_block, n_across, count(*) FILTER (p_size % 2 = 0) AS n_strong FROM c GROUP BY ALL),
    w AS (SELECT *, CASE WHEN kind = 1 THEN n_rows >= 3 AND param_id NOT IN ('price_gutter', 'both', 'usual')
                         WHEN n_block < 3 THEN false WHEN param_id IN ('veto', 'usual') THEN n_across <= n_block ELSE true END AS cut FROM p, v)
    SELECT CAST(page AS VARCHAR) AS page_id, param_id, CAST(CASE WHEN NOT cut THEN n_rows WHEN kind = 0 AND param_id = 'isolate' AND n_across > 0 THEN n_rows + n_block ELSE 2 * n_rows END AS BIGINT) AS lines,
      CAST(CASE WHEN kind = 1 AND NOT cut THEN n_rows ELSE 0 END AS BIGINT) AS priced, CAST(CASE WHEN kind = 1 AND NOT cut THEN n_strong ELSE 0 END AS BIGINT) AS complete FROM w""",
    r=BAND_ROWS,
)
def page_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV7, EV8, LN19: lines, priced and complete rows of each page under the variants of the bench."""
    return Y.variant_bench(adapt(spark, sf_dir, BAND_BOXES), Y.variants(spark))


#: Whole rows over two columns, with a gap between the sections of 0.55 to 1.75 heights of a box, by page.
GAP = "CASE page % 6 WHEN 0 THEN 0.55 WHEN 1 THEN 0.75 WHEN 2 THEN 0.95 WHEN 3 THEN 1.1 WHEN 4 THEN 1.35 ELSE 1.75 END"
HEIGHT_ROWS = rows_of(12, 6)
HEIGHT_BOXES = boxes_of(HEIGHT_ROWS, [*across("row_no < 6"), *halves("row_no >= 6")], f"980 - row_no * 12 - CASE WHEN row_no >= 6 THEN 10 * ({GAP} - 0.2) ELSE 0 END")


@query(
    f"""WITH k AS (SELECT unnest(['heights=0.5', 'heights=0.6', 'heights=0.7', 'heights=0.8', 'heights=0.9', 'heights=1.0', 'heights=1.2', 'heights=1.5', 'heights=2.0']) AS param_id, unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0]) AS heights),
    p AS (SELECT page, {GAP} AS gap, n_rows, count(*) FILTER (row_no < 6) AS n_up, count(*) FILTER (row_no >= 6) AS n_low FROM r GROUP BY ALL),
    s AS (SELECT page, param_id, CASE WHEN heights > gap AND n_low >= 3 THEN n_up * 1e0 / n_rows ELSE 0e0 END AS orphans,
      CASE WHEN n_low = 1 OR (n_low = 2 AND heights > gap) THEN n_low * 1e0 / n_rows ELSE 0e0 END AS fused FROM p, k)
    SELECT param_id, round(avg(orphans), 9) AS orphans, round(avg(fused), 9) AS fused, round(avg(orphans + fused), 9) AS bad, count(*) AS pages FROM s GROUP BY param_id""",
    r=HEIGHT_ROWS,
)
def page_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV6: what nine section gaps, in heights of text, do to pages whose sections lie 0.55 to 1.75 heights apart."""
    return Y.sweep_summary(Y.sweep_scores(adapt(spark, sf_dir, HEIGHT_BOXES), Y.height_sweep(spark)))


FEW = "len(string_split(line, ' ')) <= 2 AND NOT regexp_matches(line, '[0-9]')"


@query(
    f"""WITH p AS (SELECT page_id, CAST(page_id AS INT) % 7 * 100 + 900 AS px_w, 1400 AS px_h, round(quantile_cont(max_y - min_y, 0.5), 9) AS median_height FROM b GROUP BY page_id),
    d AS (SELECT page_id, row_no, string_agg(text, ' ' ORDER BY box_id) AS line FROM b GROUP BY page_id, row_no), r AS (SELECT page_id, count(*) AS recorded_lines, round(avg(row_no / 16e0), 9) AS confidence, round(avg(CASE WHEN {FEW} THEN 1 ELSE 0 END), 9) AS fragments_before FROM d GROUP BY page_id),
    a AS (SELECT page_id, count(*) AS lines, round(avg(CASE WHEN {FEW} THEN 1 ELSE 0 END), 9) AS fragments_after FROM c GROUP BY page_id)
    SELECT p.page_id, px_w, px_h, px_w / 1400e0 AS aspect, confidence, median_height, recorded_lines, lines, fragments_before, fragments_after FROM p JOIN r ON p.page_id = r.page_id JOIN a ON p.page_id = a.page_id""",
    b=SPLIT_BOXES, c=SQL["page_columns"],
)
def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV9: pixels, confidence, heights, line counts and fragments of each page, with rows read straight across and with columns."""
    boxes = adapt(spark, sf_dir, SPLIT_BOXES)
    pages = boxes.select("page_id").distinct().select("page_id", (F.col("page_id").cast("int") % 7 * 100 + 900).alias("px_w"), F.lit(1400).alias("px_h"))
    across = boxes.groupBy("page_id", F.col("row_no").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "text"))), lambda b: b.text), " ").alias("line"), (F.first("row_no") / 16.0).cast("double").alias("confidence"))
    done = E.page_report(boxes, pages, across, Y.assemble(boxes))
    return done.select(*(F.round(c, 9).alias(c) if c in ("confidence", "median_height", "fragments_before", "fragments_after") else c for c in done.columns))


@query(
    "SELECT CAST(page AS VARCHAR) AS page_id, CAST(row_no AS INT) AS row_no, array_to_string(list_filter(list_transform([a, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE ' ' || b || ' ' END, '', CAST(p_size AS VARCHAR)], lambda c: trim(c)), lambda c: c <> ''), ' ') AS line FROM r",
    r=SPLIT_ROWS,
)
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LY12: rows of tables as lines of their cells that are not empty."""
    rows = adapt(spark, sf_dir, SPLIT_ROWS)
    cells = F.array("a", F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.concat(F.lit(" "), "b", F.lit(" "))), F.lit(""), F.col("p_size").cast("string"))
    return Y.table_lines(rows.select(F.col("page").cast("string").alias("page_id"), F.col("row_no").cast("int").alias("row_no"), cells.alias("cells")))
