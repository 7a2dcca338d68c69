"""The driver's tables as the library's inputs, in SQL that Spark and DuckDB both read.

Table names stand in braces: adapt() binds them to DataFrames, sql_of() to the views of the same names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

OFFERS = """
SELECT CAST(floor(l_orderkey / 10.0) AS BIGINT) AS list_id,
  CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 10.0) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS BIGINT) AS item_no,
  p_name || ' ' || p_brand AS name,
  CASE WHEN l_tax = 0.08 THEN NULL ELSE CAST(round(l_extendedprice) AS INT) * CASE WHEN l_quantity = 50 THEN 100 ELSE 1 END END AS price_cents,
  l_discount * 100 AS abv, l_quantity AS size_oz,
  CASE WHEN l_returnflag = 'A' AND l_tax = 0 THEN 'nonAlcoholic' WHEN p_type LIKE 'ECONOMY%' THEN 'bottledBeer' WHEN p_type LIKE 'SMALL%' THEN 'shot'
       WHEN p_type LIKE 'MEDIUM%' THEN 'wineGlass' WHEN p_type LIKE 'PROMO%' THEN 'cocktail' WHEN p_type LIKE 'STANDARD%' THEN 'draftBeer' ELSE 'unknown' END AS category
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
PACKAGES = f"""
SELECT list_id, item_no, name, size_oz AS unit_oz, CAST(item_no % 6 AS INT) AS count, abv, price_cents FROM ({OFFERS}) o
"""
CATALOG = """
SELECT CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, CAST(p_partkey % 3 AS INT) AS source_rank, p_partkey AS row_seq,
  p_name || ' ' || p_brand AS name, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'bottledBeer' WHEN p_type LIKE 'SMALL%' THEN 'shot' WHEN p_type LIKE 'PROMO%' THEN 'nonAlcoholic' ELSE 'wineGlass' END AS category,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS abv,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size * 25 AS DOUBLE) END AS ml,
  CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS INT) ELSE NULL END AS units,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(100000 + p_partkey % 997 AS VARCHAR(20)) END AS upc
FROM {part}
"""
RAW = """
SELECT p_partkey AS row_seq, upper(p_name || ' ' || p_brand) || ' ' || CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 6 AS VARCHAR(9)) || '/' ELSE '' END
    || CAST(p_size * 24 AS VARCHAR(9)) || CASE p_partkey % 4 WHEN 0 THEN 'ML' WHEN 1 THEN ' oz' WHEN 2 THEN ' L' ELSE '' END AS name,
  CAST(p_partkey % 1000 AS VARCHAR(9)) || '-' || CAST(p_size AS VARCHAR(9)) AS upc, CAST(p_retailprice AS VARCHAR(30)) || ' %' AS price, CAST(p_size * 2 AS VARCHAR(9)) || ' PROOF' AS proof, p_type AS type, p_brand AS brand
FROM {part}
"""
QUERIES = """
SELECT row_number() OVER (ORDER BY query) AS query_id, query FROM (
  SELECT DISTINCT p_name AS query FROM {part} UNION SELECT DISTINCT p_brand FROM {part} UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM {part}) q
"""
EDITS = """
SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id % 4 AS item_id,
  CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'set_price' WHEN 'click' THEN 'correct_abv' WHEN 'view' THEN 'set_package' WHEN 'error' THEN 'remove' ELSE 'correct_size' END AS kind,
  CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'item ' || CAST(event_id AS VARCHAR(20)) END AS name, value, CAST(event_id % 7 AS INT) AS count,
  CASE event_id % 5 WHEN 0 THEN 'nonAlcoholic' WHEN 1 THEN 'draftBeer' WHEN 2 THEN 'shot' ELSE 'unknown' END AS category,
  CAST(event_id % 12 AS DOUBLE) AS abv, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 16 + 1 AS DOUBLE) END AS size_oz, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS price
FROM {events}
"""
SESSIONS = """
SELECT DISTINCT user_id AS session_id, event_id % 2 AS item_id FROM {events}
"""
#: Price-list lines: for each list a section header and its offers, numbers as decimals so that both engines print them alike.
LINES = f"""
SELECT CAST(list_id AS VARCHAR(20)) AS list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY item_no, part) AS INT) AS line_no,
  CASE part
    WHEN 0 THEN CASE item_no % 5 WHEN 0 THEN 'WINES' WHEN 1 THEN 'DRAFT BEER' WHEN 2 THEN 'KITCHEN' WHEN 3 THEN 'REDS $' || CAST(item_no AS VARCHAR(9)) ELSE 'COCKTAILS...$12' END
    WHEN 1 THEN name || CASE WHEN item_no % 3 = 0 THEN ' ' || CAST(CAST(abv AS DECIMAL(6, 1)) AS VARCHAR(9)) || '% ABV' ELSE '' END || CASE WHEN price_cents IS NULL THEN '' ELSE ' $' || CAST(CAST(price_cents / 100.0 AS DECIMAL(12, 2)) AS VARCHAR(20)) END
    ELSE '(HOUSE STYLE) ' || CAST(CAST(abv AS DECIMAL(6, 1)) AS VARCHAR(9)) || '% 12oz' END AS line
FROM (SELECT *, {{each of 0, 1, 2}} AS part FROM ({OFFERS}) o) l
WHERE part = 1 OR (part = 0 AND item_no % 4 = 1) OR (part = 2 AND item_no % 7 = 2)
"""
#: A row for each of some numbers, in either engine's words.
EACH_OF = re.compile(r"\{each of ([0-9, ]+)\}")


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def adapt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql = EACH_OF.sub(r"explode(array(\1))", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def sql_of(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", EACH_OF.sub(r"unnest([\1])", sql))
