"""Findings of the third round: results at size, and the work that they take."""

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_ranked_packages_have_the_columns_of_their_sql_in_its_order(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["package_rank"](spark, SMALL)
    assert got.columns[-3:] == ["dollars_per_drink", "value", "rank"] and got.columns[:2] == ["list_id", "item_no"]


def test_search_compares_queries_with_distinct_names(spark, monkeypatch):
    from brimful.operators import search as H

    met, join = [], H.substring_join
    monkeypatch.setattr(H, "substring_join", lambda texts, *rest: met.append(texts.count()) or join(texts, *rest))
    products = spark.createDataFrame([(i, f"Red Ale {i % 2}") for i in range(60)], "product_id long, name string")
    queries = spark.createDataFrame([(1, "red ale"), (2, "ale 1"), (3, "stout")], "query_id long, query string")
    found = H.search(products, queries, limit=35).orderBy("query_id", "place").collect()
    assert met == [2]
    first = [*range(0, 60, 2), *range(1, 11, 2)]  # all of "red ale 0", then the first of "red ale 1"
    assert [r["product_id"] for r in found if r["query_id"] == 1] == first
    assert [r["product_id"] for r in found if r["query_id"] == 2] == [*range(1, 60, 2)]
    assert [r["place"] for r in found if r["query_id"] == 1] == [*range(1, 36)]


def test_a_page_is_read_from_plain_arrays_and_its_rows_are_cut_once():
    import numpy as np

    from brimful.operators.layout import Page, Thresholds

    rng, n = np.random.default_rng(3), 60
    x, y = np.round(rng.random(n) * 0.9, 2), np.round(rng.random(n), 1)
    columns = {"text": [f"t{i}" for i in range(n)], "min_x": x, "max_x": x + 0.02, "min_y": y, "max_y": y + 0.01}
    page = Page(columns | {c: rng.random(n) < 0.5 for c in ("is_name", "is_serving", "is_price", "has_letter")}, Thresholds())
    every, cuts = np.arange(n), []
    page.by_left = lambda row: cuts.append(len(row)) or Page.by_left(page, row)
    gutters = page.gutters(every)
    assert page.verdicts(page.banded(every)[1], 0.5).shape == (len(page.bands(every)),) and page.gutters(every) == gutters
    assert sum(cuts) == n  # each box is put in its row once, whoever asks
    assert sorted(" ".join(page.lines()).split()) == sorted(columns["text"])


def test_parameters_of_a_page_share_its_cuts_and_one_shuffle(spark):
    from brimful.operators import layout as Y

    rows = [(f"p{p}", r * 10 + k, f"{w}{r}", x, x + 0.3, 0.9 - r * 0.02, 0.91 - r * 0.02) for p in range(3) for r in range(8) for k, (w, x) in enumerate([("left", 0.05), ("right", 0.6)])]
    boxes = spark.createDataFrame(rows, "page_id string, box_id long, text string, min_x double, max_x double, min_y double, max_y double")
    tried = Y.sweep_scores(boxes, Y.height_sweep(spark))
    dealt = [line for line in tried._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in line]
    assert len(dealt) == 1 and "page_id" in dealt[0] and "param_id" not in dealt[0]
    alone = [Y.sweep_scores(boxes, Y.height_sweep(spark, (h,))).collect() for h in (0.5, 1.0, 2.0)]
    together = {(r["page_id"], r["param_id"]): r for r in tried.collect()}
    assert len(together) == 27 and all(together[r["page_id"], r["param_id"]] == r for rows in alone for r in rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_shuffled_once_as_lines(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    for name in ("page_dump", "page_scores", "page_sides", "page_gutter_support"):
        by_page = [line for line in _plan(queries[name](spark, SMALL)).splitlines() if "Exchange hashpartitioning(page_id" in line]
        assert by_page and all("REPARTITION_BY_NUM" in line for line in by_page), name


def test_boxes_meet_gutters_without_a_sort_and_each_gutter_has_its_own_verdict(spark):
    from brimful.operators import layout as Y

    rows = [("p", r, r * 10 + k, f"word{k}", x, x + 0.2) for r in range(4) for k, x in enumerate([0.1, 0.6] if r else [0.1, 0.35, 0.6])]
    boxes = spark.createDataFrame(rows, "page_id string, row_no int, box_id long, text string, min_x double, max_x double")
    gutters = spark.createDataFrame([("p", 0.45), ("p", 0.15)], "page_id string, x double")
    assert "SortMergeJoin" not in _plan(Y.gutter_support(boxes, gutters)) + _plan(Y.column_sides(boxes, gutters))
    assert {(r["x"], r["voters"], r["crossers"]) for r in Y.gutter_support(boxes, gutters).collect()} == {(0.45, 3, 1), (0.15, 0, 4)}
    assert {(r["x"], r["side"], r["boxes"]) for r in Y.column_sides(boxes, gutters).collect()} == {(0.45, "left", 4), (0.45, "right", 5), (0.15, "right", 9)}


def test_logs_are_written_compressed(spark, tmp_path):
    from brimful.plans import more_queries as M

    M._logs(spark, SMALL, str(tmp_path / "logs"))
    written = [f.name for f in (tmp_path / "logs").iterdir() if f.name.startswith("part-")]
    assert written and all(name.endswith(".gz") for name in written)


def test_headers_are_found_once_for_both_sides(spark):
    import __spark_entry__

    for name in ("compare_headers", "header_changes"):
        assert "headers-" in _plan(__spark_entry__.queries()[name](spark, SMALL)), name


def test_a_batch_of_lists_takes_several_files(spark, monkeypatch):
    """30 files are no 30 batches."""
    import os
    from types import SimpleNamespace

    from brimful.plans import chain_queries as Q
    from brimful.streaming import streams as Z

    monkeypatch.setattr(Q, "LINES_PER_FILE", 300)
    monkeypatch.setattr(Z, "rank_lists", lambda batch, *_: SimpleNamespace(ranked=batch))
    out = Q.stream_rankings(spark, "/root/testdata/sf0.001")
    folder = out.inputFiles()[0].split("/epoch=")[0].removeprefix("file://")
    files = [f for f in os.listdir(folder.replace("/ranked", "/lines")) if f.endswith(".parquet")]
    epochs = [f for f in os.listdir(folder) if f.startswith("epoch=")]
    assert len(files) > 8 and len(epochs) <= -(-len(files) // 4)


def test_lines_of_several_readings_are_made_once(spark):
    """readings come from the written lines; promoting deals lines to more tasks than one shuffle has."""
    from brimful.plans import more_queries as Q

    for query in (Q.best_readings, Q.compare_places, Q.promoted_lines):
        assert not [f for f in query(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]
    assert Q.promoted_lines(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lines_are_marked_only_where_marks_can_count(spark):
    """Plain lines skip the costly marks; no line that needs them does."""
    from pyspark.sql import functions as F

    from brimful.functions import lines as L

    needed = ["Merlot $9 $34", "Merlot s5 glass S2O", "12oz $5", "Glass. $7", "$5 / 7oz", "(pint) 6", "750ml $30", "a $5\n$6 $7"]
    rows = spark.createDataFrame([(x,) for x in [*needed, "spring slate Brand#12 4.0% ABV $901.00", "KITCHEN", "Stout 6%"]], "line string")
    marked = L.marks(F.col("line"))
    wanted = L.grid_price(marked).isNotNull() | (F.size(F.filter(marked, lambda m: m.price.isNotNull())) >= 2)
    found = rows.select("line", L.may_have_marks(L.spaced(F.col("line"))).alias("may"), wanted.alias("wanted")).collect()
    assert [r.line for r in found if not r.may] == ["spring slate Brand#12 4.0% ABV $901.00", "KITCHEN", "Stout 6%"]
    assert not [r.line for r in found if r.wanted and not r.may] and sum(r.wanted for r in found) >= 4
