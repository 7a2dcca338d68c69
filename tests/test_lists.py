"""Lists read by windows: lines of several prices, grids, inherited prices, food regions, adopted lines; pages by text height and band."""

import pytest


def _read(spark, *lists):
    from brimful.operators import lists as R

    rows = [(f"L{k}", i, line) for k, lines in enumerate(lists) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "list_id string, line_no int, line string").repartition(3)
    items, gates = R.parse_lists(df).orderBy("list_id", "item_no").collect(), R.trace_lists(df).orderBy("list_id", "line_no").collect()
    return [[r for r in items if r["list_id"] == f"L{k}"] for k in range(len(lists))], [[r["gate"] for r in gates if r["list_id"] == f"L{k}"] for k in range(len(lists))]


def _shown(items):
    return [(r["name"], r["price_cents"], r["read_size_oz"], r["category"]) for r in items]


@pytest.mark.parametrize(
    "line, want",
    [
        ("Pale Ale pint $5 pitcher $18", [("Pale Ale (pint)", 500, 16.0), ("Pale Ale (pitcher)", 1800, None)]),
        ("Merlot $36 $9", [("Merlot (bottle)", 3600, 25.36), ("Merlot (glass)", 900, 5.0)]),
        ("Merlot $9 $9", [("Merlot (glass)", 900, 5.0), ("Merlot (bottle)", 900, 25.36)]),
        ("Stout 12oz $4 16oz $6 22oz $8", [("Stout (12 oz)", 400, 12.0), ("Stout (16 oz)", 600, 16.0), ("Stout (22 oz)", 800, 22.0)]),
        ("Porter $4 12oz $6 16oz", [("Porter (12 oz)", 400, 12.0), ("Porter (16 oz)", 600, 16.0)]),
        ("Kolsch $5 10oz 16oz $7", [("Kolsch (10 oz)", 500, 10.0), ("Kolsch (16 oz)", 700, 16.0)]),
        ("Kolsch $5 10oz $7 $9", [("Kolsch (10 oz)", 500, 10.0), ("Kolsch", 700, None), ("Kolsch", 900, None)]),
    ],
)
def test_lines_of_several_prices(spark, line, want):
    (items,), (gates,) = _read(spark, [line])
    got = [(r["name"], r["price_cents"], r["read_size_oz"]) for r in items]
    assert gates == ["sizes"] and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(w[2] is None or g[2] == w[2] for g, w in zip(got, want, strict=True))


def test_grids_fill_the_waiting_item_or_price_those_below(spark):
    back, ahead, twice = _read(spark, ["Mystery Ale", "glass $14 pitcher $49", "Old Ale"], ["Lager $6", "pint $5 pitcher $18", "Mystery Ale", "$3 $9", "Amber"], ["Mystery Ale", "$4 $8", "$5 $9", "Old Ale"])[0]
    assert _shown(back) == [("Mystery Ale", 1400, None, "unknown"), ("Old Ale", None, None, "unknown")]
    assert [(r["name"], r["price_cents"]) for r in ahead] == [("Lager", 600), ("Mystery Ale", 500), ("Amber", 300)]
    assert [(r["name"], r["price_cents"]) for r in twice] == [("Mystery Ale", 400), ("Old Ale", 500)]


def test_sections_prices_and_food(spark):
    (wine, food), (_, gates) = _read(spark, ["WINES - $9 GLASS / $82 BOTTLE", "Malbec", "REDS", "Syrah", "DRAFT BEER", "Amber"], ["DRAFT BEER", "Lager $6", "KITCHEN", "Plain Plate $12", "COCKTAILS...$12", "Fizz", "", "www.bar.com"])
    assert _shown(wine) == [("Malbec", 900, None, "wineGlass"), ("Syrah", 900, None, "wineGlass"), ("Amber", None, None, "draftBeer")]
    assert [(r["name"], r["price_cents"], r["category"]) for r in food] == [("Lager", 600, "draftBeer"), ("Fizz", 1200, "cocktail")]
    assert gates == ["section", "item", "food_header", "in_food", "section", "item", "blank", "url"]


def test_adopted_lines(spark):
    (items,), (gates,) = _read(spark, ["(STYLE) 5.4% ABV", "Lager $6", "(STYLE) 5.4% ABV", "9% 16oz", "vodka, lime, soda, mint", "Amber 7% 12oz $8"])
    assert gates == ["no_name" if not items or items[0]["line_no"] else "item", "item", "attribute", "attribute", "description", "item"]
    lager = next(r for r in items if r["name"] == "Lager")
    assert (lager["read_abv"], lager["read_size_oz"], lager["description"], lager["price_cents"]) == (5.4, 16.0, "(STYLE) 5.4% ABV 9% 16oz vodka, lime, soda, mint", 600)
    assert [(r["name"], r["read_abv"], r["read_size_oz"]) for r in items if r["name"].startswith("Amber")] == [("Amber", 7.0, 12.0)]


def test_no_lines(spark):
    from brimful.operators import lists as R

    none = spark.createDataFrame([], "list_id string, line_no int, line string")
    assert R.parse_lists(none).count() == R.trace_lists(none).count() == 0


def _boxes(spark, rows):
    """Boxes of one page from rows of (top in thousandths, [(text, left, right)...])."""
    out = [("p", i * 10 + k, text, a / 1000, b / 1000, (top - 10) / 1000, top / 1000) for i, (top, row) in enumerate(rows) for k, (text, a, b) in enumerate(row)]
    return spark.createDataFrame(out, "page_id string, box_id long, text string, min_x double, max_x double, min_y double, max_y double")


WHOLE = [("Wild", 60, 280), ("Garden", 285, 530), ("Herb", 535, 760), ("Punch", 765, 940)]
HALVES = [("left of it", 50, 400), ("right of it", 600, 950)]


def test_bands_between_whole_rows(spark):
    from brimful.operators.layout import assemble

    rows = [WHOLE] * 4 + [HALVES] * 2 + [[HALVES[0]]] + [HALVES] * 3 + [WHOLE] * 4
    boxes = _boxes(spark, [(980 - 20 * i, row) for i, row in enumerate(rows)])
    params = spark.createDataFrame([(str(k), k % 2 == 1) for k in range(150)], "param_id string, isolate boolean")  # any number of parameters
    lines = assemble(boxes, params)
    got = {p: [r["line"] for r in lines.where(f"param_id = '{p}'").orderBy("line_no").collect()] for p in (0, 149)}
    assert got[149] == ["Wild Garden Herb Punch"] * 4 + ["left of it"] * 6 + ["right of it"] * 5 + ["Wild Garden Herb Punch"] * 4
    assert got[0] == ["Wild Garden Herb Punch"] * 4 + ["left of it right of it"] * 2 + ["left of it"] + ["left of it right of it"] * 3 + ["Wild Garden Herb Punch"] * 4
    assert lines.select("param_id").distinct().count() == 150


def test_sections_by_text_height(spark):
    from brimful.operators.layout import height_sweep, sweep_scores

    rows = [(980 - 12 * i - (10 if i > 5 else 0), WHOLE if i < 6 else HALVES) for i in range(12)]  # 1.2 heights between the sections
    got = {r["param_id"]: (r["orphans"], r["fused"], r["lines"]) for r in sweep_scores(_boxes(spark, rows), height_sweep(spark, (0.5, 1.1, 1.3))).collect()}
    assert got == {"heights=0.5": (0.0, 0.0, 18), "heights=1.1": (0.0, 0.0, 18), "heights=1.3": (0.5, 0.0, 24)}
