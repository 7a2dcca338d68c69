"""Edits of sessions against a fold, in batch and in a stream of several parts; misread names; forms; outcomes."""

import random

import pytest

from pyspark.sql import functions as F

EVENTS = "session_id long, seq long, item_id long, kind string, name string, value double, count int, category string, abv double, size_oz double, price double"


def _log(rng, sessions=12, n=40):
    kinds = ["add", "add", "add", "remove", "set_price", "correct_abv", "correct_size", "set_package", "nonsense"]
    rows = []
    for s in range(sessions):
        for seq in range(n):
            kind = rng.choice(kinds)
            rows.append((s, seq, rng.randrange(4), kind, rng.choice(["x y", " padded\t", " ", None, f"n{seq}"]), rng.choice([None, 0.0, -1.0, 0.004, 4.25, 12.5]), rng.choice([None, -2, 0, 3]), rng.choice([None, "nonAlcoholic", "shot"]), rng.choice([None, 4.5]), rng.choice([None, 16.0]), rng.choice([None, 0.0, 7.5])))
    return rows


def _fold(base, events):
    """The rule, one event after the other."""
    live = {k: dict(v) for k, v in base.items()}
    for session, _, item, kind, name, value, count, category, abv, size, price in sorted(events, key=lambda r: r[:2]):
        key, cents = (session, item), None if (price if kind == "add" else value) is None else int((price if kind == "add" else value) * 100 + 0.5)
        cents = cents if cents is not None and cents > 0 else None
        now = live.get(key)
        if kind == "add" and now is None and (name or "").strip():
            live[key] = {"name": name.strip(), "category": "unknown" if category in (None, "nonAlcoholic") else category, "price_cents": cents, "abv": abv, "abv_estimated": False, "size_oz": size, "size_estimated": False, "count": max(1, count or 1)}
        elif now is None:
            continue
        elif kind == "remove":
            del live[key]
        elif kind == "set_price" and cents:
            now["price_cents"] = cents
        elif kind == "correct_abv" and value is not None:
            now.update(abv=value, abv_estimated=False)
        elif kind == "correct_size" and value is not None:
            now.update(size_oz=value, size_estimated=False)
        elif kind == "set_package":
            now["count"] = max(1, count or 1)
            if size is not None:
                now.update(size_oz=size, size_estimated=False)
    return live


ITEM = ("name", "category", "price_cents", "abv", "abv_estimated", "size_oz", "size_estimated", "count")


def _rows(df):
    return {(r["session_id"], r["item_id"]): {c: r[c] for c in ITEM} for r in df.collect()}


def test_batch_edits_equal_a_fold(spark):
    from brimful.operators.sessions import STATE, apply_edits

    events = _log(random.Random(5))
    base = {(s, 0): {"name": "base", "category": "wineGlass", "price_cents": 500, "abv": 5.0, "abv_estimated": True, "size_oz": 12.0, "size_estimated": True, "count": 2} for s in range(0, 14)}
    rows = [(*k, *v.values()) for k, v in base.items()]
    start = spark.createDataFrame(rows, "session_id long, item_id long, name string, category string, price_cents int, abv double, abv_estimated boolean, size_oz double, size_estimated boolean, count int").select(*STATE)
    got = _rows(apply_edits(start, spark.createDataFrame(events, EVENTS).repartition(3)))
    assert got == _fold(base, events) and (13, 0) in got
    assert apply_edits(start.limit(0), spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_of_parts_equals_batch_and_counts_late_events(spark, tmp_path):
    from brimful.streaming.streams import started, stream_sessions

    events = _log(random.Random(6))
    folder, live = f"{tmp_path}/events", []
    parts = [[e for e in events if lo <= e[1] < hi] for lo, hi in ((0, 15), (15, 16), (16, 40))] + [[(3, 2, 1, "remove", None, None, None, None, None, None, None)]]
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = stream_sessions(spark.readStream.schema(EVENTS).parquet(folder))
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda b, e: live.append(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        started(writer, spark).awaitTermination()
    last = {}
    for batch in live:
        for session in {r["session_id"] for r in batch}:
            last[session] = [r for r in batch if r["session_id"] == session]
    got = {(s, r["item_id"]): {c: r[c] for c in ITEM} for s, rows in last.items() for r in rows if r["item_id"] is not None}
    assert got == _fold({}, events) and last[3][0]["late"] == 1 and last[4][0]["late"] == 0


def test_an_epoch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    from brimful.operators.sessions import STATE, apply_edits
    from brimful.streaming import streams as z

    events = _log(random.Random(9))
    spark.createDataFrame([e for e in events if e[1] < 20], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events")
    spark.createDataFrame([e for e in events if e[1] >= 20], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    write, calls = z.write_epoch, []

    def lost(rows, folder, epoch):
        """The driver is lost after an epoch is written and before Spark notes that it is done."""
        write(rows, folder, epoch)
        calls.append(epoch)
        if len(calls) == 1:
            raise RuntimeError("lost")

    stream = lambda: spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/events")
    z.write_epoch = lost
    try:
        with pytest.raises(Exception, match="lost"):
            z.stream_session_rankings(stream(), f"{tmp_path}/ranked", f"{tmp_path}/state").awaitTermination()
        z.stream_session_rankings(stream(), f"{tmp_path}/ranked", f"{tmp_path}/state").awaitTermination()
    finally:
        z.write_epoch = write
    assert calls == [0, 0]
    nothing = spark.createDataFrame([], "session_id long, item_id long, name string, category string, price_cents int, abv double, abv_estimated boolean, size_oz double, size_estimated boolean, count int").select(*STATE)
    want = z.rank_live(apply_edits(nothing, spark.createDataFrame(events, EVENTS)))
    got = z.current_rankings(spark, f"{tmp_path}/ranked")
    columns = ("name", "rank", "value", "total_oz")
    key = lambda r: (r[0], r[1])
    assert sorted(((r["session_id"], r["item_id"], *(r[c] for c in columns)) for r in got.collect()), key=key) == sorted(((r["list_id"], r["item_no"], *(r[c] for c in columns)) for r in want.collect()), key=key)
    assert want.count() > 10


def _edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        row = [row[0] + 1] + [min(row[j] + (x != y), row[j + 1] + 1) for j, y in enumerate(b)]
        for j in range(len(b)):
            row[j + 1] = min(row[j + 1], row[j] + 1)
    return row[-1]


def _cost(menu, brand):
    """The least (edits, tier, size) over every way to lay a brand's words on a name's."""
    k, letters, ways = min(len(menu), len(brand)), sum(map(len, brand)), []
    for shift in range(abs(len(menu) - len(brand)) + 1):
        read, own, tier = (menu[shift : shift + k], brand, 0) if len(brand) <= len(menu) else (menu, brand[shift : shift + k], 1)
        pairs = list(zip(read, own, strict=True))
        costs = [0 if i == k - 1 > 0 and len(r) >= 3 and len(o) > len(r) and o.startswith(r) else _edits(r, o) for i, (r, o) in enumerate(pairs)]
        fits = all(c <= (0 if max(len(r), len(o)) < 5 else 1 if max(len(r), len(o)) < 9 else 2) for c, (r, o) in zip(costs, pairs, strict=True))
        if (fits or any(r == o for r, o in pairs)) and (tier == 0 or (k >= 2 and 2 * sum(map(len, own)) >= letters)):
            ways.append((sum(costs), tier, letters if tier else -letters))
    ways += [(_edits(word, "".join(brand)), 2, -letters) for word in menu if _edits(word, "".join(brand)) <= 2]
    return min((w for w in ways if w[0] <= (1 if letters < 12 else 2 if letters < 20 else 3)), default=None)


def test_misread_names_find_their_brand_whatever_the_number_of_brands(spark):
    from brimful.operators.knowledge import brand_table, glyph_match
    from brimful.functions.text import glyph_tokens

    rng = random.Random(2)
    extra = spark.createDataFrame([(k, k, "x", 1.0, 1000 + i) for i, k in enumerate(("abcde", "a bc de", "tre", "old tom and jerry", "x y z longish"))], "key string, label string, category string, abv double, priority int")
    brands = brand_table(spark).unionByName(extra)
    keys = [r["key"] for r in brands.orderBy("priority").collect()]
    names = {"abde", "abcd", "tre", "old tom", "tom jer", "coors lig"}
    for _ in range(300):
        w = list(rng.choice(keys))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefilmnorstuv01 ")
        names.add("".join(w)[: rng.choice([99, 99, -2])] + rng.choice(["", " ipa"]))
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    menus = {r["name"]: r["m"] for r in asked.select("name", glyph_tokens(F.lower("name")).alias("m")).collect()}
    table = [(r["priority"], r["t"], r["label"]) for r in brands.select("priority", "label", glyph_tokens(F.col("key")).alias("t")).collect()]
    want = {}
    for name, menu in menus.items():
        rated = [(cost, p, label) for p, t, label in table if menu and sum(map(len, t)) >= 5 and (cost := _cost(menu, t))]
        if rated:
            want[name] = min(rated)[2]
    assert {r["name"]: r["label"] for r in glyph_match(asked, brands).collect()} == want and len(want) > 80


def test_substring_join_equals_all_pairs(spark):
    from brimful.operators.search import substring_join

    rng = random.Random(4)
    texts = ["".join(rng.choices("abé ", k=rng.randint(0, 12))) for _ in range(150)]
    keys = sorted({"".join(rng.choices("abé ", k=rng.randint(1, 6))) for _ in range(60)} | {"", "zzz"})
    got = substring_join(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", spark.createDataFrame([(k,) for k in keys], "key string"), "key")
    assert sorted((r["i"], r["key"]) for r in got.collect()) == sorted((i, k) for i, t in enumerate(texts) for k in keys if k and k in t)


def test_forms_of_products_and_drinks(spark):
    from brimful.operators.knowledge import brand_table, prefilled_drinks, prefilled_packages, profile, style_table

    products = spark.createDataFrame([(1, "Guinness Draught 6 pack", "bottledBeer", 4.2, None, None), (2, "Some Odd IPA", "bottledBeer", None, 473.0, 4)], "product_id int, name string, category string, abv double, ml double, units int")
    names = products.select("name", F.col("category").alias("section")).unionByName(spark.createDataFrame([("margarita", None)], "name string, section string"))
    known = profile(names, brand_table(spark), style_table(spark))
    forms = {r["product_id"]: r for r in prefilled_packages(products, known).collect()}
    assert (forms[1]["abv"], forms[1]["abv_estimated"]) == (4.2, True) and forms[1]["note"].startswith("Guinness Draught 6 pack at its typical label strength")
    assert forms[2]["abv"] > 0 and forms[2]["count"] == 4 and forms[2]["oz"] == 16.0 and "matched" in forms[2]["note"]
    typed = prefilled_drinks(spark.createDataFrame([("margarita", None, None)], "name string, category string, abv double"), known).first()
    assert typed["abv"] > 0 and typed["abv_estimated"] and typed["oz"] > 0


def test_outcomes_headers_and_page_text(spark):
    from brimful.operators.evaluate import box_dump, box_literals
    from brimful.operators.quality import outcomes, session_headers

    rows = spark.createDataFrame([(1, 2, "b", None, "needs_price", True), (1, 1, "a", None, "needs_price", True), (1, 3, "c", 300, "ranked", False), (1, 4, "d", 300, "excluded", False)], "list_id int, item_no int, name string, price_cents int, status string, abv_estimated boolean")
    one = outcomes(rows).first()
    assert (one["ranked"], one["needs_price"], one["excluded"]) == (1, ["a", "b"], ["d"])
    head = session_headers(rows).first()
    assert (head["priced"], head["items"], head["read"], head["estimated"], head["low_confidence"]) == (2, 4, 1, 0, False)
    boxes = spark.createDataFrame([("p", 1, 'say "hi"\t\\', 0.1, 0.2, 0.3, 0.4)], "page_id string, box_id long, text string, min_x double, min_y double, max_x double, max_y double")
    lines = spark.createDataFrame([("p", 1, "second"), ("p", 0, "first")], "page_id string, line_no int, line string")
    assert box_dump(boxes, lines).first()["dump"] == '"say \\"hi\\"\\t\\\\" @ 0.2000,0.3000  0.2000x0.2000\n\nlines (2):\nfirst\nsecond'
    assert box_literals(boxes).first()["literal"] == '[{"text":"say \\"hi\\"\\t\\\\","min_x":0.1,"min_y":0.2,"max_x":0.3,"max_y":0.4}]'


def test_brackets_are_cut_out_in_linear_time(spark):
    from brimful.functions.lines import outside_brackets

    cases = ["a (b) c", "a (b [c) d] e", "no", ")a(", "((x)", "a" * 20000 + "(b)" * 3000, "[a](b)c", ""]

    def plain(text):
        depth, out = 0, ""
        for c in text:
            if c in "([":
                depth += 1
            elif c in ")]":
                depth = max(0, depth - 1)
            elif not depth:
                out += c
        return out

    got = spark.createDataFrame([(c,) for c in cases], "line string").select("line", outside_brackets(F.col("line")).alias("out")).collect()
    assert {r["line"]: r["out"] for r in got} == {c: plain(c) for c in cases}
