"""Findings of the fourth round: the work that results take at size."""

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_whole_blocks_of_logs_are_not_shuffled(spark, tmp_path):
    """Blocks are cut where their lines are read."""
    from brimful.sources import readers as R

    (tmp_path / "log.txt").write_text("=== EXPORT ===\n# lines (1)\none\n=== END ===\n")
    blocks = R.read_exports(spark, str(tmp_path / "log.txt"))
    for rows in (blocks, R.recorded_lines(blocks)):
        shuffles = [line for line in _plan(rows).splitlines() if "Exchange hashpartitioning" in line]
        assert len(shuffles) == 1 and "split#" in shuffles[0]  # of the few rows that tell what each split leaves open
        assert "SortMergeJoin" not in _plan(rows) and "Window" not in _plan(rows) and rows.count() == 1


def test_blocks_over_many_batches_and_splits_equal_those_of_the_whole_text(spark, tmp_path):
    """A block may cross batches and splits, and hold a whole split; one without an end is none."""
    import random
    import re

    from brimful.sources import readers as R

    rng, texts = random.Random(3), {}
    for k in range(4):
        lines = [rng.choices(["=== A ===", "=== END A ===", "cut === END A === off", "=== B ===", "=== END B ===", "plain text", ""], [1, 1, 1, 1, 1, 40 * (k + 1), 5])[0] for _ in range(600)]
        texts[f"{k}.log"] = "\n".join(lines) + "\n"
        (tmp_path / f"{k}.log").write_text(texts[f"{k}.log"])
    want = {(name, str(i), kind): body.removesuffix("\n") for name, text in texts.items() for kind in "AB" for i, body in enumerate(re.findall(rf"=== {kind} ===\n(.*?)=== END {kind} ===", text, re.S))}
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {(*r["page_id"].split("#"), r["kind"]): r["body"] for r in R.log_blocks(spark, str(tmp_path), ("A", "B")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and max(map(len, want.values())) > 1200


def test_sections_of_a_page_keep_their_places(spark):
    """lines stand under the last name above them; what a page states is checked, also where it has no lines."""
    from brimful.sources import readers as R

    body = "above\n# lines (2)\none\n \ntwo\n# other\nx\n# lines (0)\n"
    blocks = spark.createDataFrame([("p", body), ("q", ""), ("r", "# lines (1)\n# x")], "page_id string, body string")
    rows = R.export_sections(blocks.where("page_id <> 'r'")).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [("p", None, 0, "above"), ("p", "lines (2)", 2, "one"), ("p", "lines (2)", 4, "two"), ("p", "other", 6, "x")]
    assert [tuple(r) for r in R.recorded_lines(blocks.where("page_id = 'p'")).orderBy("line_no").collect()] == [("p", 0, "one"), ("p", 1, "two")]
    with pytest.raises(ValueError, match="'r'"):
        R.recorded_lines(blocks)


def test_lines_that_differ_in_their_price_share_their_features(spark, monkeypatch):
    """What a line says is found once for each kind of line, and equals what each line says by itself."""
    from brimful.functions import lines as L
    from brimful.operators import lists as R

    plain = [f"{n} ${d}.{c:02}" for n in ("Pale Ale 5.0% ABV", "Merlot", "REDS ", "Cider 12oz, dry, still") for d, c in ((7, 0), (0, 9), (1250, 99), (10, 0))]
    odd = ["12oz $5.00", "12oz $6.00", "Stout $0.00", "Ale $5", "Ale $1234", "Ale $5.000", "Ale $5.00.", "Ale$5.00", "$5.00", "Merlot $9.00 $34.00", "s5 Ale $6.00", "Ale 0.0% $7.00\n", "  Gin\t$8.00 ", "$ale $5.00", "Stout", "", "WINES", None]
    rows = spark.createDataFrame([(str(i % 5), i, x) for i, x in enumerate(plain + odd)], "list_id string, line_no int, line string")
    asked, each = [], L.line_features
    monkeypatch.setattr(R, "line_features", lambda lines: asked.append(lines.count()) or each(lines))
    shared = R.features(rows)
    alone = R.with_sizes(each(rows))
    assert shared.columns == alone.columns and shared.exceptAll(alone).isEmpty() and alone.exceptAll(shared).isEmpty()
    assert asked == [4 + len(odd) - 1]  # four kinds of plain lines; a null line is an empty one
    monkeypatch.setattr(R, "MOST_KINDS", 3)
    many = R.features(rows, deal=True)
    assert asked[1:] == [rows.count()] and many.exceptAll(alone).isEmpty() and alone.exceptAll(many).isEmpty()


def test_boxes_of_pages_are_neither_shuffled_nor_sorted(spark):
    """pages are dealt and sorted as lines, whose words are many more boxes."""
    import __spark_entry__
    from brimful.operators import layout as Y
    from brimful.plans import more_queries as M

    plan = _plan(__spark_entry__.queries()["page_lines"](spark, SMALL))
    boxes = plan[: plan.index("Generate posexplode")]
    assert "Exchange" not in boxes and "Sort " not in boxes
    got, want = Y.assemble(M._boxes(spark, SMALL, placed=True), placed=True), Y.assemble(M._boxes(spark, SMALL))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_a_session_reads_its_items_in_one_call():
    """a batch reads a session's items at once, writes those that changed, and takes rows as they are."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from brimful.streaming.streams import FIELDS, Session

    calls, items, seen = [], {i: (f"item {i}", "shot", 500, 5.0, False, 12.0, False, 1) for i in range(40)}, [(7, 0)]
    called = lambda name, do: lambda *a: calls.append(name) or do(*a)
    kept = SimpleNamespace(iterator=called("iterator", lambda: iter([((i,), v) for i, v in items.items()])), updateValue=called("update", lambda k, v: items.update({k[0]: v})), removeKey=called("remove", lambda k: items.pop(k[0])))
    state = SimpleNamespace(get=called("get", lambda: seen[-1]), update=called("seen", seen.append))
    session = Session(None)
    session.init(SimpleNamespace(getMapState=lambda *_: kept, getValueState=lambda *_: state))
    event = Row("session_id", "seq", "item_id", "kind", "name", "cents", "value", "count", "category", "abv", "size_oz")
    rows = [event(1, 10, 3, "remove", *[None] * 7), event(1, 9, 3, "set_price", None, 900, 9.0, *[None] * 4), event(1, 8, 5, "correct_abv", None, None, 6.0, *[None] * 4), event(1, 6, 6, "remove", *[None] * 7)]
    out = list(session.handleInputRows((1,), iter(rows), None))
    assert calls == ["get", "iterator", "remove", "update", "seen"] or calls == ["get", "iterator", "update", "remove", "seen"]
    assert len(out) == 39 and {(r.seq, r.late) for r in out} == {(10, 1)} and seen[-1] == (10, 1)
    assert {r.item_id: r.abv for r in out if r.abv != 5.0} == {5: 6.0} and tuple(out[0].__fields__[3:]) == FIELDS


def test_messages_of_suffix_dedup_grow_no_faster_than_the_text(monkeypatch):
    """with chunks of one size, messages between chunks and buckets grew with the square of the text."""
    from brimful.llm import suffix_dedup as D

    messages = lambda gb: D.dealing(gb << 30)[0] * D.dealing(gb << 30)[1] / gb
    assert messages(1) <= 1 << 17  # with chunks of 512 KB they were four times as many
    assert messages(6) <= 2.01 * messages(1) and messages(30) <= 1.01 * messages(6)
    assert D.dealing(30 << 30)[0] >= 1000
    assert D.dealing(0) == (8, 8)


def test_larger_chunks_remove_the_same_passages(spark, monkeypatch):
    """the number of chunks and buckets changes no result."""
    from brimful.llm import suffix_dedup as D

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = D.remove_repeats(docs)
    monkeypatch.setattr(D, "dealing", lambda size: (3, 40))
    got = D.remove_repeats(docs)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.where("n_removed > 0").isEmpty()


def test_a_batch_of_lists_takes_many_files_for_each_task(spark, monkeypatch):
    """batches were as many as files by tasks, each with the cost of planning and its jobs."""
    import os
    from types import SimpleNamespace

    from brimful.plans import chain_queries as Q
    from brimful.streaming import streams as Z

    monkeypatch.setattr(Q, "LINES_PER_FILE", 300)
    monkeypatch.setattr(Q, "FILES_PER_TASK", 6)
    monkeypatch.setattr(Z, "rank_lists", lambda batch, *_: SimpleNamespace(ranked=batch))
    out = Q.stream_rankings(spark, SMALL)
    folder = out.inputFiles()[0].split("/epoch=")[0].removeprefix("file://")
    files = [f for f in os.listdir(folder.replace("/ranked", "/lines")) if f.endswith(".parquet")]
    epochs = [f for f in os.listdir(folder) if f.startswith("epoch=")]
    assert 24 < len(files) and len(epochs) == 2  # 24 files and the rest
    assert out.count() == spark.read.parquet(folder.replace("/ranked", "/lines")).count() > 8000
