"""Texts and tables whose size once made an operator slow or its memory unbounded."""

import random
import time

import pytest
from pyspark.sql import functions as F


def _replaced(text, spans):
    out, at = "", 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_redaction_equals_a_walk_over_the_spans(spark):
    from brimful.llm.pii import find, redact

    rng = random.Random(3)
    parts = ["a.b@c.de", " 10.0.0.1 ", "+49 170 1234567", "4111 1111 1111 1111", "😀é", " token: ghp_abcdefghij0123456789ABCD ", "call 415-555-2671 ", "me (at) b (dot) com ", "x" * 300, "\n", "+1 (415) 10.0.0.1 99 "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(120)] + ["", "".join(rng.choices(parts, k=3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spans = {r["doc_id"]: r["spans"] for r in find(docs).collect()}
    assert {r["doc_id"]: r["text"] for r in redact(docs).collect()} == {i: _replaced(t, spans[i]) for i, t in enumerate(texts)}
    kinds = {x.split(":")[0] for s in spans.values() for x in s.split(",") if x}
    assert kinds >= {"email", "ip", "card", "phone"} and len(kinds) > 4


def test_redaction_of_very_many_spans_takes_time_in_proportion(spark):
    from brimful.llm.pii import redact

    def seconds(n):
        docs = spark.createDataFrame([(1, "a1@b.co, " * n)], "doc_id long, text string")
        began = time.time()
        text = redact(docs).first()["text"]
        assert text == "[EMAIL], " * n
        return time.time() - began

    seconds(10)
    assert seconds(200_000) < 90


def test_texts_without_spaces_are_sampled_in_rounds_of_a_bounded_number(spark):
    from brimful.llm.pieces import decode_pieces, sample_pieces

    rng = random.Random(4)
    texts = ["".join(map(chr, rng.choices(range(0x4E00, 0x5E00), k=333_000))), "".join(rng.choices("abcdefABCDEF0123456789+/", k=400_000)), "é" * 255 + "漢" * 2, "x" * 256 + " y", "x" * 257]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    began = time.time()
    sampled = sample_pieces(docs)
    assert {r["doc_id"]: r["text"] for r in decode_pieces(sampled).collect()} == dict(enumerate(texts))
    assert time.time() - began < 90
    alone = sample_pieces(docs.where("doc_id >= 2")).orderBy("doc_id").collect()
    assert [r["ids"] for r in alone] == [r["ids"] for r in sampled.where("doc_id >= 2").orderBy("doc_id").collect()]


def test_repeated_rows_of_a_labelled_id_reach_the_trees_once(spark, monkeypatch):
    from brimful.llm import quality_classifier as q

    ids = [i for i in range(40) if not spark.range(1).select(q.held_out(F.lit(i).cast("long"))).first()[0]][:2]
    docs = spark.range(10_000).select(F.lit(ids[0]).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(ids[1], "other words here")], "doc_id long, text string"))
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, quality int")
    seen, real = [], q.boost
    monkeypatch.setattr(q, "boost", lambda x, y, **more: seen.append(len(x)) or real(x, y, **more))
    q.train(docs, labels, max_rows=2)
    assert seen == [2]


@pytest.mark.parametrize("ids", [(1, 2, 3), (None, 5, 5)])
def test_suffix_stage_keeps_columns_of_any_name(spark, ids):
    import corpus_pipeline

    passage = "a passage of more than fifty bytes that both of these documents hold word for word"
    rows = [(ids[0], passage + " one", "mine", "l", 1, 4), (ids[1], "two " + passage, "mine", "l", 2, 4), (ids[2], "apart", "mine", "l", 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, `left` string, key int, n_chars long")
    got = corpus_pipeline.suffix_dedup(spark, docs, "")
    assert got.columns == docs.columns and [(r["digest"], r["left"], r["key"]) for r in got.orderBy("key").collect()] == [("mine", "l", 1), ("mine", "l", 2), ("mine", "l", 3)]
    assert sum(r["n_chars"] for r in got.collect()) < sum(len(r[1]) for r in rows) - 40
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
