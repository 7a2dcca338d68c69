"""Phrases, exact copies and whitening, each against a plain second computation."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

ODD = ["é", "Ä", "漢", "😀", "\x1c", "\xa0", "A-b", "ZZ"]


def _phrases(rows, least, most):
    counts = defaultdict(Counter)
    for lang, text in rows:
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = sum(c for p, c in f.items() if len(p) == 1), []
        for p, a in f.items():
            longer = [c for q, c in f.items() if len(q) == 3 and c >= least and p in (q[:2], q[1:])] if len(p) == 2 else []
            if len(p) > 1 and a >= least and not any(100 * c >= 50 * a for c in longer):
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ODD
    pieces = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 12))) for _ in range(900)]
    pieces += ["Set Phrase of\tThree"] * 40 + ["new  york"] * 30 + ["the the the"] * 15
    rng.shuffle(pieces)
    ends = [". ", ",", "\n", "\r\n", "!", " ? ", ";", ":", "\x0b", "\x0c"]
    texts = ["".join(p + rng.choice(ends) for p in pieces[i : i + 7]) for i in range(0, len(pieces), 7)]
    rows = [(rng.choice(["en", "en", "de", None, "und", "a.b", ""]), t) for t in texts]
    return [*rows, ("en", None), ("en", ""), ("de", " ".join(pieces)), ("en", ".,;"), *rows[:9]]


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, prose, small):
    from brimful.llm.collocations import Limits, collocations

    docs = spark.createDataFrame([(lang, t, "x") for lang, t in prose], "lang string, text string, word string").repartition(5)
    limits = Limits(block_bytes=150, words=30, phrases=60, burst=3) if small else Limits()
    got = collocations(docs, least=8, most=25, limits=limits)
    assert sorted(map(tuple, got.collect())) == _phrases(prose, 8, 25)
    assert {r[0] for r in _phrases(prose, 8, 25)} >= {"en", "de", "und"}


def test_phrases_of_empty_tables_and_wide_products(spark):
    from brimful.llm.collocations import collocations, score

    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0
    rows = [(10**12, 10**12 + 7, 10**12 + 9), (3, 7, 5), (999_999_999_999, 10**15, 10**18)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(score("a", "l", "r")).collect()
    assert [r[0] for r in got] == [10**6 * a * a // (left * r) for a, left, r in rows]


def test_equal_ids_of_words_change_the_salt(spark, monkeypatch):
    from brimful.llm import collocations as c

    words = spark.createDataFrame([("en", "a"), ("en", "b"), ("de", "a")], "lang string, word string")
    assert c.unambiguous_salt(words) == ""
    real = c.word_id
    monkeypatch.setattr(c, "word_id", lambda salt: real(salt) if len(salt) > 1 else F.lit(3).cast("long"))
    assert c.unambiguous_salt(words) == ".."


def _copies(rows):
    bare = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((i, t or ""))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), hashlib.sha256(text.encode()).hexdigest()) for i, _ in members]
    return out, {text: len(m) for text, m in groups.items()}


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(8)
    texts = [None, "", " \n", "a b", "ab", "a\tb ", "a b", "ab\x1c", "😀 x", "😀x", "x" * 100_000]
    rows = [(rng.randrange(900) if rng.random() < 0.95 else None, rng.choice(texts)) for _ in range(800)]
    return rows + [(i, f"text {i}") for i in range(2000)] + [(7, "twice"), (7, "twice")]


@pytest.mark.parametrize("broadcast_words, hot", [(2_000_000, 1000), (0, 4)])
def test_exact_copies(spark, copied, monkeypatch, broadcast_words, hot):
    from brimful.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", broadcast_words)
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    docs = spark.createDataFrame(copied, "doc_id long, text string").repartition(6)
    got = exact_dedup.groups(docs.withColumn("digest", F.lit("mine")).withColumn("row", F.lit(1))).collect()
    want, sizes = _copies(copied)
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + tuple(r[2:])
    assert sorted(key((r["doc_id"], r["keep_id"], r["group_size"], r["digest"].hex())) for r in got) == sorted(map(key, want))
    assert Counter(bytes(r["digest"]) for r in got if r["kept"]) == Counter({hashlib.sha256(t.encode()).digest(): 1 for t in sizes})

    boxed = docs.select("doc_id", F.lit("mine").alias("digest"), F.lit(2).alias("box"), "text", F.lit(True).alias("suspect"))
    left = exact_dedup.drop_copies(boxed)
    assert left.columns == boxed.columns and left.count() == len(sizes) and {tuple(r) for r in left.select("digest", "box").distinct().collect()} == {("mine", 2)}
    assert {(r["doc_id"], re.sub("[\x20\x09-\x0d]", "", r["text"] or "")) for r in left.collect()} == {(r["keep_id"], t) for t, r in ((t, next(g for g in got if bytes(g["digest"]) == hashlib.sha256(t.encode()).digest())) for t in sizes)}


def test_exact_copies_of_no_rows(spark):
    from brimful.llm.exact_dedup import drop_copies, groups

    none = spark.createDataFrame([], "doc_id long, text string")
    assert groups(none).count() == 0 and drop_copies(none).count() == 0


def _whitened(vectors):
    x = np.array([[np.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])
    apart = x - x.sum(0) / len(x)
    values, components = np.linalg.eigh(apart.T @ apart / len(x))
    return x.astype(np.int64), values[::-1], apart @ components[:, ::-1]


@pytest.mark.parametrize("dims, n", [(40, 500), (5, 60), (7, 8)])
def test_whitening(spark, dims, n):
    from brimful.llm.whitening import whitened_components

    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(n, dims)) @ np.diag(np.linspace(0.5, 30, dims))).round(3).tolist()
    odd = [(-1, None), (-2, [None] * dims), (-3, [float("nan")] * dims), (-4, [float("inf")] + [0.0] * (dims - 1)), (-5, [1.0] * (dims + 1)), (-6, []), (-7, [1e300] + [0.0] * (dims - 1))]
    docs = spark.createDataFrame([*enumerate(vectors), *odd, (None, vectors[0])], "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).repartition(5)
    got = sorted(whitened_components(docs).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"]))
    x, values, projected = _whitened([*vectors, vectors[0]])
    k = min(dims, 32)
    assert len(got) == (n + 1) * k and {r["n"] for r in got} == {n + 1} and max(r["identity_error"] for r in got) < 1e-9
    white = np.array([r["whitened"] for r in got]).reshape(n + 1, k)
    want = projected[:, :k] / np.sqrt(values[:k])
    assert np.abs(white * np.sign((white * want).sum(0)) - want).max() < 1e-7
    assert np.allclose([r["explained"] for r in got[:k]], values[:k] / values.sum(), rtol=1e-10)
    assert [r["deviation"] for r in got[::k]] == ((len(x) * x - x.sum(0)) ** 2).sum(1).tolist()


def test_whitening_without_spread(spark):
    from brimful.llm.whitening import whitened_components

    run = lambda rows: whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0, 2.0])] * 3) == []
    line = run([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [5.0, 10.0])])  # one direction only
    assert [(r["component"], r["explained"]) for r in line] == [(1, pytest.approx(1.0))] * 3


def test_whitening_keeps_deviations_exact_beyond_64_bits(spark):
    from brimful.llm.whitening import whitened_components

    rows = [(i, [float((i * 7919) % 1000) * 2.0**26, float(i)]) for i in range(300)]
    got = {r["vec_id"]: r["deviation"] for r in whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((300 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert [got[i] for i in range(300)] == [d if d < 1 << 63 else None for d in exact] and any(d >= 1 << 63 for d in exact)
