"""Reliabilities and the span classifier of personal data, against a plain computation candidate by candidate."""

import math
import random

import pytest

KINDS = ("secret", "phone_local")


def _odds(rows, weights, features):
    """Naive Bayes log odds of each row."""
    return [weights[r["kind"]]["prior", 0] + sum(weights[r["kind"]].get((f, r[f]), 0.0) for f in features) for r in rows]


def _fitted(rows, shares, features):
    """Smoothed log odds of each (feature, value) of a kind, given each row's share of being right."""
    out = {}
    for kind in {r["kind"] for r in rows}:
        own = [(r, p) for r, p in zip(rows, shares, strict=True) if r["kind"] == kind]
        yes = sum(p for _, p in own)
        no = len(own) - yes
        out[kind] = {("prior", 0): math.log((yes + 1) / (no + 1))}
        for f in features:
            for value in {r[f] for r, _ in own}:
                a, n = sum(p for r, p in own if r[f] == value), sum(r[f] == value for r, _ in own)
                out[kind][f, value] = math.log((a + 1) / (yes + 3)) - math.log((n - a + 1) / (no + 3))
    return out


def test_reliabilities_and_classifier_equal_a_plain_computation(spark):
    from brimful.llm.pii import FEATURES, LABELERS, learn

    rng = random.Random(11)
    rows = []
    for _ in range(400):
        real = rng.random() < 0.4
        votes = {name: rng.choice([1, 1, 0] if real == (rng.random() < 0.5 + 0.1 * k) else [-1, 0, 0]) for k, name in enumerate(LABELERS)}
        rows.append({"kind": rng.choice(KINDS), "digit_share": rng.randrange(4), "quoted": rng.randrange(2), "size": rng.randrange(3, 7), **votes})
    got = learn(spark.createDataFrame([tuple(r[c] for c in ("kind", *FEATURES)) for r in rows], "kind string, " + ", ".join(f"{f} int" for f in FEATURES)).repartition(3), rounds=5)

    shares = [1 / (1 + math.exp(-sum(r[name] for name in LABELERS))) for r in rows]
    for _ in range(5):
        weights = _fitted(rows, shares, LABELERS)
        shares = [1 / (1 + math.exp(-x)) for x in _odds(rows, weights, LABELERS)]
    want = _fitted(rows, shares, FEATURES)
    assert got.keys() == want.keys()
    for kind in want:
        assert got[kind].keys() == want[kind].keys()
        assert all(got[kind][k] == pytest.approx(v, abs=1e-9) for k, v in want[kind].items())


def test_added_spans_are_those_with_even_odds_or_better(spark):
    """Every candidate's odds, computed from its fields, decide alone whether it is added."""
    from brimful.llm.pii import FEATURES, annotate, find, learn

    rng = random.Random(12)
    parts = ["api token = 'ghp_{}' ", "hash {} ", "call 415-555-{:04d} ", "no 111 222 {:04d} ", "write me (at) mail (dot) com ", "x (at) y (dot) q "]
    word = lambda: "".join(rng.choices("abcdefABCDEF0123456789", k=rng.randint(16, 40)))
    texts = ["".join(p.format(word() if "{}" in p else rng.randrange(10000)) for p in rng.choices(parts, k=6)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    candidates = [(r["doc_id"], c) for r in annotate(docs).collect() for c in r["pii_candidates"]]
    fields = ("kind", *FEATURES)
    weights = learn(spark.createDataFrame([tuple(c[f] for f in fields) for _, c in candidates], "kind string, " + ", ".join(f"{f} int" for f in FEATURES)))
    odds = _odds([c.asDict() for _, c in candidates], weights, FEATURES)
    want = {(i, f"{c['kind']}:{c['s']}:{c['e']}") for (i, c), x in zip(candidates, odds, strict=True) if x > 1e-9}
    got = {(r["doc_id"], s) for r in find(docs).collect() for s in r["spans"].split(",") if s.split(":")[0] in ("secret", "phone_local", "email_spelled")}
    assert got == want and 0 < len(got) < len(candidates)
