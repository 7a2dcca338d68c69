"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Trees are trained on a bounded, hash-ordered sample of labelled rows (`max_rows`), collected to the
driver as numbers only, and flattened into arrays; tasks score batches by walking all rows down a tree at
once. Only the text is an input of a score.

Defined cases: a null or empty text has the statistics of an empty text and a score; without labels of
both kinds every score is the share of good labels, 0.5 without any; several labels of one doc_id count
once, as the least; equal texts have equal scores; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimful.llm.common import texts, utf8
from brimful.llm.quality_rules import CLASS_OF, COMMON_WORDS, N_CLASSES, duplicate_lines, repeated_words

MAX_ROWS = 20_000
FUNCTION_WORDS = {w.encode(): lists for w, lists in ((w, [k for k, ws in enumerate(COMMON_WORDS.values()) if w in ws]) for w in sorted(set(itertools.chain(*COMMON_WORDS.values()))))}
N_FEATURES = N_CLASSES + 15


def statistics(text: bytes) -> np.ndarray:
    """Document statistics, whatever the language."""
    words = text.split()
    n, size = len(words), len(text)
    counts = np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=N_CLASSES)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    hits = np.zeros(len(COMMON_WORDS))
    for word in words:
        for k in FUNCTION_WORDS.get(word, ()):
            hits[k] += 1
    lines = text.count(b"\n") + 1
    shares = np.sort(hits)[::-1] / max(n, 1)
    upper = sum(map(bytes.isupper, words)) / max(n, 1)
    distinct = len(set(words)) / max(n, 1)
    rest = [np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), distinct, shares[0], shares[1], upper, n / lines, np.log1p(lines), duplicate_lines(text) / lines, repeated_words(text) / max(n, 1), text.count(b".") / max(n, 1), text.count(b"!") / max(n, 1)]
    return np.concatenate([counts / max(size, 1), rest]).astype(np.float32)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    offsets, data = utf8(batch.column("text"))
    rows = [statistics(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.stack(rows) if rows else np.zeros((0, N_FEATURES), np.float32)


@dataclass
class Trees:
    """Complete trees of one depth as arrays (tree, node); a node's children are 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and len(at) and at[0] < inner:  # all rows are at one depth
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, min_weight: float = 2.0) -> Trees:
    """Histogram gradient boosting with logistic loss."""
    n, f = x.shape
    share = float(y.mean()) if n else 0.5
    none = np.zeros((0, 2**depth - 1))
    if n == 0 or share in (0.0, 1.0):
        share = min(max(share, 0.01), 0.99)
        return Trees(float(np.log(share / (1 - share))), none.astype(np.int64), none, np.zeros((0, 2**depth)))
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).astype(np.float32).T  # (feature, bins - 1)
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], axis=1)
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node, features, thresholds, cuts = np.zeros(n, np.int64), np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.full(2**depth - 1, bins)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            slot = (node[:, None] * f + np.arange(f)) * bins + binned
            g = np.bincount(slot.ravel(), np.repeat(grad, f), k * f * bins).reshape(k, f, bins).cumsum(axis=2)
            h = np.bincount(slot.ravel(), np.repeat(hess, f), k * f * bins).reshape(k, f, bins).cumsum(axis=2)
            gs, hs = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gs - g) ** 2 / (hs - h + ridge) - gs**2 / (hs + ridge)
            gain[(h < min_weight) | (hs - h < min_weight)] = 0
            best = gain[:, :, :-1].reshape(k, -1).argmax(axis=1)
            better = gain[:, :, :-1].reshape(k, -1).max(axis=1) > 1e-6
            which, cut = best // (bins - 1), best % (bins - 1)
            features[first : first + k] = which
            thresholds[first : first + k] = np.where(better, edges[which, cut], np.inf)
            cuts[first : first + k] = np.where(better, cut, bins)
            node = 2 * node + (binned[np.arange(n), features[first + node]] > cuts[first + node])
        leaf = rate * np.bincount(node, grad, 2**depth) / (np.bincount(node, hess, 2**depth) + ridge)
        total += leaf[node]
        trees.append((features, thresholds, leaf))
    return Trees(base, *(np.stack(c) for c in zip(*trees, strict=True)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees from at most max_rows labelled ids outside the held-out fold; of rows with one id the least text counts."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(matrix(batch)), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    got = sorted(rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<float>").collect())
    x = np.array([r["x"] for r in got], np.float32).reshape(len(got), N_FEATURES)
    return boost(x, np.array([float(r["quality"] > 0) for r in got]))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(matrix(batch)), pa.float64())], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
