"""Quality rules: repetition and length rules, then divergence from language references.

A document's histogram of character classes and of common words is compared with its language's
reference by Jensen-Shannon distance. A reference is built from the documents that pass the base rules:
their mean in each group of sources (every document weighs the same, so long ones do not dominate), then
the median of these means, in which a group of n documents weighs sqrt(n). So one source full of junk
moves no reference, though it may hold most documents of a language. Means are summed in Spark; sources
are dealt to SOURCE_GROUPS groups by hash, so that few rows reach the driver: those of the four languages
that have a word list, and of "other" for the rest and for null. "other" mixes languages: its distances
are given, but nothing is rejected by them.

Defined cases: a null or empty text has no words and fails the base rules; a document with fewer words
than a guard is not judged by that distance; equal rows give equal results; without a column source all
documents are of one source; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimful.llm.common import utf8, windows, word_hashes

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not are this but from or have an they which at all there their".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son elle aux".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como es más o pero sus le ha me este".split(),
}
# The character classes, by the bytes that belong to each; the rest of ASCII is one more class.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:'\"-()", "!?", "#*$%&|<>"]
SYMBOLS = b"#*$%&|<>"
N_CLASSES = len(CLASSES) + 2
LISTS = [*COMMON_WORDS, "other"]
N_COMMON = 31
#: Groups of sources, and documents below which a group joins the other small ones: a mean of few is too rough for a median.
SOURCE_GROUPS, MIN_GROUP_DOCS = 1024, 20

CLASS_OF = np.full(256, len(CLASSES), np.uint8)
CLASS_OF[128:] = len(CLASSES) + 1
for _k, _chars in enumerate(CLASSES):
    CLASS_OF[np.frombuffer(_chars.encode(), np.uint8)] = _k
NOT_COUNTED = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])
RANK = {lang: {w.encode(): i for i, w in enumerate(dict.fromkeys(words))} for lang, words in COMMON_WORDS.items()}
RANK["other"] = {w.encode(): i for i, w in enumerate(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws[:7]))}


def profile(text: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(character-class shares, common-word shares with the rest last, words)."""
    kinds = np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=N_CLASSES) / max(len(text), 1)
    words = text.split()
    ranks, common = RANK[lang], np.zeros(N_COMMON)
    for word in text.lower().split():
        k = ranks.get(word.rstrip(b".,;:"))
        common[N_COMMON - 1 if k is None else k] += 1
    return kinds, common / max(len(words), 1), words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2: 0 for equal shares, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p * np.log2(p / m), 0).sum(), np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


def repeated_words(text: bytes, width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more in the text."""
    _, hashes = word_hashes(text)
    runs = windows(hashes, width)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line.split(None, 1):
            seen.add(line)
    return count


def _list_of(lang: F.Column) -> F.Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise("other")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, str]]:
    offsets, data = utf8(batch.column("text"))
    langs = batch.column("list").to_pylist()
    for i, lang in enumerate(langs):
        yield i, data[offsets[i] : offsets[i + 1]].tobytes(), lang


def base_failed(n_words: int, repeats: int) -> bool:
    return n_words < 10 or 100 * repeats > 20 * n_words


def _group_of(docs: DataFrame) -> F.Column:
    return F.pmod(F.xxhash64("source"), F.lit(SOURCE_GROUPS)) if "source" in docs.columns else F.lit(0).cast("long")


def language_references(docs: DataFrame) -> DataFrame:
    """(list, source_group, n, kinds array, common array): sums of the documents' shares, over those that pass the base rules."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        counts: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            groups = batch.column("source_group").to_pylist()
            for i, text, lang in _rows(batch):
                kinds, common, words = profile(text, lang)
                if not base_failed(len(words), repeated_words(text) if len(words) >= 10 else 0):
                    key = lang, groups[i]
                    if key not in sums:
                        sums[key] = np.zeros(N_CLASSES), np.zeros(N_COMMON)
                    counts[key] += 1
                    sums[key][0][:] += kinds
                    sums[key][1][:] += common
        yield pa.RecordBatch.from_pydict(
            {"list": pa.array([k[0] for k in sums], pa.string()), "source_group": pa.array([k[1] for k in sums], pa.int64()), "n": pa.array([counts[k] for k in sums], pa.int64()), "kinds": pa.array([x.tolist() for x, _ in sums.values()], pa.list_(pa.float64())), "common": pa.array([x.tolist() for _, x in sums.values()], pa.list_(pa.float64()))}
        )

    parts = docs.select(_list_of(F.col("lang")).alias("list"), _group_of(docs).alias("source_group"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(partial, "list string, source_group long, n long, kinds array<double>, common array<double>")
    total = [F.sum(F.col("kinds")[i]).alias(f"k{i}") for i in range(N_CLASSES)] + [F.sum(F.col("common")[i]).alias(f"c{i}") for i in range(N_COMMON)]
    summed = parts.groupBy("list", "source_group").agg(F.sum("n").alias("n"), *total)
    return summed.select("list", "source_group", "n", F.array(*[f"k{i}" for i in range(N_CLASSES)]).alias("kinds"), F.array(*[f"c{i}" for i in range(N_COMMON)]).alias("common"))


def central(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares in the middle of the groups' means, each a row of sums over n documents: the median weighted by sqrt(n), scaled to 1 in all."""
    small = n < MIN_GROUP_DOCS
    if small.any():
        sums, n = np.vstack([sums[~small], sums[small].sum(axis=0)]), np.append(n[~small], n[small].sum())
    means, weights = sums / n[:, None], np.sqrt(n)
    order = np.argsort(means, axis=0, kind="stable")
    reached = np.cumsum(weights[order], axis=0)
    half = weights.sum() / 2
    pick = lambda side: np.take_along_axis(means, np.take_along_axis(order, np.argmax(side, axis=0)[None], 0), 0)[0]
    middle = (pick(reached >= half * (1 - 1e-12)) + pick(reached > half * (1 + 1e-12))) / 2
    return middle / middle.sum() if middle.sum() > 0 else sums.sum(axis=0) / n.sum()


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


@dataclass(frozen=True)
class Rules:
    """Limits of the divergence rules.

    The word distance of a text of n words has sampling noise of the order 1/sqrt(n), so its limit is
    max_word_distance + word_distance_noise / sqrt(n). Texts below a guard are not judged by that distance.
    """

    max_class_distance: float = 0.25
    max_word_distance: float = 0.16
    word_distance_noise: float = 1.3
    min_class_words: int = 40
    min_common_words: int = 40

    def verdict(self, text: bytes, lang: str, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple:
        """The values of NAMES for a text."""
        kinds, common, words = profile(text, lang)
        n, near = len(words), known.get(lang)
        repeats = repeated_words(text) if n > 5 else 0
        failed = base_failed(n, repeats)
        by_class = distance(kinds, near[0]) if near and n >= self.min_class_words else None
        by_word = distance(common, near[1]) if near and n >= self.min_common_words else None
        alike = (by_class is None or by_class <= self.max_class_distance) and (by_word is None or by_word <= self.max_word_distance + self.word_distance_noise / n**0.5)
        kept = not failed and (lang == "other" or alike)
        return n, len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), repeats, failed, kept, by_class, by_word


def _known(docs: DataFrame, references: DataFrame | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    rows = (references if references is not None else language_references(docs)).collect()  # at most len(LISTS) * SOURCE_GROUPS rows
    known = {}
    for name in sorted({r["list"] for r in rows}):
        own = sorted((r for r in rows if r["list"] == name), key=lambda r: r["source_group"])
        n = np.array([r["n"] for r in own])
        known[name] = tuple(central(np.array([r[c] for r in own]), n) for c in ("kinds", "common"))
    return known


def judge(docs: DataFrame, rules: Rules | None = None, references: DataFrame | None = None) -> DataFrame:
    """One row per document of docs (doc_id, text, lang) with its counts, distances and verdict."""
    rules, known = rules or Rules(), _known(docs, references)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [rules.verdict(text, lang, known) for _, text, lang in _rows(batch)]
            columns = list(zip(*out, strict=True)) if out else [()] * len(NAMES)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *NAMES])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return docs.select(F.col("doc_id").cast("long"), _list_of(F.col("lang")).alias("list"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(verdicts, schema)


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of docs whose text passes, with their columns."""
    rules, known = rules or Rules(), _known(docs, None)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            langs = [x if x in COMMON_WORDS else "other" for x in batch.column("lang").to_pylist()]
            good = [rules.verdict(data[offsets[i] : offsets[i + 1]].tobytes(), lang, known)[NAMES.index("kept")] for i, lang in enumerate(langs)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)
