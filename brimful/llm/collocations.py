"""Phrases whose words occur together more often than apart, counted in HAT-tries.

A task counts the phrases of its texts in a HAT-trie: a shallow trie over word ids whose leaves are hash containers;
a container that grows too large bursts into one for each next word. When the trie holds more phrases than its limit, its
largest subtrees are spilled whole, each as a run sorted by word ids. Runs are dealt to prefix partitions, by the
first word and a slice of the second (so that a frequent first word is spread over SLICES partitions), and merged.

Words are counted first, then pairs of words, then triples, since no phrase is more frequent than its parts: a task
leaves out pairs with a rare word and triples with a rare pair, told by a bitmap of what is frequent. Bitmaps hold
at most MOST_BITS bits, whatever the input; they may take something rare for frequent, which the exact counts then
settle, and never miss anything frequent. A word's id is a 64-bit hash of its language and the word; all distinct
words are checked for equal ids, and hashed with another salt if there are any, so counts are exact.

Defined cases: a null text is empty; a null lang is `und`; null and repeated doc_ids do not matter, every row counts;
texts of any length are read in chunks, and a phrase may run over the end of a chunk; ties in rank are settled by
count and then by the phrase's bytes; an empty table, or one without frequent phrases, gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brimful.llm.common import text_blocks, utf8, written

LEAST, MOST_OF_A_LANG = 10, 2000
SLICES = 64
MOST_BITS = 1 << 27
UNKNOWN_LANG = "und"

#: A-Z become a-z, and whatever ends a piece becomes the one mark ".", which no word holds.
ENDS = b".,;:!?\n\x0b\x0c\r"
SMALL = bytes(ord(".") if b in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = re.compile(rb"[ \t.]")
#: Numbers of a task's words: those held when a chunk begins, and those that one chunk can add, stay below.
ID_BITS = 21
ID_MASK = (1 << ID_BITS) - 1


@dataclass(frozen=True)
class Limits:
    """What a task holds at most: bytes of text read at once, distinct words, phrases in its trie, phrases in a container before it bursts."""

    block_bytes: int = 4 << 20
    words: int = 400_000
    phrases: int = 1_200_000
    burst: int = 16_384


def by_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def tokens(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word, the distinct words) of a text whose words and marks stand between spaces and tabs."""
    text = text.strip(b" \t")
    if not text:
        return np.zeros(0, np.int64), []
    row = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)])
    coded = pc.ascii_split_whitespace(row).flatten().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()


def word_chunks(batches: Iterator[pa.RecordBatch], block_bytes: int, overlap: int = 0) -> Iterator[tuple[bytes, np.ndarray, list[bytes]]]:
    """(lang, *tokens()) of about block_bytes of text each, with marks "." between pieces; a chunk of a text that goes on begins with the last `overlap` words of the one before."""
    for batch in batches:
        for block in text_blocks(batch, block_bytes):
            offsets, raw = utf8(block.column("text"))
            langs = [lang.encode() for lang in block.column("lang").to_pylist()]
            for lang in dict.fromkeys(langs):
                text = b" . ".join(raw[offsets[i] : offsets[i + 1]].tobytes() for i, own in enumerate(langs) if own == lang).translate(SMALL)
                at, tail = 0, b""
                while at < len(text):
                    blank = BLANK.search(text, at + block_bytes)
                    end = blank.start() if blank else len(text)
                    part = tail + text[at:end].replace(b".", b" . ")
                    tail = b" ".join(part.rsplit(None, overlap)[-overlap:]) + b" " if overlap else b""
                    at = end
                    yield lang, *tokens(part)


def count_words(docs: DataFrame, limits: Limits) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, Counter] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                counts.pop(b".", None)
                words = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(counts), pa.string()), words, pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            seen.clear()

        for lang, numbers, words in word_chunks(batches, limits.block_bytes):
            seen.setdefault(lang, Counter()).update(dict(zip(words, np.bincount(numbers).tolist(), strict=True)))
            if sum(map(len, seen.values())) > limits.words:
                yield from emptied()
        yield from emptied()

    return by_lang(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_id(salt: str) -> Column:
    return F.xxhash64(F.concat(F.lit(salt), "lang", F.lit("."), "word"))


def unambiguous_salt(words: DataFrame) -> str:
    """A salt with which no two of the words have one id."""
    salt = ""
    while not words.select(word_id(salt).alias("id")).groupBy("id").count().where("count > 1").isEmpty():
        salt += "."
    return salt


def bitmap(spark: SparkSession, numbers: DataFrame, n: int) -> Broadcast:
    """The bits at the n `number`s, modulo the size of the map, as bytes on all executors."""
    size = min(MOST_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    at = F.col("number").bitwiseAND(F.lit(size - 1)) + 1  # Spark numbers bits from 1
    parts = numbers.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(size >> 3, np.uint8)
    for part in parts:
        bits[(part["bucket"] - 1) * 4096 : part["bucket"] * 4096] = np.frombuffer(part["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def pair_number(first: Column, second: Column) -> Column:
    """One number for a pair of ids; mixed_pairs() is the same over arrays."""
    turned = F.shiftrightunsigned(second, 5).bitwiseOR(F.shiftleft(second, 59))
    return first.bitwiseXOR(turned)


def mixed_pairs(ids: np.ndarray) -> np.ndarray:
    return ids[:-1] ^ ((ids[1:] >> np.uint64(5)) | (ids[1:] << np.uint64(59)))


class LocalWords(dict):
    """Small numbers of a language's frequent words, in order of appearance over all languages of a task; -1 for others."""

    def __init__(self, lang: bytes, salt: bytes, bits: bytes, ids: array) -> None:
        super().__init__({b".": -1})
        self.start, self.bits, self.mask, self.ids = salt + lang + b".", bits, len(bits) * 8 - 1, ids

    def __missing__(self, word: bytes) -> int:
        own = xxhash.xxh64_intdigest(self.start + word, seed=42)
        at = own & self.mask
        number = -1
        if self.bits[at >> 3] >> (at & 7) & 1:
            number = len(self.ids)
            self.ids.append(own)
        self[word] = number
        return number


class HatTrie:
    """Counts of phrases of `width` words, packed into one number each, the first word in front.

    A container is a hash table of phrases. At the root, one holds the phrases of all first words with the same last
    bits; one with more than `burst` phrases bursts into a node with a container for each first word, and such a one
    into a node with a container for each of its second words.
    """

    SLOTS = 256

    def __init__(self, width: int, burst: int) -> None:
        self.width, self.burst, self.size = width, burst, 0
        self.roots: list[dict | tuple[dict]] = [{} for _ in range(self.SLOTS)]

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Distinct phrases with their counts."""
        slot = (phrases >> (ID_BITS * (self.width - 1))) & (self.SLOTS - 1)
        order = np.argsort(slot, kind="stable")
        bounds = np.searchsorted(slot[order], np.arange(self.SLOTS + 1)).tolist()
        keys, values = phrases[order].tolist(), counts[order].tolist()
        for k in range(self.SLOTS):
            if bounds[k] < bounds[k + 1]:
                self.roots[k] = self._put(self.roots[k], keys[bounds[k] : bounds[k + 1]], values[bounds[k] : bounds[k + 1]], 1)

    def _put(self, node: dict | tuple[dict], keys: list[int], counts: list[int], depth: int) -> dict | tuple[dict]:
        """The node with the phrases added; below it, phrases are told apart by their first `depth` words."""
        if isinstance(node, tuple):
            shift, children = ID_BITS * (self.width - depth), node[0]
            runs: dict[int, tuple[list[int], list[int]]] = {}
            for key, n in zip(keys, counts, strict=True):
                run = runs.setdefault(key >> shift, ([], []))
                run[0].append(key)
                run[1].append(n)
            for prefix, (own, ns) in runs.items():
                children[prefix] = self._put(children.get(prefix, {}), own, ns, depth + 1)
            return node
        before, had = len(node), node.get
        for key, n in zip(keys, counts, strict=True):
            node[key] = had(key, 0) + n
        self.size += len(node) - before
        if len(node) <= self.burst or depth >= self.width:
            return node
        self.size -= len(node)
        return self._put(({},), list(node), list(node.values()), depth)

    def _containers(self, node: dict | tuple[dict]) -> Iterator[dict[int, int]]:
        if isinstance(node, tuple):
            for child in node[0].values():
                yield from self._containers(child)
        else:
            yield node

    def spill(self, most_left: int, ids: array) -> pa.RecordBatch:
        """Whole subtrees, largest first, until at most `most_left` phrases stay; rows sorted by the words' global ids."""
        held = [sum(map(len, self._containers(node))) for node in self.roots]
        phrases, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in sorted(range(self.SLOTS), key=held.__getitem__, reverse=True):
            if self.size <= most_left:
                break
            for container in self._containers(self.roots[k]):
                phrases.append(np.fromiter(container.keys(), np.int64, len(container)))
                counts.append(np.fromiter(container.values(), np.int64, len(container)))
            self.size -= held[k]
            self.roots[k] = {}
        phrase, n = np.concatenate(phrases), np.concatenate(counts)
        known = np.frombuffer(ids, np.uint64).view(np.int64) if len(ids) else np.zeros(0, np.int64)
        columns = [known[(phrase >> (ID_BITS * k)) & ID_MASK] for k in range(self.width - 1, -1, -1)]
        order = np.lexsort(columns[::-1])
        return pa.RecordBatch.from_arrays([*(pa.array(c[order]) for c in columns), pa.array(n[order])], [*(f"w{k + 1}" for k in range(self.width)), "n"])


def count_phrases(docs: DataFrame, width: int, limits: Limits, salt: str, words: Broadcast, pairs: Broadcast | None = None) -> DataFrame:
    """(w1, ..., n) of the phrases of two words that are frequent, or of three whose pairs are; merged per prefix partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words.value
        pair_bits = np.frombuffer(pairs.value, np.uint8) if pairs else None
        langs: dict[bytes, LocalWords] = {}
        ids, trie = array("Q"), HatTrie(width, limits.burst)
        for lang, numbers, distinct in word_chunks(batches, limits.block_bytes, width - 1):
            if sum(map(len, langs.values())) > limits.words:
                yield trie.spill(0, ids)
                langs, ids = {}, array("Q")
            if lang not in langs:
                langs[lang] = LocalWords(lang, salt.encode(), bits, ids)
            own = np.fromiter(map(langs[lang].__getitem__, distinct), np.int64, len(distinct))[numbers]
            good = own >= 0
            good = good[:-1] & good[1:]
            if pair_bits is not None and len(own) > 1:
                at = mixed_pairs(np.frombuffer(ids, np.uint64)[own] if len(ids) else np.zeros(len(own), np.uint64)) & np.uint64(len(pair_bits) * 8 - 1)
                good &= (pair_bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if width == 3:
                good = good[:-1] & good[1:]
            starts = np.flatnonzero(good)
            if not len(starts):
                continue
            packed = own[starts]
            for k in range(1, width):
                packed = packed << ID_BITS | own[starts + k]
            trie.add(*np.unique(packed, return_counts=True))
            if trie.size > limits.phrases:
                yield trie.spill(limits.phrases // 2, ids)
        yield trie.spill(0, ids)

    names = [f"w{k + 1}" for k in range(width)]
    runs = by_lang(docs).mapInArrow(run, ", ".join(f"{name} long" for name in [*names, "n"]))
    prefixed = runs.withColumn("slice", F.pmod("w2", F.lit(SLICES))).repartition("w1", "slice")
    return prefixed.groupBy("w1", "slice", *names[1:]).agg(F.sum("n").alias("n")).drop("slice")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact over whole numbers of 38 digits."""
    wide = lambda name, digits: f"cast({name} as decimal({digits}, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide(a, 15)} * {wide(a, 15)}) div ({wide(left, 19)} * {wide(right, 19)})")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_OF_A_LANG, limits: Limits = Limits()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each lang's first `most` phrases of two or three words found `least` times or more."""
    spark = docs.sparkSession
    counted = written(count_words(docs, limits), "words")
    salt = unambiguous_salt(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    often = written(counted.where(F.col("n") >= least).select(word_id(salt).alias("id"), "lang", "word", "n"), "frequent-words")
    word_bits = bitmap(spark, often.select(F.col("id").alias("number")), often.count())
    pairs = written(count_phrases(docs, 2, limits, salt, word_bits).where(F.col("n") >= least), "pairs")
    pair_bits = bitmap(spark, pairs.select(pair_number(F.col("w1"), F.col("w2")).alias("number")), pairs.count())
    triples = written(count_phrases(docs, 3, limits, salt, word_bits, pair_bits).where(F.col("n") >= least), "triples")

    def word(k: int) -> DataFrame:
        return often.select(F.col("id").alias(f"w{k}"), F.col("lang").alias(f"lang{k}"), F.col("word").alias(f"word{k}"), F.col("n").alias(f"n{k}"))

    pair = lambda first, second, name: pairs.select(F.col("w1").alias(first), F.col("w2").alias(second), F.col("n").alias(name))
    longer = triples.select("w1", "w2", "n").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n")).groupBy("w1", "w2").agg(F.max("n").alias("inside"))
    own = pairs.join(longer, ["w1", "w2"], "left").where("inside is null or 100 * inside < 50 * n")
    two = own.join(word(1), "w1").join(word(2), "w2").select(F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"), score("n", "n1", "n2").alias("score"))
    cut = triples.join(pair("w1", "w2", "front"), ["w1", "w2"]).join(pair("w2", "w3", "back"), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    cuts = F.array_min(F.array(F.struct(score("n", "n1", "back").alias("score"), F.lit(1).alias("k"), F.col("n1").alias("l"), F.col("back").alias("r")), F.struct(score("n", "front", "n3").alias("score"), F.lit(2).alias("k"), F.col("front").alias("l"), F.col("n3").alias("r"))))
    three = cut.withColumn("cut", cuts).select(F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = two.unionByName(three).withColumn("rank", place.cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
