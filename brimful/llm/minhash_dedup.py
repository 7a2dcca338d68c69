"""Near-duplicate detection over word shingles with b-bit MinHash signatures and a multi-index Hamming join.

A signature has `chunks` chunks of four b-bit MinHash values. Two signatures that differ in at most
(errors + 1) * chunks - 1 = 19 of 40 values differ in at most one value of some chunk (pigeonhole), so
each chunk is indexed four times, once without each of its values: every pair within that distance shares
a key. At the similarity threshold of 0.75 itself, where a value differs with probability 0.25, a pair
shares no key with probability 0.262 ** 10, about 1.5e-6; more similar pairs still less. Every
candidate is confirmed on full shingle sets.

A bucket is never expanded into its pairs:

1. Documents with equal sets are one class, represented by the smallest doc_id.
2. In each bucket every class is a candidate with the bucket's smallest and largest class. Confirmed links
   give components.
3. Buckets that still hold several components are joined once more, members outside the bucket's main
   component against members of other components, so that no link between components is lost. Pairs are
   left out only where exact bounds on their common shingles rule the similarity out.

Defined cases: a text without words (or null) has no shingles and is its own component; a document of
fewer than five words has its word sequence as its only shingle; equal rows, rows with the same doc_id
included, share a class; unlike texts with one doc_id are documents of their own, told apart by the text's
digest. In near_duplicates null doc_ids are left out of links, get a null component and are kept; in keep_one
a document without a doc_id is compared like any other, but stays only if no near copy has one. Where doc_ids
are null or repeat, documents get a key of their own first. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimful.llm.common import blocks, by_key, discard, is_key, keyed, mix64, text_digest, texts, utf8, windows, word_hashes, written

WORDS, CHUNKS, PER_CHUNK, VALUE_BITS = 5, 10, 4, 16
N_VALUES = CHUNKS * PER_CHUNK
#: Pairs at the threshold differ in more values than this with probability below 1e-7.
MOST_DIFFERENT = 26
MULTIPLIERS = mix64(np.arange(1, N_VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words, hashes = word_hashes(text.lower())  # of bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(width, len(words))))


def signature(own: np.ndarray) -> np.ndarray:
    """b-bit MinHash values of a set that is not empty."""
    least = np.full(N_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(own), 1 << 14):
        least = np.minimum(least, (own[lo : lo + (1 << 14), None] * MULTIPLIERS).min(axis=0))
    return (mix64(least) >> np.uint64(64 - VALUE_BITS)).astype(np.int32)


def sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_hash, values): one row per document."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            n, digest, values = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = shingles(data[a:b].tobytes(), width)
                n.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                values.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(values, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "set_hash", "values"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, values array<int>")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, id, n): each chunk without each of its values in turn."""
    keys = []
    for chunk in range(CHUNKS):
        at = range(chunk * PER_CHUNK, (chunk + 1) * PER_CHUNK)
        for left_out in at:
            key = F.lit(left_out).cast("long")
            for i in at:
                if i != left_out:
                    key = F.shiftleft(key, VALUE_BITS).bitwiseOR(F.col("values")[i].cast("long"))
            keys.append(key)
    return classes.select(F.explode(F.array(*keys)).alias("key"), "id", "n")


def _could_link(a: str, b: str, percent: int) -> F.Column:
    """Sizes and signatures allow the similarity."""
    alike = F.size(F.filter(F.zip_with(f"values_{a}", f"values_{b}", lambda x, y: x == y), lambda z: z))
    ratio = 100 * F.least(f"n_{a}", f"n_{b}") >= percent * F.greatest(f"n_{a}", f"n_{b}")
    return ratio & (alike >= N_VALUES - MOST_DIFFERENT)


def _with_sides(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("values").alias(f"values_{side}")), side)
    return pairs


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, width: int = WORDS) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough; docs has one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[text] = shingles(text, width)
            return recent[text]

        for batch in batches:
            (at, left), (bt, right) = utf8(batch.column("text_a")), utf8(batch.column("text_b"))
            good = []
            for i in range(len(batch)):
                p, q = of(left[at[i] : at[i + 1]].tobytes()), of(right[bt[i] : bt[i + 1]].tobytes())
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(docs.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(id, component): the smallest id reachable, for the ids in links (a, b).

    Labels fall to the least label of the neighbours and then to that label's own label, until none
    changes; each round is written out. Nothing but a count reaches the driver.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")), name)
    while True:
        old = [labels]
        heard = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "id").select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        lower = written(lower, name)
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = written(lower.join(jump, "component", "left").select("id", "was", F.coalesce("next", "component").alias("component")), name)
        discard([*old, lower])
        if labels.where("component <> was").isEmpty():
            discard([edges])
            return labels.select("id", "component")


def _traits(mixed: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, shared, pivot, held, bits): bounds on what a document of mixed buckets can have in common with another.

    `shared` counts its shingles that another of these documents has too. The pivot is one document of the
    component that is the main one in most of its buckets, the one with least of its own; `bits` tells which of
    the pivot's shingles the document holds, `held` how many. Of documents with one pivot, the common shingles
    are at most the bits both have and the lesser number of shared shingles beside the pivot's. A main component
    without such a document gives no pivot (null).
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for lo, hi in blocks(offsets, 1 << 20):
                own = [shingles(data[a:b].tobytes(), width) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                ids = batch.column("doc_id").slice(lo, hi - lo).to_numpy().repeat(list(map(len, own)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(own).view(np.int64))], names=["id", "shingle"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            (at, left), (bt, right) = utf8(batch.column("text")), utf8(batch.column("pivot_text"))
            held, bits = [], []
            for i in range(len(batch)):
                if text != right[bt[i] : bt[i + 1]].tobytes():
                    text = right[bt[i] : bt[i + 1]].tobytes()
                    pivot = shingles(text, width)
                has = np.isin(pivot, shingles(left[at[i] : at[i + 1]].tobytes(), width), assume_unique=True)
                held.append(int(has.sum()))
                bits.append(np.packbits(np.append(has, np.zeros(-len(has) % 64, bool))).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["id", "held", "bits"])

    ids = mixed.groupBy("id", "n", "component", "main").agg(F.count("*").alias("buckets")).groupBy("id", "n", "component").agg(F.max_by("main", F.struct("buckets", "main")).alias("main"))
    ids = written(ids, "mixed-ids")
    owned = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(split, "id long, shingle long")
    lonely = owned.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").groupBy("id").agg(F.count("*").alias("lonely"))
    ids = written(ids.join(lonely, "id", "left").withColumn("shared", F.col("n") - F.coalesce("lonely", F.lit(0))).drop("lonely"), "shared")
    pivots = written(ids.where("component = main").groupBy("main").agg(F.max_by("id", F.struct(F.col("shared") / F.col("n"), -F.col("id"))).alias("pivot")), "pivots")
    paired = written(ids.join(pivots, "main").select("id", "pivot"), "paired")
    for side, name in (("id", "text"), ("pivot", "pivot_text")):
        paired = paired.join(docs.select(F.col("doc_id").alias(side), F.col("text").alias(name)), side)
    compared = paired.select("id", "pivot", "text", "pivot_text").mapInArrow(compare, "id long, held long, bits array<long>")
    return ids.select("id", "shared", "main").join(pivots, "main", "left").drop("main").join(compared, "id", "left")


def _across(mixed: DataFrame, traits: DataFrame, percent: int, step: float = 1.05) -> DataFrame:
    """Distinct pairs (a, b) of different components in one bucket whose bounds allow a link.

    A link of similarity t has an overlap of t / (1 + t) * (|x| + |y|) at least. The shared shingles of one
    side bound the partner's size, so the join goes by geometric size bins.
    """
    need = percent / (100 + percent)
    size_bin = lambda n: F.floor(F.log(n) / float(np.log(step))).cast("int")
    low, high = percent / 100 * F.col("n"), F.col("shared") / need - F.col("n")
    rows = mixed.join(traits, "id")
    bins = F.explode(F.sequence(size_bin(F.greatest(F.lit(1.0), low - 1)), size_bin(F.least(high, 100 / percent * F.col("n")) + 1)))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "n", "shared", "pivot", "held", "bits")]
    outside = rows.where(F.col("component") != F.col("main")).where(high >= low).select("key", *side("x"), bins.alias("bin"))
    inside = rows.where(F.col("shared") * 100 >= percent * F.col("n")).select("key", *side("y"), size_bin(F.col("n").cast("double")).alias("bin"))
    reaches = lambda most: most * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y"))
    both = F.aggregate(F.zip_with("bits_x", "bits_y", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, x: n + x)
    beside = F.least(F.col("shared_x") - F.least("shared_x", "held_x"), F.col("shared_y") - F.least("shared_y", "held_y"))
    by_pivot = F.when(F.col("pivot_x") == F.col("pivot_y"), reaches(both + beside)).otherwise(F.lit(True))
    pairs = outside.join(inside, (outside["key"] == inside["key"]) & (outside["bin"] == inside["bin"]) & (F.col("component_x") != F.col("component_y")) & reaches(F.least("shared_x", "shared_y")) & by_pivot)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _near_duplicates(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of rows (doc_id, text), whose doc_ids are a key."""
    own = written(sets(rows, width), "sets")
    classes = written(own.where("set_hash is not null").groupBy("set_hash").agg(F.min_by(F.struct("doc_id", "n_shingles", "values"), "doc_id").alias("r")).select("set_hash", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), F.col("r.values").alias("values")), "classes")

    keys = _keys(classes)
    shared = written(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(keys.join(shared, "key"), "members")
    pairs = members.select(F.col("id").alias("b"), F.explode(F.array("low", "high")).alias("a")).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = written(_with_sides(pairs, classes).where(_could_link("a", "b", percent)).select("a", "b"), "candidates")
    links = written(confirm(first, rows, percent, width), "links")
    found = components(links)

    # Buckets that still hold several components: what is outside the largest meets members of other components.
    labelled = members.select("key", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counted = labelled.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = counted.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    mixed = written(labelled.join(mixed, "key"), "mixed")
    across = written(_across(mixed, written(_traits(mixed, rows, width), "traits"), percent), "across")
    across = written(_with_sides(across, classes).where(_could_link("a", "b", percent)).select("a", "b").join(first, ["a", "b"], "left_anti"), "across-candidates")
    more = written(confirm(across, rows, percent, width), "more-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    of_class = written(classes.join(found, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id")), "components")
    out = own.join(of_class, "set_hash", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _by_own_key(keys: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept) for every row of keyed(); component_id is a doc_id."""
    found = _near_duplicates(keys.select(F.col("key").alias("doc_id"), "text"), percent, width).withColumnRenamed("doc_id", "key")
    names = keys.select(F.col("key").alias("component_id"), F.col("doc_id").alias("component"))
    found = found.join(names, "component_id").select("key", "n_shingles", F.col("component").alias("component_id"), "kept")
    return keys.select("key", "doc_id", "digest").join(found, "key").drop("key")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    rows = texts(docs, id_col, text_col)
    if is_key(rows):
        return _near_duplicates(rows, percent, width)
    known = rows.where("doc_id is not null")
    found = written(_by_own_key(keyed(known, null_first=False), percent, width), "by-own-key")
    joined = by_key(known.select("doc_id", text_digest(F.col("text")).alias("digest")), found, "n_shingles", "component_id", "kept")
    alone = sets(rows.where("doc_id is null"), width).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return joined.select("doc_id", "n_shingles", "component_id", "kept").unionByName(alone)


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of docs for each component, with its columns; of rows with one doc_id and one text one stays."""
    rows = texts(docs)
    if is_key(rows):
        kept = _near_duplicates(rows, percent, WORDS).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    found = _by_own_key(keyed(rows, null_first=False), percent, WORDS).where("kept").select("doc_id", "digest")
    # Of equal texts with one doc_id the least row by its other columns stays, whatever the order they come in.
    others = F.to_json(F.struct(F.col("text").isNull().alias("no_text"), *[c for c in docs.columns if c != "text"]))
    once = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")).agg(F.min_by(F.struct(*docs.columns), others).alias("row"))
    return by_key(once, found).select("row.*")
