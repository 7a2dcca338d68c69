"""I-Match fingerprints of documents, with DataFrame functions only.

Terms of middling document frequency form the lexicon; a document's distinct lexicon terms are sorted and
hashed once for each of several randomised subsets of the lexicon. Subsets come in levels that keep one
term in 4, 16, 64 or 256, so that short and long documents alike have subsets with about one of their
terms: an edit leaves many of those hashes as they are. Likeness is the share of equal hashes at the level
that shows most, over the subsets in which either document has a term.

The lexicon holds at most (mean distinct terms of a document) * MOST_RARE terms, since each stands in one
document in MOST_RARE or more; it is counted, and broadcast only below BROADCAST_TERMS.

Defined cases: a null or empty text, or one without lexicon terms, gets a fingerprint of its whole text,
alike 1 to equal texts and 0 to others; equal texts have equal fingerprints; rows with the same doc_id
share the next document, which is the next distinct doc_id (of its rows the least text counts); a row
with a null doc_id has no next document; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brimful.llm.common import texts, written

LEVELS, SUBSETS = (4, 16, 64, 256), 8
N_SUBSETS = len(LEVELS) * SUBSETS
MOST_RARE, MOST_COMMON = 2000, 20
BROADCAST_TERMS = 500_000
NEEDED = 3
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def lexicon(rows: DataFrame) -> DataFrame:
    """(term, mask): hashed terms within the document-frequency band, and the subsets that each is in."""
    n = rows.count()
    seen = rows.select(F.explode(terms(F.col("text"))).alias("word")).groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("df"))
    least = max(2, -(-n // MOST_RARE))
    band = seen.where(F.col("df").between(least, max(least, n // MOST_COMMON)))
    bits = [F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(LEVELS[k // SUBSETS])) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(N_SUBSETS)]
    return band.select("term", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("mask"))


def fingerprints(rows: DataFrame, key: list[str], lexicon_table: DataFrame) -> DataFrame:
    """(key..., facts, hashes array): for each key the hash of its sorted distinct terms in every subset, null where it has none.

    `rows` has the key columns, `text` and a struct `facts` that travels with one term only; one row for each
    key, all rows of a document in one partition if it is dealt by one of the key columns. Every key comes
    out, through a term in no subset.
    """
    n = lexicon_table.count()
    nothing = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("term"), F.lit(0).cast("long").alias("mask"))
    table = lexicon_table.unionByName(nothing)
    table = F.broadcast(table) if n <= BROADCAST_TERMS else table
    kind = rows.schema["facts"].dataType
    hashed = F.transform(terms(F.col("text")), lambda w: F.struct(F.xxhash64(w).alias("term"), F.lit(None).cast(kind).alias("facts")))
    every = F.concat(hashed, F.array(F.struct(F.lit(0).cast("long").alias("term"), F.col("facts"))))
    found = rows.select(*key, F.inline(every)).join(table, "term").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("term", "mask"))).alias("own"), F.first("facts", ignorenulls=True).alias("facts"))

    def subset(k: int) -> Column:
        own = F.filter("own", lambda x: x.mask.bitwiseAND(F.lit(1 << k)) != 0)
        return F.when(F.exists("own", lambda x: x.mask.bitwiseAND(F.lit(1 << k)) != 0), F.xxhash64(F.transform(own, lambda x: x.term)))

    return found.select(*key, "facts", F.array(*(subset(k) for k in range(N_SUBSETS))).alias("hashes"))


def shown(hashes: Column, text_hash: Column) -> Column:
    """The fingerprint as a string."""
    some = F.exists(hashes, lambda h: h.isNotNull())
    return F.when(some, F.array_join(F.transform(hashes, lambda h: F.coalesce(F.substring(F.hex(h), -8, 8), F.lit(""))), "-")).otherwise(F.concat(F.lit("text-"), F.hex(text_hash)))


def likeness(a: Column, b: Column) -> Column:
    """Between the arrays of two documents: 0 to 1; null where neither has a hash."""

    def share(lo: int, size: int, needed: int) -> Column:
        pair = F.zip_with(F.slice(a, lo + 1, size), F.slice(b, lo + 1, size), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        sums = F.aggregate(pair, F.struct(F.lit(0).alias("same"), F.lit(0).alias("either")), lambda t, p: F.struct((t.same + (F.coalesce(p.x == p.y, F.lit(False))).cast("int")).alias("same"), (t.either + (p.x.isNotNull() | p.y.isNotNull()).cast("int")).alias("either")), lambda t: F.when(t.either >= needed, t.same / t.either))
        return sums

    by_level = F.greatest(*(share(i * SUBSETS, SUBSETS, NEEDED) for i in range(len(LEVELS))))
    return F.coalesce(by_level, share(0, N_SUBSETS, 1))


def next_ids(rows: DataFrame) -> DataFrame:
    """(doc_id, next_id) over distinct ids in ascending order; the last one's next is the first."""
    ids = written(rows.where("doc_id is not null").select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    order = Window.orderBy("part")  # one row per partition
    parts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    parts = parts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ids.select("part", "doc_id", inside.alias("inside")).join(F.broadcast(parts), "part").select("doc_id", F.coalesce("inside", "after").alias("next_id"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter is the next document's beginning."""
    # A key that is never null keeps Spark from filtering one use of the dealt texts, so both share one shuffle.
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    table = written(lexicon(rows), "lexicon")
    following = written(next_ids(rows.where(F.col("doc_id") != NO_ID)), "following")

    # All copies of a doc_id stand in one partition, numbered by text.
    numbered = rows.repartition("doc_id").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    quarter = F.floor(F.length("text") / 4).cast("int")
    needs = rows.groupBy("doc_id").agg(F.max(quarter).alias("need")).join(following, "doc_id")
    heads = numbered.where("copy = 1").join(needs.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("of"), "need"), "doc_id").select(F.col("of").alias("doc_id"), F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, need)").alias("head"))
    both = numbered.join(heads, "doc_id", "left").withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.coalesce(F.expr("substring(head, 1, cast(floor(length(text) / 4) as int))"), F.lit(""))))
    facts = F.struct("next_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), F.xxhash64("text").alias("text_hash"), F.xxhash64("edited").alias("edited_hash"))
    versions = F.inline(F.array(F.struct(F.lit(0).alias("version"), F.col("text"), facts.alias("facts")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text"), facts.alias("facts"))))
    prints = fingerprints(both.select("doc_id", "copy", versions), ["doc_id", "copy", "version"], table)
    pick = lambda v: F.max(F.when(F.col("version") == v, F.col("hashes")))
    made = prints.groupBy("doc_id", "copy").agg(F.first("facts").alias("facts"), pick(0).alias("own"), pick(1).alias("new"))
    made = written(made.select("doc_id", "copy", "facts.*", "own", "new"), "fingerprints")

    after = made.where("copy = 1").select(F.col("doc_id").alias("next_id"), F.col("own").alias("next_own"), F.col("text_hash").alias("next_hash"))
    rated = made.join(after, "next_id", "left")
    alike = lambda a, ha, b, hb: F.coalesce(F.when(F.col(ha) == F.col(hb), 1.0), likeness(F.col(a), F.col(b)), F.lit(0.0))
    return rated.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), shown(F.col("own"), F.col("text_hash")).alias("fingerprint"), shown(F.col("new"), F.col("edited_hash")).alias("edited_fingerprint"), alike("own", "text_hash", "new", "edited_hash").alias("near_edited"), alike("own", "text_hash", "next_own", "next_hash").alias("near_next"))
