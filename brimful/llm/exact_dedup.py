"""Exact duplicates found through a two-pass Bloom filter, with DataFrame functions only.

Texts are equal when they are without white space; the SHA-256 of such a text stands for it from then on. The first
pass puts every row into a blocked Bloom filter and notes the cells that were hit twice or more; the filter is a
table (word of 64 cells, cells hit twice) that no task or driver holds as a whole unless it is proven small. The
second pass looks every row up: one whose cells were not all hit twice is surely alone and passes straight
through; only the others, members of groups and a few false alarms, are shuffled by their digest.

A group may hold a third of all rows. What is kept of it comes from an aggregate that combines before the shuffle;
where its rows need the answer back, groups of more than one row in HOT, of which there are at most HOT, meet them
by broadcast. A filter of more than BROADCAST_WORDS words is joined by shuffling narrow rows, never texts.

Defined cases: a null text is the empty text and equal to one of white space only; a null doc_id comes last among
ties; of rows alike in size and doc_id one stays, the first as written in `groups`, the one with the least hash of
its text in `drop_copies`; repeated doc_ids are rows of their own; an empty table gives an empty table; further
columns are ignored by `groups` and kept by `drop_copies`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimful.llm.common import written

CELLS_PER_ROW = 16
BROADCAST_WORDS = 2_000_000
HOT = 1000


def normalised(text: Column) -> Column:
    """The text without spaces, tabs and line ends."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def narrow(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, n_chars, digest, more...) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), *more)


def probed(rows: DataFrame, words: int) -> DataFrame:
    """rows with the word of the filter and the mask of the two cells that their digest hits."""
    hashed = rows.withColumn("hash", F.xxhash64("digest"))
    cells = "shiftleft(1L, cast(shiftrightunsigned(hash, 52) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(hash, 58) & 63 as int))"
    return hashed.withColumn("word", F.pmod("hash", F.lit(words))).withColumn("mask", F.expr(cells)).drop("hash")


def twice_hit(rows: DataFrame, words: int) -> DataFrame:
    """First pass: (word, twice), the cells of each word that two or more rows hit."""
    cells = F.explode(F.expr("array(shiftrightunsigned(hash, 52) & 63, shiftrightunsigned(hash, 58) & 63)"))
    hit = rows.select(F.xxhash64("digest").alias("hash")).select(F.pmod("hash", F.lit(words)).alias("word"), cells.alias("cell"))
    often = hit.groupBy("word", "cell").agg(F.count("*").alias("n")).where("n > 1")
    return often.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(cell as int))")).alias("twice"))


def looked_up(rows: DataFrame, hashed: DataFrame, n_rows: int) -> DataFrame:
    """Second pass: rows with `suspect`, false where the filter over `hashed` proves that no other row is equal."""
    words = 1 << max(0, (n_rows * CELLS_PER_ROW // 64).bit_length())
    table = written(twice_hit(hashed, words), "bloom")
    table = F.broadcast(table) if table.count() <= BROADCAST_WORDS else table
    met = probed(rows, words).join(table, "word", "left")
    return met.withColumn("suspect", F.coalesce(F.col("twice").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))).drop("word", "mask", "twice")


def first_choice(*last: str) -> Column:
    """Least for the row that stays: most code points, then the smallest doc_id."""
    return F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *last)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row, dropped ones too."""
    rows = written(narrow(docs, id_col, text_col, F.monotonically_increasing_id().alias("row")), "narrow")
    n = rows.count()
    met = looked_up(rows, rows, n)
    alone = met.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    suspects = written(met.where("suspect").drop("suspect"), "suspects")
    found = written(suspects.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(first_choice("row")).alias("best")), "groups")
    large = F.col("group_size") > n // HOT
    near = suspects.join(F.broadcast(found.where(large)), "digest", "left")
    told = near.where("best is not null").unionByName(near.where("best is null").drop("group_size", "best").join(found.where(~large), "digest"))
    return alone.unionByName(told.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all its columns as they are."""
    boxed = narrow(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("box"))
    hashed = written(boxed.select("digest"), "digests")
    met = looked_up(boxed, hashed, hashed.count()).withColumn("hash", F.xxhash64(F.col(f"box.`{text_col}`")))
    kept = met.where("suspect").groupBy("digest").agg(F.min_by("box", first_choice("hash")).alias("box"))
    return met.where("not suspect").select("box.*").unionByName(kept.select("box.*"))
