"""Edit logs of sessions (ED1-ED3): the state after all edits, by aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimful.operators.dealing import dealt

ITEM = ("name", "category", "price_cents", "abv", "abv_estimated", "size_oz", "size_estimated", "count")
STATE = ("session_id", "item_id", *ITEM)
BLANKS = " \t\r\n"
OPTIONAL = {"category": "string", "abv": "double", "size_oz": "double", "price": "double"}


def valid_edits(events: DataFrame) -> DataFrame:
    """The edits that can change something: (session_id, seq, item_id, kind, name, cents, value, count, category, abv, size_oz).

    Kinds: add (a name that is not blank, with abv, size_oz, price in dollars, count and category, each of which
    may be missing; a category without alcohol becomes unknown), remove, set_price (value in dollars, 1 cent or
    more), correct_abv and correct_size (value), set_package (count, at least 1, and size_oz if it is known).
    """
    for name, kind in OPTIONAL.items():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    name = F.btrim(F.col("name"), F.lit(BLANKS))
    cents = F.round(F.when(F.col("kind") == "add", F.col("price")).otherwise(F.col("value")) * 100).cast("int")
    category = F.when(F.col("category") == "nonAlcoholic", "unknown").otherwise(F.coalesce("category", F.lit("unknown")))
    rows = events.select("session_id", F.col("seq").cast("long").alias("seq"), "item_id", "kind", name.alias("name"), F.when(cents > 0, cents).alias("cents"), F.col("value").cast("double").alias("value"), F.greatest(F.lit(1), "count").cast("int").alias("count"), category.alias("category"), F.col("abv").cast("double").alias("abv"), F.col("size_oz").cast("double").alias("size_oz"))
    valid = (
        F.when(F.col("kind") == "add", F.col("name") != "")
        .when(F.col("kind") == "set_price", F.col("cents").isNotNull())
        .when(F.col("kind").isin("correct_abv", "correct_size"), F.col("value").isNotNull())
        .otherwise(F.col("kind").isin("remove", "set_package"))
    )
    return rows.where(F.coalesce(valid, F.lit(False)))


def apply_edits(base: DataFrame, events: DataFrame) -> DataFrame:
    """Live items of every session after its events.

    `base` has the columns of STATE (category may be missing), `events` those that valid_edits() describes. An item lives from
    the start if it is in the base, or from its first add after its last removal; an add of a living item and edits
    of others do nothing; of several edits the last wins.
    """
    key = ["session_id", "item_id"]
    good = valid_edits(events)
    removed = good.where("kind = 'remove'").groupBy(*key).agg(F.max("seq").alias("removed"))
    later = good.where("kind <> 'remove'").join(removed, key, "left").where("removed is null or seq > removed")
    if "category" not in base.columns:
        base = base.withColumn("category", F.lit("unknown"))
    kept = base.join(removed, key, "left_anti").select(*key, F.lit(-1).cast("long").alias("start"), F.struct(*ITEM).alias("item"))
    read = F.lit(False)
    new = F.struct("name", "category", F.col("cents").alias("price_cents"), "abv", read.alias("abv_estimated"), "size_oz", read.alias("size_estimated"), "count")
    added = later.where("kind = 'add'").groupBy(*key).agg(F.min("seq").alias("start"), F.min_by(new, "seq").alias("item")).join(kept, key, "left_anti")
    alive = kept.unionByName(added)
    last = lambda value, of: F.max_by(value, F.when(of, F.col("seq")))
    is_kind = lambda kind: F.col("kind") == kind
    size = F.when(is_kind("set_package"), F.col("size_oz")).otherwise(F.col("value"))
    edits = later.where("kind <> 'add'").join(alive.select(*key, "start"), key).where("seq > start").groupBy(*key).agg(
        last(F.col("cents"), is_kind("set_price")).alias("new_price"),
        last(F.col("value"), is_kind("correct_abv")).alias("new_abv"),
        last(size, is_kind("correct_size") | (is_kind("set_package") & F.col("size_oz").isNotNull())).alias("new_size"),
        last(F.coalesce("count", F.lit(1)), is_kind("set_package")).alias("new_count"),
    )
    rows = alive.join(edits, key, "left")
    pick = lambda new, old: F.coalesce(F.col(new), F.col(f"item.{old}")).alias(old)
    estimated = lambda new, old: (F.col(new).isNull() & F.coalesce(F.col(f"item.{old}"), F.lit(False))).alias(old)
    return rows.select(*key, "item.name", "item.category", pick("new_price", "price_cents"), pick("new_abv", "abv"), estimated("new_abv", "abv_estimated"), pick("new_size", "size_oz"), estimated("new_size", "size_estimated"), F.coalesce("new_count", "item.count", F.lit(1)).alias("count"))


def capped_adds(events: DataFrame, cap: int = 5) -> DataFrame:
    """(session_id, item_id): items left in sessions that take no add beyond `cap` live items.

    Which adds count depends on all events before, so the events of a session are folded in order; many sessions are
    folded per batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, live = None, {}
        for batch in batches:
            out = []
            for event in batch.itertuples(index=False):
                if event.session_id != session:
                    out += [(session, i) for i in live]
                    session, live = event.session_id, {}
                if event.kind == "remove":
                    live.pop(event.item_id, None)
                elif event.kind == "add" and len(live) < cap:
                    live.setdefault(event.item_id, None)
            yield pd.DataFrame(out, columns=["session_id", "item_id"])
        yield pd.DataFrame([(session, i) for i in live], columns=["session_id", "item_id"])

    named = F.btrim(F.col("name"), F.lit(BLANKS)) != ""
    good = events.where((F.col("kind") == "remove") | ((F.col("kind") == "add") & named)).select("session_id", "seq", "item_id", "kind")
    kinds = dict(events.dtypes)
    return dealt(good, "session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, f"session_id {kinds['session_id']}, item_id {kinds['item_id']}")
