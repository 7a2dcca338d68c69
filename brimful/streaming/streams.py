"""Streams of edits and lists (SM1, SM2)."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brimful.operators.sessions import valid_edits
from brimful.operators.value import rank_packages
from brimful.plans.pipeline import rank_lists

ITEM = "item_id long, name string, category string, price_cents int, abv double, abv_estimated boolean, size_oz double, size_estimated boolean, count int"
OUTPUT = f"session_id long, seq long, late long, {ITEM}"
SEEN = "last long, late long"
FIELDS = tuple(c.split()[0] for c in ITEM.split(", "))
SHOWN = Row("session_id", "seq", "late", *FIELDS)
Event = namedtuple("Event", "seq item_id kind name cents value count category abv size_oz")
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _known(x: Any) -> Any:
    """The value, or None for a number that is none."""
    return None if x != x else x


def apply_one(items: dict[int, dict[str, Any]], event: Any) -> None:
    """One row of valid_edits() on a session's items; edits of items that are not there change nothing."""
    item, kind = items.get(event.item_id), event.kind
    if kind == "add" and item is None:
        cents, abv, size, count = map(_known, (event.cents, event.abv, event.size_oz, event.count))
        items[event.item_id] = {"name": event.name, "category": event.category, "price_cents": None if cents is None else int(cents), "abv": abv, "abv_estimated": False, "size_oz": size, "size_estimated": False, "count": int(count or 1)}
    elif item is None:
        return
    elif kind == "remove":
        items.pop(event.item_id)
    elif kind == "set_price":
        item["price_cents"] = int(event.cents)
    elif kind == "correct_abv":
        item.update(abv=float(event.value), abv_estimated=False)
    elif kind == "correct_size":
        item.update(size_oz=float(event.value), size_estimated=False)
    elif kind == "set_package":
        item["count"] = int(_known(event.count) or 1)
        if _known(event.size_oz) is not None:
            item.update(size_oz=float(event.size_oz), size_estimated=False)


class Session(StatefulProcessor):
    """One session: a state entry for each live item, the last seq and the late events; it ends after `idle_ms` without events.

    A call of the store costs more than many items: they are read in one call, and those that changed are written.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item_id long", ITEM.removeprefix("item_id long, "))
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen = self.seen.get()
        last, late = seen or (-1, 0)
        events = sorted((Event(*(row[c] for c in Event._fields)) for row in rows), key=lambda e: e.seq)
        late += sum(e.seq <= last for e in events)
        events = [e for e in events if e.seq > last]
        before = {i: dict(zip(FIELDS[1:], values, strict=True)) for (i,), values in self.items.iterator()} if seen else {}
        after = {i: dict(values) for i, values in before.items()}
        for event in events:
            apply_one(after, event)
        for i in dict.fromkeys(e.item_id for e in events):
            if i in after and after[i] != before.get(i):
                self.items.updateValue((i,), tuple(after[i][c] for c in FIELDS[1:]))
            elif i in before and i not in after:
                self.items.removeKey((i,))
        last = max([last, *(e.seq for e in events)])
        self.seen.update((int(last), int(late)))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        live = [(i, *(item[c] for c in FIELDS[1:])) for i, item in after.items()] or [(None,) * len(FIELDS)]
        return (SHOWN(key[0], int(last), int(late), *values) for values in live)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.items.clear()
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """After each batch the live items of every session that changed, as of its last event.

    Events (see valid_edits()) of a session are applied by seq within a batch; batches come in order. An event whose
    seq is not above the last one applied in an earlier batch came too late: it is left out and counted in `late`. A
    session without items gives one row without item_id. A batch reads and writes the state of the items that it edits.
    With `idle_ms` a session's state goes when it has had no event for so long, and later events begin a new one; that
    needs a query that goes on, since Spark runs batches for timers even without data. Start it with started().
    """
    mode = "ProcessingTime" if idle_ms else "None"
    return valid_edits(events).groupBy("session_id").transformWithState(Session(idle_ms), OUTPUT, "Update", mode)


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query with the state store that states of maps and timers need; other queries keep theirs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def write_epoch(rows: DataFrame, folder: str, epoch: int) -> None:
    """Writes a batch as a partition of its own. An epoch that runs again after a lost driver replaces what it wrote before."""
    rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def stream_session_rankings(events: DataFrame, folder: str, checkpoint: str, idle_ms: int | None = None, once: bool = True) -> StreamingQuery:
    """Starts a query that ranks every session whose items changed, and writes its ranking into the epoch's partition of `folder`.

    A session with nothing to rank gives one row without item_id, so that a reader sees that its last ranking is gone.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()  # used twice below; Spark computes a lost part again
        changed = rows.select("session_id", "seq", "late").distinct()
        ranked = rank_live(rows.where("item_id is not null")).withColumnRenamed("list_id", "session_id").withColumnRenamed("item_no", "item_id")
        write_epoch(changed.join(ranked, "session_id", "left"), folder, epoch)
        rows.unpersist()

    writer = stream_sessions(events, idle_ms).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    return started(writer.trigger(availableNow=True) if once else writer, events.sparkSession)


def current_rankings(spark: SparkSession, folder: str) -> DataFrame:
    """The last ranking of every session in the folder of stream_session_rankings()."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy("session_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["session_id", "epoch"]).where("item_id is not null").drop("epoch")


def rank_live(items: DataFrame) -> DataFrame:
    """Live items of sessions as ranked packages."""
    return rank_packages(items.select(F.col("session_id").alias("list_id"), F.col("item_id").alias("item_no"), "name", F.col("size_oz").alias("unit_oz"), "count", "abv", "price_cents"))


def stream_lists(lines: DataFrame, brands: DataFrame, styles: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that ranks the lists of each micro-batch; every list is complete within one batch.

    `sink` may get an epoch again after a lost driver; write_epoch() then leaves the rows there once.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        sink(rank_lists(batch, brands, styles).ranked, epoch)

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
