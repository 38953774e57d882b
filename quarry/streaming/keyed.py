"""Keyed state of a stream in Spark's own state store: upserts by key, events once, timers and expiry.

A micro-batch reads and writes the state of the keys that it names and of no
others, and gives the rows of those that changed. What decides is an order number
(of arrival, or a time): a column is overwritten by an event of a higher one, and
a column that keeps its value is overwritten by one that isn't null. So the state
does not depend on how events are dealt to micro-batches, nor on their order in
them.

Defined cases: an event of null key has its own state; events of null order are
before all others; among equal orders the greater row wins, compared column by
column; an event whose `event_key` was seen is dropped, one without it is always
new; what `forget` says is dropped once the watermark is so far past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Before every order number.
NEVER = -(1 << 63)


def _rank(order, value) -> tuple:
    """What decides between two events for a column: the order, then the value."""
    return (NEVER if order is None else int(order), value is not None, value if value is not None else 0)


class Upserts(StatefulProcessor):
    """State of a key: for each column its value and the order that set it, how many events were applied, and event keys that were seen."""

    def __init__(self, columns: list[T.StructField], keeps: frozenset[str], once: bool, forget_ms: int | None, idle_ms: int | None) -> None:
        self.columns, self.keeps, self.once = columns, keeps, once
        self.forget_ms, self.idle_ms = forget_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("applied", T.LongType()), T.StructField("latest_ms", T.LongType())]
        for c in self.columns:
            fields += [T.StructField(c.name, c.dataType), T.StructField(f"{c.name}_order", T.LongType())]
        self.handle = handle
        self.row = handle.getValueState("row", T.StructType(fields))
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("event", T.StringType())]), T.StructType([T.StructField("at_ms", T.LongType())])) if self.once else None

    def _new(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows whose event key wasn't seen; they count as seen from now on."""
        if self.seen is None:
            return rows
        fresh = []
        for event, at in zip(rows["event"], rows["at_ms"], strict=True):
            new = event is None or not self.seen.containsKey((event,))
            if new and event is not None:
                self.seen.updateValue((event,), (int(at),))
                if self.forget_ms is not None:
                    self.handle.registerTimer(int(at) + self.forget_ms)
            fresh.append(new)
        return rows[fresh]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.row.get() if self.row.exists() else None
        applied, latest = (held[0], held[1]) if held else (0, NEVER)
        now = [(held[2 + 2 * i], held[3 + 2 * i]) if held else (None, NEVER) for i in range(len(self.columns))]
        before = applied
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            part = self._new(part)
            applied += len(part)
            latest = max([latest, *(int(x) for x in part["at_ms"] if x is not None)])
            for i, c in enumerate(self.columns):
                best = _rank(now[i][1], now[i][0])
                for order, value in zip(part["rank"], part[f"c{i}"], strict=True):
                    if (value is not None or c.name not in self.keeps) and _rank(order, value) > best:
                        best, now[i] = _rank(order, value), (value, NEVER if order is None else int(order))
        if applied == before:
            return
        self.row.update((applied, latest, *(x for pair in now for x in pair)))
        if self.idle_ms is not None:
            self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame({"key": [key[0]], **{f"c{i}": pd.Series([v], dtype=object) for i, (v, _) in enumerate(now)}, "applied": [applied]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.seen is not None and self.forget_ms is not None:
            for (event,), (at,) in list(self.seen.iterator()):
                if at + self.forget_ms <= due:
                    self.seen.removeKey((event,))
        if self.idle_ms is not None and self.row.exists() and self.row.get()[1] + self.idle_ms <= due:
            self.row.clear()
        yield from ()

    def close(self) -> None:
        pass


def keyed_upserts(
    events: DataFrame, key: str, order: str, keeps: list[str], overwrites: list[str], event_key: str | None = None, time: str | None = None, late: str = "1 hour", forget: int | None = None, idle: int | None = None
) -> DataFrame:
    """The stream's changed keys with their state: key, columns, applied. For output mode `update`.

    With `time`, `forget` and `idle` are seconds after which the watermark drops seen event keys, and keys without events.
    """
    spark = events.sparkSession
    if spark.conf.get(STORE, "") != ROCKS:
        raise ValueError(f"{STORE} has to be {ROCKS}")
    if (forget is not None or idle is not None) and time is None:
        raise ValueError("only with a time can something be forgotten")
    named = {f.name: f for f in events.schema}
    columns = [named[c] for c in (*overwrites, *keeps)]
    rows = events.select(
        F.col(key).alias("key"), *[F.col(c.name).alias(f"c{i}") for i, c in enumerate(columns)], F.col(order).cast("long").alias("rank"),
        (F.col(event_key) if event_key else F.lit(None)).cast("string").alias("event"), (F.unix_millis(F.col(time).cast("timestamp")) if time else F.lit(0)).cast("long").alias("at_ms"),
        *([F.col(time).cast("timestamp").alias("at")] if time else []),
    )
    if time:
        rows = rows.withWatermark("at", late)
    processor = Upserts(columns, frozenset(keeps), event_key is not None, None if forget is None else forget * 1000, None if idle is None else idle * 1000)
    out = T.StructType([T.StructField("key", named[key].dataType), *(T.StructField(f"c{i}", c.dataType) for i, c in enumerate(columns)), T.StructField("applied", T.LongType())])
    changed = rows.groupBy("key").transformWithStateInPandas(processor, outputStructType=out, outputMode="Update", timeMode="EventTime" if time else "None")
    return changed.select(F.col("key").alias(key), *[F.col(f"c{i}").alias(c.name) for i, c in enumerate(columns)], "applied")


def write_changes(changes: DataFrame, path: str, checkpoint: str):
    """A query that appends each micro-batch's changed keys to a log; a batch that runs twice replaces its own part."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The state after all batches of a log of changes: each key's last row."""
    log = spark.read.option("recursiveFileLookup", "true").parquet(path)
    columns = [c for c in log.columns if c not in (key, "batch")]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select(key, "row.*")
