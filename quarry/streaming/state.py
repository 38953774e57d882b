"""Event state as Structured Streaming: idempotent events, keyed upserts in order of arrival, and follow-up windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The event files of a folder as a stream, so many in a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def idempotent(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; state older than that is dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def reduced(batch: DataFrame, key: str, order: str, keeps: list[str], overwrites: list[str]) -> DataFrame:
    """A batch as one change for each key: the last value of what is overwritten, the last value that isn't null of what is kept."""
    last = [F.max_by(c, order).alias(c) for c in overwrites]
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in keeps]
    return batch.groupBy(key).agg(*last, *kept)


def merged(state: DataFrame, changes: DataFrame, key: str, keeps: list[str], overwrites: list[str]) -> DataFrame:
    """State after changes: arrival decides, so a late event overwrites what is newer; nulls keep what is there."""
    new = changes.select(key, F.lit(True).alias("changed"), *[F.col(c).alias(f"new_{c}") for c in (*overwrites, *keeps)])
    both = state.join(new, key, "full_outer")
    put = [F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in overwrites]
    keep = [F.coalesce(f"new_{c}", c).alias(c) for c in keeps]
    return both.select(key, *put, *keep)


def upserts(read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], key: str, order: str, keeps: list[str], overwrites: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over a state table. `write` gets the batch's number, so that a batch that runs twice replaces its own version."""

    def apply(batch: DataFrame, number: int) -> None:
        changes = reduced(batch, key, order, keeps, overwrites)
        state = read()
        write(changes if state is None else merged(state, changes, key, keeps, overwrites), number)

    return apply


def newest(events: DataFrame, key: str, time: str, late: str, columns: list[str]) -> DataFrame:
    """The event-time variant: the latest event of each key and hour, for events within the watermark."""
    events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return events.groupBy(F.window(time, "1 hour"), key).agg(F.max_by(F.struct(*columns), time).alias("row")).select(key, "window", "row.*")


def followups(left: DataFrame, right: DataFrame, key: str, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Stream pairs with the same key and left < right <= left + minutes; both watermarks bound the state."""
    l = left.select(F.col(key), F.col("ts").cast("timestamp").alias("t0"), F.col("event_id").alias("first_event")).withWatermark("t0", late)
    r = right.select(F.col(key).alias("right_key"), F.col("ts").cast("timestamp").alias("t1"), F.col("event_id").alias("next_event")).withWatermark("t1", late)
    near = F.expr(f"t1 > t0 AND t1 <= t0 + interval {minutes} minutes")
    return l.join(r, (F.col(key) == F.col("right_key")) & near).drop("right_key")


def sessions(events: DataFrame, key: str, gap_minutes: int) -> DataFrame:
    """Batch sessions: a gap of over so many minutes begins a new one."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    fresh = F.coalesce(gap > gap_minutes * 60_000_000, F.lit(True)).cast("int")
    return events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w)).drop("fresh")
