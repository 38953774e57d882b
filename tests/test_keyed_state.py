"""Keyed state in Spark's state store: the same as in batch however events are dealt, across restarts, with events once and expiry."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.queries import QUERIES
from quarry.sources.tables import table
from quarry.streaming import keyed, state

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(autouse=True)
def rocks(spark):
    was = spark.conf.get(keyed.STORE, None)
    spark.conf.set(keyed.STORE, keyed.ROCKS)
    yield
    spark.conf.set(keyed.STORE, was) if was else spark.conf.unset(keyed.STORE)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp, folder, **how):
    events = state.read_events(spark, folder)
    how = {"key": "user_id", "order": "event_id", "keeps": ["value"], "overwrites": ["event_type"]} | how
    query = keyed.write_changes(keyed.keyed_upserts(events, **how), f"{tmp}/log", f"{tmp}/checkpoint")
    query.awaitTermination()
    return query


def rows_of(spark, tmp, key="user_id"):
    return sorted(map(tuple, keyed.current(spark, f"{tmp}/log", key).collect()), key=str)


def test_shuffled_batches_and_a_restart_give_the_state_of_the_batch_query(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp"), "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    rows = [tuple(r) for r in events.collect()]
    random.Random(3).shuffle(rows)
    folder = str(tmp_path / "events")
    for k in range(2):
        put(spark, folder, rows[k::4])
    run(spark, tmp_path, folder)
    for k in range(2, 4):
        put(spark, folder, rows[k::4])
    query = run(spark, tmp_path, folder)
    want = sorted(((r.user_id, r.status, r.value, r.applied) for r in QUERIES["event_state_upsert"](spark, sf_dir).collect()), key=str)
    assert rows_of(spark, tmp_path) == want
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len(want)


def test_a_batch_touches_only_its_own_keys(spark, tmp_path):
    folder = str(tmp_path / "events")
    put(spark, folder, [(k, None, k, "new", 1.0) for k in range(50)])
    run(spark, tmp_path, folder)
    put(spark, folder, [(100, None, 7, "late", None), (101, None, None, "nobody", 2.0)])
    query = run(spark, tmp_path, folder)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/log/batch=000000000001").select("user_id", "event_type", "value", "applied").collect()), key=str) == [(7, "late", 1.0, 2), (None, "nobody", 2.0, 1)]
    assert query.lastProgress["stateOperators"][0]["numRowsUpdated"] <= 2


def test_ties_and_late_events(spark, tmp_path):
    folder = str(tmp_path / "events")
    put(spark, folder, [(5, None, 1, "b", 2.0), (5, None, 1, "c", None), (None, None, 2, "x", 1.0)])
    put(spark, folder, [(5, None, 1, "a", 9.0), (4, None, 1, "z", 100.0), (None, None, 2, None, None)])
    run(spark, tmp_path, folder)
    assert rows_of(spark, tmp_path) == [(1, "c", 9.0, 4), (2, "x", 1.0, 2)]


def test_events_count_once_until_they_are_forgotten(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    folder = str(tmp_path / "events")
    how = {"event_key": "event_id", "time": "ts", "late": "1 minute", "forget": 600, "idle": 7200}
    put(spark, folder, [(1, start, 1, "a", 1.0), (1, start, 1, "a", 1.0), (2, start, 1, "b", 1.0)])
    run(spark, tmp_path, folder, **how)
    put(spark, folder, [(1, start + timedelta(seconds=30), 1, "again", 5.0)])
    run(spark, tmp_path, folder, **how)
    assert rows_of(spark, tmp_path) == [(1, "b", 1.0, 2)]
    put(spark, folder, [(3, start + timedelta(minutes=30), 2, "c", 1.0)])  # the watermark passes what was seen
    run(spark, tmp_path, folder, **how)
    put(spark, folder, [(1, start + timedelta(minutes=31), 1, "anew", 7.0)])
    run(spark, tmp_path, folder, **how)
    assert rows_of(spark, tmp_path) == [(1, "b", 1.0, 3), (2, "c", 1.0, 1)]  # of a lower order than event 2, but new
    put(spark, folder, [(4, start + timedelta(hours=9), 2, "d", 1.0)])  # both are idle by now
    run(spark, tmp_path, folder, **how)
    put(spark, folder, [(5, start + timedelta(hours=9, minutes=1), 1, "back", 3.0)])
    query = run(spark, tmp_path, folder, **how)
    assert (1, "back", 3.0, 1) in rows_of(spark, tmp_path) and query.exception() is None


def test_what_it_needs(spark, tmp_path):
    put(spark, str(tmp_path / "e"), [(1, None, 1, "a", 1.0)])
    events = state.read_events(spark, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        keyed.keyed_upserts(events, "user_id", "event_id", [], ["value"], forget=5)
    spark.conf.unset(keyed.STORE)
    with pytest.raises(ValueError):
        keyed.keyed_upserts(events, "user_id", "event_id", [], ["value"])
