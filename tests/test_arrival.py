"""Requests served as they arrive."""

import time
from datetime import datetime, timedelta

import pytest

from passim.streaming.arrival import arrival_token_bucket, keep_state_in_rocksdb

START = datetime(2024, 3, 30)
SCHEMA = "event_id long, ts timestamp, k string"


def send(spark, base, rows, idle):
    spark.createDataFrame([(i, START + timedelta(seconds=s), k) for i, s, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = arrival_token_bucket(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), "k", 1.0, 2.0, idle_seconds=idle)
    out = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    out.trigger(once=True).start().awaitTermination(60)
    return {r["event_id"]: r["admitted"] for r in spark.read.parquet(f"{base}/out").collect()}


@pytest.fixture
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def test_late_requests_are_answered(own, tmp_path):
    keep_state_in_rocksdb(own)
    first = send(own, tmp_path, [(1, 1000, "a"), (2, 1000, "a"), (3, 1000, "a"), (4, 50, "b"), (9, 1001, None)], 600)
    assert first == {1: True, 2: True, 3: False, 4: True, 9: True}
    # Long before what the state knows, and an hour after it.
    late = send(own, tmp_path, [(5, 0, "a"), (6, 1001, "a"), (7, 3, "b"), (8, 4600, "a"), (10, 0, "c")], 600)
    assert late == first | {5: False, 6: True, 7: True, 8: True, 10: True}


def test_idle_keys_start_full(own, tmp_path):
    keep_state_in_rocksdb(own)
    assert send(own, tmp_path, [(i, 10, "a") for i in range(3)], 2) == {0: True, 1: True, 2: False}
    time.sleep(3)
    assert send(own, tmp_path, [(5, 10, "a")], 2)[5]


def test_settings_are_checked(own, tmp_path):
    stream = own.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="keep_state_in_rocksdb"):
        arrival_token_bucket(stream, "k", 1.0, 2.0)
    with pytest.raises(ValueError, match="full refill"):
        arrival_token_bucket(stream, "k", 1.0, 2.0, idle_seconds=1)
