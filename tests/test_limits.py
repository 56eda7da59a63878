import random
from datetime import datetime, timedelta

import pytest

from passim.operators.requests import token_bucket, two_level_bucket
from passim.streaming.limiter import stream_token_bucket

START = datetime(2024, 3, 30)  # the clocks change that night in many zones
SCHEMA = "event_id long, ts timestamp, k string, c string"


def reference(events, key, rate, burst):
    """One bucket per key, one event at a time."""
    state, out = {}, {}
    for event in sorted(events, key=lambda e: (e[1], e[0])):
        who, now = event[key], event[1].timestamp()
        tokens, last = state.get(who, (burst, now))
        tokens = min(burst, tokens + (now - last) * rate)
        out[event[0]] = tokens >= 1
        state[who] = (tokens - 1 if tokens >= 1 else tokens, now)
    return out


@pytest.fixture(scope="module")
def events():
    """One key sends a third of all requests; others idle and return."""
    random.seed(4)
    rows, now = [], 0.0
    for i in range(3000):
        now += random.choice([0.25, 0.5, 1.0]) if random.random() < 0.99 else 64.0
        key = "hot" if random.random() < 1 / 3 else f"k{random.randint(0, 40)}"
        rows.append((i, START + timedelta(seconds=now), key, random.choice("ab")))
    return rows


def allowed(df):
    return {r["event_id"]: r["admitted"] for r in df.collect()}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_batch_equals_one_by_one(spark, events, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(events, SCHEMA).repartition(6)
        got = allowed(token_bucket(df, "k", 0.25, 4.0))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    expected = reference(events, 2, 0.25, 4.0)
    assert got == expected and 0 < sum(expected.values()) < len(expected)


def test_first_event_refills_nothing_and_burst_caps(spark):
    rows = [(i, START + timedelta(seconds=s), "k", "a") for i, s in enumerate([0, 0, 0, 1, 1000, 1000, 1000])]
    got = allowed(token_bucket(spark.createDataFrame(rows, SCHEMA), "k", 1.0, 2.0))
    assert [got[i] for i in range(7)] == [True, True, False, True, True, True, False]


def test_two_levels(spark, events):
    df = spark.createDataFrame(events, SCHEMA)
    coarse = reference(events, 3, 0.8, 10.0)
    fine = reference([e for e in events if coarse[e[0]]], 2, 0.25, 4.0)
    got = allowed(two_level_bucket(df, "c", "k", 0.8, 10.0, 0.25, 4.0))
    assert got == {i: fine.get(i, False) for i in coarse}


@pytest.mark.parametrize("idle", [16.0, 100000.0])
def test_stream_equals_batch_with_and_without_expiry(spark, events, tmp_path, idle):
    for part in range(3):
        lot = events[part * 1000 : (part + 1) * 1000]
        spark.createDataFrame(lot, SCHEMA).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        limited = stream_token_bucket(rows, "k", 0.25, 4.0, idle_seconds=idle, late_seconds=0)
        query = limited.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert allowed(spark.read.parquet(str(tmp_path / "out"))) == reference(events, 2, 0.25, 4.0)


def test_expiry_must_cover_a_refill(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="full refill"):
        stream_token_bucket(rows, "k", 0.25, 4.0, idle_seconds=15)
