"""A token bucket in many tasks beside one event at a time, in fractions."""

import random
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from passim.operators.runs import Bucket, Limit, StateMap, admit, token_bucket_by_runs

START = datetime(2024, 3, 30)
SCHEMA = "event_id long, ts timestamp, k string, c int"


def reference(events, rate, burst):
    state, out = {}, {}
    for number, moment, key, *_ in sorted(events, key=lambda e: (e[1], e[0])):
        now = Fraction((moment - START) // timedelta(microseconds=1), 10**6)
        tokens, last = state.get(key, (Fraction(burst), now))
        tokens = min(Fraction(burst), tokens + (now - last) * rate)
        out[number] = tokens >= 1
        state[key] = (tokens - 1 if tokens >= 1 else tokens, now)
    return out


def allowed(df):
    return {r["event_id"]: r["admitted"] for r in df.collect()}


def busy(seed, n, hot):
    rng, rows, now = random.Random(seed), [], 0.0
    for i in range(n):
        now += rng.choice([0.0, 0.05, 0.1, 0.35, 1.0])
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", None, "z"])
        rows.append((i, START + timedelta(seconds=round(now, 6)), key, rng.randint(0, 9)))
    rng.shuffle(rows)
    return rows


# Burst of one, of a fraction, of many tokens; rates that decimals do not hold.
@pytest.mark.parametrize("rate, burst", [(Fraction(4, 5), 10), (Fraction(1, 3), 1), (Fraction(7, 3), Fraction(5, 2)), (3, 40), (Fraction(1, 2), Fraction(1, 2))])
def test_equals_one_by_one(spark, rate, burst):
    rows = busy(int(burst * 4), 4000, 0.9)
    found = allowed(token_bucket_by_runs(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", float(rate), float(burst)))
    wanted = reference(rows, rate, burst)
    assert found == wanted and (burst < 1 or 0 < sum(wanted.values()) < len(wanted))


def test_a_busy_key_is_served_in_many_tasks(spark):
    rows = busy(1, 4000, 1.0)
    served = token_bucket_by_runs(spark.createDataFrame(rows, SCHEMA), "k", 0.8, 10.0)
    sizes = [r["n"] for r in served.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    assert allowed(served) == reference(rows, Fraction(4, 5), 10)


def test_empty_and_single(spark):
    frame = spark.createDataFrame([(1, START, None, 1)], SCHEMA)
    assert allowed(token_bucket_by_runs(frame, "k", 1.0, 1.0)) == {1: True}
    assert token_bucket_by_runs(frame.limit(0), "k", 1.0, 1.0).count() == 0


@pytest.mark.parametrize("burst", [1, 2.5, 7, 60])
def test_map_holds_for_every_state(burst):
    limit, rng = Limit.of(0.75, burst), random.Random(3)
    for _ in range(8):
        run, gaps = StateMap(limit), [rng.choice([0, 1, 250_000, 333_333, 1_000_000, 1_400_000]) for _ in range(120)]
        for gap in gaps:
            run.step(gap)
            # However long the run, there are few pieces.
            assert len(run.pieces) <= 2 * burst + 6
        for state in [0, limit.full, *(rng.randint(0, limit.full) for _ in range(60))]:
            bucket = Bucket(state, 0)
            admit(bucket, np.cumsum(gaps), limit)
            assert run(state) == bucket.tokens
