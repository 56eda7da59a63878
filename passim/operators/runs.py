"""The token bucket for keys that never idle: runs of a key in many tasks at once."""

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from passim.operators.requests import event_micros
from passim.session import checkpointed


@dataclass(frozen=True)
class Limit:
    """A bucket in whole units, so that states are exact: what a microsecond adds, a token, a full bucket."""

    gain: int
    token: int
    full: int

    @classmethod
    def of(cls, rate: float, burst: float) -> "Limit":
        """Of ``rate`` tokens a second (read as the simplest fraction near it) and ``burst`` tokens."""
        each, most = Fraction(rate).limit_denominator(10**9) / 10**6, Fraction(burst).limit_denominator(10**9)
        token = lcm(each.denominator, most.denominator)
        return cls(int(each * token), token, int(most * token))


class Bucket:
    """State of one key: units left and the microsecond they were counted."""

    __slots__ = ("tokens", "last")

    def __init__(self, tokens: int, last: int | None = None):
        self.tokens, self.last = tokens, last


def admit(bucket: Bucket, micros: np.ndarray, limit: Limit) -> np.ndarray:
    """Serve events of one key in order; a row older than the state refills nothing."""
    tokens, last, gain, token, full = bucket.tokens, bucket.last, limit.gain, limit.token, limit.full
    allowed = np.zeros(len(micros), dtype=bool)
    for i, now in enumerate(micros.tolist()):
        if last is None:
            last = now
        elif now > last:
            tokens, last = min(full, tokens + (now - last) * gain), now
        if tokens >= token:
            tokens -= token
            allowed[i] = True
    bucket.tokens, bucket.last = tokens, last
    return allowed


class StateMap:
    """What a run of events makes of each state before it.

    Pieces ``(low, value, slope)`` cover the states from 0 to a full bucket; a
    slope is 1 or, where the bucket overflowed, 0. Pieces that continue each
    other are joined, which keeps them to about one for each token of the burst,
    however many events follow.
    """

    def __init__(self, limit: Limit):
        self.limit, self.pieces = limit, [(0, 0, 1)]

    def step(self, micros: int) -> None:
        """Refill for so long, then serve one request."""
        more, token, full = micros * self.limit.gain, self.limit.token, self.limit.full
        out: list[tuple[int, int, int]] = []

        def put(low: int, value: int, slope: int) -> None:
            if out:
                before, was, kind = out[-1]
                if kind == slope and was + kind * (low - before) == value:
                    return
            out.append((low, value, slope))

        for i, (low, value, slope) in enumerate(self.pieces):
            high = self.pieces[i + 1][0] - 1 if i + 1 < len(self.pieces) else full
            value += more
            if not slope or value >= full:
                value = min(value, full)
                put(low, value - token if value >= token else value, 0)
                continue
            # The parts of the piece below a token, up to a full bucket, and beyond.
            if value < token:
                put(low, value, 1)
            served = max(low, low + token - value)
            over = low + full - value
            if served <= min(high, over - 1):
                put(served, value + served - low - token, 1)
            if over <= high:
                put(over, full - token if full >= token else full, 0)
        self.pieces = out

    def __call__(self, state: int) -> int:
        low, value, slope = self.pieces[bisect_right([p[0] for p in self.pieces], state) - 1]
        return value + slope * (state - low)


def token_bucket_by_runs(
    events: DataFrame, key: str, rate: float, burst: float, ts: str = "ts", order: str = "event_id"
) -> DataFrame:
    """Add ``admitted``: per key a bucket that starts full and refills at ``rate``, in exact units.

    As ``token_bucket``, but for keys that never idle. Events are dealt by ranges of key and time, which cut a busy key into as many
    runs as its share of all events needs. Only the first run of a task can
    begin in another task; for it the task finds what the run makes of every
    state before it. These maps, at most two rows for each task, are applied one
    after the other; then all tasks serve their events, each from the right
    state. So no task ever holds or reads a whole busy key.
    """
    spark, limit = events.sparkSession, Limit.of(rate, burst)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.withColumn("_us", event_micros(events, ts))
    rows = rows.repartitionByRange(parts, key, "_us", order).sortWithinPartitions(key, "_us", order)
    rows = checkpointed(rows.withColumn("_part", F.spark_partition_id()))

    def runs(table: pa.Table) -> Iterator[tuple]:
        """Key, first and end row of each run of one key."""
        names = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.asarray(names.indices)
        edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield names.dictionary[int(code[low])].as_py(), low, high

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first run's map, or the state that the last one leaves if that is another."""
        first = last = None
        part = owner = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            stamps, part = table.column("_us").to_numpy(), table.column("_part")[0].as_py()
            for name, low, high in runs(table):
                if first is None:
                    first = [name, int(stamps[low]), int(stamps[low]), StateMap(limit)]
                    owner = first
                if owner is first and name == first[0]:
                    for now in stamps[low:high].tolist():
                        first[3].step(now - first[2])
                        first[2] = now
                    continue
                if last is None or last[0] != name:
                    owner = last = [name, Bucket(limit.full)]
                admit(last[1], stamps[low:high], limit)
        if first is None:
            return
        found = [(part, 0, first[0], first[1], first[2], first[3].pieces)]
        if last is not None:
            found.append((part, 1, last[0], None, last[1].last, [(0, last[1].tokens, 0)]))
        columns = list(zip(*found, strict=True))
        pieces = pa.array([[list(p) for p in x] for x in columns[5]], pa.list_(pa.list_(pa.int64())))
        names = ["part", "place", "key", "start", "end", "pieces"]
        kinds = [pa.int32(), pa.int32(), key_type, pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), pieces], names=names)

    key_field = events.schema[key].dataType
    key_type = to_arrow_type(key_field)
    kind = f"part int, place int, key {key_field.simpleString()}, start long, end long, pieces array<array<long>>"
    summary = rows.select(key, "_us", "_part").mapInArrow(summarize, kind).collect()
    starts: dict[int, tuple[int, int | None]] = {}
    owner, bucket = None, Bucket(limit.full)
    for row in sorted(summary, key=lambda r: (r["part"], r["place"])):
        made = StateMap(limit)
        made.pieces = [tuple(p) for p in row["pieces"]]
        if row["place"] == 0:
            if owner != (row["key"],):
                bucket = Bucket(limit.full)
            starts[row["part"]] = (bucket.tokens, bucket.last)
            state = bucket.tokens if bucket.last is None else min(limit.full, bucket.tokens + (row["start"] - bucket.last) * limit.gain)
            bucket = Bucket(made(state), row["end"])
        else:
            bucket = Bucket(made(0), row["end"])
        owner = (row["key"],)
    sent = spark.sparkContext.broadcast(starts)
    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.BooleanType())])

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            stamps, allowed = table.column("_us").to_numpy(), np.zeros(table.num_rows, dtype=bool)
            for name, low, high in runs(table):
                if bucket is None:
                    bucket = Bucket(*sent.value[table.column("_part")[0].as_py()])
                elif name != current:
                    bucket = Bucket(limit.full)
                current = name
                allowed[low:high] = admit(bucket, stamps[low:high], limit)
            yield from table.drop_columns(["_us", "_part"]).append_column("admitted", pa.array(allowed)).to_batches()

    return rows.mapInArrow(serve, schema)
