"""Checking search requests and limiting their rate."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passim.functions.scoring import MODES
from passim.functions.text import trim_whitespace
from passim.session import checkpointed

# Request limits.
MAX_QUERY_BYTES, MAX_K, MAX_NPROBE, DEFAULT_K = 300, 20, 4096, 8

# Requests per second and burst, overall and per client.
COARSE_RATE, COARSE_BURST = 100.0, 200.0
CLIENT_RATE, CLIENT_BURST = 5.0, 20.0


def parse_modes(spec: str) -> list[str]:
    """A comma list of modes: trimmed, without repeats, in the given order."""
    names = [name.strip() for name in spec.split(",") if name.strip()]
    for name in names:
        if name not in MODES:
            raise ValueError(f"unknown mode {name!r}, expected one of {', '.join(MODES)}")
    if not names:
        raise ValueError(f"name at least one mode of {', '.join(MODES)}")
    return list(dict.fromkeys(names))


def _integer(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def validate_queries(
    requests: DataFrame, modes: list[str], public: bool = False, default_k: int = DEFAULT_K, default_nprobe: int = 0
) -> DataFrame:
    """Add ``error`` (the first failing rule or NULL) and the settled settings.

    Input columns are strings: ``text, mode, k, nprobe``; NULL and empty mean
    the default. A public service ignores ``nprobe``.
    """
    text = trim_whitespace(F.coalesce("text", F.lit("")))
    given = lambda name: F.coalesce(F.col(name), F.lit(""))
    mode = F.when(given("mode") == "", modes[0]).otherwise(F.col("mode"))
    k = F.when(given("k") == "", F.lit(default_k).cast("long")).otherwise(_integer(F.col("k")))
    nprobe = F.lit(default_nprobe).cast("long")
    if not public:
        nprobe = F.when(given("nprobe") == "", nprobe).otherwise(_integer(F.col("nprobe")))
    rows = requests.withColumns({"text": text, "mode": mode, "k": k, "nprobe": nprobe})
    bad_range = lambda name, low, high: F.col(name).isNull() | ~F.col(name).between(low, high)
    error = F.coalesce(
        F.when(F.col("text") == "", "missing query text"),
        F.when(F.octet_length("text") > MAX_QUERY_BYTES, f"query too long (max {MAX_QUERY_BYTES} bytes)"),
        F.when(~F.col("mode").isin(modes), "mode must be one of: " + ", ".join(modes)),
        F.when(bad_range("k", 1, MAX_K), f"k must be 1..{MAX_K}"),
        F.when(bad_range("nprobe", 0, MAX_NPROBE), f"nprobe must be 0..{MAX_NPROBE}"),
    )
    return rows.withColumn("error", error)


def event_micros(events: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of either timestamp type, free of time zones."""
    if isinstance(events.schema[ts].dataType, T.TimestampNTZType):
        parts = [part(ts) for part in (F.year, F.month, F.dayofmonth, F.hour, F.minute)]
        second = F.extract(F.lit("SECOND"), ts)
        return F.unix_micros(F.make_timestamp_ltz(*parts, second, F.lit("UTC")))
    return F.unix_micros(ts)


class Bucket:
    """State of one key: tokens left and the time they were counted."""

    __slots__ = ("tokens", "last")

    def __init__(self, tokens: float, last: float | None = None):
        self.tokens, self.last = tokens, last


def admit(bucket: Bucket, seconds: np.ndarray, rate: float, burst: float) -> np.ndarray:
    """Serve events of one key in order; a row older than the state refills nothing."""
    tokens, last = bucket.tokens, bucket.last
    allowed = np.zeros(len(seconds), dtype=bool)
    for i, now in enumerate(seconds.tolist()):
        if last is None:
            last = now
        elif now > last:
            tokens, last = min(burst, tokens + (now - last) * rate), now
        if tokens >= 1.0:
            tokens -= 1.0
            allowed[i] = True
    bucket.tokens, bucket.last = tokens, last
    return allowed


def busy_periods(events: DataFrame, key: str, ts: str, refill_seconds: float) -> DataFrame:
    """Split each key where it certainly idled long enough to refill.

    Time is cut into steps of one full refill. An empty step between two used
    ones proves a longer gap than a refill, so the bucket is full again and
    what follows does not depend on what came before. Only the aggregated
    ``(key, step)`` table is sorted per key, never the events.
    """
    micros = max(1, int(np.ceil(refill_seconds * 1e6)))
    micro_column = event_micros(events, ts)
    rows = events.withColumn("_us", micro_column).withColumn("_step", F.floor(F.col("_us") / micros).cast("long"))
    steps = rows.select(key, "_step").groupBy(key, "_step").agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(key).orderBy("_step")
    fresh = (F.col("_step") - F.lag("_step").over(by_key)) > 1
    periods = steps.withColumn("_new", F.coalesce(fresh, F.lit(False)).cast("long")).withColumn(
        "_period", F.sum("_new").over(by_key)
    )
    return rows.join(periods.select(key, "_step", "_period"), [key, "_step"]).drop("_step")


def token_bucket(
    events: DataFrame, key: str, rate: float, burst: float, ts: str = "ts", order: str = "event_id"
) -> DataFrame:
    """Add ``admitted``: per key a bucket that starts full and refills at ``rate``.

    Events are hashed by key and busy period and sorted inside their partition;
    a task streams over them and keeps one bucket at a time, so no key is ever
    held in memory as a whole.
    """
    rows = busy_periods(events, key, ts, burst / rate)
    rows = rows.repartition(key, "_period").sortWithinPartitions(key, "_period", "_us", order)
    rows = rows.select(*events.columns, "_us", "_period")
    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.BooleanType())])

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, periods = table.column(key).to_pylist(), table.column("_period").to_pylist()
            stamps = table.column("_us").to_numpy() / 1e6
            allowed = np.zeros(len(keys), dtype=bool)
            start = 0
            while start < len(keys):
                owner, end = (keys[start], periods[start]), start + 1
                while end < len(keys) and keys[end] == owner[0] and periods[end] == owner[1]:
                    end += 1
                if owner != current:
                    current, bucket = owner, Bucket(burst)
                allowed[start:end] = admit(bucket, stamps[start:end], rate, burst)
                start = end
            yield from table.drop_columns(["_us", "_period"]).append_column("admitted", pa.array(allowed)).to_batches()

    return rows.mapInArrow(serve, schema)


def two_level_bucket(
    events: DataFrame,
    coarse: str,
    client: str,
    coarse_rate: float = COARSE_RATE,
    coarse_burst: float = COARSE_BURST,
    client_rate: float = CLIENT_RATE,
    client_burst: float = CLIENT_BURST,
    ts: str = "ts",
    order: str = "event_id",
) -> DataFrame:
    """Coarse bucket first, then one bucket per client.

    A coarse token is spent even if the client is refused; events the coarse
    bucket refuses never touch client state. The coarse key is a column (tenant,
    region), so coarse buckets run in parallel.
    """
    # Decided once; both what follows and the refused read the decisions.
    first = checkpointed(token_bucket(events, coarse, coarse_rate, coarse_burst, ts, order))
    through = first.filter("admitted").drop("admitted")
    second = token_bucket(through, client, client_rate, client_burst, ts, order)
    refused = first.filter(~F.col("admitted"))
    return second.unionByName(refused)
