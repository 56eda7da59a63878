"""The token bucket in order of arrival: every request is answered, however late."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passim.operators.requests import event_micros
from passim.operators.runs import Bucket, Limit, admit
from passim.streaming.limiter import IDLE_SECONDS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """This state needs the RocksDB store; a session says so before its streams start."""
    spark.conf.set(_STORE, _ROCKS)


class _Serve(StatefulProcessor):
    """Two whole numbers for each key, which expire once it has been idle."""

    def __init__(self, limit: Limit, columns: list[str], order: str, idle_ms: int):
        self.limit, self.columns, self.order, self.idle_ms = limit, columns, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("last", T.LongType())])
        self.bucket = handle.getValueState("bucket", kind, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = Bucket(*self.bucket.get()) if self.bucket.exists() else Bucket(self.limit.full)
        # One key's share of a micro-batch, which the intake of a trigger bounds.
        frame = pd.concat(list(rows))
        frame = frame.sort_values(["arrival_us", self.order], kind="stable")
        frame["admitted"] = admit(state, frame["arrival_us"].to_numpy(), self.limit)
        self.bucket.update((state.tokens, state.last))
        yield frame[[*self.columns, "admitted"]]

    def close(self) -> None:
        pass


def arrival_token_bucket(
    events: DataFrame, key: str, rate: float, burst: float, ts: str = "ts", order: str = "event_id", idle_seconds: float = IDLE_SECONDS
) -> DataFrame:
    """``key, ts, order, admitted`` of each request of the stream.

    Micro-batches are served as they arrive, each in order of ``ts, order``.
    There is no watermark, so nothing is dropped: a request older than its key's
    state refills nothing and is answered from the tokens there are. A key's
    state expires when no request of it arrived for ``idle_seconds`` of real
    time, which must cover a full refill; a key that returns starts full, as its
    bucket would be. Replays faster than real time only keep states longer.
    """
    if idle_seconds * rate < burst:
        raise ValueError("idle_seconds must cover a full refill, burst / rate")
    if events.sparkSession.conf.get(_STORE, "") != _ROCKS:
        raise ValueError("call keep_state_in_rocksdb(spark) first")
    columns = list(dict.fromkeys([key, ts, order]))
    rows = events.select(*columns, event_micros(events, ts).alias("arrival_us"))
    output = T.StructType([*(events.schema[c] for c in columns), T.StructField("admitted", T.BooleanType())])
    serve = _Serve(Limit.of(rate, burst), columns, order, int(idle_seconds * 1000))
    return rows.groupBy(key).transformWithStateInPandas(serve, output, "append", "ProcessingTime")
