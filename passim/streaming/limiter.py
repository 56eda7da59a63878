"""The token bucket on a stream of requests."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passim.operators.requests import Bucket, admit, event_micros

# Fixed value: seconds after which an idle client's state is dropped.
IDLE_SECONDS = 600


def stream_token_bucket(
    events: DataFrame,
    key: str,
    rate: float,
    burst: float,
    ts: str = "ts",
    order: str = "event_id",
    idle_seconds: float = IDLE_SECONDS,
    late_seconds: float | None = None,
) -> DataFrame:
    """Streaming form of the batch token bucket: ``key, ts, order, admitted``.

    State is two numbers per key. It expires once the watermark has passed the
    key's last request by ``idle_seconds``; by then the bucket would be full
    again, so a returning key starts in the state it would have had. Requests
    carry their arrival time; one that comes up to ``late_seconds`` (default:
    the idle time) behind the newest is still served, as the watermark waits.
    """
    if idle_seconds * rate < burst:
        raise ValueError("idle_seconds must cover a full refill, burst / rate")
    fields = {f.name: f.dataType for f in events.schema.fields}
    output = T.StructType(
        [
            T.StructField(key, fields[key]),
            T.StructField(ts, fields[ts]),
            T.StructField(order, fields[order]),
            T.StructField("admitted", T.BooleanType()),
        ]
    )
    delay = idle_seconds if late_seconds is None else late_seconds

    def serve(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(*state.get) if state.exists else Bucket(burst)
        # The rows of one key in one micro-batch; intake per trigger bounds them.
        rows = pd.concat(list(batches)).sort_values(["_us", order], kind="stable")
        rows["admitted"] = admit(bucket, rows["_us"].to_numpy() / 1e6, rate, burst)
        state.update((bucket.tokens, bucket.last))
        full_ms = int((bucket.last + idle_seconds) * 1000) + 1
        state.setTimeoutTimestamp(max(full_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[[key, ts, order, "admitted"]]

    return (
        events.select(key, ts, order, event_micros(events, ts).alias("_us"))
        .withColumn("_at", F.timestamp_micros("_us"))
        .withWatermark("_at", f"{int(delay)} seconds")
        .groupBy(key)
        .applyInPandasWithState(
            serve, output, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
