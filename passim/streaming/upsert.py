"""A stream of vector records into a collection.

The collection folder holds ``v=<n>/`` tables, ``current``, an append-only list
of published versions, and ``batches``, which says what generation each batch of
each stream got. A new batch takes the next free one; a replay after a lost
driver finds its own and overwrites it, or is skipped if a compaction has merged
it. A generation is claimed by a file that must be new, so no two writers take
one; still, streams into one collection may follow each other, but not run at one
time, as their lists are appended by commits that would disturb each other.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passim.operators.segments import compact, read_index, upsert, write_collection
from passim.session import create_new

_POINTER = "version long, merged_through long"
_BATCHES = "stream string, batch long, generation long"


def current_version(spark: SparkSession, path: str) -> tuple[int, int]:
    """``(version, merged_through)`` of the newest published table."""
    rows = _listed(spark, f"{path}/current", _POINTER)
    newest = rows.orderBy("version", ascending=False).limit(1).collect()
    return (newest[0]["version"], newest[0]["merged_through"]) if newest else (0, -1)


def _listed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an append-only list; none if it was never written."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def claim_generation(spark: SparkSession, path: str, stream: str, batch: int) -> int:
    """The generation of a stream's batch: its own if it has one, else the next that no writer has claimed."""
    listed = _listed(spark, f"{path}/batches", _BATCHES)
    own = listed.where((F.col("stream") == stream) & (F.col("batch") == batch)).agg(F.max("generation")).first()[0]
    if own is not None:
        return own
    last = listed.agg(F.max("generation")).first()[0]
    generation = max(-1 if last is None else last, current_version(spark, path)[1]) + 1
    # A file that must be new: of writers that saw the same list, each gets its own generation.
    while not create_new(spark, f"{path}/claims/{generation}"):
        generation += 1
    spark.createDataFrame([(stream, batch, generation)], _BATCHES).coalesce(1).write.mode("append").json(f"{path}/batches")
    return generation


def table_path(path: str, version: int) -> str:
    return f"{path}/v={version}"


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Every stored copy in the published table."""
    return read_index(spark, table_path(path, current_version(spark, path)[0]))


def compact_collection(spark: SparkSession, path: str, min_segments: int, through: int) -> None:
    """Write a compacted table beside the current one, then publish it."""
    version, merged = current_version(spark, path)
    if merged >= through and min_segments > 1:
        return
    write_collection(compact(read_index(spark, table_path(path, version)), min_segments), table_path(path, version + 1))
    pointer = spark.createDataFrame([(version + 1, through)], _POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{path}/current")


def stream_upsert(
    records: DataFrame,
    path: str,
    checkpoint: str,
    route: Callable[[DataFrame], DataFrame],
    pos: str = "pos",
    compact_every: int = 0,
) -> StreamingQuery:
    """Upsert a streaming DataFrame, one generation per micro-batch.

    ``route`` adds the ``cell`` column. The checkpoint folder names the stream. With ``compact_every`` a checkpoint
    compaction follows every so many batches; :func:`finish` runs the last one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, merged = current_version(spark, path)
        generation = claim_generation(spark, path, checkpoint, batch_id)
        if generation <= merged:
            return
        upsert(route(batch), table_path(path, version), generation, pos)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_collection(spark, path, 2, generation)

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish(spark: SparkSession, path: str) -> None:
    """Final compaction: one physical copy per id."""
    rows = read_collection(spark, path)
    through = rows.agg({"generation": "max"}).first()[0]
    compact_collection(spark, path, 1, int(through))
