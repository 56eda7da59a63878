"""A collection as generations of Parquet segments.

Layout: ``<path>/generation=<g>/cell=<c>/``. A write publishes one generation
and is repeatable: running it again replaces that generation. An upsert may
move an id to another cell, so the newest copy of an id is decided over the
whole collection, never inside a cell.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passim.session import broadcast_within


def last_per_id(batch: DataFrame, pos: str) -> DataFrame:
    """Inside one batch the last row in input position wins."""
    kept = [c for c in batch.columns if c not in ("id", pos)]
    return batch.groupBy("id").agg(F.max_by(F.struct(*kept), pos).alias("_row")).select("id", "_row.*")


def write_generation(batch: DataFrame, path: str, generation: int) -> DataFrame:
    """Store a batch with a ``cell`` column; returns the stored ids.

    Rows are rebalanced by cell: small cells share a task and a hot cell is
    split over several.
    """
    target = f"{path}/generation={generation}"
    batch.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(target)
    return batch.sparkSession.read.parquet(target).select("id")


def upsert(batch: DataFrame, path: str, generation: int, pos: str = "pos") -> DataFrame:
    """Insert or replace by id."""
    return write_generation(last_per_id(batch, pos), path, generation)


def read_index(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """Every stored copy, up to a generation."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows if generation is None else rows.filter(F.col("generation") <= generation)


def live(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows not replaced by a later generation anywhere in the collection.

    ``rows`` may be any part of ``index`` (for instance probed cells). Only
    generations after the first can replace something, so only their ids are
    read; after a full compaction that is nothing.
    """
    first = index.select(F.min("generation")).scalar()
    later = index.filter(F.col("generation") > first).groupBy("id").agg(F.max("generation").alias("_newest"))
    later = later.withColumnRenamed("id", "_id")
    replaced = (F.col("id") == F.col("_id")) & (F.col("generation") < F.col("_newest"))
    return rows.join(later, replaced, "left_anti")


def as_of(index: DataFrame, generation: int) -> DataFrame:
    """The collection as it stood after ``generation``."""
    seen = index.filter(F.col("generation") <= generation)
    return live(seen, seen)


def compact(index: DataFrame, min_segments: int = 1) -> DataFrame:
    """One copy per id in every cell with at least ``min_segments`` segments.

    Rewritten rows carry the newest generation, so they still win over copies
    left in cells that were not rewritten.
    """
    segments = index.groupBy("cell").agg(F.count_distinct("generation").alias("_n"))
    crowded = segments.filter(F.col("_n") >= min_segments).select("cell")
    newest = index.select(F.max("generation")).scalar()
    rewritten = live(index.join(crowded, "cell", "left_semi"), index).withColumn("generation", newest)
    if min_segments <= 1:
        return rewritten
    return rewritten.unionByName(index.join(crowded, "cell", "left_anti"))


def write_collection(index: DataFrame, path: str) -> None:
    """Write a compacted collection to a new path."""
    index.hint("rebalance", "generation", "cell").write.mode("overwrite").partitionBy("generation", "cell").parquet(path)


def index_stats(index: DataFrame) -> DataFrame:
    """Per cell: segments, vectors, and the smallest and largest segment."""
    per_segment = index.groupBy("cell", "generation").agg(F.count("*").alias("n"))
    return per_segment.groupBy("cell").agg(
        F.count("*").alias("segments"),
        F.sum("n").alias("vectors"),
        F.min("n").alias("smallest_segment"),
        F.max("n").alias("largest_segment"),
    )


def compaction_cost(stats: DataFrame, policies: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Vectors and segments each compaction policy would rewrite."""
    rows = stats.withColumn("min_segments", F.explode(F.array(*[F.lit(p) for p in policies])))
    due = F.col("segments") >= F.col("min_segments")
    return rows.groupBy("min_segments").agg(
        F.count(F.when(due, 1)).alias("cells"),
        F.sum(F.when(due, F.col("segments")).otherwise(0)).alias("segments"),
        F.sum(F.when(due, F.col("vectors")).otherwise(0)).alias("vectors"),
    )


def query_cost(probes: DataFrame, stats: DataFrame, dim: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Segments read, vectors scanned and vector bytes per query."""
    return (
        probes.join(stats, "cell")
        .groupBy(*keys)
        .agg(F.sum("segments").alias("reads"), F.sum("vectors").alias("vectors"))
        .withColumn("bytes", F.col("vectors") * (4 * dim))
    )


# More distinct buckets than this are pruned by the join instead of a list.
_LITERAL_BUCKETS = 4096


def _bucket(id_column: str, buckets: int):
    return F.pmod(F.xxhash64(id_column), F.lit(buckets)).cast("int")


def write_passage_store(passages: DataFrame, path: str, buckets: int) -> None:
    """Store passages in folders by a hash of their id, for lookups by id."""
    rows = passages.withColumn("bucket", _bucket("id", buckets))
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def fetch_metadata(
    hits: DataFrame, passages: DataFrame, max_hits: int | None = None, buckets: int | None = None
) -> DataFrame:
    """Title, url and text of records that became hits.

    ``max_hits`` (queries times k) proves the hits small enough to broadcast,
    so the passage table is filtered where it lies. With ``buckets``, the
    number used by :func:`write_passage_store`, only the folders of the hits
    are opened.
    """
    small = broadcast_within(hits, max_hits, 256)
    if buckets:
        small = small.withColumn("bucket", _bucket("id", buckets))
        used = small.select("bucket").distinct().limit(_LITERAL_BUCKETS + 1).collect()
        if len(used) <= _LITERAL_BUCKETS:
            passages = passages.filter(F.col("bucket").isin([row["bucket"] for row in used]))
    found = passages.select("id", "title", "url", "text").join(small, "id")
    return found.select(*hits.columns, "title", "url", "text")
