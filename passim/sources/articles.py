"""Article tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("id", "url", "title", "text")])


def read_articles(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "url", "title", "text")) -> DataFrame:
    """Only the named columns of a Parquet dump, with ``shard`` (the source
    file) and ``pos`` (the row's place in it)."""
    return spark.read.parquet(path).select(
        *columns,
        F.col("_metadata.file_name").alias("shard"),
        F.col("_metadata.row_index").alias("pos"),
    )
