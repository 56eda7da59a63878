"""Article files to passages, continuously."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passim.operators.passages import make_passages
from passim.sources.articles import ARTICLE_SCHEMA

# Fixed value: article files taken per trigger.
MAX_FILES = 3


def stream_passages(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema=ARTICLE_SCHEMA,
    max_files: int = MAX_FILES,
    **rules,
) -> StreamingQuery:
    """Each new article file becomes passages exactly once.

    Takes what is there and stops; the next run resumes from the checkpoint.
    """
    articles = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
        .withColumn("shard", F.col("_metadata.file_name"))
    )
    return (
        make_passages(articles, **rules)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
