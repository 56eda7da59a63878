"""From an article dump to a passage data set, resumable shard by shard."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passim.operators.passages import cap_articles, make_passages
from passim.session import checkpointed
from passim.sources import shards
from passim.sources.articles import read_articles


# Shards that are written and then recorded together.
COMMIT_SHARDS = 64


def build_passages(
    spark: SparkSession,
    source: str | DataFrame,
    folder: str,
    dataset: str,
    model: str = "",
    dim: int = 0,
    limit: int = 0,
    commit_shards: int = COMMIT_SHARDS,
    **rules,
) -> DataFrame:
    """Cut the shards the manifest does not record, write them, publish the manifest.

    Shards go in groups, in order; each group is recorded as soon as it is
    written, so a build that was interrupted goes on after its last group. A
    shard without passages is recorded as empty. ``limit`` caps the passages of
    the data set, counting recorded shards first; shards that only the cap
    emptied stay pending.
    """
    articles = read_articles(spark, source) if isinstance(source, str) else source
    manifest = shards.read_manifest(spark, folder)
    stats = checkpointed(shards.manifest_stats(manifest)) if manifest is not None else None
    done = manifest.first()["passages"] or 0 if manifest is not None else 0
    if stats is not None:
        articles = shards.pending_shards(articles, stats)
    pending = [row["shard"] for row in articles.select("shard").distinct().orderBy("shard").collect()]
    for start in range(0, len(pending), commit_shards):
        if limit and done >= limit:
            break
        names = pending[start : start + commit_shards]
        group = articles.filter(F.col("shard").isin(names))
        shards.write_passages(cap_articles(make_passages(group, **rules), limit - done if limit else 0), folder)
        new = checkpointed(shards.shard_stats(_written(spark, folder, names)))
        added = new.agg(F.sum("passages")).first()[0] or 0
        if not limit or done + added < limit:
            listed = spark.createDataFrame([(name,) for name in names], "shard string")
            new = listed.join(new, "shard", "left").na.fill(0)
        stats = checkpointed(new if stats is None else shards.merge_stats(stats, new))
        done += added
        shards.write_manifest(shards.build_manifest(stats, dataset, model, dim), folder)
    if manifest is None and not pending:
        none = spark.createDataFrame([], "shard string, passages long, articles long")
        shards.write_manifest(shards.build_manifest(none, dataset, model, dim), folder)
    return shards.read_manifest(spark, folder)


def _written(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Shard and article of every written passage of these shards, read back so
    that the manifest describes what is stored."""
    try:
        rows = spark.read.schema("article_id string, shard string").option("basePath", folder).json(f"{folder}/shard=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Not one shard had a passage so far.
        return spark.createDataFrame([], "shard string, article_id string")
    return rows.filter(F.col("shard").isin(names)).select("shard", "article_id")
