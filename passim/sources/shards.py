"""Passage shards, their manifest and the query list.

A data set is a folder with one entry per shard and ``corpus.json``. A shard is
either a JSON-lines file ``passages-*.jsonl`` or, as Spark writes it, a folder
``shard=<name>`` of part files.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE_FIELDS = ("id", "title", "url", "text")
# Fixed value: the longest line accepted, in bytes.
MAX_LINE_BYTES = 1 << 20

STATS = "passages long, articles long"
MANIFEST_SCHEMA = (
    "dataset string, articles long, passages long, shards array<string>, "
    f"shard_stats map<string,struct<passages:long,articles:long>>, model string, dim long, version long"
)


def _shard_of(path: Column) -> Column:
    folder = F.regexp_extract(path, r"/shard=([^/]+)/[^/]+$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"/([^/]+)$", 1))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest manifest as one row, or None if there is none."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(f"{folder}/corpus.json")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = F.max_by(F.struct("*"), F.coalesce("version", F.lit(0)))
    row = rows.agg(newest.alias("m")).filter("m is not null").select("m.*")
    return row if row.limit(1).count() else None


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """Publish a manifest row. Versions are appended, so the commit of one file
    replaces the manifest and a lost job leaves the old one in place."""
    spark = manifest.sparkSession
    old = read_manifest(spark, folder)
    version = 1 if old is None else (old.first()["version"] or 0) + 1
    rows = manifest.withColumn("version", F.lit(version).cast("long"))
    rows.coalesce(1).write.mode("append").json(f"{folder}/corpus.json")


def shard_paths(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """``(shard, path)`` in load order: the manifest's order; else sorted names;
    else the single ``passages.jsonl``; else an error.

    Only file names are read, one entry per shard.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*")
    )
    try:
        paths = files.load(folder).select("path")
    except AnalysisException:
        raise FileNotFoundError(f"no passage shards in {folder}") from None
    names = paths.filter(F.col("path").rlike(r"/shard=[^/]+/|/passages(-[^/]*)?\.jsonl$")).select(
        _shard_of(F.col("path")).alias("shard"), F.col("path").rlike("/shard=").alias("is_folder")
    )
    found = {row["shard"]: row["is_folder"] for row in names.distinct().collect()}
    manifest = read_manifest(spark, folder)
    row = manifest.first() if manifest is not None else None
    counts = (row["shard_stats"] or {}) if row else {}
    # A shard that is recorded as empty has no file.
    listed = [name for name in (row["shards"] or []) if name in found or name not in counts or counts[name]["passages"]] if row else []
    if not listed:
        listed = sorted(name for name in found if name != "passages.jsonl") or list(found)
    if not listed:
        raise FileNotFoundError(f"no passage shards in {folder}")
    return [(name, f"{folder}/shard={name}" if found.get(name) else f"{folder}/{name}") for name in listed]


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    path = F.col("_metadata.file_path")
    return spark.read.text(paths).select(
        "value",
        path.alias("file"),
        _shard_of(path).alias("shard"),
        F.col("_metadata.file_block_start").alias("block"),
    )


_RECORD = T.StructType([T.StructField(f, T.StringType()) for f in (*PASSAGE_FIELDS, "_corrupt_record")])


def _no_text(json: Column) -> Column:
    """Whether a field of the record holds something other than text or null."""
    value = F.try_parse_json(json)
    kinds = [F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant")) for f in PASSAGE_FIELDS]
    wrong = [F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False)) for kind in kinds]
    return reduce(lambda a, b: a | b, wrong)


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with ``rec`` and ``bad``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = lines.filter(~F.col("value").rlike(r"^\s*$")).withColumn("rec", F.from_json("value", _RECORD, options))
    broken = F.col("rec").isNull() | F.col("rec._corrupt_record").isNotNull()
    no_object = ~F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$")
    return rows.withColumn("bad", broken | no_object | (F.octet_length("value") > MAX_LINE_BYTES) | _no_text(F.col("value")))


def read_passages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``id, title, url, text, shard``. Blank lines are skipped, missing keys are
    empty, and any bad line fails the job naming its file and text. A field that
    is neither text nor null makes a line bad. :func:`check_passages` names the
    line's number."""
    rows = _parsed(_lines(spark, paths))
    failure = F.raise_error(
        F.concat(F.lit("bad passage line in "), F.col("file"), F.lit(": "), F.substring("value", 1, 200))
    )
    # The check sits in a kept column, so pruning cannot remove it.
    first = F.when(F.col("bad"), failure.cast("string")).otherwise(F.coalesce("rec.id", F.lit("")))
    rest = [F.coalesce(f"rec.{f}", F.lit("")).alias(f) for f in PASSAGE_FIELDS[1:]]
    return rows.select(first.alias("id"), *rest, "shard")


def scan_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All passages of a data set with ``shard_ord``, the shard's load position."""
    listed = shard_paths(spark, folder)
    order = spark.createDataFrame([(name, i) for i, (name, _) in enumerate(listed)], "shard string, shard_ord int")
    # One row per source file.
    return read_passages(spark, [path for _, path in listed]).join(order, "shard")


def bad_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``shard, line_no, line`` of every bad line.

    Line numbers come from per-split counts and their running sum per shard;
    the lines themselves are neither sorted nor moved. Part files of one shard
    are numbered through in name order.
    """
    lines = _lines(spark, paths).withColumn("n", F.monotonically_increasing_id())
    splits = lines.groupBy("shard", "file", "block").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("shard").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    bad = _parsed(lines).filter("bad").select("shard", "file", "block", "n", "value")
    return bad.join(splits, ["shard", "file", "block"]).select(
        "shard", (F.col("offset") + F.col("n") - F.col("first") + 1).alias("line_no"), F.col("value").alias("line")
    )


def check_passages(spark: SparkSession, paths: list[str]) -> None:
    """Fail with the shard, number and text of the first bad line, if there is one.

    A pass of its own, for a load that is to fail before it starts.
    """
    first = bad_records(spark, paths).orderBy("shard", "line_no").limit(1).collect()
    if first:
        row = first[0]
        raise ValueError(f"{row['shard']}:{row['line_no']}: bad passage line: {row['line'][:200]}")


def write_passages(passages: DataFrame, folder: str) -> None:
    """One output folder per shard, published by the commit of the write.

    The write is map-only. Rewriting a shard replaces exactly that shard.
    """
    (
        passages.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .json(folder)
    )


def pending_shards(source: DataFrame, stats: DataFrame) -> DataFrame:
    """Source rows of shards the manifest does not record yet."""
    return source.join(stats.select("shard"), "shard", "left_anti")


def shard_stats(passages: DataFrame) -> DataFrame:
    """``shard, passages, articles``: passages and contributing articles."""
    return passages.groupBy("shard").agg(
        F.count("*").alias("passages"), F.count_distinct("article_id").alias("articles")
    )


def merge_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keep recorded counts of skipped shards; new counts win where both exist."""
    renamed = new.select("shard", F.col("passages").alias("_p"), F.col("articles").alias("_a"))
    return old.join(renamed, "shard", "full").select(
        "shard", F.coalesce("_p", "passages").alias("passages"), F.coalesce("_a", "articles").alias("articles")
    )


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """The manifest's per-shard counts as rows."""
    return manifest.select(F.explode("shard_stats").alias("shard", "s")).select("shard", "s.passages", "s.articles")


def build_manifest(stats: DataFrame, dataset: str, model: str, dim: int) -> DataFrame:
    """One row: totals, ordered shard list and per-shard counts.

    ``stats`` holds one row per source file.
    """
    entries = F.array_sort(F.collect_list(F.struct("shard", F.struct("passages", "articles").alias("s"))))
    totals = stats.agg(F.sum("articles").alias("articles"), F.sum("passages").alias("passages"), entries.alias("e"))
    return totals.select(
        F.lit(dataset).alias("dataset"),
        "articles",
        "passages",
        F.col("e.shard").alias("shards"),
        F.map_from_entries("e").alias("shard_stats"),
        F.lit(model).alias("model"),
        F.lit(dim).cast("long").alias("dim"),
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank lines; a missing file gives no rows."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "text string")
    return lines.select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text")).filter("text <> ''")
