"""Vector records, token tables and evaluation output."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: decimals kept in an exported vector.
VALUE_DECIMALS = 6

VECTOR_SCHEMA = "id string, values array<float>, metadata map<string,string>"


def vector_records(embedded: DataFrame) -> DataFrame:
    """``id, values`` rounded, and ``metadata`` with title, url and text."""
    keys = ("title", "url", "text")
    pairs = [part for key in keys for part in (F.lit(key), F.col(key))]
    return embedded.select(
        "id",
        F.transform("values", lambda x: F.round(x.cast("double"), VALUE_DECIMALS)).alias("values"),
        F.create_map(*pairs).alias("metadata"),
    )


def write_vectors(embedded: DataFrame, path: str) -> None:
    vector_records(embedded).write.mode("overwrite").json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR_SCHEMA).json(path)


def read_token_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """``token_id, token, vec``; ids must be exactly 0..n-1."""
    table = spark.read.parquet(path).select("token_id", "token", "vec")
    check = table.agg(
        F.count("*").alias("n"), F.max("token_id").alias("top"), F.count_distinct("token_id").alias("ids")
    ).first()
    if check["n"] and not (check["n"] == check["ids"] == check["top"] + 1):
        raise ValueError(f"token ids are not dense: {check['n']} rows, {check['ids']} ids, highest {check['top']}")
    if rows is not None and check["n"] != rows:
        raise ValueError(f"token table has {check['n']} rows, expected {rows}")
    return table


def write_eval(summary: DataFrame, path: str) -> None:
    """Evaluation rows as JSON; one row per query or setting."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_document(document: DataFrame, path: str) -> None:
    """A document of one row (``quality.eval_document``, ``quality.sweep_document``) as one JSON file."""
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_token_table(tokens: DataFrame, path: str) -> None:
    """Store ``token, vec`` with dense ``token_id`` in token order.

    The sorted rows are written once; ids are each file's row numbers plus the
    number of rows in the files before it.
    """
    spark = tokens.sparkSession
    tokens.orderBy("token").write.mode("overwrite").parquet(f"{path}-sorted")
    rows = spark.read.parquet(f"{path}-sorted").select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    files = rows.groupBy("file").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = rows.join(files, "file").select((F.col("base") + F.col("row")).alias("token_id"), "token", "vec")
    numbered.write.mode("overwrite").parquet(path)
