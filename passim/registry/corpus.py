"""Sources and sinks over the given tables."""

from pyspark.sql import functions as F

from passim.registry import query
from passim.registry import tables as t
from passim.registry.tables import with_tables
from passim.session import new_folder
from passim.sources import articles as article_source
from passim.sources import shards, vectors as vector_io


@query("read_articles", "select doc_id, source, text, 'documents.parquet' as shard from documents")
def read_articles(spark, folder):
    rows = article_source.read_articles(spark, f"{folder}/documents.parquet", ("doc_id", "source", "text"))
    return rows.drop("pos")


def _data_set(spark, folder):
    """The passages of all documents, written as a data set."""
    path = new_folder(spark, "dataset")
    shards.write_passages(t.passages(spark, folder), path)
    return path


@query(
    "scan_shards",
    with_tables("passages")
    + "select id, title, url, text, shard, dense_rank() over (order by shard) - 1 as shard_ord from passages",
)
def scan_shards(spark, folder):
    return shards.scan_shards(spark, _data_set(spark, folder)).withColumn("shard_ord", F.col("shard_ord").cast("long"))


def _write_lines(rows, path):
    """``shard, pos, value`` as text, in order inside each shard."""
    ordered = rows.repartitionByRange("shard", "pos").sortWithinPartitions("shard", "pos")
    ordered.select("value", "shard").write.partitionBy("shard").text(path)


@query(
    "read_passages",
    with_tables("articles")
    + """select id, title, case when lang = 'fr' then '' else url end as url, text, shard
         from articles where lang <> 'de'""",
)
def read_passages(spark, folder):
    """French records lack a key, German ones are blank lines."""
    path = new_folder(spark, "lines")
    line = (
        F.when(F.col("lang") == "de", "  ")
        .when(F.col("lang") == "fr", F.to_json(F.struct("id", "title", "text")))
        .otherwise(F.to_json(F.struct("id", "title", "url", "text")))
    )
    _write_lines(t.articles(spark, folder).withColumn("value", line), path)
    return shards.read_passages(spark, [path + "/shard=*"])


@query(
    "bad_records",
    with_tables("articles")
    + """select shard, line_no, line from (
           select shard, lang, row_number() over (partition by shard order by pos) as line_no,
                  replace(text, chr(10), ' ') as line from articles)
         where lang = 'es'""",
)
def bad_records(spark, folder):
    """Spanish records are raw text, German ones blank lines."""
    path = new_folder(spark, "lines")
    line = (
        F.when(F.col("lang") == "de", "")
        .when(F.col("lang") == "es", F.replace("text", F.lit("\n"), F.lit(" ")))
        .otherwise(F.to_json(F.struct("id", "title", "url", "text")))
    )
    _write_lines(t.articles(spark, folder).withColumn("value", line), path)
    return shards.bad_records(spark, [path + "/shard=*"])


@query("write_passages", with_tables("passages") + "select shard, id, title, url, text from passages")
def write_passages(spark, folder):
    path = _data_set(spark, folder)
    rows = spark.read.schema("id string, title string, url string, text string, shard string")
    return rows.json(path).select("shard", "id", "title", "url", "text")


_STATS = """
, stats as (select shard, count(*) as passages, count(distinct article_id) as articles from passages group by shard)
"""


@query(
    "pending_shards",
    with_tables("passages")
    + _STATS
    + """select id, shard from articles where shard not in
         (select shard from stats where passages >= (select avg(passages) from stats))""",
)
def pending_shards(spark, folder):
    """Shards with at least an average count are recorded; the rest wait."""
    stats = shards.shard_stats(t.passages(spark, folder))
    mean = stats.select(F.avg("passages")).scalar()
    return shards.pending_shards(t.articles(spark, folder), stats.filter(F.col("passages") >= mean)).select("id", "shard")


@query(
    "build_manifest",
    with_tables("passages")
    + _STATS
    + """select 'documents' as dataset, sum(articles)::bigint as articles, sum(passages)::bigint as passages,
         string_agg(shard, ',' order by shard) as shards,
         string_agg(shard || ':' || passages || '/' || articles, ',' order by shard) as shard_stats,
         'static' as model, 16::bigint as dim from stats""",
)
def build_manifest(spark, folder):
    """Written, published and read back."""
    path = new_folder(spark, "manifest")
    stats = shards.shard_stats(t.passages(spark, folder))
    shards.write_manifest(shards.build_manifest(stats, "documents", "static", t.TOKEN_DIM), path)
    counts = F.transform(
        F.array_sort(F.map_entries("shard_stats")),
        lambda e: F.concat(e["key"], F.lit(":"), e["value"]["passages"], F.lit("/"), e["value"]["articles"]),
    )
    return shards.read_manifest(spark, path).select(
        "dataset",
        "articles",
        "passages",
        F.array_join("shards", ",").alias("shards"),
        F.array_join(counts, ",").alias("shard_stats"),
        "model",
        "dim",
    )


@query(
    "merge_manifest",
    with_tables("passages")
    + _STATS
    + """select shard, passages, articles from stats""",
)
def merge_manifest(spark, folder):
    """A first run records half the shards, a second run the rest and one again."""
    stats = shards.shard_stats(t.passages(spark, folder))
    half = stats.select(F.median("passages")).scalar()
    old = stats.filter(F.col("passages") >= half)
    stale = old.withColumn("passages", F.when(F.col("passages") == half, 0).otherwise(F.col("passages")))
    return shards.merge_stats(stale, stats.filter(F.col("passages") <= half))


@query(
    "read_queries",
    """select text from (select trim(unnest(string_split(text, chr(10)))) as text from benchmark) where text <> ''""",
)
def read_queries(spark, folder):
    path = new_folder(spark, "examples")
    lines = t.table(spark, folder, "benchmark").select(F.concat(F.lit("  "), "text", F.lit(" \n")).alias("value"))
    lines.write.text(path)
    return shards.read_queries(spark, path)


@query(
    "vector_records",
    with_tables("components")
    + """select id::varchar as id, i, round(x, 6) as x, 'label-' || label as title from components""",
)
def vector_records(spark, folder):
    path = new_folder(spark, "records")
    rows = t.vectors(spark, folder).select(
        F.col("id").cast("string").alias("id"),
        "values",
        F.concat(F.lit("label-"), "label").alias("title"),
        F.concat(F.lit("vec://"), "id").alias("url"),
        F.lit("").alias("text"),
    )
    vector_io.write_vectors(rows, path)
    read = vector_io.read_vectors(spark, path)
    return read.select("id", F.col("metadata")["title"].alias("title"), F.posexplode("values").alias("i", "x")).select(
        "id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"), "title"
    )


@query(
    "read_token_table",
    with_tables("token_table")
    + """select row_number() over (order by token) - 1 as token_id, token, round(vec[1], 6) as first, len(vec) as width
         from token_table""",
)
def read_token_table(spark, folder):
    path = new_folder(spark, "tokens")
    vector_io.write_token_table(t.token_table(spark, folder), path)
    read = vector_io.read_token_table(spark, path)
    return read.select(
        "token_id", "token", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.size("vec").cast("long").alias("width")
    )
