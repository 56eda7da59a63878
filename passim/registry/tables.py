"""How the given tables stand for articles, vectors, queries and requests.

Each table function has a SQL twin of the same meaning in ``SQL``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passim.functions.rows import explode_rows
from passim.functions.text import tokenize
from passim.functions.vector import mean_vector
from passim.operators.passages import make_passages
from passim.session import spread, stored

SEP = "\n"
DIM, TOKEN_DIM = 64, 16

SQL: dict[str, str] = {}


def with_tables(*names: str) -> str:
    """A WITH clause over the named tables and what they need, in order."""
    wanted: list[str] = []

    def need(name: str) -> None:
        body = SQL[name]
        for other in SQL:
            if other != name and f"«{other}»" in body:
                need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    parts = [f"{name} as ({SQL[name]})" for name in wanted]
    return ("with recursive " + ",\n".join(parts) + "\n").replace("«", "").replace("»", "")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SQL["articles"] = """
select doc_id::varchar as id, 'doc-' || doc_id as title, 'doc://' || source || '/' || doc_id as url,
       source as shard, doc_id as pos, text, lang from documents"""


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("doc-"), "doc_id").alias("title"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), "doc_id").alias("url"),
        F.col("source").alias("shard"),
        F.col("doc_id").alias("pos"),
        "text",
        "lang",
    )


SQL["pieces"] = """
select id, title, url, shard, pos, unnest(string_split(text, chr(10))) as piece,
       unnest(range(len(string_split(text, chr(10))))) as para_idx from «articles»"""
SQL["passages"] = r"""
select 'wiki-' || id || '-' || para_idx as id, title, url, text, id as article_id, para_idx, shard, pos,
       pos * 3 + nth - 1 as ord
from (select *, row_number() over (partition by id order by para_idx) as nth
      from (select *, trim(regexp_replace(piece, '\s+', ' ', 'g')) as text from «pieces»)
      where length(text) between 200 and 1200)
where nth <= 3"""


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return make_passages(articles(spark, folder).drop("lang"), sep=SEP)


SQL["vectors"] = "select vec_id as id, embedding::double[] as v, label from embeddings"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label"
    )


SQL["components"] = "select id, label, unnest(v) as x, unnest(range(64)) as i from «vectors»"
SQL["centroids"] = """
select label as cell, list(x order by i) as c
from (select label, i, round(avg(x), 9) as x from «components» group by label, i) group by label"""


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """One cell per label, at the mean of its vectors."""
    means = vectors(spark, folder).groupBy("label").agg(mean_vector(F.col("values"), DIM).alias("mean"))
    return means.select(F.col("label").alias("id"), F.transform("mean", lambda x: F.round(x, 9)).alias("values"))


SQL["routed"] = """
select a.id, a.v, a.label, arg_min(c.cell, (round(pow(list_distance(a.v, c.c), 2), 9), c.cell)) as cell
from «vectors» a, «centroids» c group by a.id, a.v, a.label"""
SQL["ranked_cells"] = """
select id as qid, v, cell, row_number() over (partition by id order by d, cell) as n
from (select a.id, a.v, c.cell, round(pow(list_distance(a.v, c.c), 2), 9) as d from «vectors» a, «centroids» c)"""

# Updates: generation 0 stores every vector twice in one batch, the wrong copy
# first; generation 1 turns four labels around, which moves ids to other cells.
SQL["stored_raw"] = """
select id, v, 0 as generation from «vectors»
union all select id, list_transform(v, lambda x: -x), 1 from «vectors» where label < 4"""
SQL["stored"] = """
select a.id, a.generation, a.v, arg_min(c.cell, (round(pow(list_distance(a.v, c.c), 2), 9), c.cell)) as cell
from «stored_raw» a, «centroids» c group by a.id, a.generation, a.v"""


def first_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder).select("id", "values")
    wrong = F.transform("values", lambda x: (x * 0).cast("float"))
    return rows.select("id", wrong.alias("values"), F.lit(1).alias("pos")).unionByName(
        rows.withColumn("pos", F.lit(2))
    )


def second_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder).filter("label < 4")
    turned = F.transform("values", lambda x: (-x).cast("float"))
    return rows.select("id", turned.alias("values"), F.lit(1).alias("pos"))


SQL["tokens"] = r"""
select id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from «articles»"""
SQL["postings"] = "select term, id, count(*) as tf from «tokens» group by term, id"
SQL["lengths"] = r"""
select id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as dl from «articles»"""
SQL["query_terms"] = r"""
select distinct item_id as qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark"""


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")


# Token vectors are the sixteen bytes of a token's MD5, scaled to -1..1.
SQL["token_table"] = """
select term as token, list_transform(range(1, 17), lambda i:
       ('0x' || substr(md5(term), 2 * i - 1, 2))::integer / 127.5::double - 1::double) as vec
from (select distinct term from «tokens»)"""


def token_vector(token):
    byte = lambda i: F.conv(F.substring(F.md5(token), 2 * i - 1, 2), 16, 10).cast("double")
    return F.array(*[byte(i) / 127.5 - 1.0 for i in range(1, TOKEN_DIM + 1)])


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    tokens = explode_rows(articles(spark, folder), [], F.array_distinct(tokenize(F.col("text"))), "token").distinct()
    return tokens.select("token", token_vector(F.col("token")).alias("vec"))


def stored_token_table(spark: SparkSession, folder: str) -> DataFrame:
    path = stored(spark, ("token_table", folder), lambda path: token_table(spark, folder).write.parquet(path))
    return spark.read.parquet(path)


def _static_sql(source: str) -> str:
    """Normalized mean of token vectors of ``source(id, term, tf)``."""
    return f"""
select id, list(m / n order by i) as v
from (select id, i, m, sqrt(sum(m * m) over (partition by id)) as n
      from (select id, i, sum(tf * x) / sum(tf) as m
            from (select p.id, p.tf, unnest(t.vec) as x, unnest(range(16)) as i
                  from {source} p join «token_table» t on p.term = t.token)
            group by id, i))
group by id"""


SQL["doc_vectors"] = _static_sql("«postings»")
SQL["query_counts"] = r"""
select id, term, count(*) as tf from (
  select item_id as id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark)
group by id, term"""
SQL["query_vectors"] = _static_sql("«query_counts»")

# Known items: the documents that hold a whole benchmark text.
SQL["judgments"] = """
select b.item_id as qid, list(a.title) filter (where a.title is not null) as expected
from benchmark b left join «articles» a on contains(a.text, b.text) group by b.item_id"""


def judgments(spark: SparkSession, folder: str) -> DataFrame:
    """Verbatim containment without comparing every pair of texts.

    An inner token of a query text is a whole token of any text that contains
    it, so the longest one is an equi-join key; candidates are then compared.
    """
    asked = text_queries(spark, folder)
    tokens = asked.select("qid", "text", tokenize(F.col("text")).alias("tokens"))
    inside = F.when(F.size("tokens") >= 3, F.slice("tokens", 2, F.size("tokens") - 2)).otherwise(
        F.raise_error(F.lit("a judged text needs three tokens")).cast("array<string>")
    )
    longest = F.array_max(F.transform(inside, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    keys = tokens.select("qid", F.col("text").alias("wanted"), longest["t"].alias("token"))
    docs = articles(spark, folder).select("id", "title", "text")
    pairs = (
        explode_rows(docs, ["id"], F.array_distinct(tokenize(F.col("text"))), "token")
        .join(keys.select("qid", "token"), "token")
        .select("qid", "id")
    )
    found = (
        pairs.join(docs, "id").join(keys.select("qid", "wanted"), "qid").filter(F.contains(F.col("text"), F.col("wanted")))
    )
    lists = found.groupBy("qid").agg(F.collect_list("title").alias("expected"))
    return asked.select("qid").join(lists, "qid", "left").withColumn(
        "expected", F.coalesce("expected", F.array().cast("array<string>"))
    )
