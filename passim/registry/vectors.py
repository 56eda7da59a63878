"""Vector expressions, embedding and exact search."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from passim.functions import text as text_functions
from passim.functions import vector
from passim.functions.rows import explode_rows
from passim.operators import embedding
from passim.operators.nearest import knn as nearest_neighbours
from passim.registry import query
from passim.registry import tables as t
from passim.registry.tables import with_tables


# Values already rounded are moved off exact halves before they are rounded
# again, as engines settle such halves differently.
NUDGE = 1e-11


def components(df, *keys, nudge=0.0):
    """One row per vector component, rounded for comparison."""
    return df.select(*keys, F.posexplode("values").alias("i", "x")).select(
        *keys, F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double") + nudge, 6).alias("x")
    )


@query(
    "squared_l2",
    with_tables("vectors", "centroids")
    + "select id, round(pow(list_distance(v, c), 2), 6) as distance from vectors join centroids on label = cell",
)
def squared_l2(spark, folder):
    """Each vector to the mean of its label."""
    means = t.centroids(spark, folder).select(F.col("id").alias("label"), F.col("values").alias("mean"))
    rows = t.vectors(spark, folder).join(means, "label")
    return rows.select("id", F.round(vector.squared_l2(F.col("values"), F.col("mean")), 6).alias("distance"))


@query(
    "l2_normalize",
    with_tables("centroids")
    + """select cell, i, round(x / n, 6) as x from (select cell, unnest(c) as x, unnest(range(64)) as i,
         sqrt(list_sum(list_transform(c, lambda y: y * y))) as n from centroids)""",
)
def l2_normalize(spark, folder):
    rows = t.centroids(spark, folder).select(F.col("id").alias("cell"), vector.l2_normalize(F.col("values")).alias("values"))
    return components(rows, "cell")


@query("check_dim", "select vec_id as id, len(embedding)::integer as width from embeddings")
def check_dim(spark, folder):
    checked = vector.check_dim(F.col("values").cast("array<double>"), t.DIM)
    return t.vectors(spark, folder).select("id", F.size(checked).alias("width"))


@query(
    "is_zero",
    with_tables("vectors") + "select id, pos, pos = 1 as zero from vectors, (values (1), (2)) as p(pos)",
)
def is_zero(spark, folder):
    """Every vector once as it is and once multiplied by zero."""
    return t.first_batch(spark, folder).select("id", "pos", vector.is_zero(F.col("values")).alias("zero"))


@query(
    "cosine_from_l2",
    with_tables("vectors", "centroids")
    + "select id, round(list_cosine_similarity(v, c), 6) as cosine from vectors join centroids on label = cell",
)
def cosine_from_l2(spark, folder):
    """From squared distances of unit vectors here, from the angle in SQL."""
    unit = vector.l2_normalize(F.col("values"))
    means = t.centroids(spark, folder).select(F.col("id").alias("label"), unit.alias("mean"))
    distance = vector.squared_l2(unit, F.col("mean"))
    rows = t.vectors(spark, folder).join(means, "label")
    return rows.select("id", F.round(vector.cosine_from_l2(distance), 6).alias("cosine"))


@query(
    "static_embed",
    with_tables("doc_vectors") + "select id, i, round(x, 6) as x from (select id, unnest(v) as x, unnest(range(16)) as i from doc_vectors)",
)
def static_embed(spark, folder):
    docs = t.articles(spark, folder)
    return components(embedding.static_embed(docs, t.stored_token_table(spark, folder), t.TOKEN_DIM), "id")


# Token vectors that an encoder remembers.
_KNOWN_TOKENS = 65_536


def token_encoder():
    """An encoder with the token vectors of the static table."""
    import regex

    pattern = regex.compile(text_functions.TOKEN)
    known: dict[str, np.ndarray] = {}

    def vec(token: str) -> np.ndarray:
        if token not in known:
            if len(known) >= _KNOWN_TOKENS:
                known.clear()
            known[token] = np.frombuffer(hashlib.md5(token.encode()).digest(), dtype=np.uint8) / 127.5 - 1.0
        return known[token]

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), t.TOKEN_DIM))
        for i, text in enumerate(texts):
            tokens = pattern.findall(text.lower())
            if tokens:
                mean = np.mean([vec(token) for token in tokens], axis=0)
                out[i] = mean / np.linalg.norm(mean)
        return out

    return encode


@query(
    "embed",
    with_tables("doc_vectors")
    + """select id, i, round(x::float::double, 6) as x
         from (select id, unnest(v) as x, unnest(range(16)) as i from doc_vectors)""",
)
def embed(spark, folder):
    return components(embedding.embed(t.articles(spark, folder).select("id", "text"), token_encoder), "id")


@query("golden_check", "select distinct text, true as ok from benchmark")
def golden_check(spark, folder):
    """The encoder against stored encodings made by the token table."""
    asked = t.text_queries(spark, folder).select(F.col("qid").alias("id"), "text").dropDuplicates(["text"])
    stored = embedding.static_embed(asked, _all_tokens(spark, folder), t.TOKEN_DIM)
    goldens = asked.join(stored, "id").select("text", "values")
    encoded = embedding.embed(asked.select("text"), token_encoder)
    return embedding.golden_check(encoded, goldens).select("text", "ok")


def _all_tokens(spark, folder):
    words = explode_rows(t.text_queries(spark, folder), [], text_functions.tokenize(F.col("text")), "token")
    return words.distinct().select(
        "token", t.token_vector(F.col("token")).alias("vec")
    )


@query(
    "golden_tokens",
    with_tables("token_table", "query_terms")
    + "select token, round(vec[1], 6) as first from token_table where token in (select term from query_terms)",
)
def golden_tokens(spark, folder):
    rows = embedding.golden_tokens(t.text_queries(spark, folder), t.token_table(spark, folder))
    return rows.select("token", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


t.SQL["exact"] = """
select qid, id, d, row_number() over (partition by qid order by d, id) as rank
from (select a.id as qid, b.id, round(pow(list_distance(a.v, b.v), 2), 9) as d from «vectors» a, «vectors» b)
qualify rank <= 10"""
KNN_SQL = with_tables("exact") + "select qid, rank, id, round(d + 1e-11, 6) as distance from exact"


def shown(hits):
    """Search output with distances rounded for comparison."""
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round(F.col("distance") + NUDGE, 6).alias("distance"))


@query("knn", KNN_SQL)
def knn(spark, folder):
    rows = t.vectors(spark, folder)
    return shown(nearest_neighbours(rows, rows, 10))
