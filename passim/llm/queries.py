"""The queries of this subpackage and the SQL that says the same where SQL can."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passim.llm import (
    byte_pairs,
    decontaminate,
    html_text,
    jaccard,
    language,
    packing,
    phrases,
    secrets,
    token_counts,
    topk,
    toxicity,
    urls,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(divisor: int):
    """The remainder that decides whether a document is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query("op1_secrets")
def find_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train_secrets(docs))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("0assign").alias("n_assign"),
        count("1access").alias("n_access"),
        count("2hex").alias("n_hex"),
        F.sha2(secrets.span_text(F.col("_base")), 256).alias("base_sha256"),
        secrets.span_text(F.col("_spans")).alias("spans"),
    )


@query("op2_pack")
def pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op3_token_counts")
def count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).drop("text")


@query("op4_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.extract_text(pages, html_text.train_blocks(pages)).select("page_id", "url", "text", "n_chars")


@query("op5_decontaminate")
def contaminated(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    weights = toxicity.train_toxicity(docs, table(spark, folder, "labels").where(~held_out))
    return toxicity.score_toxicity(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op10_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    model = language.train_languages(docs.where(~held_out))
    found = language.identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# Host and path rules of the query's contract.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query("op7_urls")
def judge_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Rules are mined from weak labels of all pages: given rules that block, and seed words in host names."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.filter_urls(pages, URL_RULES, urls.mine(urls.seed_labels(pages, URL_RULES)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op8_jaccard")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "op9_top_k",
    """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e::double[], c.e::double[]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, cast(row_number() over w as int) as rank, vec_id, score from s
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 10""",
)
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantized(table(spark, folder, "embeddings"))
    return topk.exact_top_k(vectors.where("id % 100 = 0"), vectors, 10)


@query("op11_whitening")
def whitened(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    found = whitening.whiten(vectors, whitening.fit_whitening(vectors))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query(
    "op12_phrases",
    """with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from p),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, i, ws, unnest([1, 2, 3, 4]) as k from s),
c as (select lang, ws[i:i + k - 1] as ph, count(*)::hugeint as f from g where i + k - 1 <= len(ws) group by 1, 2),
t as (select lang, sum(f) as n from c where len(ph) = 1 group by lang),
a as (select lang, ph, f as a from c where len(ph) > 1 and f >= 30),
u as (select lang, ph, a, unnest(range(1, len(ph))) as k from a),
v as (select u.*, x.f as l, y.f as r, (2000000 * u.a) // (x.f + y.f) as score from u
  join c x on x.lang = u.lang and x.ph = u.ph[1:u.k] join c y on y.lang = u.lang and y.ph = u.ph[u.k + 1:len(u.ph)]),
best as (select * from v qualify row_number() over (partition by lang, ph order by score, k) = 1),
i as (select lang, ph, a, unnest(range(2, len(ph))) as m from a where len(ph) > 2),
j as (select lang, ph, a, m, unnest(range(1, len(ph) - m + 2)) as b from i),
o as (select lang, ph[b:b + m - 1] as ph, max(a) as longer from j group by 1, 2),
k as (select b.lang, array_to_string(b.ph, ' ') as phrase, b.a, b.l, b.r, b.score from best b left join o on o.lang = b.lang and o.ph = b.ph
  where o.longer is null or 100 * o.longer < 80 * b.a)
select k.lang, row_number() over z as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n,
  cast(score as bigint) as score
from k join t on t.lang = k.lang
window z as (partition by k.lang order by score desc, a desc, phrase) qualify row_number() over z <= 2000""",
)
def mine_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, folder, "documents").select("lang", "text"))


@query("op13_byte_pairs")
def encode_and_decode(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    file = tokenizer("byte_bpe_multi_50k.tiktoken")
    encoded = byte_pairs.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), file, public_tokenizers.PATTERN)
    return byte_pairs.decode_ids(encoded, file).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
