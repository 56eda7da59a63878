"""Keyword search, fusion and whole search requests."""

from pyspark.sql import functions as F

from passim.functions.text import query_prefix
from passim.operators import blocks, embedding, fusion, lexical, requests, segments
from passim.operators.nearest import knn, vector_places
from passim.plans.search import SearchIndex, search
from passim.registry import query
from passim.registry import tables as t
from passim.registry.tables import with_tables
from passim.registry.vectors import NUDGE
from passim.session import checkpointed, stored

t.SQL["bm25_scores"] = """
select q.qid, p.id, round(sum(ln(1::double + (n.n_docs - d.df + 0.5::double) / (d.df + 0.5::double)) * p.tf * 2.2::double
         / (p.tf + 1.2::double * (0.25::double + 0.75::double * l.dl / n.avgdl))), 6) as score
from «query_terms» q join «postings» p on q.term = p.term
join (select term, count(*) as df from «postings» group by term) d on d.term = q.term
join «lengths» l on l.id = p.id, (select count(*) as n_docs, avg(dl) as avgdl from «lengths») n
group by q.qid, p.id"""
t.SQL["bm25_ranked"] = """
select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from «bm25_scores»"""


@query("build_postings", with_tables("postings") + "select term, id, tf from postings")
def build_postings(spark, folder):
    return lexical.build_postings(t.articles(spark, folder)).drop("dl")


@query("document_lengths", with_tables("lengths") + "select id, dl from lengths")
def document_lengths(spark, folder):
    return lexical.document_lengths(t.articles(spark, folder))


@query(
    "collection_stats",
    with_tables("lengths") + "select count(*) as n_docs, round(avg(dl), 6) as avgdl from lengths",
)
def collection_stats(spark, folder):
    stats = lexical.collection_stats(lexical.document_lengths(t.articles(spark, folder)))
    return stats.withColumn("avgdl", F.round("avgdl", 6))


def text_index(spark, folder, stop_words=None, title_weight=0):
    """Postings and statistics of all documents, stored once and read back."""
    docs, key = t.articles(spark, folder), (folder, str(stop_words), title_weight)

    def write_stats(path):
        lengths = lexical.document_lengths(docs, stop_words, title_weight)
        lexical.collection_stats(lengths).write.parquet(path)

    stats = spark.read.parquet(stored(spark, ("stats", *key), write_stats))

    def write_postings(path):
        most = stats.select(F.col("n_docs") * F.col("avgdl")).first()[0]
        lexical.write_postings(lexical.build_postings(docs, stop_words, title_weight), path, most)

    return spark.read.parquet(stored(spark, ("postings", *key), write_postings)), stats


def block_index(spark, folder):
    """The index with block maxima, stored once."""
    docs = t.articles(spark, folder)
    return blocks.open_text_index(spark, stored(spark, ("text_blocks", folder), lambda path: blocks.write_text_index(docs, path)))


def bm25_hits(spark, folder, k=10):
    return blocks.search_text(t.text_queries(spark, folder), block_index(spark, folder), k)


def ranked(hits):
    return hits.withColumn("rank", F.col("rank").cast("long"))


BM25_SQL = with_tables("bm25_ranked") + "select qid, rank, id, score from bm25_ranked where rank <= 10"


@query("bm25", BM25_SQL)
def bm25(spark, folder):
    return ranked(bm25_hits(spark, folder))


@query("bm25_postings", BM25_SQL)
def bm25_postings(spark, folder):
    """The same over a flat table of postings."""
    return ranked(lexical.bm25(t.text_queries(spark, folder), *text_index(spark, folder), 10))


@query(
    "block_bounds",
    with_tables("postings", "lengths")
    + """select term, count(*)::bigint as passages, max(tf)::bigint as most_tf, min(dl)::bigint as least_dl, sum(tf)::bigint as occurrences
         from postings join lengths using (id) group by term""",
)
def block_bounds(spark, folder):
    """The maxima of all blocks together are those of the collection."""
    rows = block_index(spark, folder).terms()
    long = lambda value, name: value.cast("long").alias(name)
    held = F.aggregate("tfs", F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.groupBy("term").agg(
        long(F.sum("passages"), "passages"), long(F.max("most_tf"), "most_tf"), long(F.min("least_dl"), "least_dl"), long(F.sum(held), "occurrences")
    )


@query(
    "bm25_title_weighted",
    with_tables("bm25_ranked")
    + """, w_tokens as (select id, term from tokens union all
             select id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) from articles, range(2)),
           w_postings as (select term, id, count(*) as tf from w_tokens where term not in ('the', 'of') group by term, id),
           w_lengths as (select id, count(*) as dl from w_tokens where term not in ('the', 'of') group by id),
           all_lengths as (select a.id, coalesce(w.dl, 0) as dl from articles a left join w_lengths w using (id)),
           w_scores as (
             select q.qid, p.id, round(sum(ln(1::double + (n.n_docs - d.df + 0.5::double) / (d.df + 0.5::double)) * p.tf
               * 2.2::double / (p.tf + 1.2::double * (0.25::double + 0.75::double * l.dl / n.avgdl))), 6) as score
             from query_terms q join w_postings p on q.term = p.term
             join (select term, count(*) as df from w_postings group by term) d on d.term = q.term
             join all_lengths l on l.id = p.id, (select count(*) as n_docs, avg(dl) as avgdl from all_lengths) n
             group by q.qid, p.id)
         select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank
         from w_scores qualify rank <= 10""",
)
def bm25_title_weighted(spark, folder):
    """The optional analyzer settings: stop words, and titles counted twice."""
    stop = ["the", "of"]
    return ranked(
        lexical.bm25(t.text_queries(spark, folder), *text_index(spark, folder, stop, 2), 10, stop_words=stop)
    )


@query(
    "fetch_metadata",
    with_tables("bm25_ranked")
    + """select qid, rank, id, score, title, url, text from bm25_ranked join articles using (id) where rank <= 10""",
)
def fetch_metadata(spark, folder):
    """Looked up in a store that is folded by id."""
    asked, buckets = t.table(spark, folder, "benchmark").count(), 16

    def write(path):
        segments.write_passage_store(t.articles(spark, folder), path, buckets)

    passages = spark.read.parquet(stored(spark, ("passage_store", folder), write))
    return segments.fetch_metadata(ranked(bm25_hits(spark, folder)), passages, asked * 10, buckets)


t.SQL["static_ranked"] = """
select qid, id, d, row_number() over (partition by qid order by d, id) as rank
from (select q.id as qid, a.id, round(pow(list_distance(q.v, a.v), 2), 9) as d from «query_vectors» q, «doc_vectors» a)"""
t.SQL["fused"] = """
select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank
from (select qid, id, round(sum(1::double / (60 + rank)), 9) as score
      from (select qid, id, rank from «static_ranked» where rank <= 100
            union all select qid, id, rank from «bm25_ranked» where rank <= 100)
      group by qid, id)"""


def static_vectors(spark, folder):
    """Document and query vectors over one token table, which is stored once."""
    table = t.stored_token_table(spark, folder)

    def write_vectors(path):
        embedding.static_embed(t.articles(spark, folder), table, t.TOKEN_DIM).write.parquet(path)

    docs = spark.read.parquet(stored(spark, ("doc_vectors", folder), write_vectors))
    asked = t.text_queries(spark, folder).withColumnRenamed("qid", "id")
    return docs, embedding.static_embed(asked, table, t.TOKEN_DIM), table


@query("rrf", with_tables("fused") + "select qid, rank, id, score from fused where rank <= 10")
def rrf(spark, folder):
    docs, asked, _ = static_vectors(spark, folder)
    return ranked(fusion.rrf([knn(asked, docs, 100), bm25_hits(spark, folder, 100)], 10))


t.SQL["fused_whole"] = t.SQL["fused"].replace(" where rank <= 100", "")


def static_legs(spark, folder):
    docs, asked, _ = static_vectors(spark, folder)
    text, index = t.text_queries(spark, folder), block_index(spark, folder)
    some = lambda rows, key, qids: rows.join(qids.withColumnRenamed("qid", key), key, "left_semi")
    return [
        fusion.Leg(lambda qids, depth: knn(some(asked, "id", qids), docs, depth), lambda pairs: vector_places(pairs, asked, docs)),
        fusion.Leg(lambda qids, depth: blocks.search_text(some(text, "qid", qids), index, depth), lambda pairs: blocks.text_places(pairs, text, index)),
    ]


@query("rrf_whole", with_tables("fused_whole") + "select qid, rank, id, score from fused_whole where rank <= 10")
def rrf_whole(spark, folder):
    """Fusion of the whole legs, of which a few rows are read."""
    qids = t.text_queries(spark, folder).select("qid")
    return ranked(fusion.fuse(static_legs(spark, folder), qids, 10, depth=20))


@query(
    "leg_places",
    with_tables("static_ranked", "bm25_ranked")
    + """select 'text' as leg, v.qid, v.id, w.rank from static_ranked v join bm25_ranked w using (qid, id) where v.rank <= 10
         union all select 'vector', w.qid, w.id, v.rank from bm25_ranked w join static_ranked v using (qid, id) where w.rank <= 10""",
)
def leg_places(spark, folder):
    """The hits of each leg, found in the whole ranking of the other."""
    asked = t.text_queries(spark, folder).select("qid")
    vector, text = static_legs(spark, folder)
    near, word = (checkpointed(leg.top(asked, 10).select("qid", "id")) for leg in (vector, text))
    named = lambda rows, name: rows.select(F.lit(name).alias("leg"), "qid", "id", "rank")
    return named(text.places(near), "text").unionByName(named(vector.places(word), "vector"))


# Requests: every benchmark text in every mode; one in eight misses a rule.
t.SQL["requests"] = """
select item_id * 3 + m as qid, item_id, '  ' || text || ' ' as text,
       case when item_id % 8 = 3 then 'fuzzy' else ['semantic', 'keyword', 'hybrid'][m + 1] end as mode,
       case when item_id % 8 = 5 then '21' when item_id % 8 = 6 then '' else (item_id % 8 + 3)::varchar end as k,
       case when item_id % 8 = 7 then '5000' else '' end as nprobe
from benchmark, (select unnest(range(3)) as m)"""
t.SQL["checked"] = r"""
select *, case when text = '' then 'missing query text'
               when strlen(text) > 300 then 'query too long (max 300 bytes)'
               when mode not in ('semantic', 'keyword', 'hybrid') then 'mode must be one of: semantic, keyword, hybrid'
               when k is null or k not between 1 and 20 then 'k must be 1..20'
               when nprobe is null or nprobe not between 0 and 4096 then 'nprobe must be 0..4096' end as error
from (select qid, item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as text, if(mode = '', 'semantic', mode) as mode,
             if(k = '', 8, try_cast(k as bigint)) as k, if(nprobe = '', 0, try_cast(nprobe as bigint)) as nprobe
      from «requests»)"""


def sent(spark, folder):
    item = F.col("item_id") % 8
    rows = t.table(spark, folder, "benchmark").select(
        "*", F.posexplode(F.array(F.lit("semantic"), F.lit("keyword"), F.lit("hybrid"))).alias("m", "mode")
    )
    return rows.select(
        (F.col("item_id") * 3 + F.col("m")).alias("qid"),
        "item_id",
        F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"),
        F.when(item == 3, "fuzzy").otherwise(F.col("mode")).alias("mode"),
        F.when(item == 5, "21").when(item == 6, "").otherwise((item + 3).cast("string")).alias("k"),
        F.when(item == 7, "5000").otherwise("").alias("nprobe"),
    )


@query(
    "validate_queries",
    with_tables("checked") + "select qid, text, mode, k, nprobe, error from checked",
)
def validate_queries(spark, folder):
    modes = requests.parse_modes("semantic, keyword,hybrid, semantic")
    return requests.validate_queries(sent(spark, folder), modes).drop("item_id")


t.SQL["asked_terms"] = r"""
select id, term, count(*) as tf from (
  select item_id as id, unnest(regexp_extract_all(lower(
    'Represent this sentence for searching relevant passages: ' || text), '[\p{L}\p{N}]+')) as term from benchmark)
group by id, term"""
t.SQL["asked_vectors"] = t._static_sql("«asked_terms»")
t.SQL["near"] = """
select qid, id, d, row_number() over (partition by qid order by d, id) as rank
from (select q.id as qid, a.id, round(pow(list_distance(q.v, a.v), 2), 9) as d from «asked_vectors» q, «doc_vectors» a)"""
t.SQL["far"] = "select qid, id, score, rank from «bm25_ranked»"
t.SQL["mixed"] = """
select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank
from (select qid, id, round(sum(1::double / (60 + rank)), 9) as score
      from (select qid, id, rank from «near» union all select qid, id, rank from «far») group by qid, id)"""
t.SQL["answers"] = """
select c.qid, c.text as query, c.mode, h.rank, h.id, h.score, h.kind as score_kind, a.title, a.url, null::varchar as error
from «checked» c join (
  select 'semantic' as mode, qid, id, rank, 1 - d / 2 as score, 'cosine' as kind from «near»
  union all select 'keyword', qid, id, rank, score, 'bm25' from «far»
  union all select 'hybrid', qid, id, rank, score, 'rrf' from «mixed») h
on c.error is null and h.mode = c.mode and h.qid = c.item_id and h.rank <= c.k
join «articles» a on a.id = h.id
union all
select qid, text, mode, null, null, null, null, null, null, error from «checked» where error is not null"""


def answered(spark, folder):
    docs, _, table = static_vectors(spark, folder)
    checked = requests.validate_queries(sent(spark, folder), requests.parse_modes("semantic,keyword,hybrid"))
    prefixed = checked.select(F.col("qid").alias("id"), query_prefix(F.col("text")).alias("text"))
    vectors = embedding.static_embed(prefixed, table, t.TOKEN_DIM).withColumnRenamed("id", "qid")
    index = SearchIndex(vectors=docs, passages=t.articles(spark, folder), text=block_index(spark, folder), corpus="documents")
    return search(checked.join(vectors, "qid", "left"), index)


@query(
    "search",
    with_tables("answers") + "select qid, query, mode, rank, id, round(score + 1e-11, 6) as score, score_kind, title, url, error, 'documents' as corpus from answers",
)
def search_requests(spark, folder):
    return ranked(answered(spark, folder)).withColumn("score", F.round(F.col("score") + NUDGE, 6)).drop("text")


@query(
    "compare_modes",
    with_tables("answers")
    + """, r as (select qid // 3 as item, mode, rank, id from answers where error is null)
         select r.item as qid, r.mode, r.rank, r.id,
                case when r.mode = 'hybrid' then s.rank end as semantic_rank,
                case when r.mode = 'hybrid' then w.rank end as keyword_rank
         from r left join r s on s.mode = 'semantic' and s.item = r.item and s.id = r.id
         left join r w on w.mode = 'keyword' and w.item = r.item and w.id = r.id where r.rank <= 5""",
)
def compare_modes(spark, folder):
    results = answered(spark, folder).filter("error is null").withColumn("qid", F.floor(F.col("qid") / 3))
    compared = fusion.compare_modes(checkpointed(results.select("qid", "mode", "rank", "id")))
    ranks = {c: F.col(c).cast("long") for c in ("rank", "semantic_rank", "keyword_rank")}
    return compared.withColumns(ranks)
