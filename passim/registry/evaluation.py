"""Result quality."""

from pyspark.sql import functions as F

from passim.operators import cells, quality, segments
from passim.operators.nearest import knn
from passim.plans import search as plans
from passim.registry import query
from passim.registry import tables as t
from passim.registry.index import _routed
from passim.registry.keyword import bm25_hits, static_vectors
from passim.registry.tables import with_tables
from passim.session import checkpointed, new_folder
from passim.sources.vectors import write_document, write_eval

t.SQL["ranks"] = """
select j.qid, min(case when list_contains(j.expected, a.title) then h.rank end) as rank,
       coalesce(arg_min(a.title, h.rank), '-') as top
from «judgments» j left join (select * from «bm25_ranked» where rank <= 10) h on h.qid = j.qid
left join «articles» a on a.id = h.id group by j.qid"""
t.SQL["ranks_static"] = """
select j.qid, min(case when list_contains(j.expected, a.title) then h.rank end) as rank,
       coalesce(arg_min(a.title, h.rank), '-') as top
from «judgments» j left join (select * from «static_ranked» where rank <= 10) h on h.qid = j.qid
left join «articles» a on a.id = h.id group by j.qid"""


def _judge(spark, folder, hits):
    titles = t.articles(spark, folder).select("id", "title")
    ranks = quality.first_relevant_rank(hits.join(titles, "id"), t.judgments(spark, folder))
    return ranks.withColumn("rank", F.col("rank").cast("long"))


def keyword_ranks(spark, folder):
    return _judge(spark, folder, bm25_hits(spark, folder))


@query("first_relevant_rank", with_tables("ranks") + "select qid, rank, top from ranks")
def first_relevant_rank(spark, folder):
    return keyword_ranks(spark, folder)


@query(
    "hit_at",
    with_tables("ranks")
    + """select c as cutoff, count(*) filter (where rank <= c) as hits, count(*) as n,
         round(count(*) filter (where rank <= c) / count(*), 6) as share
         from ranks, (values (1), (3), (10)) as v(c) group by c""",
)
def hit_at(spark, folder):
    return quality.hit_at(keyword_ranks(spark, folder)).withColumn("share", F.round("share", 6))


@query(
    "mrr",
    with_tables("ranks") + "select count(*) as n, round(avg(coalesce(1::double / rank, 0)), 6) as mrr from ranks",
)
def mrr(spark, folder):
    return quality.mrr(keyword_ranks(spark, folder)).withColumn("mrr", F.round("mrr", 6))


@query(
    "latency_summary",
    "select event_type, round(median(value), 6) as p50, max(value) as max from events group by event_type",
)
def latency_summary(spark, folder):
    summary = quality.latency_summary(t.table(spark, folder, "events"), "value", ["event_type"])
    return summary.withColumn("p50", F.round("p50", 6))


@query(
    "misses",
    with_tables("ranks") + "select qid, rank, substr(top, 1, 40) as top from ranks where rank is null or rank > 3",
)
def misses(spark, folder):
    return quality.misses(keyword_ranks(spark, folder))


def _both_runs(spark, folder):
    docs, asked, _ = static_vectors(spark, folder)
    return _judge(spark, folder, knn(asked, docs, 10)), keyword_ranks(spark, folder)


@query(
    "compare_runs",
    with_tables("ranks", "ranks_static")
    + """select qid, a.rank as rank_before, b.rank as rank_after,
         round(coalesce(1::double / b.rank, 0) - coalesce(1::double / a.rank, 0), 6) as gain
         from ranks_static a full join ranks b using (qid)""",
)
def compare_runs(spark, folder):
    before, after = _both_runs(spark, folder)
    return quality.compare_runs(before, after).withColumn("gain", F.round("gain", 6))


@query(
    "summarize_runs",
    with_tables("ranks", "ranks_static")
    + """select run, count(*) as n, count(*) filter (where rank <= 1) as hit_at_1, count(*) filter (where rank <= 3) as hit_at_3,
         count(*) filter (where rank <= 10) as hit_at_10, round(avg(coalesce(1::double / rank, 0)), 6) as mrr
         from (select 'static' as run, rank from ranks_static union all select 'keyword', rank from ranks) group by run""",
)
def summarize_runs(spark, folder):
    before, after = _both_runs(spark, folder)
    runs = before.withColumn("run", F.lit("static")).unionByName(after.withColumn("run", F.lit("keyword")))
    return quality.summarize(runs, ["run"]).withColumn("mrr", F.round("mrr", 6))


@query(
    "write_eval",
    with_tables("ranks") + "select qid, rank, top from ranks",
)
def write_results(spark, folder):
    """Evaluation rows written as JSON and read back."""
    path = new_folder(spark, "eval")
    write_eval(keyword_ranks(spark, folder), path)
    return spark.read.schema("qid long, rank long, top string").json(path)


@query(
    "eval_document",
    with_tables("ranks")
    + """select 'events' as base, 'keyword' as mode, count(*) as n, count(*) filter (where rank <= 1) as hit_1, count(*) filter (where rank <= 3) as hit_3,
         count(*) filter (where rank <= 10) as hit_10, round(avg(coalesce(1::double / rank, 0)), 4) as mrr,
         (select round(median(value), 1) from events) as latency_p50_ms,
         string_agg(qid || ':' || coalesce(rank::varchar, '-') || ':' || top, ',' order by qid) as rows from ranks""",
)
def eval_document(spark, folder):
    """The document of a run, with the event values as its latencies, written and read back."""
    path, latencies = new_folder(spark, "document"), t.table(spark, folder, "events").select("value")
    document = quality.eval_document(keyword_ranks(spark, folder), latencies, "events", "keyword", "value")
    write_document(document, path)
    back = spark.read.schema(document.schema).json(path)
    shown = F.transform("rows", lambda r: F.concat_ws(":", r["q"].cast("string"), F.coalesce(r["rank"].cast("string"), F.lit("-")), r["top"]))
    hits = [F.col(f"hit_at.`{n}`").alias(f"hit_{n}") for n in quality.CUTOFFS]
    return back.select("base", "mode", "n", *hits, "mrr", "latency_p50_ms", F.array_join(shown, ",").alias("rows"))


_NPROBES = [1, 2, 3, 5, 10]
# Query vectors are the stored ones read backwards, so that no query finds itself.
t.SQL["turned"] = "select id, list_reverse(v) as v, label from «vectors»"
t.SQL["turned_cells"] = """
select qid, v, label, cell, row_number() over (partition by qid order by d, cell) as n
from (select a.id as qid, a.v, a.label, c.cell, round(pow(list_distance(a.v, c.c), 2), 9) as d from «turned» a, «centroids» c)"""
t.SQL["swept"] = """
select nprobe, qid, label, hit_label, row_number() over (partition by nprobe, qid order by d, id) as rank
from (select s.nprobe, p.qid, p.label, r.id, r.label as hit_label, round(pow(list_distance(p.v, r.v), 2), 9) as d
      from (select unnest([1, 2, 3, 5, 10]) as nprobe) s join «turned_cells» p on p.n <= s.nprobe join «routed» r on r.cell = p.cell)
qualify rank <= 10"""
t.SQL["cell_sizes"] = "select cell, count(*) as vectors from «routed» group by cell"


@query(
    "sweep",
    with_tables("swept", "cell_sizes")
    + """, firsts as (select nprobe, qid, min(case when label = hit_label then rank end) as rank from swept group by nprobe, qid),
           quality as (select nprobe, count(*) as n, count(*) filter (where rank <= 1) as hit_at_1,
             count(*) filter (where rank <= 3) as hit_at_3, count(*) filter (where rank <= 10) as hit_at_10,
             round(avg(coalesce(1::double / rank, 0)), 6) as mrr from firsts group by nprobe),
           cost as (select nprobe, avg(reads) as avg_reads, round(avg(vectors), 6) as avg_vectors, median(vectors)::double as p50_vectors
             from (select s.nprobe, p.qid, count(*) as reads, sum(c.vectors) as vectors
                   from (select unnest([1, 2, 3, 5, 10]) as nprobe) s join turned_cells p on p.n <= s.nprobe
                   join cell_sizes c using (cell) group by s.nprobe, p.qid) group by nprobe)
         select * from quality join cost using (nprobe)""",
)
def sweep(spark, folder):
    index, model = _routed(spark, folder)
    index = checkpointed(index.withColumn("generation", F.lit(0)))
    title = F.concat(F.lit("label-"), "label")
    swept = plans.sweep(
        t.vectors(spark, folder).select("id", F.reverse("values").alias("values")),
        index.select(F.col("id").alias("qid"), F.array(title).alias("expected")),
        index,
        index.select("id", title.alias("title")),
        model,
        segments.index_stats(index),
        _NPROBES,
        10,
        t.DIM,
    )
    return swept.withColumn("mrr", F.round("mrr", 6)).withColumn("avg_vectors", F.round("avg_vectors", 6))


@query(
    "recall_at_k",
    with_tables("exact", "probed")
    + """select e.qid, round(count(p.id) / count(*), 6) as recall
         from exact e left join probed p on p.qid = e.qid and p.id = e.id group by e.qid""",
)
def recall_at_k(spark, folder):
    rows = t.vectors(spark, folder)
    index, model = _routed(spark, folder)
    approximate = cells.ivf_search(rows, index, model, 10, nprobe=3)
    return quality.recall_at_k(approximate, knn(rows, rows, 10)).withColumn("recall", F.round("recall", 6))
