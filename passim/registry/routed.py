"""Compressed search inside probed cells, and the stored collection."""

from pyspark.sql import functions as F

from passim.operators import cells, codes, routed
from passim.plans import collection
from passim.registry import query
from passim.registry import tables as t
from passim.registry.tables import with_tables
from passim.registry.vectors import KNN_SQL, shown
from passim.session import new_folder

M, KS = 16, 16

t.SQL["residuals"] = """
select r.id, r.cell, r.v as exact, list_transform(range(1, 65), lambda i: r.v[i] - c.c[i]) as v
from «routed» r join «centroids» c using (cell)"""
t.SQL["residual_words"] = """
select s as sub, code, v[4 * s + 1 : 4 * s + 4] as word
from (select v, row_number() over (order by id) - 1 as code from «residuals»), (select unnest(range(16)) as s)
where code < 16"""
t.SQL["residual_codes"] = """
select a.id, a.cell, a.sub, arg_min(w.code, (round(pow(list_distance(a.part, w.word), 2), 9), w.code)) as code
from (select id, cell, s as sub, v[4 * s + 1 : 4 * s + 4] as part from «residuals», (select unnest(range(16)) as s)) a
join «residual_words» w on a.sub = w.sub group by a.id, a.cell, a.sub"""
# Each vector asks with settings of its own.
t.SQL["settings"] = """
select id as qid, (5 + id % 3)::integer as k, (1 + id % 4)::integer as nprobe, ([-1, 0, 20])[(id // 3) % 3 + 1] as rescore from «vectors»"""
t.SQL["code_tables"] = """
select p.qid, p.cell, s as sub, w.code,
       round(pow(list_distance(list_transform(range(4 * s + 1, 4 * s + 5), lambda i: p.v[i] - c.c[i]), w.word), 2), 9) as d
from «ranked_cells» p join «settings» x on x.qid = p.qid and p.n <= x.nprobe join «centroids» c on c.cell = p.cell,
     (select unnest(range(16)) as s) join «residual_words» w on w.sub = s"""
t.SQL["code_ranked"] = """
select qid, id, d, row_number() over (partition by qid order by d, id) as n
from (select e.qid, r.id, round(sum(e.d), 9) as d
      from «code_tables» e join «residual_codes» r on r.cell = e.cell and r.sub = e.sub and r.code = e.code group by e.qid, r.id)"""
t.SQL["routed_hits"] = """
select qid, id, d, row_number() over (partition by qid order by d, id) as rank, k
from (select h.qid, h.id, x.k,
             case when x.rescore < 0 then h.d else round(pow(list_distance(q.v, c.v), 2), 9) end as d
      from «code_ranked» h join «settings» x on x.qid = h.qid
        and h.n <= case when x.rescore < 0 then x.k when x.rescore = 0 then greatest(10 * x.k, 100) else greatest(x.k, x.rescore) end
      join «vectors» q on q.id = h.qid join «vectors» c on c.id = h.id)"""
HITS_SQL = with_tables("routed_hits") + "select qid, rank, id, round(d + 1e-11, 6) as distance from routed_hits where rank <= k"


def requests(spark, folder):
    rescore = F.get(F.array(F.lit(-1), F.lit(0), F.lit(20)), (F.floor(F.col("id") / 3) % 3).cast("int"))
    return t.vectors(spark, folder).select(
        "id", "values", (F.col("id") % 3 + 5).cast("int").alias("k"), (F.col("id") % 4 + 1).cast("int").alias("nprobe"), rescore.alias("rescore")
    )


def models(spark, folder):
    """Cells at the label means; codewords are the residuals of the lowest ids."""
    centroids = t.centroids(spark, folder)
    rows = cells.assign_cells(t.vectors(spark, folder), centroids)
    return rows, centroids, codes.first_codebooks(routed.residuals(rows, centroids), M, KS, [F.col("id")])


@query("encode_residuals", with_tables("residual_codes") + "select id, cell, sub, code from residual_codes")
def encode_residuals(spark, folder):
    rows, centroids, books = models(spark, folder)
    coded = routed.encode_residuals(rows, centroids, books).select("id", "cell", F.posexplode("codes").alias("sub", "code"))
    return coded.select("id", "cell", F.col("sub").cast("long").alias("sub"), F.col("code").cast("long").alias("code"))


@query("ivf_pq_search", HITS_SQL)
def ivf_pq_search(spark, folder):
    """Every vector as a request with its own k, probes and pool, over codes stored by cell."""
    rows, centroids, books = models(spark, folder)
    path = new_folder(spark, "coded")
    routed.encode_residuals(rows, centroids, books).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return shown(routed.search_routed(requests(spark, folder), spark.read.parquet(path), centroids, books))


@query("ivf_pq_exhaustive", KNN_SQL)
def ivf_pq_exhaustive(spark, folder):
    """With trained models, all cells probed and all candidates rescored: exact search."""
    vectors = t.vectors(spark, folder).select("id", "values")
    count = vectors.count()
    centroids = cells.train_cells(vectors, max(1, round(count**0.5)), iterations=2)
    rows = cells.assign_cells(vectors, centroids)
    books = routed.train_residual_pq(rows, centroids, M, KS, iterations=2)
    asked = vectors.withColumns({"k": F.lit(10), "nprobe": F.lit(count), "rescore": F.lit(count)})
    return shown(routed.search_routed(asked, routed.encode_residuals(rows, centroids, books), centroids, books))


# A stored collection: version 0 holds every vector, version 1 turns four labels
# around, and a new session opens it by its path.
t.SQL["live_rows"] = "select id, v, cell, generation from «stored» qualify row_number() over (partition by id order by generation desc) = 1"
t.SQL["live_residuals"] = """
select r.id, r.cell, r.v as exact, list_transform(range(1, 65), lambda i: r.v[i] - c.c[i]) as v
from «live_rows» r join «centroids» c using (cell)"""
for _name in ("residual_codes", "code_ranked", "routed_hits"):
    _live = t.SQL[_name].replace("«residuals»", "«live_residuals»").replace("«residual_codes»", "«live_codes»")
    _live = _live.replace("«code_ranked»", "«live_ranked»").replace("«vectors» c on", "«live_rows» c on")
    t.SQL[{"residual_codes": "live_codes", "code_ranked": "live_ranked", "routed_hits": "live_hits"}[_name]] = _live


def reopened(spark, folder):
    path = new_folder(spark, "stored")
    _, centroids, books = models(spark, folder)
    created = collection.create_collection(t.vectors(spark, folder), path, centroids, books)
    created.upsert(t.second_batch(spark, folder), "pos")
    return collection.open_collection(spark.newSession(), path)


def shown_rows(rows):
    first = F.round(F.get("values", F.lit(0)).cast("double"), 6)
    return rows.select("id", F.col("cell").cast("int").alias("cell"), F.col("write").cast("int").alias("version"), first.alias("first"))


@query("collection_rows", with_tables("live_rows") + "select id, cell, generation as version, round(v[1], 6) as first from live_rows")
def collection_rows(spark, folder):
    return shown_rows(reopened(spark, folder).rows())


@query("collection_as_of", with_tables("routed") + "select id, cell, 0 as version, round(v[1], 6) as first from routed")
def collection_as_of(spark, folder):
    newest = reopened(spark, folder)
    return shown_rows(collection.open_collection(newest.spark, newest.path, 0).rows())


@query("collection_search", with_tables("live_hits") + "select qid, rank, id, round(d + 1e-11, 6) as distance from live_hits where rank <= k")
def collection_search(spark, folder):
    """Requests to a collection with replaced rows, by the models that lie beside it."""
    return shown(reopened(spark, folder).search(requests(spark, folder)))


@query(
    "collection_compacted",
    with_tables("live_rows")
    + """, crowded as (select cell from stored group by cell having count(distinct generation) >= 2)
         select id, cell, case when cell in (select cell from crowded) then 2 else generation end as version, round(v[1], 6) as first
         from live_rows""",
)
def collection_compacted(spark, folder):
    """Cells of two segments are rewritten; the others keep theirs."""
    return shown_rows(reopened(spark, folder).compact(2).rows())


@query(
    "collection_deleted",
    with_tables("live_rows") + "select id, cell, generation as version, round(v[1], 6) as first from live_rows where id % 5 <> 0",
)
def collection_deleted(spark, folder):
    stored = reopened(spark, folder)
    return shown_rows(stored.delete(t.vectors(spark, folder).filter("id % 5 = 0")).rows())
