"""Cells, codes and the stored collection."""

from pyspark.sql import functions as F

from passim.operators import cells, codes, segments
from passim.registry import query
from passim.registry import tables as t
from passim.registry.tables import with_tables
from passim.registry.vectors import KNN_SQL, NUDGE, components, shown
from passim.session import checkpointed, new_folder


@query(
    "train_sample",
    with_tables("vectors") + "select id from vectors order by md5(id::varchar), id limit 100",
)
def train_sample(spark, folder):
    return cells.train_sample(t.vectors(spark, folder).select("id"), 100)


@query(
    "sample_report",
    "select least(count(*), 400) as samples, 10::bigint as nlist, least(count(*), 400) / 10.0::double as samples_per_cell, "
    "least(count(*), 400) >= 390 as enough from embeddings",
)
def sample_report(spark, folder):
    return cells.sample_report(cells.train_sample(t.vectors(spark, folder), 400), 10)


t.SQL["lloyd"] = """
select cell, i, round(avg(x), 9) as x
from (select cell, unnest(v) as x, unnest(range(64)) as i from «routed») group by cell, i"""


@query("train_cells_step", with_tables("lloyd") + "select cell as id, i, round(x + 1e-11, 6) as x from lloyd")
def train_cells_step(spark, folder):
    """One step from the label means, by moving only partial sums."""
    return components(cells.lloyd_step(t.vectors(spark, folder), t.centroids(spark, folder)), "id", nudge=NUDGE)


def _trained(spark, folder):
    rows = t.vectors(spark, folder)
    return rows, cells.train_cells(rows, max(1, round(rows.count() ** 0.5)))


@query("train_cells", None)
def train_cells(spark, folder):
    """Cell sizes of a trained collection with about sqrt(N) cells."""
    rows, model = _trained(spark, folder)
    return cells.assign_cells(rows, model).groupBy("cell").agg(F.count("*").alias("vectors"))


def _routed(spark, folder):
    rows, model = t.vectors(spark, folder), t.centroids(spark, folder)
    return cells.assign_cells(rows, model), model


@query("assign_cells", with_tables("routed") + "select id, cell from routed")
def assign_cells(spark, folder):
    return _routed(spark, folder)[0].select("id", "cell")


t.SQL["probed"] = """
select qid, id, d, row_number() over (partition by qid order by d, id) as rank
from (select p.qid, r.id, round(pow(list_distance(p.v, r.v), 2), 9) as d
      from «ranked_cells» p join «routed» r on p.cell = r.cell where p.n <= 3)
qualify rank <= 10"""


@query("ivf_search", with_tables("probed") + "select qid, rank, id, round(d + 1e-11, 6) as distance from probed")
def ivf_search(spark, folder):
    index, model = _routed(spark, folder)
    return shown(cells.ivf_search(index, index, model, 10, nprobe=3))


@query("ivf_search_all_cells", KNN_SQL)
def ivf_search_all_cells(spark, folder):
    """Probing every trained cell equals exact search."""
    rows, model = _trained(spark, folder)
    index = cells.assign_cells(rows, model)
    return shown(cells.ivf_search(index, index, model, 10, nprobe=model.count()))


# Codebooks: 16 subspaces of 4 dimensions, codewords of the 16 lowest ids.
_M, _KS = 16, 16
t.SQL["words"] = """
select s as sub, code, v[4 * s + 1 : 4 * s + 4] as word
from (select v, row_number() over (order by id) - 1 as code from «vectors»), (select unnest(range(16)) as s)
where code < 16"""
t.SQL["coded"] = """
select a.id, a.sub, a.part, arg_min(w.code, (round(pow(list_distance(a.part, w.word), 2), 9), w.code)) as code
from (select id, s as sub, v[4 * s + 1 : 4 * s + 4] as part from «vectors», (select unnest(range(16)) as s)) a
join «words» w on a.sub = w.sub group by a.id, a.sub, a.part"""


def _codebooks(spark, folder):
    rows = t.vectors(spark, folder)
    return codes.first_codebooks(rows, _M, _KS, [F.col("id")])


@query(
    "train_pq_step",
    with_tables("coded")
    + """select sub::integer as sub, code::integer as code, i, round(round(avg(x), 9) + 1e-11, 6) as x
         from (select sub, code, unnest(part) as x, unnest(range(4)) as i from coded) group by sub, code, i
         union all
         select sub::integer, code::integer, i, round(x + 1e-11, 6)
         from (select sub, code, unnest(word) as x, unnest(range(4)) as i from words
               where (sub, code) not in (select (sub, code) from coded))""",
)
def train_pq_step(spark, folder):
    step = codes.pq_step(t.vectors(spark, folder), _codebooks(spark, folder))
    return components(step.withColumnRenamed("centroid", "values"), "sub", "code", nudge=NUDGE)


def _coded(spark, folder):
    books = _codebooks(spark, folder)
    return codes.encode_pq(t.vectors(spark, folder), books), books


@query("encode_pq", with_tables("coded") + "select id, sub, code from coded")
def encode_pq(spark, folder):
    rows = _coded(spark, folder)[0].select("id", F.posexplode("codes").alias("sub", "code"))
    return rows.select("id", F.col("sub").cast("long").alias("sub"), F.col("code").cast("long").alias("code"))


t.SQL["by_code"] = """
select qid, id, d, row_number() over (partition by qid order by d, id) as rank
from (select q.id as qid, c.id, round(sum(round(pow(list_distance(q.part, w.word), 2), 9)), 9) as d
      from «coded» q join «coded» c on q.sub = c.sub join «words» w on w.sub = c.sub and w.code = c.code
      group by q.id, c.id)
qualify rank <= 10"""


@query("pq_search_codes_only", with_tables("by_code") + "select qid, rank, id, round(d + 1e-11, 6) as distance from by_code")
def pq_search_codes_only(spark, folder):
    index, books = _coded(spark, folder)
    return shown(codes.pq_search(index, index, books, 10, rescore=-1))


@query("pq_search_full_pool", KNN_SQL)
def pq_search_full_pool(spark, folder):
    """A pool as large as the collection gives exact results."""
    index, books = _coded(spark, folder)
    return shown(codes.pq_search(index, index, books, 10, rescore=index.count()))


@query("pq_search", None)
def pq_search(spark, folder):
    """Trained codebooks and the default pool."""
    rows = t.vectors(spark, folder)
    books = codes.train_pq(rows, _M, _KS, iterations=3)
    return shown(codes.pq_search(rows, codes.encode_pq(rows, books), books, 10))


def collection(spark, folder):
    """Two generations in a fresh folder; see ``stored`` in the table SQL."""
    path, model = new_folder(spark, "collection"), checkpointed(t.centroids(spark, folder))
    segments.upsert(cells.assign_cells(t.first_batch(spark, folder), model), path, 0)
    segments.upsert(cells.assign_cells(t.second_batch(spark, folder), model), path, 1)
    return segments.read_index(spark, path)


def copies(index):
    first = F.round(F.get("values", F.lit(0)).cast("double"), 6)
    return index.select("id", F.col("cell").cast("int").alias("cell"), F.col("generation").cast("int").alias("generation"), first.alias("first"))


LIVE_SQL = """select id, cell, generation, round(v[1], 6) as first
              from stored qualify row_number() over (partition by id order by generation desc) = 1"""


@query("upsert", with_tables("stored") + LIVE_SQL)
def upsert(spark, folder):
    index = collection(spark, folder)
    return copies(segments.live(index, index))


@query("as_of", with_tables("stored") + "select id, cell, generation, round(v[1], 6) as first from stored where generation = 0")
def as_of(spark, folder):
    return copies(segments.as_of(collection(spark, folder), 0))


@query(
    "compact",
    with_tables("stored")
    + """, crowded as (select cell from stored group by cell having count(distinct generation) >= 2),
           newest as (select id, max(generation) as generation from stored group by id)
         select id, cell, 1 as generation, round(v[1], 6) as first from stored
         where cell in (select cell from crowded) and (id, generation) in (select (id, generation) from newest)
         union all
         select id, cell, generation, round(v[1], 6) from stored where cell not in (select cell from crowded)""",
)
def compact(spark, folder):
    """Cells with two segments become one copy per id, written and read back."""
    path = new_folder(spark, "compacted")
    segments.write_collection(segments.compact(collection(spark, folder), 2), path)
    return copies(segments.read_index(spark, path))


@query(
    "compact_fully",
    with_tables("stored")
    + """select id, cell, 1 as generation, round(v[1], 6) as first
         from stored qualify row_number() over (partition by id order by generation desc) = 1""",
)
def compact_fully(spark, folder):
    return copies(segments.compact(collection(spark, folder), 1))


t.SQL["stats"] = """
select cell, count(*) as segments, sum(n)::bigint as vectors, min(n) as smallest_segment, max(n) as largest_segment
from (select cell, generation, count(*) as n from «stored» group by cell, generation) group by cell"""


@query("index_stats", with_tables("stats") + "select * from stats")
def index_stats(spark, folder):
    return segments.index_stats(collection(spark, folder)).withColumn("cell", F.col("cell").cast("int"))


@query(
    "compaction_cost",
    with_tables("stats")
    + """select p as min_segments, count(*) filter (where segments >= p) as cells,
         coalesce(sum(segments) filter (where segments >= p), 0)::bigint as segments,
         coalesce(sum(vectors) filter (where segments >= p), 0)::bigint as vectors
         from stats, (values (1), (2)) as policy(p) group by p""",
)
def compaction_cost(spark, folder):
    return segments.compaction_cost(segments.index_stats(collection(spark, folder)))


@query(
    "query_cost",
    with_tables("stats", "ranked_cells")
    + """select qid, sum(segments)::bigint as reads, sum(vectors)::bigint as vectors, (sum(vectors) * 256)::bigint as bytes
         from ranked_cells join stats using (cell) where n <= 3 group by qid""",
)
def query_cost(spark, folder):
    probes = cells.probe_cells(t.vectors(spark, folder), t.centroids(spark, folder), 3)
    return segments.query_cost(probes, segments.index_stats(collection(spark, folder)), t.DIM)


t.SQL["live_probed"] = """
select qid, id, d, row_number() over (partition by qid order by d, id) as rank
from (select p.qid, r.id, round(pow(list_distance(p.v, r.v), 2), 9) as d
      from «ranked_cells» p join
        (select * from «stored» qualify row_number() over (partition by id order by generation desc) = 1) r
      on p.cell = r.cell where p.n <= 3)
qualify rank <= 10"""


@query("ivf_search_live", with_tables("live_probed") + "select qid, rank, id, round(d + 1e-11, 6) as distance from live_probed")
def ivf_search_live(spark, folder):
    """Pruned search over a stored collection with replaced copies."""
    index = collection(spark, folder)
    return shown(
        cells.ivf_search(t.vectors(spark, folder), segments.live(index, index), t.centroids(spark, folder), 10, nprobe=3)
    )
