"""The same results from streams. Each query runs the stream to its end."""

from pyspark.sql import functions as F

from passim.operators import cells, segments
from passim.operators.requests import event_micros
from passim.registry import query
from passim.registry import tables as t
from passim.registry.index import LIVE_SQL, copies
from passim.registry.limits import BURST, LIMITED_SQL, RATE, events
from passim.registry.tables import with_tables
from passim.session import checkpointed, new_folder
from passim.streaming.arrival import arrival_token_bucket, keep_state_in_rocksdb
from passim.streaming.limiter import stream_token_bucket
from passim.streaming.passages import stream_passages as start_passages
from passim.streaming.upsert import finish, read_collection, stream_upsert as start_upsert


@query("stream_passages", with_tables("passages") + "select id, title, url, text, article_id from passages")
def stream_passages(spark, folder):
    """Article files arrive in two lots; the second run resumes the first."""
    base = new_folder(spark, "articles")
    rows = t.articles(spark, folder).select("id", "url", "title", "text", "lang")
    for lot in (F.col("lang").eqNullSafe("en"), ~F.col("lang").eqNullSafe("en")):
        rows.filter(lot).drop("lang").repartition(4, "id").write.mode("append").parquet(f"{base}/in")
        start_passages(spark, f"{base}/in", f"{base}/out", f"{base}/state", sep=t.SEP).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "title", "url", "text", "article_id")


def _upsert(spark, folder, compact_every):
    base, model = new_folder(spark, "records"), checkpointed(t.centroids(spark, folder))
    schema = "id long, values array<float>, pos int"
    for batch in (t.first_batch(spark, folder), t.second_batch(spark, folder)):
        batch.write.mode("append").parquet(f"{base}/in")
        start_upsert(
            spark.readStream.schema(schema).parquet(f"{base}/in"),
            f"{base}/index",
            f"{base}/state",
            lambda rows: cells.assign_cells(rows, model),
            compact_every=compact_every,
        ).awaitTermination()
    return f"{base}/index"


@query("stream_upsert", with_tables("stored") + LIVE_SQL)
def stream_upsert(spark, folder):
    index = read_collection(spark, _upsert(spark, folder, 0))
    return copies(segments.live(index, index))


@query("stream_compaction", with_tables("stored") + LIVE_SQL.replace("generation, round", "1 as generation, round"))
def stream_compaction(spark, folder):
    """A compaction after every batch and a final one: one copy per id."""
    path = _upsert(spark, folder, 1)
    finish(spark, path)
    return copies(read_collection(spark, path))


@query("stream_token_bucket", LIMITED_SQL)
def stream_limit(spark, folder):
    """Events arrive in time order in two lots; state carries over."""
    base = new_folder(spark, "requests")
    rows = events(spark, folder)
    moment = event_micros(rows, "ts")
    middle = rows.select(F.avg(moment)).scalar()
    for lot in (moment < middle, moment >= middle):
        rows.filter(lot).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        limited = stream_token_bucket(arriving, "user_id", RATE, BURST, idle_seconds=BURST / RATE, late_seconds=0)
        (
            limited.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.parquet(f"{base}/out").select("event_id", "user_id", "admitted")


# Every third event arrives in a second lot, long after later ones.
t.SQL["arrived"] = """
with recursive numbered as (
  select event_id, user_id as k, epoch_us(ts) as us,
         row_number() over (partition by user_id order by event_id % 3 = 0, ts, event_id) as n from events),
run as (
  select k, n, event_id, us as last, 108000000000 - 36000000000 as units, true as admitted from numbered where n = 1
  union all
  select x.k, x.n, x.event_id, x.last, if(x.u >= 36000000000, x.u - 36000000000, x.u), x.u >= 36000000000
  from (select e.k, e.n, e.event_id, greatest(r.last, e.us) as last, least(108000000000, r.units + greatest(0, e.us - r.last)) as u
        from run r join numbered e on e.k = r.k and e.n = r.n + 1) x)
select event_id, admitted from run"""


@query("stream_arrivals", with_tables("arrived") + "select event_id, user_id, admitted from arrived join events using (event_id)")
def stream_arrivals(spark, folder):
    """Late events are served when they arrive, from what is left."""
    base, own = new_folder(spark, "arrivals"), spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    keep_state_in_rocksdb(own)
    rows, late = events(spark, folder), F.col("event_id") % 3 == 0
    for lot in (~late, late):
        rows.filter(lot).write.mode("append").parquet(f"{base}/in")
        arriving = own.readStream.schema(rows.schema).parquet(f"{base}/in")
        answers = arrival_token_bucket(arriving, "user_id", RATE, BURST, idle_seconds=BURST / RATE)
        stream = answers.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        # One batch for a lot: with timers in real time a stream never finds that nothing is left to do.
        stream.trigger(once=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "user_id", "admitted")
