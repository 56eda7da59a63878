"""Cutting, cleaning and showing text."""

from pyspark.sql import functions as F

from passim.functions import scoring, text
from passim.functions.rows import explode_rows
from passim.operators import embedding
from passim.operators import passages as p
from passim.registry import query
from passim.registry import tables as t
from passim.registry.tables import with_tables


@query("split_paragraphs", with_tables("pieces") + "select id, para_idx, piece as text from pieces")
def split_paragraphs(spark, folder):
    rows = p.split_paragraphs(t.articles(spark, folder), t.SEP).select("id", "para_idx", "text")
    return rows.withColumn("para_idx", F.col("para_idx").cast("long"))


@query("clean_text", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def clean_text(spark, folder):
    return t.table(spark, folder, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(
    "length_filter",
    with_tables("pieces")
    + r"""select id, para_idx, trim(regexp_replace(piece, '\s+', ' ', 'g')) as text from pieces
          where length(trim(regexp_replace(piece, '\s+', ' ', 'g'))) between 200 and 1200""",
)
def length_filter(spark, folder):
    rows = p.split_paragraphs(t.articles(spark, folder), t.SEP)
    rows = rows.select("id", F.col("para_idx").cast("long").alias("para_idx"), text.clean_text(F.col("text")).alias("text"))
    return rows.filter(p.length_filter(F.col("text")))


@query(
    "first_n_per_article",
    with_tables("pieces")
    + """select id, string_agg(piece, chr(10) order by para_idx) as lead from pieces where para_idx < 3 group by id""",
)
def first_n_per_article(spark, folder):
    pieces = F.split("text", t.SEP, -1)
    return t.articles(spark, folder).select("id", F.array_join(p.first_n_per_article(pieces), t.SEP).alias("lead"))


@query("passage_id", with_tables("pieces") + "select 'wiki-' || id || '-' || para_idx as id from pieces")
def passage_id(spark, folder):
    rows = p.split_paragraphs(t.articles(spark, folder), t.SEP)
    return rows.select(p.passage_id(F.col("id"), F.col("para_idx")).alias("id"))


@query(
    "make_passages",
    with_tables("passages") + "select id, title, url, text, article_id, para_idx, shard, pos, ord from passages",
)
def make_passages(spark, folder):
    return t.passages(spark, folder).withColumn("para_idx", F.col("para_idx").cast("long"))


@query(
    "cap_articles",
    with_tables("passages")
    + """, counts as (select shard, pos, count(*) as n from passages group by shard, pos),
         kept as (select shard, pos from (select *, coalesce(sum(n) over (order by shard, pos
           rows between unbounded preceding and 1 preceding), 0) as seen from counts)
           where seen < (select count(*) // 2 from passages))
         select id, shard, pos from passages join kept using (shard, pos)""",
)
def cap_articles(spark, folder):
    """Half the corpus, ending with a whole article."""
    rows = t.passages(spark, folder)
    return p.cap_articles(rows, rows.count() // 2).select("id", "shard", "pos")


@query(
    "head_per_shard",
    with_tables("passages")
    + """select id, shard from (select *, row_number() over (partition by shard order by ord) as n from passages)
         where n <= 25""",
)
def head_per_shard(spark, folder):
    return p.head_per_shard(t.passages(spark, folder), 25, ["ord"]).select("id", "shard")


_BUCKETS = """
, placed as (select id, shard, length(to_json({'id': id, 'title': title, 'url': url, 'text': text})) as length,
             row_number() over (partition by shard order by ord) - 1 as row_pos from passages),
  sorted as (select *, row_pos // 64 as window_no, row_number() over (
             partition by shard, row_pos // 64 order by length, row_pos) - 1 as sorted_pos from placed),
  buckets as (select *, sorted_pos // 16 as slice_no, sorted_pos % 16 // 4 as batch_no from sorted)
"""


def _buckets(spark, folder):
    length = p.record_length("id", "title", "url", "text")
    return p.length_buckets(t.passages(spark, folder), "ord", length, window=64, slice_rows=16, batch=4)


@query(
    "length_buckets",
    with_tables("passages")
    + _BUCKETS
    + "select id, shard, length, row_pos, window_no, slice_no, batch_no from buckets",
)
def length_buckets(spark, folder):
    return _buckets(spark, folder).select(
        "id", "shard", F.col("length").cast("long").alias("length"), "row_pos", "window_no", "slice_no", "batch_no"
    )


@query(
    "padding_report",
    with_tables("passages")
    + _BUCKETS
    + """, a as (select shard, sum(c) as sorted_length, sum(l) as real_length from (
           select shard, count(*) * max(length) as c, sum(length) as l from buckets
           group by shard, window_no, slice_no, batch_no) group by shard),
         b as (select shard, sum(c) as arrival_length from (
           select shard, count(*) * max(length) as c from buckets group by shard, row_pos // 4) group by shard)
         select shard, sorted_length::bigint as sorted_length, real_length::bigint as real_length,
                arrival_length::bigint as arrival_length,
                round(arrival_length::double / sorted_length::double, 6) as gain from a join b using (shard)""",
)
def padding_report(spark, folder):
    return p.padding_report(_buckets(spark, folder), batch=4).withColumn("gain", F.round("gain", 6))


@query(
    "query_prefix",
    "select item_id, 'Represent this sentence for searching relevant passages: ' || trim(text) as text from benchmark",
)
def query_prefix(spark, folder):
    return t.table(spark, folder, "benchmark").select("item_id", text.query_prefix(F.col("text")).alias("text"))


@query("tokenize", with_tables("tokens") + "select id, term, count(*) as n from tokens group by id, term")
def tokenize(spark, folder):
    terms = explode_rows(t.articles(spark, folder), ["id"], text.tokenize(F.col("text")), "term")
    return terms.groupBy("id", "term").agg(F.count("*").alias("n"))


# Event types stand for search modes, event values for scores.
_SCORES = """
(select event_id, value, case event_type when 'view' then 'semantic' when 'click' then 'keyword' else 'hybrid' end
 as mode from events)"""


def _scores(spark, folder):
    kind = F.col("event_type")
    mode = F.when(kind == "view", "semantic").when(kind == "click", "keyword").otherwise("hybrid")
    return t.table(spark, folder, "events").select("event_id", "value", mode.alias("mode"))


@query(
    "display_score",
    f"""select event_id, case mode when 'semantic' then 'cosine' when 'keyword' then 'bm25' else 'rrf' end as kind,
        round(case mode when 'semantic' then 1 - value / 2 else value end, 6) as score from {_SCORES}""",
)
def display_score(spark, folder):
    mode, value = F.col("mode"), F.col("value")
    score = F.round(scoring.display_score(mode, value, value), 6)
    return _scores(spark, folder).select("event_id", scoring.score_kind(mode).alias("kind"), score.alias("score"))


@query(
    "format_score",
    f"""select event_id, case mode when 'semantic' then printf('%.3f cos', value)
        when 'keyword' then printf('%.1f bm25', value + 0.03125) else printf('%.4f rrf', value) end as shown
        from {_SCORES}""",
)
def format_score(spark, folder):
    """BM25 values move off exact halves, where engines print differently."""
    value = F.when(F.col("mode") == "keyword", F.col("value") + 0.03125).otherwise(F.col("value"))
    kind = scoring.score_kind(F.col("mode"))
    return _scores(spark, folder).select("event_id", scoring.format_score(kind, value).alias("shown"))


_STOP = ", ".join(f"'{w}'" for w in text.HIGHLIGHT_STOP_WORDS)


@query(
    "highlight",
    with_tables("articles")
    + rf""", split as (select id, text, string_split_regex(lower(string_split(text, chr(10))[1]), '[^\p{{L}}\p{{N}}]+') as words
             from articles),
           terms as (select id, text, list_filter(words, lambda w: length(w) >= 3 and w not in ({_STOP})) as words from split),
           firsts as (select id, text, list_filter(words, lambda w, i: list_position(words, w) = i) as words from terms),
           marked as (select id, case when len(words) = 0 then text else regexp_replace(text,
             '(^|[^\p{{L}}\p{{N}}])(' || array_to_string(words, '|') || ')', '\1' || chr(2) || '\2' || chr(3), 'gi') end as text
             from firsts)
         select id, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
                chr(160), '&nbsp;'), chr(2), '<mark>'), chr(3), '</mark>') as html from marked""",
)
def highlight(spark, folder):
    """Each document with the words of its first line marked."""
    first_line = F.substring_index("text", "\n", 1)
    return t.articles(spark, folder).select("id", text.highlight(F.col("text"), first_line).alias("html"))


@query(
    "client_key",
    """select event_id, case event_type
         when 'view' then '10.0.' || user_id || '.1'
         when 'click' then 'fe80::' || user_id
         when 'error' then '192.168.0.' || user_id
         else 'socket-' || user_id end as client from events""",
)
def client_key(spark, folder):
    """Views come through a proxy, clicks from IPv6 peers, errors from IPv4
    peers, anything else from a peer without a port."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    hops = F.when(kind == "view", F.concat(F.lit(" 10.0."), user, F.lit(".1 , 172.16.0.1")))
    peer = (
        F.when(kind == "click", F.concat(F.lit("[fe80::"), user, F.lit("]:443")))
        .when(kind == "error", F.concat(F.lit("192.168.0."), user, F.lit(":8080")))
        .otherwise(F.concat(F.lit("socket-"), user))
    )
    return t.table(spark, folder, "events").select("event_id", text.client_key(hops, peer).alias("client"))


@query(
    "embed_windows",
    with_tables("passages")
    + """, r as (select id, shard, length(text) as l, row_number() over (partition by shard order by ord) - 1 as pos from passages),
           s as (select *, pos // 64 as w, row_number() over (partition by shard, pos // 64 order by l, pos) - 1 as sp from r)
         select id, l::double as length, (max(l) over (partition by shard, w, sp // 16, sp % 16 // 4))::double as padded from s""",
)
def embed_windows(spark, folder):
    """An encoder that tells how long a text is, and to what length its batch is padded."""

    def factory():
        return lambda texts: [[len(text), max(map(len, texts))] for text in texts]

    rows = t.passages(spark, folder).select("id", "shard", "ord", "text")
    found = embedding.embed_windows(rows, factory, "ord", window=64, slice_rows=16, batch=4)
    return found.select("id", *[F.get("values", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("length", "padded"))])
