"""Cutting articles into passages and laying passages out for embedding.

Articles carry ``id, url, title, text`` plus ``shard`` (the source file) and
``pos`` (a unique integer position in the shard).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passim.functions.rows import explode_rows
from passim.functions.text import clean_text
from passim.operators.ranking import row_positions, running_total, top_k
from passim.session import broadcast_within, checkpointed

# The passage rules of the published corpus.
SEPARATOR = "\n\n"
MIN_CHARS, MAX_CHARS = 200, 1200
PER_ARTICLE = 3
ID_PREFIX = "wiki"

# Window, slice and batch sizes of the embedding layout.
WINDOW_ROWS, SLICE_ROWS, BATCH_ROWS = 65536, 512, 32


def _pieces(text: Column, sep: str) -> Column:
    return F.split(text, "\\Q" + sep + "\\E", -1)


def split_paragraphs(articles: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """One row per piece of text; the index counts every piece, kept or not."""
    kept = [c for c in articles.columns if c != "text"]
    return articles.select(*kept, F.posexplode(_pieces(F.col("text"), sep)).alias("para_idx", "text"))


def length_filter(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """True if the code-point length lies between both ends, inclusive."""
    return F.length(text).between(low, high)


def first_n_per_article(pieces: Column, n: int = PER_ARTICLE) -> Column:
    """The first ``n`` entries of an array, with no shuffle."""
    return F.slice(pieces, 1, n)


def passage_id(article_id: Column, para_idx: Column, prefix: str = ID_PREFIX) -> Column:
    return F.concat_ws("-", F.lit(prefix), article_id.cast("string"), para_idx.cast("string"))


def make_passages(
    articles: DataFrame,
    sep: str = SEPARATOR,
    low: int = MIN_CHARS,
    high: int = MAX_CHARS,
    per_article: int = PER_ARTICLE,
    prefix: str = ID_PREFIX,
) -> DataFrame:
    """Articles to passages in one map-only projection."""
    cleaned = F.transform(
        _pieces(F.col("text"), sep),
        lambda piece, i: F.struct(i.cast("int").alias("para_idx"), clean_text(piece).alias("text")),
    )
    kept = first_n_per_article(F.filter(cleaned, lambda piece: length_filter(piece["text"], low, high)), per_article)
    layout = [c for c in ("shard", "pos") if c in articles.columns]
    if "pos" in layout:
        # A dense order over the passages of a shard, for windows and caps.
        place = lambda i: (F.col("pos") * per_article + i).cast("long").alias("ord")
        kept = F.transform(kept, lambda piece, i: F.struct(piece["para_idx"].alias("para_idx"), piece["text"].alias("text"), place(i)))
        layout.append("ord")
    keep = [F.col("id").cast("string").alias("article_id"), *[c for c in layout if c != "ord"], "title", "url"]
    rows = explode_rows(articles, keep, kept, "p").select("*", "p.*")
    return rows.select(
        passage_id(F.col("article_id"), F.col("para_idx"), prefix).alias("id"),
        "title",
        "url",
        "text",
        "article_id",
        "para_idx",
        *layout,
    )


def cap_articles(passages: DataFrame, limit: int) -> DataFrame:
    """Whole articles, in shard order, up to the one whose passages reach ``limit``.

    Shard totals (one row per shard) are summed first. Every shard but the one
    the limit falls into is kept or dropped as a whole; that one is numbered
    inside, by :func:`running_total`, to find its last kept article. Passages
    are then filtered against one row per shard and never shuffled.
    """
    if not limit:
        return passages
    articles = passages.groupBy("shard", "pos").agg(F.count("*").alias("_n"))
    shards = articles.groupBy("shard").agg(F.sum("_n").alias("_total"))
    # One row per source file, so this window stays small at any corpus size.
    order = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    opened = shards.withColumn("_first", F.coalesce(F.sum("_total").over(order), F.lit(0)))
    opened = checkpointed(opened.filter(F.col("_first") < limit).withColumn("_cut", F.col("_first") + F.col("_total") > limit))
    cut = opened.filter("_cut").first()
    whole = opened.filter("NOT _cut").select("shard", F.lit(None).cast("long").alias("_last"))
    if cut is not None:
        inside = running_total(articles.filter(F.col("shard") == cut["shard"]), ["shard"], "pos", F.col("_n"), "_before")
        last = inside.filter(F.col("_before") < limit - cut["_first"]).groupBy("shard").agg(F.max("pos").alias("_last"))
        whole = whole.unionByName(last)
    kept = broadcast_within(whole, opened.count(), 256)
    inside = F.col("_last").isNull() | (F.col("pos") <= F.col("_last"))
    return passages.join(kept, "shard").filter(inside).select(*passages.columns)


def head_per_shard(rows: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` rows of each shard."""
    return top_k(rows, ["shard"], [F.col(c) for c in order], limit, "_line").drop("_line")


def record_length(*columns: str) -> Column:
    """Length of the JSON line a record is written as."""
    return F.length(F.to_json(F.struct(*columns)))


def length_buckets(
    passages: DataFrame,
    order: str,
    length: Column,
    window: int = WINDOW_ROWS,
    slice_rows: int = SLICE_ROWS,
    batch: int = BATCH_ROWS,
) -> DataFrame:
    """Number windows of input order, then slices and batches of equal length.

    Inside each window rows are sorted by length (input order on ties) so that
    a batch of neighbours barely pads. A window is bounded, so the sort is too.
    Only ``id, shard``, the order and the length are moved, never the text.
    """
    slim = passages.select("id", "shard", order, length.alias("length"))
    rows = row_positions(slim, ["shard"], order, "row_pos")
    rows = rows.withColumn("window_no", F.floor(F.col("row_pos") / window).cast("long"))
    by_length = Window.partitionBy("shard", "window_no").orderBy("length", "row_pos")
    rows = rows.withColumn("sorted_pos", F.row_number().over(by_length) - 1)
    in_slice = F.col("sorted_pos") % slice_rows
    return rows.withColumn(
        "slice_no", F.floor(F.col("sorted_pos") / slice_rows).cast("long")
    ).withColumn("batch_no", F.floor(in_slice / batch).cast("long"))


def padding_report(buckets: DataFrame, batch: int = BATCH_ROWS) -> DataFrame:
    """Padded length per shard when batches follow length order or input order."""

    def padded(keys: list[str], name: str) -> DataFrame:
        per_batch = buckets.groupBy("shard", *keys).agg(
            (F.count("*") * F.max("length")).alias("_padded"), F.sum("length").alias("_real")
        )
        return per_batch.groupBy("shard").agg(
            F.sum("_padded").alias(name), F.sum("_real").alias("real_length")
        )

    buckets = buckets.withColumn("arrival_no", F.floor(F.col("row_pos") / batch).cast("long"))
    sorted_cost = padded(["window_no", "slice_no", "batch_no"], "sorted_length")
    arrival_cost = padded(["arrival_no"], "arrival_length").drop("real_length")
    return sorted_cost.join(arrival_cost, "shard").withColumn(
        "gain", F.col("arrival_length") / F.col("sorted_length")
    )
