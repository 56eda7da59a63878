"""Turning text into vectors."""

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passim.functions.rows import explode_rows
from passim.functions.text import tokenize
from passim.functions.vector import l2_normalize
from passim.operators.nearest import arrow_matrix
from passim.operators.passages import BATCH_ROWS, SLICE_ROWS, WINDOW_ROWS, length_buckets
from passim.session import BROADCAST_BYTES, broadcast_within, checkpointed

# An encoder factory runs once per partition and returns the encoder, which
# maps a list of texts to a ``len(texts) x dim`` array.
Encoder = Callable[[list[str]], np.ndarray]

_GROUP = 512


def embed(df: DataFrame, factory: Callable[[], Encoder], batch: int = BATCH_ROWS, text: str = "text") -> DataFrame:
    """Add ``values`` by a model loaded once per task.

    Each group of 512 rows is sorted by length before it is cut into batches,
    so that batches barely pad. Output order is free.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("values", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for rows in batches:
            encoder = encoder or factory()
            for start in range(0, rows.num_rows, _GROUP):
                part = rows.slice(start, _GROUP)
                texts = part.column(text).to_pylist()
                order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
                out = [None] * len(texts)
                for low in range(0, len(order), batch):
                    picked = order[low : low + batch]
                    for i, vec in zip(picked, encoder([texts[i] or "" for i in picked])):
                        out[i] = np.asarray(vec, dtype=np.float32)
                column = pa.array(out, type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "values"])

    return df.mapInArrow(run, schema)


def embed_windows(
    df: DataFrame,
    factory: Callable[[], Encoder],
    ord: str,
    text: str = "text",
    window: int = WINDOW_ROWS,
    slice_rows: int = SLICE_ROWS,
    batch: int = BATCH_ROWS,
) -> DataFrame:
    """Add ``values``, encoding the batches of ``length_buckets``.

    ``df`` has ``id, shard``, the order ``ord`` (unique in a shard) and the text.
    Windows of a shard, sorted by length and cut into slices, become ranges of
    the shuffle: a slice lies whole in one task, in batches, so that a batch
    holds texts of nearly one length and pads as ``padding_report`` says.
    """
    buckets = length_buckets(df, ord, F.length(F.coalesce(F.col(text), F.lit(""))), window, slice_rows, batch)
    places = buckets.select("shard", ord, "window_no", "slice_no", "batch_no")
    keys = ["shard", "window_no", "slice_no"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    rows = df.join(places, ["shard", ord]).repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "batch_no")
    schema = T.StructType([*df.schema.fields, T.StructField("values", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = None, None
        for rows in chain(batches, [None]):
            if rows is not None:
                table = pa.Table.from_batches([rows])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            encoder = encoder or factory()
            table = held.combine_chunks()
            mark = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in (*keys, "batch_no")]
            mark = np.stack([np.asarray(m.indices) for m in mark])
            edges = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            # The last batch may go on in the next rows.
            stop = len(edges) - (1 if rows is None else 2)
            for low, high in zip(edges[:stop], edges[1 : stop + 1], strict=True):
                part = table.slice(low, high - low).select(columns)
                vectors = encoder([t or "" for t in part.column(text).to_pylist()])
                column = pa.array([np.asarray(v, dtype=np.float32) for v in vectors], type=pa.list_(pa.float32()))
                yield from part.append_column("values", column).combine_chunks().to_batches()
            held = table.slice(edges[stop])

    return rows.mapInArrow(run, schema)


def static_embed(df: DataFrame, token_table: DataFrame, dim: int, text: str = "text", budget: int = BROADCAST_BYTES) -> DataFrame:
    """``id, values``: the normalized mean of a text's token vectors.

    ``token_table`` has ``token, vec``. Unknown tokens drop out, and a text
    without known tokens has no row. The table is sent out and each text's
    tokens are looked up and added where the text lies: no row per token, and no
    shuffle. Beyond the budget, texts are dealt to parts, and each part meets the
    vectors of its own distinct tokens: every text is read and tokenized a fixed
    number of times however large the table, of which the driver holds nothing.
    """
    spark, rows = df.sparkSession, df.select("id", tokenize(F.col(text)).alias("tokens"))
    if token_table.count() * (8 * dim + 64) <= budget:
        table = token_table.select("token", "vec").toArrow()
        sent = spark.sparkContext.broadcast((table.column("token").combine_chunks(), arrow_matrix(table.column("vec"))))
        summed = rows.select("id", _token_sums(sent, dim)(F.col("tokens")).alias("_s")).filter("_s.n > 0").select("id", "_s.n", "_s.total")
    else:
        summed = _sums_by_parts(rows, token_table, dim)
    mean = F.transform("total", lambda x: x / F.col("n"))
    return summed.select("id", mean.alias("_mean")).select("id", l2_normalize(F.col("_mean")).alias("values"))


# Token vectors that a task adds up at once, in numbers.
_HELD_NUMBERS = 4_000_000


def _token_sums(sent, dim: int):
    """Number and sum of the known tokens of each list."""

    @F.arrow_udf("n long, total array<double>")
    def add(lists: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(list(_known_sums(lists, *sent.value, dim)), ["n", "total"])

    return add


def _known_sums(lists: pa.Array, names: pa.Array, matrix: np.ndarray, dim: int) -> tuple[pa.Array, pa.Array]:
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1), dtype=np.int64)
    place = place[np.asarray(coded.indices)] if len(place) else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)[place >= 0]
    place = place[place >= 0]
    counts = np.bincount(row, minlength=len(lists))
    total = np.zeros((len(lists), dim))
    ends = np.concatenate([[0], np.cumsum(counts)])
    step, low = max(1, _HELD_NUMBERS // max(1, dim)), 0
    while low < len(place):
        # Cut where a text ends, if it ends within reach.
        high = int(ends[np.searchsorted(ends, low + step, side="right") - 1])
        high = high if high > low else min(low + step, len(place))
        some = row[low:high]
        starts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        total[some[starts]] += np.add.reduceat(matrix[place[low:high]], starts, axis=0)
        low = high
    offsets = pa.array(np.arange(0, total.size + 1, dim, dtype=np.int32))
    return pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))


# Texts of a part that meets the vectors of its tokens.
_PART_TEXTS = 8192


def _sums_by_parts(rows: DataFrame, token_table: DataFrame, dim: int) -> DataFrame:
    """``id, n, total`` where the token table cannot be sent out."""
    parts = max(1, -(-rows.count() // _PART_TEXTS))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition("_part")
    # Rows of a part lie together already, so that this moves nothing.
    needed = checkpointed(dealt.select("_part", F.explode(F.array_distinct("tokens")).alias("token")).distinct())
    known = token_table.select("token", "vec").join(broadcast_within(needed, needed.count(), 128), "token").select("_part", "token", "vec")
    schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def add(texts: pa.Table, table: pa.Table) -> pa.Table:
        lists, names = texts.column("tokens").combine_chunks(), table.column("token").combine_chunks()
        if not texts.num_rows or not table.num_rows:
            return pa.table({"id": texts.column("id").slice(0, 0), "n": pa.array([], pa.int64()), "total": pa.array([], pa.list_(pa.float64()))})
        counts, total = _known_sums(lists, names, arrow_matrix(table.column("vec")), dim)
        out = pa.table({"id": texts.column("id"), "n": counts, "total": total})
        return out.filter(pc.greater(out.column("n"), 0))

    return dealt.groupBy("_part").cogroup(known.groupBy("_part")).applyInArrow(add, schema)


def golden_check(encoded: DataFrame, goldens: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Largest component gap to each stored encoding, and whether it is below ``eps``.

    Both sides have ``text, values``; a text without an encoding fails.
    """
    stored = goldens.select("text", F.col("values").alias("_golden"))
    gaps = F.zip_with("values", "_golden", lambda a, b: F.abs(a - b))
    same_width = F.size("values") == F.size("_golden")
    worst = F.when(same_width, F.array_max(gaps))
    return (
        stored.join(encoded.select("text", "values"), "text", "left")
        .select("text", worst.alias("gap"))
        .withColumn("ok", F.coalesce(F.col("gap") < eps, F.lit(False)))
    )


def golden_tokens(goldens: DataFrame, token_table: DataFrame) -> DataFrame:
    """The token rows the golden texts use."""
    used = explode_rows(goldens, [], tokenize(F.col("text")), "token")
    return token_table.join(used, "token", "left_semi")
