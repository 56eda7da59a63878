"""Top-k and running totals that hold when one group owns most of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passim.session import checkpointed


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Spark cuts each map task's rows to ``k`` per group before the shuffle
    (WindowGroupLimit), up to a configured ``k``. Above that limit the same cut
    is made here per input partition first, so no task sees a whole group.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        parts = df.withColumn("_part", F.spark_partition_id())
        inner = Window.partitionBy(*by, "_part").orderBy(*order)
        df = parts.withColumn("_n", F.row_number().over(inner)).filter(F.col("_n") <= k).drop("_n", "_part")
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


_BITS = 16


def running_total(df: DataFrame, by: list[str], ord: str, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same group.

    ``ord`` is a unique non-negative integer within the group. Rows are summed
    in blocks of 65,536 consecutive ``ord`` values, blocks in blocks of blocks,
    and the offsets are joined back. A window therefore never holds more than
    65,536 detail rows, however large the group is.
    """
    block, upper = F.shiftright(F.col(ord), _BITS), F.shiftright(F.col("_b1"), _BITS)
    rows = df.withColumn("_v", value).withColumn("_b1", block)
    blocks = rows.groupBy(*by, "_b1").agg(F.sum("_v").alias("_s1")).withColumn("_b2", upper)
    tops = blocks.groupBy(*by, "_b2").agg(F.sum("_s1").alias("_s2"))

    def before(partition: list[str], order: str, total: str) -> Column:
        frame = Window.partitionBy(*partition).orderBy(order)
        return F.sum(total).over(frame.rowsBetween(Window.unboundedPreceding, -1))

    zero = F.lit(0)
    tops = tops.select(*by, "_b2", F.coalesce(before(by, "_b2", "_s2"), zero).alias("_o2"))
    blocks = blocks.join(tops, [*by, "_b2"]).select(
        *by, "_b1", (F.col("_o2") + F.coalesce(before([*by, "_b2"], "_b1", "_s1"), zero)).alias("_o1")
    )
    inner = F.coalesce(before([*by, "_b1"], ord, "_v"), zero)
    return (
        rows.withColumn("_in", inner)
        .join(blocks, [*by, "_b1"])
        .withColumn(out, F.col("_o1") + F.col("_in"))
        .select(*df.columns, out)
    )


def row_positions(df: DataFrame, by: list[str], ord: str, out: str = "row_pos") -> DataFrame:
    """Add ``out``: the dense position of each row in its group, from 0."""
    return running_total(df, by, ord, F.lit(1).cast("long"), out)


# Bins of one pass over the values that may still be the median.
_BINS = 1024


def exact_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, ``median``: the middle value, or the mean of the two middle ones.

    Each pass counts a group's values in bins between the bounds found so far and
    keeps the bin that holds the middle, until its values are all equal. A
    task holds bin counts, never the values of a group, and each pass leaves
    about a thousandth of them. Nulls do not count; a group of nulls has none.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    one = [] if by else [F.lit(0).alias("_all")]
    keys = by or ["_all"]
    rows = checkpointed(rows.select(*one, *by, "_v"))
    named = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    # The places, from 0, of the lower and the upper middle.
    places = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("place")
    open_ = checkpointed(bounds.select(*named, "low", "high", places, F.lit(0).cast("long").alias("below")))
    done = []
    while True:
        done.append(open_.filter("low = high").select(*[f"_{i}" for i in range(len(keys))], F.col("low").alias("_v")))
        open_ = open_.filter("low < high")
        if open_.isEmpty():
            break
        # Halves of the bounds, as their difference can be beyond the largest double.
        share = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        # The bounds themselves are in the first and the last bin, so that each pass gets on, infinities or not.
        share = F.when(F.col("_v") == F.col("high"), 1.0).when(F.col("_v") == F.col("low"), 0.0).otherwise(F.nanvl(share, F.lit(0.5)))
        bin_ = F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).alias("bin")
        inside = rows.join(open_, same).filter((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
        group = [*[f"_{i}" for i in range(len(keys))], "place"]
        bins = inside.select(*group, "below", "_v", bin_).groupBy(*group, "below", "bin").agg(
            F.count("*").alias("size"), F.min("_v").alias("low"), F.max("_v").alias("high")
        )
        before = F.sum("size").over(Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        found = bins.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0)))
        found = found.filter((F.col("below") <= F.col("place")) & (F.col("place") < F.col("below") + F.col("size")))
        open_ = checkpointed(found.select(*[f"_{i}" for i in range(len(keys))], "low", "high", "place", "below"))
    middles = reduce(DataFrame.unionByName, done)
    medians = middles.groupBy(*[f"_{i}" for i in range(len(keys))]).agg(F.avg("_v").alias("median"))
    return medians.select(*[F.col(f"_{i}").alias(k) for i, k in enumerate(keys) if by], "median")
