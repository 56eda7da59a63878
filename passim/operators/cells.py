"""Inverted-file cells: training, routing and pruned search."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passim.functions.vector import sum_vector
from passim.operators import nearest
from passim.operators.nearest import (
    answered_in_slices,
    arrow_ids,
    arrow_matrix,
    bounded_block,
    bounded_pairs,
    budget_rows,
    merge_best,
    pair_blocks,
    result_schema,
    scan_with_queries,
    vector_width,
)
from passim.operators.ranking import top_k
from passim.session import BROADCAST_BYTES, checkpointed, new_folder

# Sample size and guidance for training.
TRAIN_SAMPLE = 250_000
SAMPLES_PER_CELL = 39
ITERATIONS = 10
CENTROID_DECIMALS = 9


def default_nprobe(nlist: int) -> int:
    return max(1, nlist // 4)


def hash_order(df: DataFrame) -> list:
    """A fixed pseudo-random order that does not follow the input order."""
    return [F.md5(F.col("id").cast("string")), F.col("id")]


def train_sample(vectors: DataFrame, n: int = TRAIN_SAMPLE) -> DataFrame:
    """The first ``n`` rows in hash order.

    A cut on the hash first keeps about as many rows as are wanted, so that the
    sort behind the limit never sees the whole collection. The cut is widened
    until it holds ``n`` rows, so the result is the same as without it.
    """
    share = 1.2 * n / max(1, vectors.count()) + 1e-6
    low = vectors
    while share < 1:
        bound = format(int(share * 16**12), "012x")
        low = vectors.filter(F.md5(F.col("id").cast("string")) < bound)
        if low.count() >= n:
            break
        share, low = share * 2, vectors
    return low.orderBy(*hash_order(vectors)).limit(n)


def sample_report(sample: DataFrame, nlist: int) -> DataFrame:
    """Samples per centroid against the usual guidance."""
    per_cell = F.count("*") / F.lit(float(nlist))
    return sample.agg(
        F.count("*").alias("samples"),
        F.lit(nlist).cast("long").alias("nlist"),
        per_cell.alias("samples_per_cell"),
        (per_cell >= SAMPLES_PER_CELL).alias("enough"),
    )


def centroid_frame(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id int, values array<double>")


def partial_sums(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """Assign and add up: ``id, n, total`` per cell that received a vector.

    Tasks emit one partial sum per cell they meet, so the shuffle carries model
    rows, not vectors.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, means = shared.value
        order = np.argsort(names)
        totals, counts = np.zeros(means.shape), np.zeros(len(means), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                data = arrow_matrix(batch.column("values"))
                home = order[np.searchsorted(names[order], closest(data, means, names))]
                np.add.at(totals, home, data)
                counts += np.bincount(home, minlength=len(means))
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[seen].astype(np.int32)),
                    pa.array(counts[seen]),
                    pa.array(totals[seen].tolist(), type=pa.list_(pa.float64())),
                ],
                names=["id", "n", "total"],
            )

    return (
        vectors.select("values")
        .mapInArrow(partial, "id int, n long, total array<double>")
        .groupBy("id")
        .agg(F.sum("n").alias("n"), sum_vector(F.col("total"), matrix.shape[1]).alias("total"))
    )


def lloyd_step(vectors: DataFrame, centroids: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """One k-means step: assign, then average. An empty cell keeps its centroid.

    Centroids beyond the budget meet the vectors block by block, and the sums
    are made by Spark.
    """
    block = bounded_block(centroids, budget)
    if block is None:
        homed = assign_cells(vectors.select("id", "values"), centroids, budget).withColumnRenamed("id", "_row").withColumnRenamed("cell", "id")
        sums = homed.groupBy("id").agg(F.count("*").alias("n"), sum_vector(F.col("values"), vector_width(centroids)).alias("total"))
    else:
        sums = partial_sums(vectors, arrow_ids(block.ids), block.matrix)
    moved = F.transform("total", lambda x: F.round(x / F.col("n"), CENTROID_DECIMALS))
    return centroids.join(sums, "id", "left").select(
        "id", F.when(F.col("n").isNull(), F.col("values")).otherwise(moved).alias("values")
    )


def closest(data: np.ndarray, matrix: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Name of the nearest block row for each data row; ties to the lower name."""
    order = np.argsort(names, kind="stable")
    sorted_matrix, out = matrix[order], []
    step = max(1, min(nearest._BLOCK_CELLS, nearest._SLICE_CELLS) // max(1, len(matrix)))
    for start in range(0, len(data), step):
        part = nearest.squared_distances(data[start : start + step], sorted_matrix)
        out.append(part.argmin(axis=1))
    return names[order][np.concatenate(out)]


def train_cells(
    vectors: DataFrame, nlist: int, iterations: int = ITERATIONS, sample: int | None = None, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """k-means centroids ``id, values`` over all rows, or over ``sample`` of them.

    The start is the ``nlist`` lowest rows in hash order. The loop carries only
    the model; the sample is cut once and reused. A model beyond the budget is
    trained in two levels, see :func:`train_two_levels`.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", "values")
    chosen = checkpointed(rows if sample is None else train_sample(rows, max(sample, nlist)))
    if nlist > budget_rows(vector_width(chosen), budget):
        return train_two_levels(chosen, nlist, iterations, budget)
    start = chosen.orderBy(*hash_order(chosen)).limit(nlist).select("values")
    matrix = arrow_matrix(start.toArrow().column("values"))
    for _ in range(iterations):
        sums = partial_sums(chosen, np.arange(len(matrix)), matrix).toArrow()
        moved, at = matrix.copy(), sums.column("id").to_numpy()
        if len(at):
            means = arrow_matrix(sums.column("total")) / sums.column("n").to_numpy()[:, None]
            moved[at] = np.round(means, CENTROID_DECIMALS)
        if np.array_equal(moved, matrix):
            break
        matrix = moved
    return centroid_frame(spark, matrix)


def shares(counts: list[int], total: int) -> list[int]:
    """``total`` dealt in proportion to the counts: at least one each, at most the count itself."""
    out = [1] * len(counts)
    left = min(total, sum(counts)) - len(counts)
    exact = [left * n / max(1, sum(counts)) for n in counts]
    out = [min(n, 1 + int(x)) for n, x in zip(counts, exact, strict=True)]
    # What rounding left goes to those that lost most by it and have rows left.
    order = sorted(range(len(counts)), key=lambda i: (out[i] - 1 - exact[i], i))
    rest = min(total, sum(counts)) - sum(out)
    while rest > 0:
        for i in order:
            if rest > 0 and out[i] < counts[i]:
                out[i], rest = out[i] + 1, rest - 1
    return out


def train_two_levels(vectors: DataFrame, nlist: int, iterations: int = ITERATIONS, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``nlist`` centroids, of which no task and no driver ever holds all.

    The square root of ``nlist`` coarse cells are trained first, and the rows
    stored by coarse cell. Each coarse cell then gets fine centroids in proportion
    to its rows, trained among these alone: as many coarse cells at a time as
    have fine centroids within the budget, in scans that open only their rows.
    The fine centroids are stored as they are made.
    """
    spark, width = vectors.sparkSession, vector_width(vectors)
    fit = max(1, budget_rows(width, budget))
    coarse = train_cells(vectors, max(1, min(fit, round(nlist**0.5))), iterations, budget=budget)
    base = new_folder(spark, "coarse")
    assign_cells(vectors.select("id", "values"), coarse, budget).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()
    wanted = shares([r["n"] for r in sizes], nlist)
    first, batch = 0, []
    for i, (row, count) in enumerate(zip(sizes, wanted, strict=True)):
        if count > fit and len(sizes) > 1:
            # A coarse cell too large for one turn is cut in two levels itself.
            inner = train_two_levels(rows.filter(F.col("cell") == row["cell"]).drop("cell"), count, iterations, budget)
            inner.withColumn("id", (F.col("id") + first).cast("int")).write.mode("append").parquet(f"{base}/centroids")
            first += count
        else:
            batch.append((row["cell"], count))
        full = sum(n for _, n in batch) + (wanted[i + 1] if i + 1 < len(wanted) else 0) > fit
        if batch and (full or i + 1 == len(sizes)):
            _train_fine(rows, batch, first, iterations).write.mode("append").parquet(f"{base}/centroids")
            first, batch = first + sum(n for _, n in batch), []
    return spark.read.parquet(f"{base}/centroids")


def _train_fine(rows: DataFrame, batch: list[tuple[int, int]], first: int, iterations: int) -> DataFrame:
    """Centroids ``id, values``, numbered from ``first``, of some coarse cells, each trained on its own rows."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(batch, "cell int, _n int")
    own = checkpointed(rows.filter(F.col("cell").isin([cell for cell, _ in batch])))
    ranked = top_k(own.join(F.broadcast(wanted), "cell"), ["cell"], hash_order(own), max(n for _, n in batch), "_rank")
    start = ranked.filter(F.col("_rank") <= F.col("_n")).orderBy("cell", "_rank").select("cell", "values").toArrow()
    cells, matrix = start.column("cell").to_numpy().astype(np.int64), arrow_matrix(start.column("values"))
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((cells, matrix))

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cells, means = shared.value
            totals, counts = np.zeros(means.shape), np.zeros(len(means), dtype=np.int64)
            for part in batches:
                if not part.num_rows:
                    continue
                data, home = arrow_matrix(part.column("values")), part.column("cell").to_numpy(zero_copy_only=False)
                for cell in np.unique(home):
                    low, high = np.searchsorted(cells, [cell, cell + 1])
                    here = data[home == cell]
                    at = closest(here, means[low:high], np.arange(low, high))
                    np.add.at(totals, at, here)
                    counts += np.bincount(at, minlength=len(means))
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen), pa.array(counts[seen]), pa.array(totals[seen].tolist(), type=pa.list_(pa.float64()))], names=["id", "n", "total"]
            )

        sums = own.select("values", "cell").mapInArrow(partial, "id long, n long, total array<double>").groupBy("id")
        sums = sums.agg(F.sum("n").alias("n"), sum_vector(F.col("total"), matrix.shape[1]).alias("total")).toArrow()
        moved, at = matrix.copy(), sums.column("id").to_numpy()
        moved[at] = np.round(arrow_matrix(sums.column("total")) / sums.column("n").to_numpy()[:, None], CENTROID_DECIMALS)
        if np.array_equal(moved, matrix):
            break
        matrix = moved
    return centroid_frame(spark, matrix).withColumn("id", (F.col("id") + first).cast("int"))


def assign_cells(vectors: DataFrame, centroids: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``cell``: the nearest centroid of each record, with no shuffle.

    Only ``values`` travels to Python. Centroids over the budget are paired
    with the records block by block and the answer is joined back on ``id``.
    """
    block = bounded_block(centroids, budget)
    if block is None:
        best = nearest.knn(vectors, centroids, 1, budget)
        return vectors.join(best.select(F.col("qid").alias("id"), F.col("id").cast("int").alias("cell")), "id")
    shared = vectors.sparkSession.sparkContext.broadcast((block.ids, block.matrix))

    @F.arrow_udf("int")
    def home(values: pa.Array) -> pa.Array:
        ids, matrix = shared.value
        if not len(values):
            return pa.array([], type=pa.int32())
        names = arrow_ids(ids)
        return pa.array(answered_in_slices(values, lambda data: closest(data, matrix, names)).astype(np.int32))

    return vectors.withColumn("cell", home("values"))


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int, budget: int = BROADCAST_BYTES) -> DataFrame:
    """The ``nprobe`` nearest cells of each query: ``qid, cell``."""
    return nearest.knn(queries, centroids, nprobe, budget).select("qid", F.col("id").alias("cell"))


def request_probes(requests: DataFrame, centroids: DataFrame, most: int, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``qid, cell``: the ``nprobe`` nearest cells of each request ``id, values, nprobe``, its own number up to ``most``."""
    ranked = nearest.knn(requests.select("id", "values"), centroids, most, budget).select("qid", F.col("id").alias("cell"), "rank")
    wanted = requests.select(F.col("id").alias("qid"), "nprobe")
    return ranked.join(wanted, "qid").filter(F.col("rank") <= F.col("nprobe")).select("qid", "cell")


# More distinct cells than this are pruned by a join instead of a literal list.
_LITERAL_CELLS = 4096


def in_probed_cells(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Index rows of probed cells only; the filter reaches the partition column."""
    cells = probes.select("cell").distinct()
    found = [row["cell"] for row in cells.limit(_LITERAL_CELLS + 1).collect()]
    if len(found) <= _LITERAL_CELLS:
        return index.filter(F.col("cell").isin(found))
    return index.join(cells, "cell", "left_semi")


def with_cells(queries: DataFrame, probes: DataFrame) -> DataFrame:
    """``id, values`` and, in one list, the ``cells`` that the query probes."""
    lists = probes.groupBy(F.col("qid").alias("id")).agg(F.collect_list(F.col("cell").cast("int")).alias("cells"))
    return queries.select("id", "values").join(lists, "id")


def search_probes(
    queries: DataFrame, index: DataFrame, probes: DataFrame, k: int, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Top-k of each query among the vectors of its probed cells."""
    schema = result_schema(queries, index)
    rows = in_probed_cells(index, probes)
    block = bounded_block(queries, budget)
    pairs = bounded_pairs(probes, block, budget) if block is not None else None
    if pairs is not None:
        partial = scan_with_queries(index.sparkSession, block, rows, k, schema, pairs)
    else:
        partial = pair_blocks(with_cells(queries, probes), rows, k, schema, budget)
    return merge_best(partial, k).select("qid", "rank", "id", "distance")


def ivf_search(
    queries: DataFrame,
    index: DataFrame,
    centroids: DataFrame,
    k: int,
    nprobe: int = 0,
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rank only the vectors in the ``nprobe`` nearest cells; 0 takes a quarter."""
    if not nprobe:
        nprobe = default_nprobe(centroids.count())
    probes = checkpointed(probe_cells(queries, centroids, nprobe, budget))
    return search_probes(queries, index, probes, k, budget)
