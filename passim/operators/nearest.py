"""Exact nearest neighbours: the engine behind every vector search.

Vectors stay in their Spark partitions. Each task multiplies its Arrow batches
with a block of query vectors and keeps a running top-k per query, so a task
emits at most ``k`` rows per query and the shuffle that merges tasks is small.

Which side is sent to the executors is decided by measured size:

* few queries: the query block is broadcast and the vectors are scanned once;
* few vectors (centroids): the vector block is broadcast, and every query row
  is finished where it lies;
* neither: both sides are cut into blocks of bounded size and the blocks are
  paired by one shuffle.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passim.operators.ranking import top_k
from passim.session import BROADCAST_BYTES, broadcast_within, checkpointed, spread

# Distances are rounded so that equal vectors tie in any block layout.
DISTANCE_DECIMALS = 9
# Cells of one distance block held in memory by a task.
_BLOCK_CELLS = 4_000_000
# Cells of one product, small enough to stay near the processor, and vectors of one:
# a product of few queries by many vectors reads the vectors again and again.
_PRODUCT_CELLS, _PRODUCT_VECTORS = 1_000_000, 2048
# Queries of one product, at most.
_PRODUCT_QUERIES = 16_384
# Rows of a batch that are turned into numbers at once, where each has an answer of its own.
_SLICE_ROWS = 1024
# Cells of one distance block of such rows.
_SLICE_CELLS = 262_144
# Rows of the blocks of queries and of vectors that a shuffle pairs, at most: each
# vector block gives each query a list, and each query block takes a copy of the vectors.
_QUERY_ROWS, _VECTOR_ROWS = 65_536, 131_072
# Rows of the lists of a block of queries, from the least of its queries on.
_LIST_ROWS, _LEAST_QUERIES = 655_360, 16_384
# Blocks are cut smaller, down to so many rows, until there are so many pairs for each core.
_SMALL_ROWS, _CORE_PAIRS = 8192, 3
# Shuffle partitions of the paired blocks, at most.
_MOST_PARTS = 2048
# From so many queries a scan has as many tasks as there are cores.
_MANY_QUERIES = 4096


def arrow_matrix(column: pa.Array) -> np.ndarray:
    """A list column as a dense DOUBLE matrix; rows must share one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows == 0:
        return flat.reshape(0, 0)
    if flat.size % rows or not (np.diff(column.offsets.to_numpy()) == flat.size // rows).all():
        raise ValueError("vectors of different widths in one collection")
    return flat.reshape(rows, -1)


def arrow_ids(column: pa.Array) -> np.ndarray:
    """Ids as a sortable NumPy array (integers, or strings in code-point order)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=np.str_)
    return column.to_numpy(zero_copy_only=False)


def answered_in_slices(values: pa.Array, answer: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``answer`` to the rows of a list column, a slice at a time, so that a full batch is never held as numbers."""
    return np.concatenate([answer(arrow_matrix(values.slice(i, _SLICE_ROWS))) for i in range(0, len(values), _SLICE_ROWS)])


def squared_distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    squares = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :]
    return np.round(np.maximum(squares - 2.0 * (queries @ vectors.T), 0.0), DISTANCE_DECIMALS)


class BestK:
    """Running top-k of ``(distance, id)`` per query, fed block by block.

    A block touches only the lists of the queries that gain by it, so its cost
    does not grow with the number of queries held.
    """

    def __init__(self, queries: int, k: int):
        self.k = k
        self.bound = np.full(queries, np.inf)
        self.counts = np.zeros(queries, dtype=np.int64)
        self.lists = np.empty((queries, 0))
        self.names: np.ndarray | None = None

    def candidates(self, which: np.ndarray, dist: np.ndarray, slack: float | np.ndarray = 0.0, less: float | np.ndarray = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of what may enter the lists, if ``dist`` errs by half of ``slack`` at most.

        ``less`` is what the distances of each query are given without.
        """
        slack = np.broadcast_to(slack, len(which))
        bound = self.bound[which] - less + slack
        wide = dist.shape[1] > self.k
        loose = np.isinf(bound) if wide else np.zeros(len(which), dtype=bool)
        if loose.any():
            bound[loose] = np.fmin(bound[loose], np.partition(dist[loose], self.k - 1, axis=1)[:, self.k - 1] + slack[loose])
        hits = dist <= _at_least(bound, dist.dtype)[:, None]
        if wide and np.count_nonzero(hits) > 8 * self.k * len(which):
            bound = np.fmin(bound, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1] + slack)
            hits = dist <= _at_least(bound, dist.dtype)[:, None]
        return np.divmod(_places(hits), dist.shape[1])

    def add(self, which: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``dist[i, j]``: query ``which[i]`` to vector ``ids[j]``."""
        if dist.size:
            row, col = self.candidates(which, dist)
            self.offer(which[row], dist[row, col], ids[col])

    def offer(self, rows: np.ndarray, dists: np.ndarray, names: np.ndarray) -> None:
        """Offer vector ``names[i]`` at ``dists[i]`` to query ``rows[i]``."""
        bound = self.bound[rows]
        keep = dists <= bound
        # A vector as far as the last of a full list needs a lower id.
        tied = np.flatnonzero((dists == bound) & (self.counts[rows] == self.k))
        if len(tied):
            keep[tied] = names[tied] < self.names[rows[tied], self.k - 1]
        if not keep.any():
            return
        rows, dists, names = rows[keep], dists[keep], names[keep]
        which, place = np.unique(rows, return_inverse=True)
        held = self.counts[which]
        if held.any():
            old = np.repeat(np.arange(len(which)), held)
            at = np.arange(len(old)) - np.repeat(np.cumsum(held) - held, held)
            place = np.concatenate([old, place])
            dists = np.concatenate([self.lists[which[old], at], dists])
            names = np.concatenate([self.names[which[old], at], names])
        order = np.lexsort((names, dists, place))
        place, dists, names = place[order], dists[order], names[order]
        sizes = np.bincount(place, minlength=len(which))
        at = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = at < self.k
        place, dists, names, at = place[first], dists[first], names[first], at[first]
        self._widen(int(at.max()) + 1, names.dtype)
        self.lists[which[place], at], self.names[which[place], at] = dists, names
        self.counts[which] = np.minimum(sizes, self.k)
        full = at == self.k - 1
        self.bound[which[place[full]]] = dists[full]

    def _widen(self, width: int, kind: np.dtype) -> None:
        """Room for lists of ``width`` rows and names of ``kind``."""
        have = self.lists.shape[1]
        if self.names is None:
            self.names = np.empty((len(self.bound), 0), dtype=kind)
        kind = np.promote_types(self.names.dtype, kind)
        if kind != self.names.dtype:
            self.names = self.names.astype(kind)
        if width > have:
            more = max(width, min(self.k, 2 * have)) - have
            self.lists = np.concatenate([self.lists, np.empty((len(self.bound), more))], axis=1)
            self.names = np.concatenate([self.names, np.empty((len(self.bound), more), dtype=kind)], axis=1)

    def found(self, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, distance and name of all that the lists of these queries hold, in order."""
        counts = self.counts[low:high]
        rows = np.repeat(np.arange(low, low + len(counts)), counts)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        names = self.names if self.names is not None else np.empty((len(self.bound), 1), dtype=np.int64)
        return rows, self.lists[rows, at] if len(rows) else np.empty(0), names[rows, at]


# Distances are rounded to nine decimals; a product of blocks errs by much less than this share of the squares.
_ROUNDING, _PRODUCT_ERROR = 2e-9, 1e-12


def near_products(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All squared distances by one product, neither clipped nor rounded, and for each query a bound of twice the error."""
    left, right = (queries**2).sum(axis=1), (vectors**2).sum(axis=1)
    near = np.column_stack([-2.0 * queries, np.ones(len(queries)), left]) @ np.vstack([vectors.T, right, np.ones(len(vectors))])
    most = right[np.isfinite(right)].max(initial=0.0)
    return near, _ROUNDING + _PRODUCT_ERROR * (left + most)


def _at_least(bound: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The bounds as numbers of ``kind``, none of them lower."""
    return bound if bound.dtype == kind else np.nextafter(bound.astype(kind), kind.type(np.inf))


def _places(hits: np.ndarray) -> np.ndarray:
    """``np.flatnonzero``, for few hits eight cells at a time."""
    if hits.size % 8 or 64 * np.count_nonzero(hits) > hits.size:
        return np.flatnonzero(hits)
    flat = hits.reshape(-1)
    some = (8 * np.flatnonzero(flat.view(np.uint64))[:, None] + np.arange(8)).ravel()
    return some[flat[some]]


def row_squares(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[(rows[i : i + _SLICE_ROWS] ** 2).sum(axis=1) for i in range(0, len(rows), _SLICE_ROWS)]])


class NearVectors:
    """Vectors whose products with queries find, in single precision, what may be near.

    A distance that is given out is never taken from these products; what they
    leave is measured again. Numbers that single precision cannot hold are
    multiplied in double precision.
    """

    # Share of the squares by which a product errs, for each component and a few more operations.
    _ERROR, _MORE = 2.0**-24, 8
    # Squares up to this neither overflow nor, where they do not count, vanish.
    _LARGEST = 1e30

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.squares = vectors, row_squares(vectors)
        finite = np.isfinite(self.squares)
        self.most = self.squares[finite].max(initial=0.0)
        self.single = None
        if finite.all() and self.most < self._LARGEST:
            self.single = np.empty((len(vectors), vectors.shape[1] + 1), dtype=np.float32)
            self.single[:, :-1], self.single[:, -1] = vectors, self.squares

    def cut(self, queries: np.ndarray) -> Callable:
        """What gives, for a slice of the vectors and some of the queries (else all), their near distances, and for each query what these lack and a bound of twice the error."""
        squares = row_squares(queries)
        single = self.single is not None and bool((squares < self._LARGEST).all())
        if single:
            left = np.empty((len(queries), queries.shape[1] + 1), dtype=np.float32)
            left[:, :-1], left[:, -1] = -2.0 * queries, 1.0
            slack = _ROUNDING + 2.0 * self._ERROR * (queries.shape[1] + self._MORE) * (squares + 2.0 * self.most)

        def near(some: slice, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if single:
                return left[rows] @ self.single[some].T, squares[rows], slack[rows]
            found, wide = near_products(queries[rows], self.vectors[some])
            return found, np.zeros(len(found)), wide

        return near

    def products(self, queries: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """The same for all queries, some vectors at a time, with the slice of these."""
        near = self.cut(queries)
        for low in range(0, len(self.vectors), _PRODUCT_VECTORS):
            some = slice(low, min(low + _PRODUCT_VECTORS, len(self.vectors)))
            yield some, *near(some)

    def query_step(self) -> int:
        """Queries of one product."""
        return max(1, min(_PRODUCT_QUERIES, _PRODUCT_CELLS // max(1, min(_PRODUCT_VECTORS, len(self.vectors)))))


def add_blocks(best: BestK, queries: np.ndarray, which: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
    """Offer vectors to queries. Only what may enter a list is measured and rounded one by one."""
    held = NearVectors(vectors)
    step = held.query_step()
    for start in range(0, len(which), step):
        part = which[start : start + step]
        block = queries[part]
        squares = row_squares(block)
        for some, near, less, slack in held.products(block):
            row, col = best.candidates(part, near, slack, less)
            if 8 * len(row) > near.size:
                best.offer(part[row], squared_distances(block, vectors[some])[row, col], ids[some][col])
            elif len(row):
                col += some.start
                best.offer(part[row], paired_distances(block, squares, row, vectors, held.squares, col), ids[col])


def paired_distances(queries: np.ndarray, left: np.ndarray, row: np.ndarray, vectors: np.ndarray, right: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distance of ``queries[row[i]]`` to ``vectors[col[i]]``, rounded; ``left`` and ``right`` are their squares."""
    out, step = np.empty(len(row)), max(1, _BLOCK_CELLS // max(1, queries.shape[1]))
    for low in range(0, len(row), step):
        some = slice(low, low + step)
        out[some] = np.einsum("ij,ij->i", queries[row[some]], vectors[col[some]])
    return np.round(np.maximum(left[row] + right[col] - 2.0 * out, 0.0), DISTANCE_DECIMALS)


# Queries of one output batch.
_BATCH_QUERIES = 16_384


def _best_batch(best: BestK, query_ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kind = schema.field("id").type
    for low in range(0, len(best.bound), _BATCH_QUERIES):
        rows, dist, names = best.found(low, low + _BATCH_QUERIES)
        if len(rows):
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(rows)), arrow_names(names, kind), pa.array(dist, type=pa.float64())], schema=schema)


def arrow_names(names: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(names if names.dtype.kind in "iu" else names.tolist(), type=kind)


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


class Block:
    """A measured block of rows, small enough to broadcast."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix


def budget_rows(width: int, budget: int) -> int:
    """Rows of ``width`` DOUBLEs and an id that fit the budget."""
    return max(0, budget // (8 * max(1, width) + 64))


def vector_width(df: DataFrame) -> int:
    head = df.select(F.size("values").alias("n")).limit(1).collect()
    return head[0]["n"] if head else 0


def bounded_block(df: DataFrame, budget: int = BROADCAST_BYTES) -> Block | None:
    """Read ``id, values`` if they fit the budget, else None.

    The count comes first: on a stored table it reads file footers only.
    """
    if df.count() > budget_rows(vector_width(df), budget):
        return None
    table = df.select("id", "values").toArrow()
    return Block(table.column("id").combine_chunks(), arrow_matrix(table.column("values")))


def bounded_pairs(probes: DataFrame, block: Block, budget: int = BROADCAST_BYTES):
    """``(query number, cell)`` arrays ordered by cell, or None over the budget."""
    if probes.count() > budget // 64:
        return None
    table = probes.select("qid", "cell").toArrow()
    cells = table.column("cell").combine_chunks().to_numpy()
    numbers = pc.index_in(table.column("qid").combine_chunks(), value_set=block.ids).to_numpy()
    order = np.argsort(cells, kind="stable")
    return numbers[order].astype(np.int64), cells[order]


def result_schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", queries.schema["id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])


def scan_with_queries(
    spark: SparkSession, block: Block, vectors: DataFrame, k: int, schema: T.StructType, pairs=None
) -> DataFrame:
    """Per-task top-k of a broadcast query block.

    With ``pairs`` (see :func:`bounded_pairs`) a vector meets only the queries
    that probe its ``cell``; without, it meets them all.
    """
    shared = spark.sparkContext.broadcast((block.ids, block.matrix, pairs))
    arrow = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, routes = shared.value
        best = BestK(len(matrix), k)
        everyone = np.arange(len(matrix))
        for batch in batches:
            if not batch.num_rows or not len(matrix):
                continue
            data = arrow_matrix(batch.column("values"))
            ids = arrow_ids(batch.column("id"))
            if routes is None:
                add_blocks(best, matrix, everyone, data, ids)
                continue
            numbers, cells = routes
            home = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(home):
                low, high = np.searchsorted(cells, [cell, cell + 1])
                if high > low:
                    here = home == cell
                    add_blocks(best, matrix, numbers[low:high], data[here], ids[here])
        yield from _best_batch(best, query_ids, arrow)

    columns = ["id", "values"] if pairs is None else ["id", "values", "cell"]
    return in_tasks(vectors.select(*columns), len(block.ids)).mapInArrow(scan, schema)


def in_tasks(vectors: DataFrame, queries: int) -> DataFrame:
    """Vectors in as many tasks as there are cores, if many queries make a scan long."""
    return vectors if queries < _MANY_QUERIES else vectors.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "id")


def finish_against_block(
    spark: SparkSession, queries: DataFrame, block: Block, k: int, schema: T.StructType
) -> DataFrame:
    """Top-k of every query row against a broadcast vector block; no shuffle."""
    shared = spark.sparkContext.broadcast((block.ids, block.matrix))
    arrow = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        names = arrow_ids(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            data = arrow_matrix(batch.column("values"))
            best = BestK(len(data), k)
            add_blocks(best, data, np.arange(len(data)), matrix, names)
            yield from _best_batch(best, batch.column("id"), arrow)

    return queries.select("id", "values").mapInArrow(scan, schema)


def pair_blocks(
    queries: DataFrame, vectors: DataFrame, k: int, schema: T.StructType, budget: int = BROADCAST_BYTES, meet=None, columns: tuple[str, ...] = ("values",)
) -> DataFrame:
    """Top-k per pair of blocks when neither side can be broadcast.

    Every query meets every vector or, where the queries carry a list ``cells``,
    every vector whose ``cell`` is in it. Blocks are of bounded size: small cells
    share one, and a large cell is cut into as many as its own row count needs.
    A query goes once to each block that holds one of its cells, with the list of
    these, so neither its vector nor a pair is repeated for each cell.

    ``meet(block, pairs, part)`` takes the query vectors, a list of ``(cell,
    query numbers, vector rows)`` and the table of the vectors' ``columns``, and
    gives query numbers and the output's other columns; by default squared
    distances are ranked.
    """
    spark, routed = vectors.sparkSession, "cells" in queries.columns
    fit = max(1, budget_rows(vector_width(queries), budget))
    if not routed:
        queries, vectors = queries.withColumn("cells", F.array(F.lit(0))), vectors.withColumn("cell", F.lit(0))
    # One row for each cell: the model's size.
    sizes = {r["cell"]: r["n"] for r in vectors.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    asks = queries.select(F.explode(F.array_distinct("cells")).alias("cell")) if routed else queries.select(F.lit(0).alias("cell"))
    asked = {r["cell"]: r["n"] for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    cores = spark.sparkContext.defaultParallelism
    groups = _sized_groups({c: n for c, n in sizes.items() if c in asked}, asked, queries.count(), min(_block_queries(k), fit), min(_VECTOR_ROWS, fit), _CORE_PAIRS * cores)
    cells = np.array(sorted(groups), dtype=np.int64)
    # A group's pairs are numbered from its first one on.
    first, pairs = {}, 0
    for group, qparts, vparts in sorted(set(groups.values())):
        first[group], pairs = pairs, pairs + qparts * vparts
    spots = [(int(c), first[groups[c][0]], *map(int, groups[c][1:])) for c in cells.tolist()]
    sent = spark.sparkContext.broadcast((cells, np.array([spot[1:] for spot in spots], dtype=np.int64).reshape(-1, 3)))
    parts = max(1, min(_MOST_PARTS, pairs))
    numbers = F.split(F.lit(",".join(map(str, dealt_numbers(pairs, parts)))), ",").cast("array<int>")
    pair_number = F.get(numbers, F.col("_first") + F.col("_q") * F.col("_vparts") + F.col("_v"))
    grid = spark.createDataFrame(spots, "cell int, _first int, _qparts int, _vparts int")
    right = (
        spread(vectors.select("id", *columns, "cell"), "id")
        .withColumn("cell", F.col("cell").cast("int"))
        .join(F.broadcast(grid), "cell")
        .withColumn("_v", F.pmod(F.xxhash64("id"), F.col("_vparts")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qparts") - 1)))
        .select("id", *columns, "cell", pair_number.alias("_pair"))
    )

    @F.arrow_udf("array<struct<_first: int, _qparts: int, _vparts: int, cells: array<int>>>")
    def deal(lists: pa.Array) -> pa.Array:
        """The blocks' groups that a list of cells meets, each with its part of the list."""
        known, place = sent.value
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        keep = known[at] == flat if len(known) else np.zeros(len(flat), dtype=bool)
        flat, row, at = flat[keep], row[keep], at[keep]
        order = np.lexsort((place[at, 0], row))
        flat, row, spot = flat[order], row[order], place[at[order]]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (spot[1:, 0] != spot[:-1, 0])]) if len(row) else np.zeros(0, dtype=np.int64)
        inner = pa.ListArray.from_arrays(pa.array(np.r_[first, len(flat)].astype(np.int32)), pa.array(flat.astype(np.int32)))
        parts = [pa.array(spot[first, i].astype(np.int32)) for i in range(3)]
        entries = pa.StructArray.from_arrays([*parts, inner], ["_first", "_qparts", "_vparts", "cells"])
        ends = np.searchsorted(row[first], np.arange(len(lists) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), entries)

    left = (
        spread(queries.select("id", "values", "cells"), "id")
        .select("id", "values", F.explode(deal("cells")).alias("_d"))
        .select("id", "values", "_d.*")
        .withColumn("_q", F.pmod(F.xxhash64("id"), F.col("_qparts")).cast("int"))
        .withColumn("_v", F.explode(F.sequence(F.lit(0), F.col("_vparts") - 1)))
        .select(*[F.col(c).alias("q_" + c) for c in ("id", "values", "cells")], pair_number.alias("q_pair"))
    )
    arrow = _arrow_schema(schema)

    def ranked(block: np.ndarray, pairs: list, part: pa.Table) -> Iterator[tuple]:
        best, data, ids = BestK(len(block), k), arrow_matrix(part.column("values")), arrow_ids(part.column("id"))
        for _, which, here in pairs:
            add_blocks(best, block, which, data[here], ids[here])
        query, dist, names = best.found()
        return query, [arrow_names(names, arrow.field("id").type), pa.array(dist)]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        lists = left.column("q_cells").combine_chunks()
        flat = lists.flatten().to_numpy().astype(np.int64)
        number = np.repeat(np.arange(left.num_rows), pc.list_value_length(lists).to_numpy())
        order = np.argsort(flat, kind="stable")
        flat, number = flat[order], number[order]
        home, pairs = right.column("cell").to_numpy(), []
        by_cell = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(home[by_cell]) != 0, True])
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            cell = int(home[by_cell[low]])
            first, last = np.searchsorted(flat, [cell, cell + 1])
            if last > first:
                pairs.append((cell, number[first:last], by_cell[low:high]))
        query, out = (meet or ranked)(arrow_matrix(left.column("q_values")), pairs, right)
        return pa.Table.from_arrays([left.column("q_id").combine_chunks().take(pa.array(query)), *out], schema=arrow)

    # By number, as blocks of few bytes are much work and must not be put together.
    left, right = left.repartition(parts, "q_pair"), right.repartition(parts, "_pair")
    return left.groupBy("q_pair").cogroup(right.groupBy("_pair")).applyInArrow(pair, schema)


def dealt_numbers(count: int, parts: int) -> list[int]:
    """Whole numbers of which Spark's hash puts the same number into each of the partitions, or one more."""
    most, size = -(-count // parts), 4 * (count + parts)
    while True:
        home = np.mod(_murmur(np.arange(size, dtype=np.uint32)), parts)
        held = np.bincount(home, minlength=parts)
        if held.min() >= most:
            break
        size *= 2
    order, start = np.argsort(home, kind="stable"), np.cumsum(held) - held
    number = np.arange(count)
    return order[start[number % parts] + number // parts].tolist()


def _murmur(numbers: np.ndarray) -> np.ndarray:
    """Spark's hash of an INT, by which rows are dealt to partitions."""
    turned = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    x = np.uint32(42) ^ (turned(numbers * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    x = turned(x, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    x ^= np.uint32(4)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (x ^ (x >> np.uint32(16))).view(np.int32)


def _block_queries(k: int) -> int:
    """Queries of a block, fewer for longer lists."""
    return max(_LEAST_QUERIES, min(_QUERY_ROWS, _LIST_ROWS // max(1, k)))


def _sized_groups(sizes: dict[int, int], asked: dict[int, int], queries: int, query_rows: int, rows: int, pairs: int) -> dict[int, tuple[int, int, int]]:
    """Groups in the largest blocks that make so many pairs; first blocks of queries are halved, then those of vectors."""
    while True:
        groups = _cell_groups(sizes, asked, queries, query_rows, rows)
        if sum(q * v for _, q, v in set(groups.values())) >= pairs or max(query_rows, rows) <= _SMALL_ROWS:
            return groups
        if query_rows > _SMALL_ROWS:
            query_rows = max(_SMALL_ROWS, query_rows // 2)
        else:
            rows = max(_SMALL_ROWS, rows // 2)


def _cell_groups(sizes: dict[int, int], asked: dict[int, int], queries: int, query_rows: int, rows: int) -> dict[int, tuple[int, int, int]]:
    """Group of each cell, and into how many parts its queries and its vectors are cut."""
    out, group, members, held = {}, 0, [], 0

    def close() -> None:
        nonlocal group, members, held
        if members:
            parts = max(1, -(-min(queries, sum(asked[c] for c in members)) // query_rows)), max(1, -(-held // rows))
            out.update(dict.fromkeys(members, (group, *parts)))
            group, members, held = group + 1, [], 0

    for cell in sorted(sizes):
        if held + sizes[cell] > rows:
            close()
        members.append(cell)
        held += sizes[cell]
    close()
    return out


def merge_best(partial: DataFrame, k: int) -> DataFrame:
    """Merge per-task winners: best distance first, then id."""
    return top_k(partial, ["qid"], [F.col("distance"), F.col("id")], k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, budget: int = BROADCAST_BYTES) -> DataFrame:
    """Exact top-k by squared L2 distance: ``qid, rank, id, distance``.

    Both inputs have ``id`` (unique) and ``values``. Ties go to the lower id.
    """
    spark = vectors.sparkSession
    schema = result_schema(queries, vectors)
    block = bounded_block(queries, budget)
    if block is not None:
        partial = scan_with_queries(spark, block, vectors, k, schema)
    else:
        block = bounded_block(vectors, budget)
        if block is not None:
            partial = finish_against_block(spark, queries, block, k, schema)
        else:
            partial = pair_blocks(queries.select("id", "values"), vectors.select("id", "values"), k, schema, budget)
    return merge_best(partial, k).select("qid", "rank", "id", "distance")


def vector_places(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``qid, id, rank`` of the pairs ``qid, id`` in the whole ranking of their query.

    The distances of the pairs are found first; one scan then counts, for each,
    the vectors before it. Pairs go in batches that fit the budget with their
    queries; an id that is no vector has no row.
    """
    spark, width = vectors.sparkSession, vector_width(queries)
    asked = queries.select(F.col("id").alias("qid"), F.col("values").alias("_query"))
    wanted = pairs.select("qid", "id").distinct()
    count = wanted.count()
    ids = broadcast_within(wanted, count, 64)
    held = vectors.select("id", "values").join(ids, "id").join(asked, "qid").select("qid", "_query", "id", "values")
    held = checkpointed(held)
    parts = max(1, -(-count // max(1, budget_rows(2 * width, budget))))
    schema = T.StructType([pairs.schema["qid"], pairs.schema["id"], T.StructField("rank", T.LongType())])
    out = spark.createDataFrame([], schema)
    for part in range(parts):
        table = held.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).toArrow()
        if not table.num_rows:
            continue
        qid, id_ = table.column("qid").combine_chunks(), table.column("id").combine_chunks()
        coded = qid.dictionary_encode()
        query = np.asarray(coded.indices)
        first = np.unique(query, return_index=True)[1]
        matrix = arrow_matrix(table.column("_query"))
        # As a scan finds it: by one product of blocks, rounded.
        own = np.concatenate([squared_distances(matrix[i : i + 1], arrow_matrix(table.column("values").slice(i, 1)))[0] for i in range(len(query))])
        sent = spark.sparkContext.broadcast((matrix[first], query, own, id_))

        def count_before(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matrix, query, own, named = sent.value
            names, before = arrow_ids(named), np.zeros(len(query), dtype=np.int64)
            order = np.lexsort((names, own, query))
            edges = np.searchsorted(query[order], np.arange(len(matrix) + 1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, ids = arrow_matrix(batch.column("values")), arrow_ids(batch.column("id"))
                step = max(1, _BLOCK_CELLS // len(data))
                for start in range(0, len(matrix), step):
                    dist = squared_distances(matrix[start : start + step], data)
                    for q, line in enumerate(dist, start):
                        mine = order[edges[q] : edges[q + 1]]
                        ranked = np.sort(line)
                        before[mine] += np.searchsorted(ranked, own[mine], side="left")
                        for i in mine[np.searchsorted(ranked, own[mine], side="right") > np.searchsorted(ranked, own[mine], side="left")]:
                            before[i] += (ids[line == own[i]] < names[i]).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(query))), pa.array(before)], names=["i", "before"])

        counted = vectors.select("id", "values").mapInArrow(count_before, "i long, before long").groupBy("i").agg(F.sum("before").alias("before"))
        which = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(query))), "qid": qid, "id": id_}))
        out = out.unionByName(counted.join(F.broadcast(which), "i").select("qid", "id", (F.col("before") + 1).alias("rank")))
    return out
