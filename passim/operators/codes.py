"""Product quantization: codebooks, codes and compressed search."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passim.functions.vector import squared_l2, sum_vector
from passim.operators.cells import CENTROID_DECIMALS, ITERATIONS, hash_order, train_sample
from passim.operators.nearest import (
    _BLOCK_CELLS,
    _PRODUCT_ERROR,
    _ROUNDING,
    _SLICE_CELLS,
    DISTANCE_DECIMALS,
    BestK,
    NearVectors,
    _arrow_schema,
    _best_batch,
    answered_in_slices,
    arrow_ids,
    arrow_matrix,
    arrow_names,
    bounded_block,
    in_tasks,
    merge_best,
    pair_blocks,
    result_schema,
    row_squares,
    vector_width,
)
from passim.operators.ranking import top_k
from passim.session import BROADCAST_BYTES, broadcast_within, checkpointed

# Subspaces and codewords of the published index.
SUBSPACES, CODEWORDS = 96, 256

# Codebooks are ``sub, code, centroid`` rows: codewords x width numbers in
# total, whatever the corpus size, so they are always broadcast.


def codebook_array(codebooks: DataFrame) -> np.ndarray:
    """Codebooks as ``[sub, code, component]``."""
    table = codebooks.orderBy("sub", "code").select("sub", "code", "centroid").toArrow()
    subs = len(set(table.column("sub").to_pylist()))
    return arrow_matrix(table.column("centroid")).reshape(subs, table.num_rows // subs, -1)


def codebook_frame(spark: SparkSession, books: np.ndarray) -> DataFrame:
    rows = [
        (sub, code, [float(x) for x in word]) for sub, book in enumerate(books) for code, word in enumerate(book)
    ]
    return spark.createDataFrame(rows, "sub int, code int, centroid array<double>")


def sub_distances(data: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distance of each subvector to each codeword: ``[sub, row, code]``."""
    subs, _, width = books.shape
    cut = data.reshape(len(data), subs, width).transpose(1, 0, 2)
    squares = (cut**2).sum(axis=2)[:, :, None] + (books**2).sum(axis=2)[:, None, :]
    return np.round(np.maximum(squares - 2.0 * (cut @ books.transpose(0, 2, 1)), 0.0), DISTANCE_DECIMALS)


def nearest_codes(data: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codeword of each subvector, the lower code on ties: ``[row, sub]``."""
    step = max(1, _SLICE_CELLS // (books.shape[0] * books.shape[1]))
    parts = [sub_distances(data[i : i + step], books).argmin(axis=2).T for i in range(0, len(data), step)]
    return np.concatenate(parts)


def partial_sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Assign and add up every subspace in one job: ``sub, code, n, total``."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        subs, codes, size = words.shape
        totals, counts = np.zeros((subs * codes, size)), np.zeros(subs * codes, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                data = arrow_matrix(batch.column("values"))
                slot = (nearest_codes(data, words) + np.arange(subs) * codes).ravel()
                np.add.at(totals, slot, data.reshape(-1, size))
                counts += np.bincount(slot, minlength=subs * codes)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((seen // codes).astype(np.int32)),
                    pa.array((seen % codes).astype(np.int32)),
                    pa.array(counts[seen]),
                    pa.array(totals[seen].tolist(), type=pa.list_(pa.float64())),
                ],
                names=["sub", "code", "n", "total"],
            )

    return (
        vectors.select("values")
        .mapInArrow(partial, "sub int, code int, n long, total array<double>")
        .groupBy("sub", "code")
        .agg(F.sum("n").alias("n"), sum_vector(F.col("total"), books.shape[2]).alias("total"))
    )


def pq_step(vectors: DataFrame, codebooks: DataFrame) -> DataFrame:
    """One Lloyd step of every subspace in a single job."""
    sums = partial_sums(vectors, codebook_array(codebooks))
    moved = F.transform("total", lambda x: F.round(x / F.col("n"), CENTROID_DECIMALS))
    return codebooks.join(sums, ["sub", "code"], "left").select(
        "sub", "code", F.when(F.col("n").isNull(), F.col("centroid")).otherwise(moved).alias("centroid")
    )


def first_codebooks(vectors: DataFrame, m: int, ks: int, order: list) -> DataFrame:
    """Start codebooks: the subvectors of the first ``ks`` rows in ``order``."""
    start = arrow_matrix(vectors.orderBy(*order).limit(ks).select("values").toArrow().column("values"))
    if start.shape[1] % m:
        raise ValueError(f"width {start.shape[1]} does not divide into {m} subspaces")
    books = start.reshape(len(start), m, -1).transpose(1, 0, 2)
    return codebook_frame(vectors.sparkSession, books)


def train_pq(
    vectors: DataFrame,
    m: int = SUBSPACES,
    ks: int = CODEWORDS,
    iterations: int = ITERATIONS,
    sample: int | None = None,
) -> DataFrame:
    """Per-subspace codebooks over all rows, or over ``sample`` of them."""
    rows = vectors.select("id", "values")
    chosen = checkpointed(rows if sample is None else train_sample(rows, max(sample, ks)))
    books = codebook_array(first_codebooks(chosen, m, ks, hash_order(chosen)))
    for _ in range(iterations):
        sums = partial_sums(chosen, books).toArrow()
        if sums.num_rows:
            means = arrow_matrix(sums.column("total")) / sums.column("n").to_numpy()[:, None]
            books = books.copy()
            books[sums.column("sub").to_numpy(), sums.column("code").to_numpy()] = np.round(means, CENTROID_DECIMALS)
    return codebook_frame(vectors.sparkSession, books)


def encode_pq(vectors: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Add ``codes``: one small integer per subspace, with no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebook_array(codebooks))

    @F.arrow_udf("array<smallint>")
    def encode(values: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], type=pa.list_(pa.int16()))
        codes = answered_in_slices(values, lambda data: nearest_codes(data, shared.value)).astype(np.int16)
        offsets = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))

    return vectors.withColumn("codes", encode("values"))


def scan_codes(
    queries: DataFrame, index: DataFrame, codebooks: DataFrame, pool: int, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Top-``pool`` per query by code distance; only ``id, codes`` are read."""
    spark = index.sparkSession
    schema = result_schema(queries, index)
    block = bounded_block(queries, budget)
    if block is None:
        return join_codes(queries, index, codebooks, pool, budget)
    shared = spark.sparkContext.broadcast((block.ids, block.matrix, codebook_array(codebooks)))
    arrow = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, books = shared.value
        best = BestK(len(matrix), pool)
        for batch in batches:
            if batch.num_rows and len(matrix):
                add_codes(best, matrix, np.arange(len(matrix)), arrow_matrix(batch.column("codes")), arrow_ids(batch.column("id")), books)
        yield from _best_batch(best, query_ids, arrow)

    return merge_best(in_tasks(index.select("id", "codes"), len(block.ids)).mapInArrow(scan, schema), pool)


def add_codes(best: BestK, queries: np.ndarray, which: np.ndarray, codes: np.ndarray, ids: np.ndarray, books: np.ndarray) -> None:
    """Offer coded rows to the queries ``which[i]`` at ``queries[i]``.

    The distance to the vector that a code stands for is, but for roundings, the
    sum of its table entries; so one product finds what may enter a list, and
    entries are added up for that alone.
    """
    codes = codes.astype(np.int64)
    subs, words, _ = books.shape
    decoded = NearVectors(decoded_rows(codes, books))
    step = max(1, min(_BLOCK_CELLS // (subs * words), decoded.query_step()))
    for start in range(0, len(which), step):
        block, part, table = queries[start : start + step], which[start : start + step], None
        for some, near, less, slack in decoded.products(block):
            row, col = best.candidates(part, near, slack + _code_slack(books), less)
            if len(row):
                table = sub_distances(block, books) if table is None else table
                best.offer(part[row], code_sums(table, row, codes[some], col), ids[some][col])


def decoded_rows(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    return books[np.arange(len(books))[None, :], codes].reshape(len(codes), -1)


def _code_slack(books: np.ndarray) -> float:
    """Twice what rounding the entries of a sum, and the sum, can change."""
    return (len(books) + 1) * 10.0**-DISTANCE_DECIMALS


def code_sums(table: np.ndarray, row: np.ndarray, codes: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Sum of the table entries of query ``row[i]`` for the code ``col[i]``, rounded."""
    total = np.zeros(len(row))
    for sub in range(len(table)):
        total += table[sub][row, codes[col, sub]]
    return np.round(total, DISTANCE_DECIMALS)


def join_codes(queries: DataFrame, index: DataFrame, codebooks: DataFrame, pool: int, budget: int = BROADCAST_BYTES, centroids=None) -> DataFrame:
    """The same scan when the queries do not fit the budget: blocks are paired by a shuffle.

    With ``centroids`` (sorted ids, matrix), queries have ``cells`` and codes are of residuals.
    """
    schema = result_schema(queries, index)
    kind = _arrow_schema(schema).field("id").type
    sent = index.sparkSession.sparkContext.broadcast((codebook_array(codebooks), centroids))

    def meet(block: np.ndarray, pairs: list, part: pa.Table) -> tuple:
        best, codes, ids = BestK(len(block), pool), arrow_matrix(part.column("codes")), arrow_ids(part.column("id"))
        books, centres = sent.value
        for cell, which, here in pairs:
            add_codes(best, _to_centre(block[which], centres, cell), which, codes[here], ids[here], books)
        query, dist, names = best.found()
        return query, [arrow_names(names, kind), pa.array(dist)]

    homed = centroids is not None
    queries = queries.select("id", "values", *(["cells"] if homed else []))
    partial = pair_blocks(queries, index.select("id", "codes", *(["cell"] if homed else [])), pool, schema, budget, meet, ("codes",))
    return merge_best(partial, pool)


def _to_centre(queries: np.ndarray, centroids, cell: int) -> np.ndarray:
    return queries if centroids is None else queries - centroids[1][np.searchsorted(centroids[0], cell)]


def rescored_search(
    queries: DataFrame, index: DataFrame, codebooks: DataFrame, k: int, pool: int, budget: int = BROADCAST_BYTES, centroids=None, pools: DataFrame | None = None
) -> DataFrame:
    """``qid, rank, id, distance``: the first ``k`` by exact distance among the first ``pool`` by code.

    Where a block of queries meets a block of coded vectors, the task ranks by
    code, measures what its pools hold, and emits both distances, so no candidate
    is joined with its vector or its query later. A pool that has room for the
    whole index leaves out no row of any block; each block's pool is then ranked
    where it lies and only its first ``k`` are emitted, so that the pools never
    are rows of a table. With ``centroids`` (sorted ids, matrix), queries have
    ``cells`` and codes are of residuals; ``pools`` (``qid, _pool``) are smaller
    pools of single queries.
    """
    whole = pool >= index.count()
    sent = index.sparkSession.sparkContext.broadcast((codebook_array(codebooks), centroids))
    schema = T.StructType([*result_schema(queries, index).fields, T.StructField("exact", T.DoubleType())])

    def meet(block: np.ndarray, pairs: list, part: pa.Table) -> tuple:
        books, centres = sent.value
        vectors, codes, ids = arrow_matrix(part.column("values")), arrow_matrix(part.column("codes")).astype(np.int64), arrow_ids(part.column("id"))
        # Rows are numbered in the order of their ids, so that ties go to the lower id.
        by_id = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), dtype=np.int64)
        number[by_id] = np.arange(len(ids))
        best = BestK(len(block), k if whole else pool)
        for cell, which, here in pairs:
            asked = _to_centre(block[which], centres, cell)
            if whole:
                _add_pooled(best, block, asked, which, vectors[here], _to_centre(vectors[here], centres, cell), codes[here], number[here], books)
            else:
                add_codes(best, asked, which, codes[here], number[here], books)
        query, dist, names = best.found()
        row = by_id[names]
        exact = dist if whole else _measured(block, query, vectors, row)
        return query, [part.column("id").combine_chunks().take(pa.array(row)), pa.array(dist), pa.array(exact)]

    columns = ("values", "codes")
    homed = centroids is not None
    queries, rows = queries.select("id", "values", *(["cells"] if homed else [])), index.select("id", *columns, *(["cell"] if homed else []))
    partial = pair_blocks(queries, rows, k if whole else pool, schema, budget, meet, columns)
    if not whole:
        partial = top_k(partial, ["qid"], [F.col("distance"), F.col("id")], pool)
        partial = partial if pools is None else partial.join(pools, "qid").filter(F.col("rank") <= F.col("_pool"))
    exact = partial.select("qid", "id", F.col("exact").alias("distance"))
    return top_k(exact, ["qid"], [F.col("distance"), F.col("id")], k).select("qid", "rank", "id", "distance")


def _measured(queries: np.ndarray, row: np.ndarray, vectors: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distance of ``queries[row[i]]`` to ``vectors[col[i]]``, from the differences, rounded."""
    out, step = np.empty(len(row)), max(1, _BLOCK_CELLS // max(1, queries.shape[1]))
    for low in range(0, len(row), step):
        gap = queries[row[low : low + step]] - vectors[col[low : low + step]]
        out[low : low + step] = np.einsum("ij,ij->i", gap, gap)
    return np.round(out, DISTANCE_DECIMALS)


def _add_pooled(
    best: BestK, block: np.ndarray, asked: np.ndarray, which: np.ndarray, vectors: np.ndarray, coded: np.ndarray, codes: np.ndarray, names: np.ndarray, books: np.ndarray
) -> None:
    """Offer by exact distance the rows of a pool that holds them all.

    ``coded`` is what the codes stand for but for an error. A row is as far as its
    code less that error at least, so only queries whose lists some code may still
    change have their exact distances to these rows found.
    """
    words = decoded_rows(codes, books)
    error = np.sqrt(row_squares(coded - words))
    decoded, exact = NearVectors(words), NearVectors(vectors)
    step = exact.query_step()
    for start in range(0, len(which), step):
        part, query = which[start : start + step], asked[start : start + step]
        own = block[part]
        by_code, by_vector = decoded.products(query), exact.cut(own)
        for some, near, less, slack in by_code:
            reach = (np.sqrt(best.bound[part] + _ROUNDING) + error[some].max()) ** 2 * (1 + _PRODUCT_ERROR)
            open_ = np.flatnonzero(~(near.min(axis=1) > reach + slack - less))
            if not len(open_):
                continue
            near, less, slack = by_vector(some, open_)
            row, col = best.candidates(part[open_], near, slack, less)
            if len(row):
                row, col = open_[row], col + some.start
                best.offer(part[row], _measured(own, row, vectors, col), names[col])


def decode_pq(index: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Replace ``values`` by the vector its codes stand for."""
    shared = index.sparkSession.sparkContext.broadcast(codebook_array(codebooks))

    @F.arrow_udf("array<double>")
    def decode(codes: pa.Array) -> pa.Array:
        books = shared.value
        rows = arrow_matrix(codes).astype(np.int64)
        words = books[np.arange(len(books))[None, :], rows].reshape(len(rows), -1)
        return pa.array(list(words), type=pa.list_(pa.float64()))

    return index.withColumn("values", decode("codes"))


# More candidates than this are measured where the codes are, not by joins.
_JOINED_PAIRS = 300_000


def default_pool(k: int) -> int:
    return max(10 * k, 100)


def pq_search(
    queries: DataFrame,
    index: DataFrame,
    codebooks: DataFrame,
    k: int,
    rescore: int = 0,
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Scan codes for candidates, then rank them by exact distance.

    ``rescore``: 0 takes the default pool, a positive number is the pool size,
    a negative number returns the code ranking itself.
    """
    if rescore < 0:
        return scan_codes(queries, index, codebooks, k, budget).select("qid", "rank", "id", "distance")
    pool = max(k, rescore or default_pool(k))
    asked, width = queries.count(), vector_width(queries)
    if asked * pool > min(_JOINED_PAIRS, budget // 64):
        return rescored_search(queries, index, codebooks, k, pool, budget)
    found = scan_codes(queries, index, codebooks, pool, budget).select("qid", "id")
    ask = queries.select(F.col("id").alias("qid"), F.col("values").alias("_query"))
    # Candidates number queries times pool; while that is small the stored
    # vectors are filtered where they lie.
    exact = (
        index.select("id", "values")
        .join(broadcast_within(found, asked * pool, 64), "id")
        .join(broadcast_within(ask, asked, 8 * width + 64), "qid")
        .select(
            "qid", "id", F.round(squared_l2(F.col("_query"), F.col("values")), DISTANCE_DECIMALS).alias("distance")
        )
    )
    return top_k(exact, ["qid"], [F.col("distance"), F.col("id")], k).select("qid", "rank", "id", "distance")
