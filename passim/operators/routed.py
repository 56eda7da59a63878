"""Compressed search inside probed cells.

The code of a stored row is that of its residual: the vector less the centroid of
its cell. A query meets a cell through its own residual to that centroid, so each
(query, cell) pair has its own table of distances to the codewords, and a row's
distance is a sum of table entries. Codes of unprobed cells are never read; of
the vectors themselves only those of the candidates count.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.functions.vector import squared_l2
from passim.operators.cells import ITERATIONS, default_nprobe, in_probed_cells, request_probes, with_cells
from passim.operators.codes import _JOINED_PAIRS, CODEWORDS, SUBSPACES, add_codes, codebook_array, encode_pq, join_codes, rescored_search, train_pq
from passim.operators.nearest import (
    DISTANCE_DECIMALS,
    BestK,
    _arrow_schema,
    _best_batch,
    arrow_ids,
    arrow_matrix,
    merge_best,
    result_schema,
    vector_width,
)
from passim.operators.ranking import top_k
from passim.session import BROADCAST_BYTES, broadcast_within, checkpointed

# Hits asked for and pool scanned for exact ranking, unless said.
DEFAULT_K, LEAST_POOL, POOL_PER_HIT = 8, 100, 10


def residuals(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """``values`` less the centroid of the row's ``cell``."""
    centres = centroids.select(F.col("id").alias("cell"), F.col("values").alias("_centre"))
    sent = broadcast_within(centres, centroids.count(), 8 * vector_width(centroids) + 64)
    moved = F.zip_with("values", "_centre", lambda x, c: x.cast("double") - c.cast("double"))
    return rows.join(sent, "cell").withColumn("values", moved).select(*rows.columns)


def train_residual_pq(
    index: DataFrame, centroids: DataFrame, m: int = SUBSPACES, ks: int = CODEWORDS, iterations: int = ITERATIONS, sample: int | None = None
) -> DataFrame:
    """Codebooks of the residuals of all rows, or of ``sample`` of them."""
    rows = residuals(index.select("id", "values", "cell"), centroids)
    return train_pq(rows, m, ks, iterations, sample)


def encode_residuals(index: DataFrame, centroids: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Add ``codes`` of the residual; ``values`` stay as they are."""
    kept = [c for c in index.columns if c != "codes"]
    rows = residuals(index.select(*kept, F.col("values").alias("_exact")), centroids)
    coded = encode_pq(rows, codebooks)
    return coded.select(*[F.col("_exact").alias(c) if c == "values" else F.col(c) for c in kept], "codes")


def settle(requests: DataFrame, nlist: int) -> DataFrame:
    """``id, values, k, nprobe, pool, exact`` with the defaults filled in.

    ``k`` null means 8; ``nprobe`` null or 0 a quarter of the cells; ``rescore``
    null or 0 ten times ``k`` but 100 at least. A negative ``rescore`` asks for
    the ranking by code distance itself.
    """
    given = lambda name, kind: F.col(name) if name in requests.columns else F.lit(None).cast(kind)
    k = F.coalesce(given("k", "int"), F.lit(DEFAULT_K)).cast("int")
    nprobe, rescore = F.coalesce(given("nprobe", "int"), F.lit(0)), F.coalesce(given("rescore", "int"), F.lit(0))
    pool = F.when(rescore > 0, F.greatest(k, rescore)).when(rescore < 0, k).otherwise(F.greatest(k * POOL_PER_HIT, F.lit(LEAST_POOL)))
    return requests.select(
        "id",
        "values",
        k.alias("k"),
        F.least(F.when(nprobe > 0, nprobe).otherwise(default_nprobe(nlist)), F.lit(nlist)).cast("int").alias("nprobe"),
        pool.cast("int").alias("pool"),
        (rescore >= 0).alias("exact"),
    )


def scan_probed_codes(routed: DataFrame, rows: DataFrame, codebooks: DataFrame, pool: int) -> DataFrame:
    """Top ``pool`` by code distance: ``qid, rank, id, distance``.

    ``routed`` has a row for each query and probed cell, ``id, cell, values`` (the
    residual), and fits the budget.
    """
    spark, schema = rows.sparkSession, result_schema(routed, rows)
    books = codebook_array(codebooks)
    table = routed.select("id", "cell", "values").toArrow()
    cells = table.column("cell").combine_chunks().to_numpy()
    order = np.argsort(cells, kind="stable")
    named = table.column("id").combine_chunks()
    names = pc.unique(named)
    numbers = pc.index_in(named, value_set=names).to_numpy().astype(np.int64)
    shared = spark.sparkContext.broadcast((names, cells[order], numbers[order], arrow_matrix(table.column("values"))[order], books))
    arrow = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, routes, query, residual, words = shared.value
        best = BestK(len(query_ids), pool)
        for batch in batches:
            if not batch.num_rows or not len(routes):
                continue
            codes, ids = arrow_matrix(batch.column("codes")), arrow_ids(batch.column("id"))
            home = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(home):
                low, high = np.searchsorted(routes, [cell, cell + 1])
                if high > low:
                    here = home == cell
                    add_codes(best, residual[low:high], query[low:high], codes[here], ids[here], words)
        yield from _best_batch(best, query_ids, arrow)

    return merge_best(rows.select("id", "codes", "cell").mapInArrow(scan, schema), pool)


def search_routed(requests: DataFrame, index: DataFrame, centroids: DataFrame, codebooks: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """Compressed search, each request with its own settings: ``qid, rank, id, distance``.

    ``requests``: ``id, values`` and, as wanted, ``k, nprobe, rescore`` (see
    :func:`settle`). ``index``: ``id, values, cell, codes`` with codes of
    residuals; stored by cell, only probed folders are opened, and the vectors
    are read for candidates alone. Distances are exact after a rescore and code
    distances without. Ties go to the lower id.
    """
    asked = checkpointed(settle(requests, centroids.count()))
    limits = asked.agg(F.max("nprobe"), F.max("pool"), F.count("*"), F.sum(F.when(F.col("exact"), F.col("pool")))).first()
    most, pool, count, pooled = limits[0] or 1, limits[1] or 1, limits[2], limits[3] or 0
    probes = checkpointed(request_probes(asked, centroids, most, budget))
    rows, width = in_probed_cells(index, probes), vector_width(asked)
    if probes.count() * (8 * width + 64) > budget or pooled > min(_JOINED_PAIRS, budget // 64):
        return _search_paired(asked, probes, rows, centroids, codebooks, budget)
    routed = asked.select("id", "values").join(probes.withColumnRenamed("qid", "id"), "id")
    routed = residuals(routed.select("id", "cell", "values"), centroids)
    limit = asked.select(F.col("id").alias("qid"), "k", "pool", "exact")
    found = scan_probed_codes(routed, rows.select("id", "codes", "cell"), codebooks, pool)
    found = checkpointed(found.join(limit, "qid").filter(F.col("rank") <= F.col("pool")))
    by_code = found.filter("not exact").select("qid", "rank", "id", "distance")
    if not pooled:
        return by_code
    wanted = found.filter("exact").select("qid", "id", "k")
    ask = asked.select(F.col("id").alias("qid"), F.col("values").alias("_query"))
    exact = (
        rows.select("id", "values")
        .join(broadcast_within(wanted, pooled, 64), "id")
        .join(broadcast_within(ask, count, 8 * width + 64), "qid")
        .select("qid", "k", "id", F.round(squared_l2(F.col("_query"), F.col("values")), DISTANCE_DECIMALS).alias("distance"))
    )
    ranked = top_k(exact, ["qid"], [F.col("distance"), F.col("id")], asked.agg(F.max("k")).first()[0])
    return ranked.filter(F.col("rank") <= F.col("k")).select("qid", "rank", "id", "distance").unionByName(by_code)


def _search_paired(asked: DataFrame, probes: DataFrame, rows: DataFrame, centroids: DataFrame, codebooks: DataFrame, budget: int) -> DataFrame:
    """The same where the probes, or the pools, are beyond the budget.

    Requests go, once for each block of the probed cells' rows, to where the rows
    are; residuals are made there, and candidates measured. Requests are taken by
    what they ask for, since a pool that holds all rows is never stored.
    """
    table = centroids.select(F.col("id").cast("int").alias("id"), "values").orderBy("id").toArrow()
    centres = table.column("id").to_numpy().astype(np.int64), arrow_matrix(table.column("values"))
    asked = checkpointed(asked.drop("cells").join(with_cells(asked, probes).select("id", "cells"), "id"))
    count = rows.count()
    kinds = [F.col("exact") & (F.col("pool") >= count), F.col("exact") & (F.col("pool") < count), ~F.col("exact")]
    out = []
    for i, kind in enumerate(kinds):
        some = asked.filter(kind)
        k, pool, least = some.agg(F.max("k"), F.max("pool"), F.min("pool")).first()
        if k is None:
            continue
        if i == 2:
            hits = join_codes(some, rows, codebooks, k, budget, centres)
        elif least == pool or i == 0:
            hits = rescored_search(some, rows, codebooks, k, pool, budget, centres)
        else:
            hits = rescored_search(some, rows, codebooks, k, pool, budget, centres, some.select(F.col("id").alias("qid"), F.col("pool").alias("_pool")))
        hits = hits.join(some.select(F.col("id").alias("qid"), "k"), "qid").filter(F.col("rank") <= F.col("k"))
        out.append(hits.select("qid", "rank", "id", "distance"))
    return reduce(DataFrame.unionByName, out)
