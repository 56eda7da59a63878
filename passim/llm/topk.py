"""Exact top-k search with a uniform threshold in three phases."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passim.session import BROADCAST_BYTES, checkpointed

SCALE = 1024
# Parts of a vector that each have a list of partial scores.
PARTS = 2
# Scores of one block that a task holds at once.
BLOCK_SCORES = 4_000_000


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id`` and ``v``: each component ``floor(scale * x)`` as a whole number.

    Rows whose id or vector is null, whose vector is empty, or which hold a
    null or non-finite component, take no part.
    """
    x = F.transform(F.col(f"`{embedding}`"), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & (F.size("x") > 0) & good)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrices(ids: np.ndarray, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each width."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    widths = np.diff(offsets)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield ids[rows], flat[offsets[rows][:, None] + np.arange(width)]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products; in floating point while that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _parts(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(PARTS, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _against(block: dict[int, tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Query ids and vectors of a block beside each part of the batches of the same width."""
    for batch in batches:
        for ids, v in _matrices(np.asarray(batch.column(0)), batch.column(1)):
            if v.shape[1] in block:
                queries, q = block[v.shape[1]]
                step = max(1, BLOCK_SCORES // len(queries))
                for s in range(0, len(ids), step):
                    yield queries, q, ids[s : s + step], v[s : s + step]


def _gather(sent, k: int):
    """Phase one: of each query, the k highest scores among the rows that lead a
    list of partial scores here. They are scores of real rows, so the k-th of
    all of them is a safe cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for queries, q, ids, v in _against(sent.value, batches):
            lead = []
            for part in _parts(q.shape[1]):
                partial = _product(v[:, part], q[:, part])
                n = len(partial)
                lead.append(np.argpartition(partial, max(0, n - k - 1), axis=0)[max(0, n - k - 1) :])
            rows = np.sort(np.concatenate(lead), axis=0)
            total = np.einsum("rqd,qd->rq", v[rows], q)
            again = np.concatenate([np.zeros((1, rows.shape[1]), bool), rows[1:] == rows[:-1]])
            total[again | (ids[rows] == queries[None, :])] = np.iinfo(np.int64).min
            for j, query in enumerate(queries.tolist()):
                held[query] = np.sort(np.concatenate([held.get(query, total[:0, j]), total[:, j]]))[-k:]
        found = {x: s[s > np.iinfo(np.int64).min].tolist() for x, s in held.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["query_id", "scores"]
        )

    return run


def _collect(sent, cutoffs, k: int):
    """Phases two and three: a row whose score reaches the cutoff has a partial
    score of at least the cutoff over the number of parts. Those entries are
    collected and their whole scores resolved where the vector lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        least = np.iinfo(np.int64).min
        for queries, q, ids, v in _against(sent.value, batches):
            cut = np.array([cutoffs.value.get(x, least) for x in queries.tolist()], dtype=np.int64)
            parts = _parts(q.shape[1])
            share = -(-cut // len(parts))
            share[cut == least] = least
            some = np.zeros((len(v), len(q)), dtype=bool)
            for part in parts:
                some |= _product(v[:, part], q[:, part]) >= share[None, :]
            row, col = np.nonzero(some & (ids[:, None] != queries[None, :]))
            for s in range(0, len(row), BLOCK_SCORES // 16):
                r, c = row[s : s + BLOCK_SCORES // 16], col[s : s + BLOCK_SCORES // 16]
                score = np.einsum("ed,ed->e", v[r], q[c])
                keep = score >= cut[c]
                r, c, score = r[keep], c[keep], score[keep]
                for j in np.unique(c).tolist():
                    own, old = c == j, held.get(int(queries[j]), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    i, x = np.concatenate([old[0], ids[r[own]]]), np.concatenate([old[1], score[own]])
                    order = np.lexsort((i, -x))[:k]
                    held[int(queries[j])] = i[order], x[order]
        out = [(query, i, x) for query, (many, scores) in held.items() for i, x in zip(many.tolist(), scores.tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, block_bytes: int = BROADCAST_BYTES // 4) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest inner product.

    Both sides come from ``quantized``. A row is never its query's own result
    (same id); equal scores go to the smaller id. Repeated ids count as rows of
    their own; of queries with one id, that with the least vector is asked. Vectors of another width are no candidates. A query with
    fewer candidates gets all of them.

    Queries are sent out in blocks of at most ``block_bytes``, each block
    against all rows; with the cutoff known, a block's last shuffle carries
    little more than its k rows for each query.
    """
    spark = queries.sparkSession
    queries = checkpointed(queries.groupBy("id").agg(F.min("v").alias("v")))
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v") * 8 + 16).alias("bytes")).first()
    blocks = -(-(size["bytes"] or 0) // block_bytes)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))))
    found = None
    for b in range(max(1, blocks)):
        own = dealt.where(F.col("block") == b).select("id", "v").toArrow()
        # Plain arrays by width of the vectors: a class would have to be installed where they are read.
        matrices = _matrices(np.asarray(own.column("id").combine_chunks()), own.column("v"))
        block = spark.sparkContext.broadcast({v.shape[1]: (ids, v) for ids, v in matrices})
        scores = vectors.select("id", "v").mapInArrow(_gather(block, k), "query_id long, scores array<long>")
        top = Window.partitionBy("query_id").orderBy(F.desc("s"))
        ranked = scores.select("query_id", F.explode("scores").alias("s")).withColumn("r", F.row_number().over(top))
        # One row for each query of the block comes back.
        cut = {r["query_id"]: r["s"] for r in ranked.where(F.col("r") == k).select("query_id", "s").collect()}
        entries = vectors.select("id", "v").mapInArrow(
            _collect(block, spark.sparkContext.broadcast(cut), k), "query_id long, vec_id long, score long"
        )
        found = entries if found is None else found.unionByName(entries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
