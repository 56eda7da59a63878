"""Postings and BM25."""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.functions.rows import explode_rows
from passim.functions.text import token_counts, tokenize
from passim.operators.ranking import top_k
from passim.session import BROADCAST_BYTES, broadcast_within, checkpointed

# BM25 parameters (Robertson and Zaragoza 2009).
K1, B = 1.2, 0.75
SCORE_DECIMALS = 6
# Postings that one task sorts, whatever the size of the collection.
TASK_POSTINGS = 1_000_000
# Pairs of a query and a posting, or of a query and a passage, held at once.
_PAIRS = 1_000_000


def passage_tokens(passages: DataFrame, stop_words: list[str] | None = None, title_weight: int = 0) -> DataFrame:
    """``id, tokens`` with the title's tokens repeated ``title_weight`` times."""
    tokens = tokenize(F.col("text"), stop_words)
    if title_weight:
        title = tokenize(F.col("title"), stop_words)
        tokens = F.concat(tokens, F.flatten(F.array_repeat(title, title_weight)))
    return passages.select("id", tokens.alias("tokens"))


def build_postings(passages: DataFrame, stop_words: list[str] | None = None, title_weight: int = 0) -> DataFrame:
    """``term, id, tf, dl``: map-only, as terms are counted inside the row.

    The passage length ``dl`` is stored with each posting, so that scoring
    needs no join with a table of passages.
    """
    rows = passage_tokens(passages, stop_words, title_weight)
    counted = rows.select("id", F.size("tokens").cast("long").alias("dl"), token_counts(F.col("tokens")).alias("c"))
    entries = explode_rows(counted, ["id", "dl"], F.col("c"), "e")
    return entries.select("e.term", "id", "e.tf", "dl")


def document_lengths(passages: DataFrame, stop_words: list[str] | None = None, title_weight: int = 0) -> DataFrame:
    """``id, dl`` without a shuffle."""
    rows = passage_tokens(passages, stop_words, title_weight)
    return rows.select("id", F.size("tokens").cast("long").alias("dl"))


def collection_stats(lengths: DataFrame) -> DataFrame:
    """One row: ``n_docs, avgdl``."""
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def write_postings(postings: DataFrame, path: str, most: float | None = None) -> None:
    """Store postings in term order, so a reader of few terms skips row groups.

    Range partitioning by ``term, id`` splits a hot term over several files.
    ``most``, a bound for the number of postings such as the sum of all lengths,
    makes as many files as keep what a task sorts small; there are
    ``spark.sql.shuffle.partitions`` at least.
    """
    files = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(files, -(-int(most or 0) // TASK_POSTINGS))
    ordered = postings.repartitionByRange(files, "term", "id").sortWithinPartitions("term", "id")
    ordered.write.mode("overwrite").parquet(path)


def query_terms(queries: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Distinct terms per query: ``qid, term``."""
    terms = F.array_distinct(tokenize(F.col("text"), stop_words))
    return explode_rows(queries, ["qid"], terms, "term")


def document_frequencies(postings: DataFrame) -> DataFrame:
    """``term, df``; may be stored beside the postings."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def bm25(
    queries: DataFrame,
    postings: DataFrame,
    stats: DataFrame,
    k: int,
    frequencies: DataFrame | None = None,
    stop_words: list[str] | None = None,
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Top-k by BM25: ``qid, rank, id, score``. Ties go to the lower id.

    Postings meet the query terms before anything is shuffled; a passage with
    none of the terms never appears. ``stats`` is the row of
    :func:`collection_stats`. The postings of a passage are brought together
    once and scored there for all queries: of a task only the first ``k`` of
    each query go on, never a row for each query and passage. Queries whose
    terms exceed the budget are answered batch by batch.
    """
    asked = query_terms(queries, stop_words)
    if frequencies is None:
        terms = checkpointed(asked.select("term").distinct())
        frequencies = document_frequencies(postings.join(broadcast_within(terms, terms.count(), 128), "term", "left_semi"))
    # The one row of collection statistics enters as a scalar subquery.
    n, df, avgdl = stats.select("n_docs").scalar(), F.col("df"), stats.select("avgdl").scalar()
    idf = F.log(1.0 + (n - df + 0.5) / (df + 0.5))
    weighted = asked.join(frequencies, "term").groupBy("qid", "term").agg(F.sum(idf).alias("idf"), F.max("df").alias("df"))
    weighted = checkpointed(weighted)
    tf = F.col("tf").cast("double")
    gain = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("dl") / avgdl))
    # Weighted terms, and the scores that a task holds for each query.
    held = max(128 * weighted.count(), 16 * k * weighted.select("qid").distinct().count())
    parts = max(1, -(-held // max(1, budget)))
    found = []
    for part in range(parts):
        some = weighted.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
        found.append(_scored(some, postings.select("term", "id", gain.alias("gain")), queries, k))
    scored = reduce(DataFrame.unionByName, found)
    return top_k(scored, ["qid"], [F.col("score").desc(), F.col("id")], k).select("qid", "rank", "id", "score")


def _scored(weighted: DataFrame, postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, id, score`` of passages among which are the first k of each query, for one batch of weighted terms."""
    spark = weighted.sparkSession
    table = weighted.toArrow()
    coded = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("qid", "term")]
    (qids, query), (terms, term) = ((c.dictionary, np.asarray(c.indices).astype(np.int64)) for c in coded)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(terms) + 1))
    sent = spark.sparkContext.broadcast((len(qids), starts, query[order], np.asarray(table.column("idf"))[order]))
    named = spark.createDataFrame(pa.table({"term": pa.array(terms.to_pylist(), pa.string()), "t": pa.array(range(len(terms)), pa.int64())}))
    held = weighted.groupBy("term").agg(F.max("df").alias("df")).agg(F.sum("df")).first()[0] or 0
    tasks = max(min(spark.sparkContext.defaultParallelism, held // 10_000 + 1), -(-held // TASK_POSTINGS))
    rows = postings.join(F.broadcast(named), "term").select("t", "id", "gain")
    rows = rows.repartition(int(tasks), "id").sortWithinPartitions("id")
    kind = postings.schema["id"].dataType.simpleString()
    best = rows.mapInArrow(_first_of_task(sent, k), f"q long, id {kind}, score double")
    names = spark.createDataFrame(pa.table({"q": pa.array(range(len(qids)), pa.int64()), "qid": qids}))
    names = names.select("q", F.col("qid").cast(queries.schema["qid"].dataType).alias("qid"))
    return best.join(F.broadcast(names), "q").select("qid", "id", "score")


def _first_of_task(sent, k: int) -> Callable:
    """Of postings ``t, id, gain`` sorted by id, the passages that can be among the first k of a query.

    Ids rise, so a passage that only ties with the k-th score so far is behind
    it. A passage may go on in the next batch: its scores so far are carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, starts, queries, weights = sent.value
        best = np.full((count, k), -np.inf)
        # The passage that is still open: its id, and of each query the score and whether there is one.
        open_id, score, met = None, np.zeros(count), np.zeros(count, dtype=bool)

        def give(ids: pa.Array, total: np.ndarray, some: np.ndarray) -> Iterator[pa.RecordBatch]:
            total = np.where(some, np.round(total, SCORE_DECIMALS), -np.inf)
            # Of queries that a passage gains by, the first k of these passages.
            live = np.flatnonzero((total > best[:, :1]).any(axis=1))
            if not len(live):
                return
            order = np.argsort(-total[live], axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(total[live], order, axis=1)
            row, col = np.nonzero(top > best[live, :1])
            best[live] = np.sort(np.concatenate([best[live], top], axis=1), axis=1)[:, -k:]
            yield pa.RecordBatch.from_arrays([pa.array(live[row]), ids.take(pa.array(order[row, col])), pa.array(top[row, col])], names=["q", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, ids, gain = (batch.column(c) for c in ("t", "id", "gain"))
            t, gain = np.asarray(t), np.asarray(gain)
            number = np.asarray(ids.dictionary_encode(null_encoding="encode").indices).astype(np.int64)
            fresh = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1])
            doc = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(number))))
            widths = starts[t + 1] - starts[t]
            pairs = np.concatenate([[0], np.cumsum(widths)])
            low = 0
            while low < len(t):
                last = min(len(fresh), doc[low] + max(1, _PAIRS // max(1, count)))
                high = min(int(np.searchsorted(pairs, pairs[low] + _PAIRS, side="right")) - 1, int(fresh[last]) if last < len(fresh) else len(t))
                high = max(high, low + 1)
                own = slice(low, high)
                docs = int(doc[high - 1] - doc[low] + 1)
                # A line for each query of each posting's term.
                line = np.repeat(np.arange(low, high), widths[own])
                at = np.arange(len(line)) + np.repeat(starts[t[own]] - (pairs[low:high] - pairs[low]), widths[own])
                place = queries[at] * docs + (doc[line] - doc[low])
                total = np.bincount(place, weights[at] * gain[line], count * docs).reshape(count, docs)
                some = np.zeros(count * docs, dtype=bool)
                some[place] = True
                some = some.reshape(count, docs)
                here = ids.take(pa.array(fresh[doc[low] : doc[high - 1] + 1]))
                if open_id is not None and open_id[0].as_py() == here[0].as_py():
                    total[:, 0] += score
                    some[:, 0] |= met
                elif open_id is not None:
                    yield from give(open_id, score[:, None], met[:, None])
                open_id, score, met = here.slice(docs - 1), total[:, -1].copy(), some[:, -1].copy()
                if docs > 1:
                    yield from give(here.slice(0, docs - 1), total[:, :-1], some[:, :-1])
                low = high
        if open_id is not None:
            yield from give(open_id, score[:, None], met[:, None])

    return run
