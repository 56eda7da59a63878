"""Scoring result lists against judged queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.operators.ranking import exact_median

# The cut-offs of the published evaluation.
CUTOFFS = (1, 3, 10)
LOW_RANK, TITLE_CHARS = 3, 40


def first_relevant_rank(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """Per judged query: rank of the first accepted title (or NULL) and the top title.

    ``results`` has ``qid, rank, title``; ``judgments`` has ``qid, expected``.
    Titles are compared exactly.
    """
    hits = judgments.select("qid", "expected").join(results.select("qid", "rank", "title"), "qid", "left")
    accepted = F.array_contains("expected", F.col("title"))
    return hits.groupBy("qid").agg(
        F.min(F.when(accepted, F.col("rank"))).alias("rank"),
        F.coalesce(F.min_by("title", "rank"), F.lit("-")).alias("top"),
    )


def hit_at(ranks: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, by: list[str] | None = None) -> DataFrame:
    """Count and share of queries answered within each cut-off."""
    by = by or []
    counts = [F.count(F.when(F.col("rank") <= n, 1)).alias(f"hit_{n}") for n in cutoffs]
    wide = ranks.groupBy(*by).agg(F.count("*").alias("n"), *counts)
    entries = F.array(*[F.struct(F.lit(n).alias("cutoff"), F.col(f"hit_{n}").alias("hits")) for n in cutoffs])
    rows = wide.select(*by, "n", F.inline(entries))
    return rows.select(*by, "cutoff", "hits", "n", (F.col("hits") / F.col("n")).alias("share"))


def mrr(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean reciprocal rank over all queries; a miss counts 0."""
    reciprocal = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(reciprocal).alias("mrr"))


def latency_summary(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Exact median and maximum."""
    medians = exact_median(df, by or [], column).withColumnRenamed("median", "p50")
    if not by:
        return df.agg(F.max(column).alias("max")).select(medians.select("p50").scalar().alias("p50"), "max")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
    most = df.groupBy(*by).agg(F.max(column).alias("max"))
    renamed = medians.select(*[F.col(k).alias(f"_{k}") for k in by], "p50")
    return most.join(renamed, same, "left").select(*by, "p50", "max")


def misses(ranks: DataFrame) -> DataFrame:
    """Queries without an accepted title in the first three."""
    low = F.col("rank").isNull() | (F.col("rank") > LOW_RANK)
    return ranks.filter(low).select("qid", "rank", F.substring("top", 1, TITLE_CHARS).alias("top"))


def summarize(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group: ``n``, hits at each cut-off and MRR."""
    counts = [F.count(F.when(F.col("rank") <= n, 1)).alias(f"hit_at_{n}") for n in CUTOFFS]
    reciprocal = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), *counts, F.avg(reciprocal).alias("mrr"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rank change per query between two runs of the same query set."""
    old = before.select("qid", F.col("rank").alias("rank_before"))
    new = after.select("qid", F.col("rank").alias("rank_after"))
    old_gain = F.coalesce(1.0 / F.col("rank_before"), F.lit(0.0))
    new_gain = F.coalesce(1.0 / F.col("rank_after"), F.lit(0.0))
    return old.join(new, "qid", "full").select(
        "qid", "rank_before", "rank_after", (new_gain - old_gain).alias("gain")
    )


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours each query found."""
    found = approximate.select("qid", "id", F.lit(1).alias("found"))
    return (
        exact.select("qid", "id")
        .join(found, ["qid", "id"], "left")
        .groupBy("qid")
        .agg((F.count("found") / F.count("*")).alias("recall"))
    )


def eval_document(ranks: DataFrame, latencies: DataFrame, base: str, mode: str, column: str = "ms") -> DataFrame:
    """One row, the document of an evaluation: ``base, mode, n, hit_at, mrr, latency_p50_ms, rows``.

    ``ranks`` has ``qid, rank, top``, a row for each judged query; ``rows`` lists
    them in the order of ``qid`` as ``q, rank, top``.
    """
    hits = F.struct(*[F.count(F.when(F.col("rank") <= n, 1)).alias(str(n)) for n in CUTOFFS])
    reciprocal = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    listed = F.array_sort(F.collect_list(F.struct(F.col("qid").alias("q"), "rank", "top")))
    one = ranks.agg(F.count("*").alias("n"), hits.alias("hit_at"), F.round(F.avg(reciprocal), 4).alias("mrr"), listed.alias("rows"))
    median = F.round(latency_summary(latencies, column).select("p50").scalar(), 1)
    return one.select(F.lit(base).alias("base"), F.lit(mode).alias("mode"), "n", "hit_at", "mrr", median.alias("latency_p50_ms"), "rows")


def sweep_document(swept: DataFrame, base: str, mode: str) -> DataFrame:
    """One row, the document of a sweep: ``base, mode, settings``, by ``nprobe``.

    ``swept`` comes from ``plans.search.sweep``.
    """
    hits = F.struct(*[F.col(f"hit_at_{n}").alias(str(n)) for n in CUTOFFS])
    each = F.struct("nprobe", "n", hits.alias("hit_at"), F.round("mrr", 4).alias("mrr"), "avg_reads", "avg_vectors", "p50_vectors")
    listed = F.array_sort(F.collect_list(each))
    return swept.agg(listed.alias("settings")).select(F.lit(base).alias("base"), F.lit(mode).alias("mode"), "settings")
