"""Rank fusion and side-by-side comparison of search modes."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.operators.ranking import top_k
from passim.session import checkpointed

# Reciprocal-rank fusion (Cormack et al. 2009).
RRF_OFFSET, LEG_DEPTH = 60, 100
SCORE_DECIMALS = 9

# Fixed value: hits shown per mode of those fetched.
SHOWN = 5


def rrf(legs: list[DataFrame], k: int) -> DataFrame:
    """Fuse ranked legs (``qid, rank, id``) into ``qid, rank, id, score``."""
    parts = [leg.select("qid", "id", (1.0 / (RRF_OFFSET + F.col("rank"))).alias("part")) for leg in legs]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("qid", "id").agg(F.round(F.sum("part"), SCORE_DECIMALS).alias("score"))
    return top_k(fused, ["qid"], [F.col("score").desc(), F.col("id")], k).select("qid", "rank", "id", "score")


@dataclass(frozen=True)
class Leg:
    """One ranking of the collection for each query.

    ``top(qids, depth)`` gives ``qid, rank, id`` of the first ``depth`` rows of
    the queries ``qids``; ``places(pairs)`` gives ``qid, id, rank`` of the pairs
    that the whole ranking holds. A leg that cannot look up places is read on
    until nothing depends on them.
    """

    top: Callable[[DataFrame, int], DataFrame]
    places: Callable[[DataFrame], DataFrame] | None = None


def fuse(legs: list[Leg], qids: DataFrame, k: int, depth: int = LEG_DEPTH) -> DataFrame:
    """As :func:`rrf` over the whole legs, of which only the needed part is read.

    The threshold algorithm (Fagin, Lotem and Naor 2003): of each leg the first
    ``depth`` rows are read. The k-th sum of known parts is a threshold. A row
    that no list holds has at most the sum of the next rank's parts; while that
    reaches the threshold, the query is undecided and its lists are made four
    times as long. Of a decided query the rows that could still reach the
    threshold are looked up in the legs that do not list them. Scores are those
    of the whole legs, so a rank beyond ``depth`` counts like any other.

    ``qids`` has ``qid``. Ties go to the lower id.
    """
    part = lambda rank: 1.0 / (RRF_OFFSET + rank)
    rounded = lambda value: F.round(value, SCORE_DECIMALS)
    total = lambda values: reduce(lambda a, b: a + b, values)
    asked, depth = checkpointed(qids.select("qid").distinct()), max(depth, k)
    fused = None
    while True:
        tops = [leg.top(asked, depth).select("qid", "id", F.lit(i).alias("leg"), "rank") for i, leg in enumerate(legs)]
        listed = checkpointed(reduce(DataFrame.unionByName, tops))
        ranks = [F.max(F.when(F.col("leg") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(legs))]
        sizes = [(F.count(F.when(F.col("leg") == i, 1)) >= depth).alias(f"more{i}") for i in range(len(legs))]
        more = asked.join(listed.groupBy("qid").agg(*sizes), "qid", "left").na.fill(False)
        rows = listed.groupBy("qid", "id").agg(*ranks).join(more, "qid")
        known = total([F.coalesce(part(F.col(f"r{i}")), F.lit(0.0)) for i in range(len(legs))])
        # A leg read to its end holds no further row.
        gap = lambda i, missing: F.when(missing & F.col(f"more{i}"), F.lit(part(depth + 1))).otherwise(0.0)
        most = known + total([gap(i, F.col(f"r{i}").isNull()) for i in range(len(legs))])
        rows = checkpointed(rows.select("*", known.alias("known"), most.alias("most")))
        cut = top_k(rows.select("qid", "known"), ["qid"], [F.col("known").desc()], k).filter(F.col("rank") == k)
        unseen = total([gap(i, F.lit(True)) for i in range(len(legs))])
        state = more.select("qid", unseen.alias("unseen")).join(cut.select("qid", F.col("known").alias("cut")), "qid", "left")
        state = state.select("qid", F.coalesce("cut", F.lit(0.0)).alias("cut"), (rounded(F.col("unseen")) >= rounded(F.coalesce("cut", F.lit(0.0)))).alias("reachable"), "unseen")
        state = state.select("qid", "cut", (F.col("reachable") & (F.col("unseen") > 0)).alias("undecided"))
        open_rows = rows.join(state.select("qid", "cut"), "qid").filter(rounded(F.col("most")) >= rounded(F.col("cut"))).drop("cut")
        blind = [F.col(f"r{i}").isNull() & F.col(f"more{i}") for i, leg in enumerate(legs) if leg.places is None]
        if blind:
            waits = open_rows.groupBy("qid").agg(F.bool_or(reduce(lambda a, b: a | b, blind)).alias("waits"))
            state = state.join(waits, "qid", "left").select("qid", (F.col("undecided") | F.coalesce("waits", F.lit(False))).alias("undecided"))
        state = checkpointed(state.select("qid", "undecided"))
        found = checkpointed(open_rows.join(state.filter("not undecided").select("qid"), "qid", "left_semi"))
        for i, leg in enumerate(legs):
            if leg.places is None:
                continue
            lost = found.filter(F.col(f"r{i}").isNull() & F.col(f"more{i}")).select("qid", "id")
            if not lost.isEmpty():
                placed = leg.places(lost).select("qid", "id", F.col("rank").alias("placed"))
                found = checkpointed(found.join(placed, ["qid", "id"], "left").withColumn(f"r{i}", F.coalesce(f"r{i}", "placed")).drop("placed"))
        score = rounded(total([F.coalesce(part(F.col(f"r{i}")), F.lit(0.0)) for i in range(len(legs))]))
        scored = found.select("qid", "id", score.alias("score"))
        fused = scored if fused is None else fused.unionByName(scored)
        asked, depth = checkpointed(state.filter("undecided").select("qid")), 4 * depth
        if asked.isEmpty():
            break
    return top_k(fused, ["qid"], [F.col("score").desc(), F.col("id")], k).select("qid", "rank", "id", "score")


def compare_modes(results: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first hits of every mode; a hybrid hit also shows its rank in each leg."""

    def leg(mode: str, name: str) -> DataFrame:
        return results.filter(F.col("mode") == mode).select("qid", "id", F.col("rank").alias(name))

    listed = results.filter(F.col("rank") <= shown)
    joined = listed.join(leg("semantic", "semantic_rank"), ["qid", "id"], "left").join(
        leg("keyword", "keyword_rank"), ["qid", "id"], "left"
    )
    hybrid = F.col("mode") == "hybrid"
    return joined.select(
        "qid",
        "mode",
        "rank",
        "id",
        F.when(hybrid, F.col("semantic_rank")).alias("semantic_rank"),
        F.when(hybrid, F.col("keyword_rank")).alias("keyword_rank"),
    )
