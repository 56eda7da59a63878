"""Answering batches of search requests."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.functions.scoring import display_score, score_kind
from passim.functions.vector import is_zero
from passim.operators.blocks import TextIndex, search_text, text_places
from passim.operators.cells import default_nprobe, request_probes, search_probes
from passim.operators.codes import pq_search
from passim.operators.fusion import Leg, fuse
from passim.operators.nearest import knn, vector_places
from passim.operators.quality import first_relevant_rank, summarize
from passim.operators.routed import search_routed
from passim.operators.segments import fetch_metadata, query_cost
from passim.session import broadcast_within, checkpointed

NO_WORDS = "no known words in that query"


@dataclass
class SearchIndex:
    """The tables a search reads.

    Without centroids vectors are ranked exactly; with them (``vectors`` with
    ``cell``) in each request's probed cells; with codebooks too (``codes`` of
    residuals) by code there, and rescored. Codebooks alone rank all codes.
    """

    vectors: DataFrame
    passages: DataFrame
    text: TextIndex
    centroids: DataFrame | None = None
    codebooks: DataFrame | None = None
    rescore: int = 0
    corpus: str = ""


def vector_leg(requests: DataFrame, index: SearchIndex, depth: int) -> DataFrame:
    """``qid, rank, id, distance`` of every request with a vector, ``depth`` rows each."""
    asked = requests.select(F.col("qid").alias("id"), "values", "nprobe")
    if index.centroids is None:
        vectors = asked.select("id", "values")
        return knn(vectors, index.vectors, depth) if index.codebooks is None else pq_search(vectors, index.vectors, index.codebooks, depth, index.rescore)
    if index.codebooks is not None:
        asked = asked.withColumns({"k": F.lit(depth), "rescore": F.lit(index.rescore)})
        return search_routed(asked, index.vectors, index.centroids, index.codebooks)
    cells = index.centroids.count()
    probing = F.when(F.col("nprobe") > 0, F.col("nprobe")).otherwise(default_nprobe(cells))
    asked = asked.withColumn("nprobe", F.least(probing, F.lit(cells)))
    most = asked.agg(F.max("nprobe")).first()[0] or 1
    probes = checkpointed(request_probes(asked, index.centroids, most))
    return search_probes(asked.select("id", "values"), index.vectors, probes, depth)


def hybrid_legs(requests: DataFrame, index: SearchIndex) -> list[Leg]:
    """The vector leg, of requests with a vector, and the text leg."""
    seen = requests.filter("not _blind")
    text = requests.select("qid", "text")
    exact = index.centroids is None and index.codebooks is None
    vectors = seen.select(F.col("qid").alias("id"), "values")
    return [
        Leg(
            lambda qids, depth: vector_leg(seen.join(qids, "qid", "left_semi"), index, depth),
            (lambda pairs: vector_places(pairs, vectors, index.vectors)) if exact else None,
        ),
        Leg(
            lambda qids, depth: search_text(text.join(qids, "qid", "left_semi"), index.text, depth),
            lambda pairs: text_places(pairs, text, index.text),
        ),
    ]


def search(requests: DataFrame, index: SearchIndex) -> DataFrame:
    """Run each valid request in its mode and explain each failed one.

    ``requests`` comes from ``validate_queries`` with ``qid`` and ``values``
    (NULL or zero if the text has no known word). A hybrid request without a
    vector falls back to its text leg; a semantic one has nothing left and
    fails. Rows: ``qid, query, mode, rank, id, score, score_kind, title, url,
    text, corpus, error``.
    """
    unknown = F.col("values").isNull() | is_zero("values")
    lost = F.when((F.col("mode") == "semantic") & unknown, NO_WORDS)
    rows = checkpointed(requests.withColumn("error", F.coalesce("error", lost)).withColumn("_blind", unknown))
    valid = rows.filter("error is null")
    settings = valid.select("qid", "mode", "k")
    most = valid.agg(F.max("k")).first()[0] or 1
    of = lambda mode: valid.filter(F.col("mode") == mode)

    near = vector_leg(of("semantic"), index, most).withColumn("score", display_score(F.lit("semantic"), F.col("distance"), F.lit(None).cast("double")))
    word = search_text(of("keyword").select("qid", "text"), index.text, most)
    hybrid = of("hybrid")
    fused = fuse(hybrid_legs(hybrid, index), hybrid.select("qid"), most)
    hits = reduce(DataFrame.unionByName, [leg.select("qid", "rank", "id", "score") for leg in (near, word, fused)])
    hits = checkpointed(hits.join(settings, "qid").filter(F.col("rank") <= F.col("k")).select("qid", "mode", "rank", "id", "score"))

    answered = fetch_metadata(hits, index.passages, max_hits=rows.count() * most)
    answered = answered.withColumn("score_kind", score_kind(F.col("mode"))).withColumn("error", F.lit(None).cast("string"))
    failed = rows.filter("error is not null").select("qid", "mode", "error")
    asked = rows.select("qid", F.col("text").alias("query"))
    return answered.unionByName(failed, allowMissingColumns=True).join(asked, "qid").withColumn("corpus", F.lit(index.corpus))


def sweep(
    queries: DataFrame,
    judgments: DataFrame,
    index: DataFrame,
    titles: DataFrame,
    centroids: DataFrame,
    stats: DataFrame,
    nprobes: list[int],
    k: int,
    dim: int,
) -> DataFrame:
    """Quality and read cost for each ``nprobe``, in one search pass.

    ``queries`` has ``id, values``. A cell is read for a query once, by the least
    ``nprobe`` that probes it; what a larger one finds is the best of its own cells
    and of all that smaller ones found. ``titles`` has ``id, title``.
    """
    levels = sorted(set(nprobes))
    settings = F.explode(F.array(*[F.lit(n) for n in levels])).alias("nprobe")
    least = F.get(F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("rank")), F.lit(0)).alias("least")
    ranked = knn(queries, centroids, max(levels)).select("qid", F.col("id").alias("cell"), "rank", least)
    ranked = checkpointed(ranked)
    probes = ranked.select("*", settings).filter(F.col("rank") <= F.col("nprobe")).select("nprobe", "qid", "cell")
    cost = query_cost(probes, stats, dim, ("nprobe", "qid")).groupBy("nprobe").agg(
        F.avg("reads").alias("avg_reads"), F.avg("vectors").alias("avg_vectors"), F.median("vectors").alias("p50_vectors")
    )
    hits = _nested_hits(queries, index, ranked, levels, k)
    small = broadcast_within(hits, queries.count() * len(levels) * k, 256)
    shown = _small_titles(titles.select("id", "title")).join(small, "id").select("qid", "rank", "title")
    cases = judgments.select("qid", "expected", settings).select(F.concat_ws(":", "nprobe", "qid").alias("qid"), "expected")
    ranks = first_relevant_rank(shown, cases).withColumn(
        "nprobe", F.substring_index("qid", ":", 1).cast("int")
    )
    return summarize(ranks, ["nprobe"]).join(cost, "nprobe")


def _nested_hits(queries: DataFrame, index: DataFrame, ranked: DataFrame, levels: list[int], k: int) -> DataFrame:
    """``qid, rank, id``: the first ``k`` for each query and level, ``qid`` made of both.

    ``ranked`` has ``qid, cell, least``, the least level that reads the cell. Each
    level's own cells are searched as a query of their own.
    """
    each = F.explode(F.array(*[F.lit(n) for n in levels])).alias("least")
    asked = queries.select("id", "values", each).select(F.concat_ws(":", "least", "id").alias("id"), "values")
    own = search_probes(asked, index, ranked.select(F.concat_ws(":", "least", "qid").alias("qid"), "cell"), k)
    # The id of a query without one is not in the key, nor is the colon.
    mark = F.instr("qid", ":")
    query = F.when(mark > 0, F.expr("substring(qid, instr(qid, ':') + 1)"))
    own = own.select(query.alias("qid"), F.substring_index("qid", ":", 1).cast("int").alias("least"), "distance", "id")
    found = own.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("distance", "id", "least"))).alias("found"))
    best = lambda n: F.slice(F.filter("found", lambda hit: hit["least"] <= n), 1, k)
    lists = F.array(*[F.struct(F.lit(n).alias("nprobe"), best(n).alias("hits")) for n in levels])
    rows = found.select("qid", F.explode(lists).alias("list")).select("qid", "list.nprobe", F.posexplode("list.hits").alias("at", "hit"))
    return rows.select(F.concat_ws(":", "nprobe", "qid").alias("qid"), (F.col("at") + 1).alias("rank"), "hit.id")


def _small_titles(titles: DataFrame) -> DataFrame:
    """``id, title``, sent to all if their count and longest value prove them small."""
    count, longest = titles.agg(F.count("*"), F.max(F.length(F.concat_ws("", "id", "title")))).first()
    return broadcast_within(titles, count, 4 * (longest or 0) + 32)
