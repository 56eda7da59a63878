"""The sweep over numbers of probed cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passim.operators import cells, segments
from passim.plans import search as plans

NPROBES, K = [1, 2, 4, 6], 5


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(size=(240, 6)), 3)
    vectors[100:140] = vectors[100]
    centres = np.round(rng.normal(size=(6, 6)), 3)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, values array<double>")
    model = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "id int, values array<double>")
    index = cells.assign_cells(rows, model).withColumn("generation", F.lit(0))
    return vectors, centres, rows, model, index


def swept(world):
    vectors, _, rows, model, index = world
    title = F.concat(F.lit("t"), (F.col("id") % 7).cast("string"))
    asked = rows.select("id", F.reverse("values").alias("values"))
    wanted = rows.select(F.col("id").alias("qid"), F.array(title).alias("expected"))
    return plans.sweep(asked, wanted, index, rows.select("id", title.alias("title")), model, segments.index_stats(index), NPROBES, K, 6)


def plain(world):
    """``nprobe: n, hits at 1, 3 and 10, mrr``, by going through all rows."""
    vectors, centres, *_ = world
    apart = lambda a, b: np.round(((a - b) ** 2).sum(axis=1), 9)
    home = np.array([np.lexsort((np.arange(6), apart(centres, v)))[0] for v in vectors])
    out = {}
    for n in NPROBES:
        ranks = []
        for i, v in enumerate(vectors):
            q = v[::-1]
            probed = np.lexsort((np.arange(6), apart(centres, q)))[:n]
            here = np.flatnonzero(np.isin(home, probed))
            hits = here[np.lexsort((here, apart(vectors[here], q)))][:K]
            good = [at + 1 for at, h in enumerate(hits) if h % 7 == i % 7]
            ranks.append(good[0] if good else None)
        out[n] = (len(ranks), *[sum(r is not None and r <= c for r in ranks) for c in (1, 3, 10)], round(sum(1 / r for r in ranks if r) / len(ranks), 9))
    return out


def test_a_sweep_finds_what_each_search_of_its_own_finds(spark, world):
    found = {r["nprobe"]: (r["n"], r["hit_at_1"], r["hit_at_3"], r["hit_at_10"], round(r["mrr"], 9)) for r in swept(world).collect()}
    assert found == plain(world)


def test_a_cell_is_read_for_a_query_once(spark, world, monkeypatch):
    """Not once for each number of cells that probes it."""
    counts, search = [], plans.search_probes
    monkeypatch.setattr(plans, "search_probes", lambda queries, index, probes, k: counts.append(probes.count()) or search(queries, index, probes, k))
    swept(world)
    assert sum(counts) == 240 * max(NPROBES)


def test_a_query_without_an_id_and_repeated_rows(spark, world):
    """A null id is a query; a colon in an id stays in it; a row that comes twice is two rows."""
    _, _, rows, model, index = world
    asked = rows.filter("id < 3").select(F.when(F.col("id") == 1, F.lit("a:b")).when(F.col("id") == 2, F.lit("c")).alias("id"), "values")
    ranked = plans.knn(asked, model, 6).select("qid", F.col("id").alias("cell"), F.when(F.col("rank") <= 1, 1).otherwise(6).alias("least"))
    hits = plans._nested_hits(asked, index.unionByName(index.filter("id = 1")), ranked, [1, 6], K).collect()
    found = {}
    for r in sorted(hits, key=lambda r: r["rank"]):
        found.setdefault(r["qid"], []).append(r["id"])
    assert set(found) == {"1", "6", "1:a:b", "6:a:b", "1:c", "6:c"}
    assert found["6:a:b"][:2] == [1, 1] and found["6:c"][0] == 2 and found["6"][0] == 0
