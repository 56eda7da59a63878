"""Compressed search inside probed cells beside plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passim.operators import cells, codes, nearest, routed


def frame(spark, matrix, ids=None):
    rows = [(i, [float(x) for x in row]) for i, row in zip(range(len(matrix)) if ids is None else ids, matrix)]
    return spark.createDataFrame(rows, "id long, values array<double>")


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8)) * 3
    matrix = np.round(centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8)), 3)
    matrix[50:90] = matrix[50]  # copies tie
    rows = frame(spark, matrix)
    centroids = cells.train_cells(rows, 6, iterations=3)
    index = cells.assign_cells(rows, centroids)
    books = routed.train_residual_pq(index, centroids, 4, 8, iterations=3)
    coded = routed.encode_residuals(index, centroids, books).cache()
    return matrix, centroids, books, coded


def settings(i):
    return {"k": 1 + i % 9, "nprobe": i % 7, "rescore": [-1, 0, 15][i % 3]}


def plain(matrix, centroids, books, asked):
    """Hits of each request from the definitions."""
    means = np.array([r["values"] for r in centroids.orderBy("id").collect()])
    words = codes.codebook_array(books)
    gap = lambda a, b: np.round(((a - b) ** 2).sum(axis=-1), 9)
    home = np.array([int(np.lexsort((range(len(means)), gap(means, v)))[0]) for v in matrix])
    cut = (matrix - means[home]).reshape(len(matrix), 4, -1)
    code = np.array([[int(gap(words[s], c[s]).argmin()) for s in range(4)] for c in cut])
    out = {}
    for i, (vector, s) in asked.items():
        nprobe = min(s["nprobe"] or max(1, len(means) // 4), len(means))
        probed = np.lexsort((range(len(means)), gap(means, vector)))[:nprobe]
        found = []
        for cell in probed:
            table = np.array([gap(words[b], (vector - means[cell]).reshape(4, -1)[b]) for b in range(4)])
            found += [(round(float(sum(table[b][code[j][b]] for b in range(4))), 9), int(j)) for j in np.flatnonzero(home == cell)]
        pool = s["k"] if s["rescore"] < 0 else max(10 * s["k"], 100) if not s["rescore"] else max(s["k"], s["rescore"])
        found = sorted(found)[:pool]
        if s["rescore"] >= 0:
            found = sorted((float(gap(matrix[j], vector)), j) for _, j in found)
        out[i] = [j for _, j in found[: s["k"]]]
    return out


def answers(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
        assert r["rank"] == len(out[r["qid"]])
    return out


# Everything sent out; nothing sent out, so that blocks are paired by shuffles.
@pytest.mark.parametrize("budget", [1 << 24, 4000])
def test_equals_plain_search(spark, world, budget):
    matrix, centroids, books, coded = world
    asked = {i: (matrix[i * 5], settings(i)) for i in range(60)}
    rows = [(i, v.tolist(), s["k"], s["nprobe"], s["rescore"]) for i, (v, s) in asked.items()]
    requests = spark.createDataFrame(rows, "id long, values array<double>, k int, nprobe int, rescore int")
    assert answers(routed.search_routed(requests, coded, centroids, books, budget)) == plain(matrix, centroids, books, asked)


def test_only_probed_cells_are_read(spark, world, tmp_path):
    matrix, centroids, books, coded = world
    coded.write.partitionBy("cell").parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    requests = frame(spark, matrix[:1]).withColumn("nprobe", F.lit(2))
    settled = routed.settle(requests, 6)
    probes = cells.request_probes(settled, centroids, 2)
    wanted = {r["cell"] for r in probes.collect()}
    rows = cells.in_probed_cells(index, probes)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and len(wanted) == 2
    assert {r["cell"] for r in rows.select("cell").distinct().collect()} == wanted
    assert {f.split("cell=")[1].split("/")[0] for f in [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]} == {str(c) for c in wanted}
    hits = routed.search_routed(requests, index, centroids, books)
    assert hits.count() == routed.DEFAULT_K


def test_settings_and_defaults(spark):
    rows = [(1, [0.0], None, None, None), (2, [0.0], 3, 0, 0), (3, [0.0], 30, 99, 5), (4, [0.0], 4, 2, -7), (5, [0.0], 2, 1, 50)]
    settled = routed.settle(spark.createDataFrame(rows, "id long, values array<double>, k int, nprobe int, rescore int"), 12)
    found = {r.id: (r.k, r.nprobe, r.pool, r.exact) for r in settled.collect()}
    assert found == {1: (8, 3, 100, True), 2: (3, 3, 100, True), 3: (30, 12, 30, True), 4: (4, 2, 4, False), 5: (2, 1, 50, True)}


def test_without_requests_or_rows(spark, world):
    matrix, centroids, books, coded = world
    asked = frame(spark, matrix[:3])
    assert routed.search_routed(asked.limit(0), coded, centroids, books).count() == 0
    assert routed.search_routed(asked, coded.limit(0), centroids, books).count() == 0


def test_more_probes_and_larger_pools_find_more(spark, world):
    matrix, centroids, books, coded = world
    asked = frame(spark, matrix[::10]).withColumn("k", F.lit(10))
    truth = answers(nearest.knn(asked, coded.select("id", "values"), 10))
    recall = []
    for nprobe, rescore in ((1, -1), (1, 100), (6, 100), (6, 400)):
        found = answers(routed.search_routed(asked.withColumns({"nprobe": F.lit(nprobe), "rescore": F.lit(rescore)}), coded, centroids, books))
        recall.append(np.mean([len(set(found[i]) & set(truth[i])) / 10 for i in truth]))
    assert recall == sorted(recall) and recall[-1] == 1.0


def test_residual_codes_are_closer_than_plain_ones(spark, world):
    matrix, centroids, books, coded = world
    means = np.array([r["values"] for r in centroids.orderBy("id").collect()])
    words = codes.codebook_array(books)
    plain_books = codes.train_pq(frame(spark, matrix), 4, 8, iterations=3)
    error = lambda a, b: float(((a - b) ** 2).sum())
    decode = lambda row, book: np.concatenate([book[s][c] for s, c in enumerate(row)])
    rows = coded.collect()
    own = sum(error(np.array(r["values"]) - means[r["cell"]], decode(r["codes"], words)) for r in rows)
    flat = codes.codebook_array(plain_books)
    other = sum(error(np.array(r["values"]), decode(r["codes"], flat)) for r in codes.encode_pq(frame(spark, matrix), plain_books).collect())
    assert own < other


def test_no_residual_row_for_a_query_and_cell(spark, world, monkeypatch):
    """Beyond the budget residuals are made where the rows are, and pools of all rows are never stored."""
    matrix, centroids, books, coded = world
    asked = frame(spark, matrix).withColumns({"k": F.lit(5), "nprobe": F.lit(6), "rescore": F.lit(400)})

    def fail(*_):
        raise AssertionError("stored")

    monkeypatch.setattr(routed, "residuals", fail)
    exact = {}
    for r in nearest.knn(frame(spark, matrix), frame(spark, matrix), 5).collect():
        exact.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    exact = {q: [i for _, i in sorted(h)] for q, h in exact.items()}
    assert answers(routed.search_routed(asked, coded, centroids, books, 4000)) == exact
