import pytest
from pyspark.sql import functions as F

from passim.operators import fusion, quality

N = None
# Ranks of the published evaluation runs, with the hits at 1, 3
# and 10 and the mean reciprocal rank published for them.
RUNS = {
    "static": (
        [N, 3, 8, N, N, N, 6, N, N, N, N, N, 2, 8, 1, 4, 5, 9, N, N, N, 10, N, N, N, N, N, N, 9, N],
        (1, 3, 11),
        0.10074074074074076,
    ),
    "semantic": (
        [N, 1, 1, N, N, N, 1, 4, 4, N, N, N, 2, 4, 2, N, 1, N, N, N, 1, 1, N, 1, N, N, 3, N, 1, N],
        (8, 11, 14),
        0.33611111111111114,
    ),
    "keyword": (
        [N, N, N, N, N, N, N, N, N, N, N, N, N, N, 3, 4, 8, N, N, N, N, N, N, N, N, N, N, N, N, N],
        (0, 1, 3),
        0.023611111111111107,
    ),
    "hybrid": (
        [N, 6, 3, N, N, N, 3, N, N, N, N, N, 9, 8, 1, 1, 2, N, N, N, 2, 3, N, 6, N, N, 8, N, 3, N],
        (2, 8, 13),
        0.1675925925925926,
    ),
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(run, i, rank, "x" * 50) for run, (ranks, _, _) in RUNS.items() for i, rank in enumerate(ranks)]
    return spark.createDataFrame(rows, "run string, qid int, rank int, top string")


def test_published_runs(runs):
    hits = quality.hit_at(runs, by=["run"]).collect()
    for run, (_, expected, _) in RUNS.items():
        got = {r["cutoff"]: (r["hits"], r["n"], r["share"]) for r in hits if r["run"] == run}
        assert got == {c: (h, 30, h / 30) for c, h in zip((1, 3, 10), expected)}
    means = {r["run"]: r["mrr"] for r in quality.mrr(runs, ["run"]).collect()}
    assert means == {run: pytest.approx(mean, abs=1e-15) for run, (_, _, mean) in RUNS.items()}


def test_misses_and_run_change(runs):
    low = quality.misses(runs.filter("run = 'semantic'")).collect()
    assert len(low) == 30 - 11 and {len(r["top"]) for r in low} == {40}
    changes = quality.compare_runs(runs.filter("run = 'hybrid'"), runs.filter("run = 'semantic'"))
    total = changes.agg(F.avg("gain")).first()[0]
    assert total == pytest.approx(RUNS["semantic"][2] - RUNS["hybrid"][2])


def test_first_relevant_rank(spark):
    results = spark.createDataFrame(
        [(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (2, 1, "A"), (4, 1, "a")], "qid int, rank int, title string"
    )
    judged = spark.createDataFrame([(1, ["x", "a"]), (2, ["a"]), (3, ["a"])], "qid int, expected array<string>")
    rows = sorted(map(tuple, quality.first_relevant_rank(results, judged).collect()))
    assert rows == [(1, 2, "b"), (2, None, "A"), (3, None, "-")]


def test_latency_median_averages_the_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "ms double")
    assert tuple(quality.latency_summary(df, "ms").first()) == (3.0, 9.0)


def test_fusion_and_comparison(spark):
    leg = lambda ids: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(ids)], "qid int, rank int, id string")
    near, word = leg(["a", "b", "c"]), leg(["c", "d"])
    fused = fusion.rrf([near, word], 3)
    assert [r["id"] for r in fused.orderBy("rank").collect()] == ["c", "a", "b"]
    assert fused.filter("id = 'c'").first()["score"] == round(1 / 63 + 1 / 61, 9)
    alone = fusion.rrf([near, word.limit(0)], 5)
    assert [r["id"] for r in alone.orderBy("rank").collect()] == ["a", "b", "c"]
    parts = [df.withColumn("mode", F.lit(m)) for m, df in (("semantic", near), ("keyword", word), ("hybrid", fused.drop("score")))]
    rows = fusion.compare_modes(parts[0].unionByName(parts[1]).unionByName(parts[2]), shown=2).collect()
    hybrid = {r["id"]: (r["semantic_rank"], r["keyword_rank"]) for r in rows if r["mode"] == "hybrid"}
    assert hybrid == {"c": (3, 1), "a": (1, None)}
    assert all(r["rank"] <= 2 for r in rows) and len(rows) == 6


def test_exact_median_narrows_to_the_middle(spark):
    import random
    import statistics

    from passim.operators.ranking import exact_median

    rng, rows = random.Random(8), []
    groups = {"even": 4000, "odd": 3001, "one": 1, "two": 2}
    for name, n in groups.items():
        rows += [(name, rng.choice([1e-9, 1.0, 5e4]) * rng.random()) for _ in range(n)]
    rows += [("same", 2.5)] * 500 + [("far", float("-inf")), ("far", 3.0), ("far", 1e308), ("far", -1e308), ("far", float("inf"))]
    rows += [("none", None), (None, 7.0), (None, 8.0), ("odd", None)]
    found = {r["g"]: r["median"] for r in exact_median(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v").collect()}
    wanted = {}
    for g, v in rows:
        if v is not None:
            wanted.setdefault(g, []).append(v)
    assert found == {g: statistics.median(v) for g, v in wanted.items()}
    grouped = quality.latency_summary(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()
    assert {r["g"]: r["p50"] for r in grouped} == found | {"none": None}


def test_documents(spark, tmp_path):
    import json

    from passim.sources.vectors import write_document

    ranks = spark.createDataFrame([(3, None, "-"), (1, 1, "a"), (2, 4, "b")], "qid int, rank int, top string")
    times = spark.createDataFrame([(5.0,), (7.26,), (9.0,)], "ms double")
    write_document(quality.eval_document(ranks, times, "local", "hybrid"), str(tmp_path / "eval"))
    (file,) = (tmp_path / "eval").glob("*.json")
    rows = [{"q": 1, "rank": 1, "top": "a"}, {"q": 2, "rank": 4, "top": "b"}, {"q": 3, "rank": None, "top": "-"}]
    assert json.loads(file.read_text()) == {"base": "local", "mode": "hybrid", "n": 3, "hit_at": {"1": 1, "3": 1, "10": 2}, "mrr": 0.4167, "latency_p50_ms": 7.3, "rows": rows}
    kind = "nprobe int, n long, hit_at_1 long, hit_at_3 long, hit_at_10 long, mrr double, avg_reads double, avg_vectors double, p50_vectors double"
    swept = spark.createDataFrame([(8, 3, 1, 2, 3, 0.51234, 2.0, 9.0, 8.0), (2, 3, 0, 1, 1, 0.1, 1.0, 4.0, 4.0)], kind)
    document = quality.sweep_document(swept, "local", "semantic").first()
    assert [s["nprobe"] for s in document["settings"]] == [2, 8] and document["settings"][1]["mrr"] == 0.5123
    assert document["settings"][1]["hit_at"].asDict() == {"1": 1, "3": 2, "10": 3}
