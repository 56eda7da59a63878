"""The stored collection: versions, places, claims, and what a write touches."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from passim.operators import cells, nearest, routed
from passim.operators.segments import compaction_cost, index_stats
from passim.plans import collection


def frame(spark, matrix, ids):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, matrix)], "id long, values array<float>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return np.round(rng.normal(size=(120, 4)), 3).astype(np.float32)


@pytest.fixture
def stored(spark, data, tmp_path):
    rows = frame(spark, data, range(120))
    centroids = cells.train_cells(rows, 5, iterations=2)
    books = routed.train_residual_pq(cells.assign_cells(rows, centroids), centroids, 2, 8, iterations=2)
    return collection.create_collection(rows, str(tmp_path / "c"), centroids, books)


def held(snapshot):
    rows = {}
    for r in snapshot.rows().collect():
        assert r["id"] not in rows
        rows[r["id"]] = [round(float(x), 4) for x in r["values"]]
    return rows


def wanted(data, changes=()):
    rows = {i: [round(float(x), 4) for x in v] for i, v in enumerate(data)}
    for i, v in changes:
        rows[i] = [round(float(x), 4) for x in v]
    return rows


def files(snapshot):
    base = Path(snapshot.path) / "data"
    return {str(p.relative_to(base)): p.stat().st_mtime_ns for p in base.rglob("*.parquet")}


def test_versions_stay_as_they_were(spark, data, stored):
    turned = -data[:30]
    second = stored.upsert(frame(spark, turned, range(30)))
    third = second.delete(frame(spark, data[:5], [2, 50, 999, 2, 3]))
    assert (stored.version, second.version, third.version) == (0, 1, 2)
    assert held(stored) == wanted(data) == held(collection.open_collection(spark, stored.path, 0))
    assert held(second) == wanted(data, enumerate(turned))
    left = wanted(data, enumerate(turned))
    assert held(collection.open_collection(spark, stored.path)) == {i: v for i, v in left.items() if i not in (2, 3, 50)}


def test_last_row_of_an_id_counts_and_new_ids_are_added(spark, data, stored):
    batch = frame(spark, [data[0], data[1], data[2]], [7, 7, 500]).withColumn("pos", F.monotonically_increasing_id())
    assert held(stored.upsert(batch, "pos")) == wanted(data, [(7, data[1]), (500, data[2])])


def test_wrong_width_fails_and_the_claim_can_be_freed(spark, data, stored):
    with pytest.raises(Exception, match="width 2, expected 4"):
        stored.upsert(frame(spark, [[1.0, 2.0]], [1]))
    with pytest.raises(RuntimeError, match="taken by another writer"):
        stored.delete(frame(spark, data[:1], [1]))
    assert collection.open_collection(spark, stored.path).version == 0
    assert collection.release_claim(spark, stored.path) == 1
    assert collection.release_claim(spark, stored.path) is None
    assert 1 not in held(stored.delete(frame(spark, data[:1], [1])))


def test_a_writer_of_an_old_version_is_turned_away(spark, data, stored):
    stored.delete(frame(spark, data[:1], [1]))
    with pytest.raises(RuntimeError, match="version 1 is taken"):
        stored.upsert(frame(spark, data[:1], [2]))
    with pytest.raises(RuntimeError, match="version 0 is taken"):
        collection.create_collection(frame(spark, data, range(120)), stored.path, stored.centroids())


def test_compaction_leaves_other_cells_alone(spark, data, stored):
    near = data[stored.rows().filter("cell = 0").select("id").limit(3).toPandas()["id"]] + np.float32(0.001)
    second = stored.upsert(frame(spark, near, [200, 201, 202]))
    due = {r["cell"] for r in second.due(2).collect()}
    assert due and len(due) < 5
    before, rows = files(second), held(second)
    third = second.compact(2)
    after = files(third)
    assert {f: after[f] for f in before} == before
    new = set(after) - set(before)
    assert {int(f.split("cell=")[1].split("/")[0]) for f in new} == due and all(f.startswith("write=2/") for f in new)
    assert held(third) == rows
    # What was written is what the cost table says.
    stats = index_stats(second.rows().withColumn("generation", F.col("write")))
    cost = {r["min_segments"]: r["vectors"] for r in compaction_cost(stats).collect()}
    assert third.segments().filter("write = 2").agg(F.sum("rows")).first()[0] == cost[2]
    assert third.segments().groupBy("cell").count().filter("count > 1").count() == 0
    # Untouched segments are still those of the first write, by reference.
    assert {(r["write"], r["cell"]) for r in third.segments().collect()} == {(2 if c in due else 0, c) for c in range(5)}


def test_deleted_places_go_with_their_segment(spark, data, stored):
    second = stored.upsert(frame(spark, -data[:40], range(40)))
    assert second.deleted().count() == 40
    third = second.compact()
    assert third.deleted().count() == 0 and held(third) == held(second)
    assert third.segments().count() == 5 and third.segments().agg(F.sum("rows")).first()[0] == 120


def test_only_live_segments_of_probed_cells_are_read(spark, data, stored):
    snapshot = stored.upsert(frame(spark, -data[:40], range(40))).compact()
    rows = cells.in_probed_cells(snapshot.rows(), spark.createDataFrame([(1, 2)], "qid long, cell int"))
    assert {(r["write"], r["cell"]) for r in rows.select("write", "cell").distinct().collect()} == {(2, 2)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "write" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_many_segments_are_found_by_a_join(spark, data, stored, monkeypatch):
    second = stored.upsert(frame(spark, -data[:40], range(40)))
    rows = held(second)
    monkeypatch.setattr(collection, "_LITERAL_SEGMENTS", 1)
    assert held(second) == rows and held(second.compact()) == rows


def test_another_application_opens_it(spark, data, stored):
    """Only the path is handed over."""
    stored.upsert(frame(spark, -data[:10], range(10)))
    script = (
        "import sys; from pyspark.sql import SparkSession, functions as F\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from passim.plans.collection import open_collection\n"
        "c = open_collection(s, sys.argv[1])\n"
        "asked = c.rows().filter('id = 20').select('id', 'values', F.lit(1).alias('k'), F.lit(5).alias('nprobe'))\n"
        "print('FOUND', c.version, c.width, c.rows().count(), c.search(asked).first()['id'])\n"
    )
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", script, stored.path], capture_output=True, text=True, cwd=root, env={**os.environ, "PYTHONPATH": root}, timeout=300)
    assert "FOUND 1 4 120 20" in done.stdout, done.stderr[-2000:]


def test_search_without_codebooks_is_exact(spark, data, stored, tmp_path):
    plain = collection.create_collection(frame(spark, data, range(120)), str(tmp_path / "plain"), stored.centroids())
    asked = frame(spark, data[:20], range(20)).withColumns({"k": (F.col("id") % 4 + 1).cast("int"), "nprobe": F.lit(5)})
    found = {(r["qid"], r["rank"]): r["id"] for r in plain.search(asked).collect()}
    exact = nearest.knn(asked, frame(spark, data, range(120)), 4).join(asked.select(F.col("id").alias("qid"), "k"), "qid").filter("rank <= k")
    assert found == {(r["qid"], r["rank"]): r["id"] for r in exact.collect()}


def test_empty_changes(spark, data, stored):
    same = stored.upsert(frame(spark, [], [])).delete(frame(spark, [], []))
    assert same.version == 2 and held(same) == wanted(data)


def test_missing_collection(spark, tmp_path, stored):
    with pytest.raises(FileNotFoundError):
        collection.open_collection(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError, match="version 7"):
        collection.open_collection(spark, stored.path, 7)
