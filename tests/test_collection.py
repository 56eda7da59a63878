from passim.operators import segments
from passim.streaming import upsert as stream

SCHEMA = "id long, values array<float>, cell int, pos int"


def batch(spark, *rows):
    return spark.createDataFrame([(i, [float(v)], cell, pos) for i, v, cell, pos in rows], SCHEMA)


def contents(df):
    return {r["id"]: (r["values"][0], r["cell"]) for r in df.collect()}


def build(spark, path):
    first = segments.upsert(batch(spark, (1, 10, 0, 1), (2, 20, 0, 1), (2, 21, 1, 2), (3, 30, 1, 1)), path, 0)
    assert sorted(r["id"] for r in first.collect()) == [1, 2, 3]
    segments.upsert(batch(spark, (2, 22, 2, 1), (4, 40, 0, 1)), path, 1)
    return segments.read_index(spark, path)


def test_newest_copy_wins_across_cells(spark, tmp_path):
    index = build(spark, str(tmp_path / "c"))
    assert index.count() == 5
    assert contents(segments.live(index, index)) == {1: (10, 0), 2: (22, 2), 3: (30, 1), 4: (40, 0)}
    stale_cell = index.filter("cell = 1")
    assert contents(segments.live(stale_cell, index)) == {3: (30, 1)}
    assert contents(segments.as_of(index, 0)) == {1: (10, 0), 2: (21, 1), 3: (30, 1)}


def test_replaying_a_generation_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    build(spark, path)
    segments.upsert(batch(spark, (2, 22, 2, 1), (4, 40, 0, 1)), path, 1)
    index = segments.read_index(spark, path)
    assert index.count() == 5


def test_compaction_keeps_the_logical_rows(spark, tmp_path):
    index = build(spark, str(tmp_path / "c"))
    before = contents(segments.live(index, index))
    full = segments.compact(index, 1)
    assert full.count() == 4 and contents(full) == before
    segments.write_collection(segments.compact(index, 2), str(tmp_path / "d"))
    partly = segments.read_index(spark, str(tmp_path / "d"))
    # Cell 0 had two segments; cells 1 and 2 are untouched, stale copy included.
    assert partly.filter("cell = 0").select("generation").distinct().count() == 1
    assert partly.count() == 5 and contents(segments.live(partly, partly)) == before


def test_costs(spark, tmp_path):
    index = build(spark, str(tmp_path / "c"))
    stats = segments.index_stats(index)
    assert {r["cell"]: (r["segments"], r["vectors"]) for r in stats.collect()} == {0: (2, 2), 1: (1, 2), 2: (1, 1)}
    cost = {r["min_segments"]: (r["cells"], r["segments"], r["vectors"]) for r in segments.compaction_cost(stats).collect()}
    assert cost == {1: (3, 4, 5), 2: (1, 2, 2)}
    probes = spark.createDataFrame([(7, 0), (7, 2), (8, 1)], "qid int, cell int")
    rows = {r["qid"]: (r["reads"], r["vectors"], r["bytes"]) for r in segments.query_cost(probes, stats, 384).collect()}
    assert rows == {7: (3, 3, 3 * 1536), 8: (1, 2, 2 * 1536)}


def run(spark, tmp_path, every):
    schema = SCHEMA
    stream.stream_upsert(
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")),
        str(tmp_path / "index"),
        str(tmp_path / "state"),
        lambda rows: rows,
        compact_every=every,
    ).awaitTermination(120)
    return stream.read_collection(spark, str(tmp_path / "index"))


def test_stream_with_compaction_and_replay(spark, tmp_path):
    lots = [batch(spark, (1, 10, 0, 1), (2, 20, 1, 1)), batch(spark, (2, 21, 0, 1), (3, 30, 0, 1)), batch(spark, (1, 11, 1, 1))]
    for lot in lots:
        lot.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index = run(spark, tmp_path, every=2)
    expected = {1: (11, 1), 2: (21, 0), 3: (30, 0)}
    assert contents(segments.live(index, index)) == expected
    assert stream.current_version(spark, str(tmp_path / "index")) == (1, 1)
    # A lost commit of the last batch makes the stream run it again.
    for log in ("commits", "offsets"):
        for name in ("2", ".2.crc"):
            path = tmp_path / "state" / log / name
            if log == "commits" and path.exists():
                path.unlink()
    index = run(spark, tmp_path, every=2)
    assert contents(segments.live(index, index)) == expected
    stream.finish(spark, str(tmp_path / "index"))
    index = stream.read_collection(spark, str(tmp_path / "index"))
    assert index.count() == 3 and contents(index) == expected


def test_a_full_batch_is_measured_in_slices():
    """Cells and codes of a batch take memory by the slice, not by the batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from passim.operators import cells, codes, nearest

    rng = np.random.default_rng(5)
    data, books, means = rng.normal(size=(10_000, 64)).astype(np.float32), rng.normal(size=(16, 16, 4)), rng.normal(size=(200, 64))
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, data.size + 1, 64), pa.int32()), pa.array(data.ravel()))
    want = codes.sub_distances(data.astype(float), books).argmin(axis=2).T, nearest.squared_distances(data.astype(float), means).argmin(axis=1)
    tracemalloc.start()
    coded = nearest.answered_in_slices(column, lambda rows: codes.nearest_codes(rows, books))
    homed = nearest.answered_in_slices(column, lambda rows: cells.closest(rows, means, np.arange(200)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (coded == want[0]).all() and (homed == want[1]).all()
    assert peak < 16 << 20
