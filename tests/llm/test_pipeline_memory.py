"""What the pipeline's stages leave in workers, and how texts come there."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from passim import session
from passim.llm import arrow

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", [corpus_pipeline.keep_known_languages, corpus_pipeline.keep_one_of_near_duplicates, corpus_pipeline.drop_benchmark_texts])
def test_rows_of_a_stage_go_to_python_in_small_batches_when_they_are_written(spark, odd, tmp_path, stage):
    before = spark.conf.get(BATCH_BYTES)
    spark.createDataFrame([(1, "an item that no text holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    try:
        rows = stage(spark, odd, str(tmp_path))
        assert spark.conf.get(BATCH_BYTES) == f"{session.TEXT_BATCH_BYTES}b" != before
        small = sorted(map(str, rows.collect()))
        spark.conf.set(BATCH_BYTES, before)
        assert small == sorted(map(str, rows.collect())) != []
    finally:
        spark.conf.set(BATCH_BYTES, before)


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_workers_give_small_pieces_back():
    def own():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        for _ in batches:
            # Many pieces too small to be mapped on their own, below one that stays.
            pieces = [np.ones(8000, dtype=np.int64) for _ in range(3000)]
            last = np.ones(8000, dtype=np.int64)
            most.append(own())
            del pieces
            yield last

    most, before = [], own()
    (kept,) = arrow.giving_back(run)(iter([1]))
    assert len(kept) == 8000
    assert most[0] > before + 150 and own() < before + 60
