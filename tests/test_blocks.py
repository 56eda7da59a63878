"""Keyword search over blocks: runs of an index, and tasks of a search."""

import math

from pyspark.sql import functions as F

from passim.operators import blocks, lexical


def test_an_index_is_sorted_run_by_run_and_searched_in_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_PASSAGES", 40)
    monkeypatch.setattr(blocks, "RUN_BLOCKS", 2)
    monkeypatch.setattr(blocks, "_RUN_ROWS", 5)
    docs = spark.range(0, 900, 1, 2).select(F.col("id"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 11)).alias("text"))
    path = str(tmp_path / "index")
    blocks.write_text_index(docs, path, block_rows=50)
    index = blocks.open_text_index(spark, path)
    assert index.size() == (900, 2.0)
    # Two files of nine blocks, in runs of two blocks: terms fall four times in each.
    rows = index.rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("block"), F.coalesce("term", F.lit("")).alias("term"))
    files = {}
    for r in rows.orderBy("file", "row").collect():
        files.setdefault(r["file"], []).append((r["term"], r["block"]))
    assert [sum(a > b for a, b in zip(x, x[1:])) for x in files.values()] == [4, 4]
    assert blocks._together(index.terms(), index).rdd.getNumPartitions() == math.ceil(900 / 40)
    asked = spark.createDataFrame([(1, "w3 v5"), (2, "v1"), (3, "none")], "qid long, text string")
    stats = lexical.collection_stats(lexical.document_lengths(docs))
    found = {tuple(r) for r in blocks.search_text(asked, index, 6).collect()}
    assert len(found) == 12
    assert found == {tuple(r) for r in lexical.bm25(asked, lexical.build_postings(docs), stats, 6).collect()}
