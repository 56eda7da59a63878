"""BM25 over a flat table of postings: what it moves, and ids and queries that repeat or are null."""

import math

import pytest
from pyspark.sql import functions as F

from passim.operators import lexical


def expected(asked, docs, k):
    """By the definition: postings of one id count together, as do rows of one query."""
    words = [(i, t.split()) for i, t in docs]
    avgdl = sum(len(w) for _, w in words) / len(words)
    df = {}
    for _, w in words:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    scores = {}
    for qid, text in asked:
        for term in set(text.split()):
            for i, w in words:
                if term in w:
                    tf, idf = w.count(term), math.log(1 + (len(words) - df[term] + 0.5) / (df[term] + 0.5))
                    gain = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))
                    scores.setdefault(qid, {}).setdefault(i, []).append(gain)
    out = set()
    for qid, found in scores.items():
        ranked = sorted(((-round(sum(s), 6), i is not None, i or "") for i, s in found.items()))
        out |= {(qid, n + 1, i if known else None, -s) for n, (s, known, i) in enumerate(ranked[:k])}
    return out


@pytest.fixture(scope="module")
def texts():
    docs = [(f"d{i % 90:02d}" if i % 17 else None, " ".join(f"w{i * j % 7}" for j in range(1, 3 + i % 5))) for i in range(120)]
    asked = [(i % 20 if i % 6 else None, f"w{i % 7} w{i % 3} none") for i in range(25)]
    return docs, asked


def answer(spark, texts, k, **more):
    docs, asked = (spark.createDataFrame(rows, kind) for rows, kind in zip(texts, ("id string, text string", "qid long, text string"), strict=True))
    docs = docs.repartition(3)
    stats = lexical.collection_stats(lexical.document_lengths(docs))
    return lexical.bm25(asked, lexical.build_postings(docs), stats, k, **more)


@pytest.mark.parametrize("pairs", [1, 60, lexical._PAIRS])
def test_scores_of_a_passage_are_whole_however_it_is_cut(spark, texts, monkeypatch, pairs):
    monkeypatch.setattr(lexical, "_PAIRS", pairs)
    monkeypatch.setattr(lexical, "TASK_POSTINGS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {tuple(r) for r in answer(spark, texts, 4).collect()}
        batches = {tuple(r) for r in answer(spark, texts, 4, budget=1500).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == batches == expected(texts[1], texts[0], 4)


def test_no_row_for_each_query_and_passage_leaves_a_task(spark):
    docs = spark.range(3000).select(F.col("id"), F.lit("a b c").alias("text"))
    asked = spark.range(50).select(F.col("id").alias("qid"), F.lit("a c").alias("text"))
    postings = lexical.build_postings(docs)
    stats = lexical.collection_stats(lexical.document_lengths(docs))
    hits = lexical.bm25(asked, postings, stats, 3)
    assert hits.filter("rank != id + 1").isEmpty() and hits.count() == 150
    weighted = lexical.query_terms(asked).withColumns({"idf": F.lit(0.5), "df": F.lit(3000)})
    given = lexical._scored(weighted, postings.select("term", "id", F.lit(1.0).alias("gain")), asked, 3).count()
    assert given <= 50 * 3 * spark.sparkContext.defaultParallelism


def test_files_of_postings_grow_with_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_POSTINGS", 50)
    rows = lexical.build_postings(spark.range(400).select("id", F.lit("a b").alias("text")))
    lexical.write_postings(rows, str(tmp_path / "p"), 800.0)
    assert len(list((tmp_path / "p").glob("*.parquet"))) >= 12
    assert spark.read.parquet(str(tmp_path / "p")).count() == 800


def test_nothing_asked_or_stored(spark, texts):
    assert answer(spark, (texts[0], [(1, "none"), (2, None)]), 3).isEmpty()
    assert answer(spark, ([("d", None)], texts[1]), 3).isEmpty()
