"""The pipeline's stages on the smallest tables, each beside plain Python."""

import re
from collections import Counter

import pytest

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        out.append(docs)
    return out


def test_columns(steps):
    for step in steps[1:-1]:
        assert step.dtypes == steps[0].dtypes


def test_language_stage_keeps_texts_with_letters(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    letters = {r.doc_id for r in steps[0].collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert kept == letters


def test_one_of_each_group_stays(steps):
    from test_operators import brute_components

    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    wanted = {component for _, _, component in brute_components(rows)}
    assert Counter(r.doc_id for r in steps[2].collect()) == Counter(wanted)


def test_benchmark_texts_go(steps, spark):
    items = [r.text.lower() for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    held = {r.doc_id for r in steps[2].collect() if any(i in r.text.lower() for i in items)}
    assert {r.doc_id for r in steps[3].collect()} == {r.doc_id for r in steps[2].collect()} - held


def test_secrets_are_redacted(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    for r in steps[4].collect():
        assert not re.search("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", r.text)
        if "[secret]" not in r.text:
            assert r == before[r.doc_id]
        else:
            assert r.n_chars == len(r.text)


def test_packing_covers_every_document(steps):
    tokens = Counter()
    for r in steps[5].collect():
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert all(total == n for (_, n), total in tokens.items())
    assert {d for d, _ in tokens} == {r.doc_id for r in steps[4].collect()}


def test_odd_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF_DIR)
            assert after.columns == docs.columns and after.count() <= docs.count()
        assert corpus_pipeline.pack_sequences(spark, docs, SF_DIR).count() >= docs.count()
