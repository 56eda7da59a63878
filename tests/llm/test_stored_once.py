"""What the n-gram Jaccard join of the pipeline writes."""

import corpus_pipeline


def test_texts_are_stored_once(spark, monkeypatch):
    paths = []

    def named(session, name, make=corpus_pipeline.new_folder):
        paths.append(make(session, name))
        return paths[-1]

    monkeypatch.setattr(corpus_pipeline, "new_folder", named)
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, None), (None, "f g h i")]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, None}
    assert spark.read.parquet(paths[0]).columns == ["row", "key"]
