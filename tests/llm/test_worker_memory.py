"""What the pipeline's stages keep of an executor's memory."""

import pyarrow as pa

import corpus_pipeline
from passim import session
from passim.llm import arrow, jaccard, packing
from passim.llm.queries import tokenizer

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_are_packed_in_small_batches(spark, odd, monkeypatch):
    before, seen = spark.conf.get(BATCH_BYTES), []

    def pack(*args, own=packing.pack):
        seen.append(spark.conf.get(BATCH_BYTES))
        return own(*args)

    monkeypatch.setattr(packing, "pack", pack)
    packed = packing.pack_documents(odd, tokenizer("byte_bpe_50k.json"))
    assert seen == [f"{session.TEXT_BATCH_BYTES}b"] and spark.conf.get(BATCH_BYTES) == before
    assert packed.where("start = 0").count() == odd.count()


def test_small_slices_give_the_same_pieces(spark, monkeypatch):
    texts = [None, "", *(f"word {i} thing. " * 4000 for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in packing.cut_documents(docs, tokenizer("byte_bpe_50k.json")).collect()}
    encoder = packing.Encoder(tokenizer("byte_bpe_50k.json"))
    assert sum(map(len, filter(None, texts))) > 2 * packing.SLICE_BYTES
    for i, text in enumerate(texts):
        n = len(encoder.exact.encode(text or "", add_special_tokens=False).ids) + 1
        own = {start: row for (doc, start), row in cut.items() if doc == i}
        assert sum(length for length, _, _ in own.values()) == n and {total for _, _, total in own.values()} == {n}


def test_workers_give_memory_back(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    double = arrow.giving_back(lambda batches: (2 * b for b in batches))
    assert list(double(iter([1, 2]))) == [2, 4] and Pool.released == 1
    assert list(jaccard._runs(iter([]))) == [] and Pool.released == 2


def test_texts_stay_where_they_lie_while_copies_go(spark, monkeypatch, capsys):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, None), (None, "f g h i"), (3, None), (None, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
        kept.explain()
        assert "BroadcastHashJoin" in (plan := capsys.readouterr().out) and "Exchange hashpartitioning" not in plan
        few = sorted(map(str, kept.collect()))
        # Too many to be sent out: the rows are the same.
        monkeypatch.setattr(corpus_pipeline, "NUMBER_BYTES", session.BROADCAST_BYTES)
        kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
        kept.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out
        assert sorted(map(str, kept.collect())) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 3]
