"""Byte-level BPE beside the library that defines its ids."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from passim.llm import byte_pairs
from passim.llm.queries import QUERIES, tokenizer

FILE = tokenizer("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(FILE)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_the_library(ranks, library):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefth eé日\n😀'1.") for _ in range(rng.randint(1, 90))) for _ in range(3000)] + ["a" * 5001, "ab" * 33, "\n" * 64]
    ids, counts = byte_pairs.Merger(ranks).ids(words)
    ends = np.cumsum(counts)
    for word, start, end in zip(words, ends - counts, ends, strict=True):
        wanted = library._core_bpe.encode_single_piece(word.encode())
        assert ids[start:end].tolist() == wanted == byte_pairs.merge(word.encode(), ranks)


def test_ranks_of_a_small_file():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"aa": 301, b"xyz": 302}
    merger = byte_pairs.Merger(ranks)
    # Least rank first, leftmost of equal ranks; xyz has no way there but is a token itself.
    for word, wanted in {"abc": [300], "bca": [257, 97], "aaa": [301, 97], "aaaaa": [301, 301, 97], "xyz": [302], "xyzx": [120, 121, 122, 120], "": []}.items():
        assert byte_pairs.merge(word.encode(), ranks) == wanted
        if word:
            assert merger.ids([word])[0].tolist() == wanted


def test_memory_is_bounded(ranks):
    merger = byte_pairs.Merger(ranks, kept=50)
    words = [f"w{i}" for i in range(40)]
    first = merger.ids(words)[0].tolist()
    for i in range(20):
        merger.ids([f"v{i}-{k}" for k in range(40)])
        assert len(merger.young) + len(merger.old) <= 4 * 50
    assert merger.ids(words)[0].tolist() == first


def test_texts(spark, odd, none, library):
    texts = ["a <|endoftext|> b", "  x \n\n y ", "日本 語 😀", "\x00\x1f 　", "don't we'll", "é" * 300, "x " * 700_000, "q" * 200_000]
    frame = odd.unionByName(spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(texts)], odd.schema))
    frame = frame.withColumnRenamed("score", "ids").withColumnRenamed("source", "decoded")
    rows = byte_pairs.decode_ids(byte_pairs.encode_texts(frame, FILE, public_tokenizers.PATTERN), FILE).collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_pairs.decode_ids(byte_pairs.encode_texts(none, FILE, public_tokenizers.PATTERN), FILE).count() == 0


def test_ids_beyond_the_file(spark):
    frame = spark.createDataFrame([(None,), (bytearray(np.array([5, 49_999], dtype="<u4").tobytes()),)], "ids binary")
    found = byte_pairs.decode_ids(frame, FILE).collect()
    table = {v: k for k, v in byte_pairs.read_ranks(FILE).items()}
    assert [bytes(r.decoded) for r in found] == [b"", table[5] + table[49_999]]
    with pytest.raises(Exception, match="unknown id 70000"):
        byte_pairs.decode_ids(spark.createDataFrame([(bytearray(np.array([70_000], dtype="<u4").tobytes()),)], "ids binary"), FILE).collect()


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    wanted = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array(library.encode_ordinary(r.text or ""), dtype="<u4")
        wanted.add((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    found = QUERIES["op13_byte_pairs"](spark, folder).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == wanted
