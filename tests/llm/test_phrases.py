"""Phrase mining beside plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, database

from passim.llm import phrases
from passim.llm.queries import ORACLES, QUERIES


def plain(rows, max_words=4, min_count=30, top=2000, covered=80):
    """Result rows from (lang, text) pairs."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", words[i : i + k]] += 1
    out = {}
    some = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    longer = Counter()
    for (lang, words), a in some.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                longer[lang, words[i : i + k]] = max(longer[lang, words[i : i + k]], a)
    for (lang, words), a in some.items():
        if (lang, words) in longer and 100 * longer[lang, words] >= covered * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    }


def rows_of(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def texts(seed, count=400):
    rng = random.Random(seed)
    words = ["of", "The", "the", "a", "ÀÉ", "àé", "x-y", "état", " nb", "日本", "q", "zeta", "Rare"]
    weights = [9, 3, 9, 6, 2, 2, 2, 2, 2, 2, 1, 1, 1]
    out = []
    for _ in range(count):
        own = [rng.choices(words, weights)[0] + rng.choices(["", ".", ",", "\n", "!"], [12, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 40))]
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(own)))
    return out


@pytest.mark.parametrize("bits", [12, 26])
def test_equals_plain_counts(spark, bits):
    rows = texts(4) + [("en", None), (None, None), ("de", ""), ("en", "! . \t"), ("fr", "one two " * 3), ("es", "uno"), ("la", "a b c d e f " * 40)]
    frame = spark.createDataFrame([(t, lang, "x", 1) for lang, t in rows], "text string, lang string, phrase string, n long").repartition(6)
    assert rows_of(phrases.mine_phrases(frame, min_count=30, bucket_bits=bits)) == plain(rows)
    assert rows_of(phrases.mine_phrases(frame, min_count=3, top=7, covered=95, max_words=3, bucket_bits=bits)) == plain(rows, 3, 3, 7, 95)


def test_repeated_and_long_texts(spark):
    long = "alpha beta gamma, delta " * 300_000
    rows = [("en", long), ("en", long), ("de", "kein bruch " * 50)]
    frame = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert rows_of(phrases.mine_phrases(frame)) == plain([("en", "alpha beta gamma, delta " * 300_000)] * 2 + rows[2:])


def test_without_words(spark):
    for rows in ([], [("en", None), (None, " .")]):
        frame = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
        assert phrases.mine_phrases(frame).count() == 0


def test_long_text_is_cut_behind_breaks(monkeypatch):
    monkeypatch.setattr(phrases, "PART_BYTES", 64)
    value = "no break for a long while in this first piece of the text that goes on and on. then one; and another, short " * 9
    whole = [p.tobytes() for p, _, _ in phrases._parts(pa.array([value, "b c"], pa.large_string()))]
    assert b"".join(whole).decode() == value + "b c" and len(whole) > 3
    assert all(w[-1:] in b".,;" for w in whole[:-2])


def test_counts_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    a, left, right = 9 * 10**12, 10**13, 10**13 + 1
    frame = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    expr = f"{phrases.SCORE_SCALE} * cast(a as decimal(24,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    assert frame.selectExpr(expr).first()[0] == 2_000_000 * a // (left + right)


def test_words_are_split_as_stated():
    raw = np.frombuffer("Ab cD.\tEéF g".encode() + b"x" + b"\x0by", dtype=np.uint8)
    index, distinct, text, joined = phrases.split_words(raw, np.array([0, len(raw) - 3, len(raw) - 3]))
    assert [distinct[i].as_py() for i in index] == ["ab", "cd", "eéf", "g", "x", "y"]
    assert joined.tolist() == [True, False, True, False, False, False] and text.tolist() == [0, 0, 0, 0, 2, 2]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = QUERIES["op12_phrases"](spark, folder)
    rows = found.collect()
    assert compare(found.columns, rows, database(folder), ORACLES["op12_phrases"]) == []
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows} == plain([(d.lang, d.text) for d in docs])
