import re

import pytest
from pyspark.sql import functions as F

from passim.functions import scoring, text
from passim.operators import passages as p
from passim.operators.requests import parse_modes, validate_queries


def one(spark, column, **values):
    schema = ", ".join(f"{name} string" for name in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["  a\t\nb ", "a  b", "\x1c\x1da\x1fb", "\u0085x　", "", " \n "])
def test_clean_text_follows_python(spark, raw):
    assert one(spark, text.clean_text(F.col("t")), t=raw) == re.sub(r"\s+", " ", raw).strip()


def test_length_counts_code_points_inclusively(spark):
    for size, kept in ((199, False), (200, True), (1200, True), (1201, False)):
        assert one(spark, p.length_filter(F.col("t")), t="😀" * size) is kept


def test_ids_keep_gaps_and_only_three_stay(spark):
    paragraphs = ["x" * 10, "a" * 200, "y" * 1201, "b" * 300, "c" * 300, "d" * 300]
    rows = spark.createDataFrame([("7", "u", "t", "\n\n".join(paragraphs))], "id string, url string, title string, text string")
    assert [r["id"] for r in p.make_passages(rows).collect()] == ["wiki-7-1", "wiki-7-3", "wiki-7-4"]


def test_token_counts(spark):
    counts = text.token_counts(text.tokenize(F.col("t")))
    rows = one(spark, counts, t="b A b, c-a b 42 Ünï")
    assert [(r["term"], r["tf"]) for r in rows] == [("42", 1), ("a", 2), ("b", 3), ("c", 1), ("ünï", 1)]
    assert one(spark, counts, t="... !") is None


def test_highlight(spark):
    def mark(body, asked):
        return one(spark, text.highlight(F.col("t"), F.col("q")), t=body, q=asked)

    assert mark("Bees & beehives; the bee", "the BEE of") == (
        "<mark>Bee</mark>s &amp; <mark>bee</mark>hives; the <mark>bee</mark>"
    )
    assert mark("amp & <amp>", "amp") == "<mark>amp</mark> &amp; &lt;<mark>amp</mark>&gt;"
    assert mark("café Café", "café") == "<mark>café</mark> <mark>Café</mark>"
    assert mark("a<b", "who is") == "a&lt;b"
    assert mark("10$ $1 \\", "x10 10$1") == "10$ $1 \\"


@pytest.mark.parametrize(
    "forwarded, peer, expected",
    [
        (" 1.2.3.4 , 9.9.9.9", "5.5.5.5:80", "1.2.3.4"),
        ("", "5.5.5.5:80", "5.5.5.5"),
        (None, "[::1]:443", "::1"),
        (None, "no-port", "no-port"),
        (None, "::1", "::1"),
        (",b", "5.5.5.5:80", ""),
    ],
)
def test_client_key(spark, forwarded, peer, expected):
    assert one(spark, text.client_key(F.col("f"), F.col("p")), f=forwarded, p=peer) == expected


def test_scores(spark):
    shown = {"semantic": "0.750 cos", "keyword": "12.3 bm25", "hybrid": "0.0328 rrf"}
    for mode, value in (("semantic", 0.5), ("keyword", 12.34), ("hybrid", 0.03279)):
        column = F.col("m")
        score = scoring.display_score(column, F.lit(value), F.lit(value))
        assert one(spark, scoring.format_score(scoring.score_kind(column), score), m=mode) == shown[mode]


def test_parse_modes():
    assert parse_modes(" hybrid, semantic,,hybrid ") == ["hybrid", "semantic"]
    for bad in ("", " , ", "semantic,fuzzy"):
        with pytest.raises(ValueError):
            parse_modes(bad)


@pytest.mark.parametrize(
    "row, error",
    [
        ((" x ", "", "", ""), None),
        (("  \t", "", "99", ""), "missing query text"),
        (("é" * 150, "", "", ""), None),
        (("é" * 151, "", "", ""), "query too long (max 300 bytes)"),
        (("x", "compare", "0", ""), "mode must be one of: keyword, semantic"),
        (("x", "hybrid", "", ""), "mode must be one of: keyword, semantic"),
        (("x", "", "0", ""), "k must be 1..20"),
        (("x", "", "21", ""), "k must be 1..20"),
        (("x", "", "5.0", ""), "k must be 1..20"),
        (("x", "", " 5", ""), "k must be 1..20"),
        (("x", "", "+5", ""), None),
        (("x", "", "99999999999999999999", ""), "k must be 1..20"),
        (("x", "", "", "4096"), None),
        (("x", "", "", "4097"), "nprobe must be 0..4096"),
        (("x", "", "", "-1"), "nprobe must be 0..4096"),
    ],
)
def test_validate(spark, row, error):
    rows = spark.createDataFrame([row], "text string, mode string, k string, nprobe string")
    assert validate_queries(rows, ["keyword", "semantic"]).first()["error"] == error


def test_validate_defaults_and_public(spark):
    rows = spark.createDataFrame([(" x ", None, None, "junk")], "text string, mode string, k string, nprobe string")
    row = validate_queries(rows, ["keyword"], public=True, default_nprobe=8).first()
    assert (row["text"], row["mode"], row["k"], row["nprobe"], row["error"]) == ("x", "keyword", 8, 8, None)
