"""How a hit's score is named, computed and printed in each search mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from passim.functions.vector import cosine_from_l2

# The three search modes and the score each one shows.
MODES = ("semantic", "keyword", "hybrid")


def score_kind(mode: Column) -> Column:
    return F.when(mode == "keyword", "bm25").when(mode == "hybrid", "rrf").otherwise("cosine")


def display_score(mode: Column, distance: Column, score: Column) -> Column:
    """Cosine for vector search; the stored score otherwise."""
    return F.when(mode == "semantic", cosine_from_l2(distance)).otherwise(score)


def format_score(kind: Column, score: Column) -> Column:
    """Three decimals for cosine, one for BM25, four for fused scores."""
    return (
        F.when(kind == "bm25", F.format_string("%.1f bm25", score))
        .when(kind == "rrf", F.format_string("%.4f rrf", score))
        .otherwise(F.format_string("%.3f cos", score))
    )
