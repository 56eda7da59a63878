"""Vector expressions over ``ARRAY<FLOAT>`` columns, computed in DOUBLE."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from passim.functions.text import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def norm(vec: Column) -> Column:
    return F.sqrt(_sum(F.transform(vec, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(vec: Column) -> Column:
    """Divide by the Euclidean norm; a zero vector stays zero."""
    return let(
        norm(vec),
        lambda n: F.transform(
            vec, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)
        ),
    )


def squared_l2(a: Column, b: Column) -> Column:
    def square(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _sum(F.zip_with(a, b, square))


def check_dim(vec: Column, dim: int) -> Column:
    """The vector itself, or an error naming both widths."""
    wrong = F.raise_error(
        F.concat(F.lit("vector has width "), F.size(vec).cast("string"), F.lit(f", expected {dim}"))
    )
    return F.when(F.size(vec) == dim, vec).otherwise(wrong.cast("array<double>"))


def is_zero(vec: Column) -> Column:
    return F.forall(vec, lambda x: x == 0)


def cosine_from_l2(distance: Column) -> Column:
    """Cosine similarity of two unit vectors from their squared distance."""
    return F.lit(1.0) - distance / F.lit(2.0)


def mean_vector(vec: Column, dim: int) -> Column:
    """Aggregate: component-wise mean, combined map-side by the hash aggregate."""
    return F.array(*[F.avg(F.get(vec, F.lit(i)).cast("double")) for i in range(dim)])


def sum_vector(vec: Column, dim: int) -> Column:
    """Aggregate: component-wise sum."""
    return F.array(*[F.sum(F.get(vec, F.lit(i)).cast("double")) for i in range(dim)])
