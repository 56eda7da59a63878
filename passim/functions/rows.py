"""Arrays to rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per non-NULL array element beside the kept columns.

    An inner explode is planned with a filter on the array's size, which
    evaluates the array expression again before the rows are made. For arrays
    of cleaned or tokenized text that doubles the work; an outer explode with
    the empty rows dropped afterwards evaluates it once.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())
