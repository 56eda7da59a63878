"""Several streams into one collection lose nothing."""

import pytest
from pyspark.sql import functions as F

from passim.session import create_new
from passim.streaming.upsert import claim_generation, current_version, finish, read_collection, stream_upsert

SCHEMA = "id string, values array<double>, metadata map<string,string>, pos long"


def rows_of(first: int, n: int, value: float):
    return [(f"v{i:03}", [value, float(i)], {}, i) for i in range(first, first + n)]


def send(spark, base, stream: str, lots, compact_every: int):
    for lot in lots:
        spark.createDataFrame(lot, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/{stream}-in")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{base}/{stream}-in")
        route = lambda df: df.withColumn("cell", F.lit(0).cast("int"))
        stream_upsert(arriving, f"{base}/collection", f"{base}/{stream}-state", route, compact_every=compact_every).awaitTermination(120)


@pytest.mark.parametrize("compact_every", [0, 1])
def test_two_streams(spark, tmp_path, compact_every):
    base = str(tmp_path)
    send(spark, base, "a", [rows_of(0, 10, 1.0), rows_of(5, 10, 2.0)], compact_every)
    send(spark, base, "b", [rows_of(100, 10, 3.0), rows_of(0, 3, 4.0)], compact_every)
    finish(spark, f"{base}/collection")
    found = {r["id"]: r["values"][0] for r in read_collection(spark, f"{base}/collection").collect()}
    wanted = {r[0]: r[1][0] for lot in (rows_of(0, 10, 1.0), rows_of(5, 10, 2.0), rows_of(100, 10, 3.0), rows_of(0, 3, 4.0)) for r in lot}
    assert found == wanted
    assert current_version(spark, f"{base}/collection")[1] == 3


def test_only_a_missing_list_is_empty(spark, tmp_path):
    assert current_version(spark, str(tmp_path / "nowhere")) == (0, -1)


def test_a_claimed_generation_is_not_taken_again(spark, tmp_path):
    path = str(tmp_path / "c")
    assert create_new(spark, f"{path}/claims/0") and not create_new(spark, f"{path}/claims/0")
    assert claim_generation(spark, path, "a", 0) == 1
    # A replay finds its own.
    assert claim_generation(spark, path, "a", 0) == 1
