"""Run registered queries beside their SQL and compare the rows.

``python tests/oracle.py [--sf DIR] [name ...]``
"""

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_integer_ratio"):
        return int(value) if value == int(value) else repr(float(value))
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(columns, rows, con, sql: str) -> list[str]:
    """Differences between a Spark result and the SQL; empty if equal."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = bag(names, result.fetchall())
    actual = bag(columns, rows)
    if sorted(names) != sorted(columns):
        return [f"columns {sorted(columns)} expected {sorted(names)}"]
    lost, extra = expected - actual, actual - expected
    if not lost and not extra:
        return []
    return [
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; {sum(lost.values())} missing, {sum(extra.values())} extra",
        f"missing {list(lost)[:3]}",
        f"extra {list(extra)[:3]}",
    ]


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, failed = database(args.sf), entry.queries(), entry.oracle_sql(), 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            rows = df.collect()
            note = f" spark {time.time() - start:.1f}s, {len(rows)} rows" + ("" if name in oracles else ", no SQL")
            problems = compare(df.columns, rows, con, oracles[name]) if name in oracles else []
        except Exception as error:  # noqa: BLE001
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{note}", flush=True)
        for line in problems:
            print("      " + line[:2000], flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
