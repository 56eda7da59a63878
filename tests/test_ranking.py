import random
from itertools import accumulate

from pyspark.sql import functions as F

from passim.operators import passages
from passim.operators.ranking import row_positions, running_total, top_k


def test_running_total_of_sparse_and_hot_groups(spark):
    random.seed(1)
    rows = [("hot", ord, random.randint(0, 9)) for ord in random.sample(range(1 << 40), 500)]
    rows += [("hot", ord, 1) for ord in range(200_000, 200_400)] + [("small", 5, 3), ("small", 1 << 33, 4)]
    df = spark.createDataFrame(rows, "g string, ord long, v long").repartition(8)
    got = {(r["g"], r["ord"]): (r["before"]) for r in running_total(df, ["g"], "ord", F.col("v"), "before").collect()}
    for group in ("hot", "small"):
        mine = sorted((o, v) for g, o, v in rows if g == group)
        sums = [0, *accumulate(v for _, v in mine)]
        assert [got[(group, o)] for o, _ in mine] == sums[:-1]
    places = row_positions(df, ["g"], "ord").filter("g = 'hot'").orderBy("ord").select("row_pos").collect()
    assert [r[0] for r in places] == list(range(900))


def test_top_k_above_the_window_limit(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "a").otherwise("b").alias("g"), "id")
    rows = top_k(df, ["g"], [F.col("id").desc()], 1500).groupBy("g").agg(F.count("*"), F.min("id"), F.max("rank"))
    assert sorted(map(tuple, rows.collect())) == [("a", 1500, 2500, 1500), ("b", 1000, 4000, 1000)]


def cap_reference(counts, limit):
    kept, seen = [], 0
    for key, n in sorted(counts.items()):
        if seen >= limit:
            break
        seen += n
        kept.append(key)
    return kept


def test_cap_keeps_whole_articles_in_order(spark):
    random.seed(2)
    counts = {(f"s{s}", pos): random.randint(1, 3) for s in range(4) for pos in random.sample(range(10**6), 40)}
    rows = [(s, pos, f"{s}-{pos}-{i}") for (s, pos), n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "shard string, pos long, id string")
    total = len(rows)
    for limit in (1, 2, 57, 80, 150, total, total + 5):
        got = {(r["shard"], r["pos"]) for r in passages.cap_articles(df, limit).collect()}
        assert sorted(got) == cap_reference(counts, limit)
    assert passages.cap_articles(df, 0) is df


def test_length_buckets_follow_a_stable_sort(spark):
    random.seed(3)
    rows = [("s", i, random.randint(1, 20)) for i in range(150)]
    df = spark.createDataFrame(rows, "shard string, ord long, n long").withColumn("id", F.col("ord"))
    out = passages.length_buckets(df, "ord", F.col("n"), window=64, slice_rows=16, batch=4)
    got = {r["ord"]: (r["window_no"], r["slice_no"], r["batch_no"]) for r in out.collect()}
    for start in range(0, 150, 64):
        window = sorted(rows[start : start + 64], key=lambda r: r[2])
        for i, (_, ord, _) in enumerate(window):
            assert got[ord] == (start // 64, i // 16, i % 16 // 4)
    report = passages.padding_report(out, batch=4).first()
    assert report["real_length"] <= report["sorted_length"] <= report["arrival_length"]
