import json

import pytest
from pyspark.sql import functions as F

from passim.plans.build import build_passages
from passim.sources import shards, vectors


def lines(path, *rows):
    path.write_text("".join(row + "\n" for row in rows))


def record(name):
    return json.dumps({"id": name, "title": "T", "url": "u", "text": "x"})


def test_manifest_order_wins(spark, tmp_path):
    for name in ("passages-00000.jsonl", "passages-00001.jsonl"):
        lines(tmp_path / name, record(name))
    order = ["passages-00001.jsonl", "passages-00000.jsonl"]
    (tmp_path / "corpus.json").write_text(json.dumps({"shards": order}, indent=2))
    assert [name for name, _ in shards.shard_paths(spark, str(tmp_path))] == order
    rows = shards.scan_shards(spark, str(tmp_path)).orderBy("shard_ord").collect()
    assert [(r["id"], r["shard_ord"]) for r in rows] == [(order[0], 0), (order[1], 1)]


def test_sorted_without_manifest(spark, tmp_path):
    for n in (2, 0, 1):
        lines(tmp_path / f"passages-0000{n}.jsonl", record(str(n)))
    names = [name for name, _ in shards.shard_paths(spark, str(tmp_path))]
    assert names == [f"passages-0000{n}.jsonl" for n in range(3)]


def test_single_file(spark, tmp_path):
    lines(tmp_path / "passages.jsonl", record("a"))
    assert [r["id"] for r in shards.scan_shards(spark, str(tmp_path)).collect()] == ["a"]


def test_no_shards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        shards.shard_paths(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        shards.shard_paths(spark, str(tmp_path / "missing"))


def test_blank_lines_and_missing_keys(spark, tmp_path):
    lines(tmp_path / "passages.jsonl", record("a"), "", "  \t", '{"id": "b"}')
    rows = shards.read_passages(spark, [str(tmp_path / "passages.jsonl")]).orderBy("id").collect()
    assert [(r["id"], r["title"], r["text"]) for r in rows] == [("a", "T", "x"), ("b", "", "")]


@pytest.mark.parametrize("bad", ["not json", "[1]", '{"id": "x"', '"text"', '{"id": 7}', '{"id": "x", "text": ["a"]}', '{"title": true}'])
def test_bad_line_is_named(spark, tmp_path, bad):
    path = tmp_path / "passages.jsonl"
    lines(path, record("a"), bad)
    with pytest.raises(Exception, match="passages.jsonl"):
        shards.read_passages(spark, [str(path)]).collect()
    with pytest.raises(Exception, match="bad passage line"):
        shards.read_passages(spark, [str(path)]).select("id").collect()
    found = shards.bad_records(spark, [str(path)]).collect()
    assert [(r["shard"], r["line_no"], r["line"]) for r in found] == [("passages.jsonl", 2, bad)]


def test_long_line_fails(spark, tmp_path):
    path = tmp_path / "passages.jsonl"
    lines(path, record("a"), json.dumps({"id": "b", "text": "x" * (1 << 20)}))
    assert [r["line_no"] for r in shards.bad_records(spark, [str(path)]).collect()] == [2]


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "passages.jsonl"
    lines(path, *[f"bad {i}" if i % 7 == 0 else record(str(i)) for i in range(1, 400)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = shards.bad_records(spark, [str(path)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line_no"], r["line"]) for r in found) == [(i, f"bad {i}") for i in range(7, 400, 7)]


def test_manifest_fields(spark, tmp_path):
    body = {"dataset": "d", "articles": 5355565, "passages": 12519135, "shards": ["a"], "model": "m", "dim": 256}
    (tmp_path / "corpus.json").write_text(json.dumps(body))
    row = shards.read_manifest(spark, str(tmp_path)).first()
    assert (row["passages"], row["articles"], row["dim"], row["dataset"]) == (12519135, 5355565, 256, "d")
    assert shards.read_manifest(spark, str(tmp_path / "none")) is None


def test_query_lines(spark, tmp_path):
    lines(tmp_path / "examples.txt", "first", "", "  second \t")
    rows = shards.read_queries(spark, str(tmp_path / "examples.txt")).collect()
    assert [r["text"] for r in rows] == ["first", "second"]
    assert shards.read_queries(spark, str(tmp_path / "none.txt")).count() == 0


def test_token_table_must_be_dense(spark, tmp_path):
    schema = "token_id long, token string, vec array<double>"
    spark.createDataFrame([(0, "a", [1.0]), (2, "b", [1.0])], schema).write.parquet(str(tmp_path / "gap"))
    with pytest.raises(ValueError, match="not dense"):
        vectors.read_token_table(spark, str(tmp_path / "gap"))
    spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0])], schema).write.parquet(str(tmp_path / "ok"))
    with pytest.raises(ValueError, match="expected 3"):
        vectors.read_token_table(spark, str(tmp_path / "ok"), rows=3)
    assert vectors.read_token_table(spark, str(tmp_path / "ok"), rows=2).count() == 2


def test_unicode_stays_unescaped(spark, tmp_path):
    rows = spark.createDataFrame([("a", "é中", "u", "x", "s")], "id string, title string, url string, text string, shard string")
    shards.write_passages(rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").rglob("*.json"))
    assert "é中" in text


def articles(spark, shard_count, per_shard):
    text = "\n\n".join(["word " * 50, "short", "more " * 60])
    rows = [(f"{s}-{i}", "u", "t", text, f"s{s}", i) for s in range(shard_count) for i in range(per_shard)]
    return spark.createDataFrame(rows, "id string, url string, title string, text string, shard string, pos long")


def test_build_resumes(spark, tmp_path):
    folder = str(tmp_path / "data")
    everything = articles(spark, 3, 4)
    first = build_passages(spark, everything.filter("shard = 's0'"), folder, "d").first()
    assert (first["passages"], first["articles"], first["shards"]) == (8, 4, ["s0"])
    before = sorted(p.name for p in (tmp_path / "data" / "shard=s0").iterdir())
    second = build_passages(spark, everything, folder, "d", "m", 7).first()
    assert (second["passages"], second["articles"]) == (24, 12)
    assert second["shards"] == ["s0", "s1", "s2"] and second["dim"] == 7
    assert sorted(p.name for p in (tmp_path / "data" / "shard=s0").iterdir()) == before
    assert shards.scan_shards(spark, folder).count() == 24


def test_build_limit_carries_over(spark, tmp_path):
    folder = str(tmp_path / "data")
    everything = articles(spark, 3, 4)
    build_passages(spark, everything.filter("shard = 's0'"), folder, "d", limit=11)
    capped = build_passages(spark, everything, folder, "d", limit=11).first()
    assert (capped["passages"], capped["shards"]) == (12, ["s0", "s1"])
    again = build_passages(spark, everything, folder, "d", limit=11).first()
    assert again["passages"] == 12
    assert shards.scan_shards(spark, folder).agg(F.count_distinct("id")).first()[0] == 12


def test_check_names_the_line(spark, tmp_path):
    path = tmp_path / "passages.jsonl"
    lines(path, record("a"), "", '{"id": null, "other": 5}', '{"id": 3}', "junk")
    with pytest.raises(ValueError, match=r"passages.jsonl:4: bad passage line: .*3"):
        shards.check_passages(spark, [str(path)])
    lines(path, record("a"), '{"id": null, "other": 5}')
    shards.check_passages(spark, [str(path)])
    assert sorted(r["id"] for r in shards.read_passages(spark, [str(path)]).collect()) == ["", "a"]


def test_interrupted_build_goes_on_after_its_last_group(spark, tmp_path, monkeypatch):
    from passim.plans import build

    folder = str(tmp_path / "data")
    everything = articles(spark, 5, 2).withColumn("text", F.when(F.col("shard") == "s1", "short").otherwise(F.col("text")))
    write, calls = shards.write_passages, []

    def fails_at_third(rows, target):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        write(rows, target)

    monkeypatch.setattr(build.shards, "write_passages", fails_at_third)
    with pytest.raises(RuntimeError, match="lost"):
        build_passages(spark, everything, folder, "d", commit_shards=2)
    part = shards.read_manifest(spark, folder).first()
    assert part["shards"] == ["s0", "s1", "s2", "s3"] and part["passages"] == 12 and part["shard_stats"]["s1"]["passages"] == 0
    kept = {p.name for p in (tmp_path / "data" / "shard=s0").iterdir()}
    done = build_passages(spark, everything, folder, "d", commit_shards=2).first()
    assert done["shards"] == ["s0", "s1", "s2", "s3", "s4"] and done["passages"] == 16 and len(calls) == 4
    assert {p.name for p in (tmp_path / "data" / "shard=s0").iterdir()} == kept
    assert shards.scan_shards(spark, folder).count() == 16
    assert build_passages(spark, everything, folder, "d").first()["version"] == done["version"] and len(calls) == 4
