import numpy as np
import pytest
from pyspark.sql import functions as F

from passim.functions import vector
from passim.operators import cells, codes, embedding, nearest, quality


def frame(spark, matrix, ids=None, kind="long"):
    ids = list(range(len(matrix))) if ids is None else ids
    rows = [(i, [float(x) for x in row]) for i, row in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"id {kind}, values array<float>")


def brute(queries, vectors, k, qids, ids):
    """The first ``k`` by rounded squared distance, then id."""
    queries, vectors = queries.astype(np.float32).astype(float), vectors.astype(np.float32).astype(float)
    out = {}
    for qid, q in zip(qids, queries):
        dist = np.round(((vectors - q) ** 2).sum(axis=1), 9)
        out[qid] = [i for _, i in sorted(zip(dist, ids))][:k]
    return out


def answer(hits):
    out = {}
    for row in hits.orderBy("qid", "rank").collect():
        out.setdefault(row["qid"], []).append(row["id"])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(300, 8))
    matrix[100:220] = matrix[100]  # copies of one vector
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


# Budgets in bytes: both sides fit; only the queries; only the vectors; neither.
@pytest.mark.parametrize("queries, vectors, budget", [(40, 300, 1 << 20), (40, 300, 8000), (300, 40, 8000), (300, 300, 8000)])
def test_knn_equals_brute_force_in_every_plan(spark, data, queries, vectors, budget):
    left, right = data[:queries], data[:vectors]
    hits = nearest.knn(frame(spark, left), frame(spark, right), 7, budget)
    assert answer(hits) == brute(left, right, 7, range(queries), range(vectors))


def test_knn_text_ids_and_small_collections(spark, data):
    names = [f"v-{i}" for i in range(5)]
    hits = nearest.knn(frame(spark, data[:3]), frame(spark, data[:5], names, "string"), 10)
    assert answer(hits) == brute(data[:3], data[:5], 10, range(3), names)
    empty = frame(spark, data[:3]).limit(0)
    assert nearest.knn(empty, frame(spark, data), 3).count() == 0
    assert nearest.knn(frame(spark, data), empty, 3).count() == 0


def test_mixed_widths_fail(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "id long, values array<float>")
    with pytest.raises(Exception, match="different widths"):
        nearest.knn(rows, rows, 1).collect()


@pytest.mark.parametrize("budget", [1 << 20, 4000])
def test_probing_hot_cells(spark, data, budget):
    """A third of the vectors share one cell."""
    centers = data[[0, 100, 250]]
    index = cells.assign_cells(frame(spark, data), frame(spark, centers, kind="int"))
    home = {r["id"]: r["cell"] for r in index.collect()}
    hits = answer(cells.ivf_search(frame(spark, data), index, frame(spark, centers, kind="int"), 5, 1, budget))
    for qid in range(len(data)):
        same = [i for i in range(len(data)) if home[i] == home[qid]]
        assert hits[qid] == brute(data[qid : qid + 1], data[same], 5, [qid], same)[qid]


def test_recall_rises_to_one(spark):
    rows = frame(spark, np.random.default_rng(3).normal(size=(400, 8)))
    model = cells.train_cells(rows, 20, iterations=5)
    index = cells.assign_cells(rows, model)
    exact = nearest.knn(rows, rows, 10)
    found = []
    for nprobe in (1, 5, 10, 20):
        recall = quality.recall_at_k(cells.ivf_search(rows, index, model, 10, nprobe), exact)
        found.append(recall.agg(F.avg("recall")).first()[0])
    assert found == sorted(found) and found[0] < found[-1] == 1.0


def test_training_lowers_the_error_and_keeps_empty_cells(spark):
    rows = frame(spark, np.repeat(np.eye(4), 10, axis=0))
    model = cells.train_cells(rows, 8)
    assert model.count() == 8
    index = cells.assign_cells(rows, model)
    assert index.groupBy("values").agg(F.count_distinct("cell").alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("budget", [1 << 20, 4000])
def test_code_search(spark, budget):
    matrix = np.random.default_rng(5).normal(size=(200, 8))
    rows = frame(spark, matrix)
    books = codes.train_pq(rows, 4, 16, iterations=4)
    index = codes.encode_pq(rows, books)
    exact = nearest.knn(rows, rows, 5)
    recall = []
    for rescore in (-1, 20, 200):
        hits = codes.pq_search(rows, index, books, 5, rescore, budget)
        recall.append(quality.recall_at_k(hits, exact).agg(F.avg("recall")).first()[0])
    assert recall == sorted(recall) and recall[-1] == 1.0
    decoded = codes.decode_pq(index, books)
    assert codes.encode_pq(decoded, books).exceptAll(codes.encode_pq(decoded, books).select(*decoded.columns)).count() == 0


def value(spark, column, vec):
    return spark.createDataFrame([(vec,)], "v array<double>").select(column.alias("x")).first()["x"]


def test_expressions(spark):
    for distance, cosine in ((0.0, 1.0), (2.0, 0.0), (4.0, -1.0), (0.5, 0.75)):
        assert value(spark, vector.cosine_from_l2(F.lit(distance)), [1.0]) == cosine
    v = F.col("v")
    assert value(spark, vector.l2_normalize(v), [3.0, 4.0]) == [0.6, 0.8]
    assert value(spark, vector.l2_normalize(v), [0.0, 0.0]) == [0.0, 0.0]
    assert value(spark, vector.is_zero(v), [0.0, 0.0]) and not value(spark, vector.is_zero(v), [0.0, 1e-9])
    assert value(spark, vector.check_dim(v, 2), [1.0, 2.0]) == [1.0, 2.0]
    with pytest.raises(Exception, match="width 2, expected 384"):
        value(spark, vector.check_dim(v, 384), [1.0, 2.0])


def test_static_embedding_drops_unknown_words(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vec array<double>")
    texts = spark.createDataFrame([(1, "a A b zzz a"), (2, "zzz"), (3, "")], "id long, text string")
    rows = embedding.static_embed(texts, table, 2).collect()
    assert [r["id"] for r in rows] == [1]
    assert rows[0]["values"] == pytest.approx([3 / np.sqrt(10), 1 / np.sqrt(10)])


def test_golden_check_finds_drift(spark):
    stored = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [1.0])], "text string, values array<double>")
    encoded = spark.createDataFrame([("x", [1.0, 1e-7]), ("y", [0.1, 1.0])], "text string, values array<double>")
    rows = {r["text"]: r["ok"] for r in embedding.golden_check(encoded, stored).collect()}
    assert rows == {"x": True, "y": False, "z": False}


def test_encoder_is_built_once_per_task_and_batches_by_length(spark):
    def factory():
        sizes = []

        def encode(texts):
            sizes.append(len(texts))
            assert len(texts) <= 4 and max(map(len, texts)) - min(map(len, texts)) <= 8
            return np.array([[len(text), len(sizes)] for text in texts])

        return encode

    rows = spark.createDataFrame([(i, "x" * (i * 37 % 64)) for i in range(64)], "id long, text string").coalesce(1)
    out = {r["id"]: r["values"] for r in embedding.embed(rows, factory, batch=4).collect()}
    assert {i: v[0] for i, v in out.items()} == {i: i * 37 % 64 for i in range(64)}
    assert max(v[1] for v in out.values()) == 16


def test_two_levels_train_beyond_the_budget(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 6)) * 20
    matrix = np.concatenate([centres[rng.integers(0, 24, 500)], np.repeat(centres[:1], 300, axis=0)]) + rng.normal(size=(800, 6))
    rows = frame(spark, matrix)
    # Five centroids fit; one group holds more than a third of all rows.
    budget = 5 * (8 * 6 + 64)
    model = cells.train_cells(rows, 24, iterations=4, budget=budget)
    table = model.orderBy("id").collect()
    assert [r["id"] for r in table] == list(range(24))
    index = cells.assign_cells(rows, model, budget)
    assert index.count() == 800
    means = np.array([r["values"] for r in table])
    error = lambda m: float(((matrix[:, None, :] - m[None]) ** 2).sum(axis=2).min(axis=1).sum())
    coarse = np.array([r["values"] for r in cells.train_cells(rows, 5, iterations=4).collect()])
    assert error(means) < error(coarse) / 2


def test_shares_are_whole_and_bounded():
    assert cells.shares([10, 10, 10], 9) == [3, 3, 3]
    assert sum(cells.shares([1000, 3, 1], 40)) == 40 and cells.shares([1000, 3, 1], 40)[2] == 1
    assert cells.shares([2, 1], 9) == [2, 1]


def test_step_beyond_the_budget_is_the_same(spark, data):
    rows, model = frame(spark, data), frame(spark, data[:40:4]).withColumn("id", F.col("id").cast("int"))
    table = lambda df: {r["id"]: [round(x, 7) for x in r["values"]] for r in df.collect()}
    assert table(cells.lloyd_step(rows, model)) == table(cells.lloyd_step(rows, model, budget=500))


def test_static_vectors_of_any_width_in_blocks(spark):
    rng, dim = np.random.default_rng(6), 256
    tokens = {f"t{i}": rng.normal(size=dim) for i in range(60)}
    texts = [" ".join(rng.choice([*tokens, "unknown"], rng.integers(0, 50))) for _ in range(80)] + ["", None, "unknown", "T1 t1, t2!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    table = spark.createDataFrame([(t, v.tolist()) for t, v in tokens.items()], "token string, vec array<double>")
    wanted = {}
    for i, text in enumerate(texts):
        known = [tokens[t] for t in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if t in tokens]
        if known:
            mean = np.mean(known, axis=0)
            wanted[i] = mean / np.linalg.norm(mean)
    for budget in (1 << 24, 20 * (8 * dim + 64)):
        found = {r["id"]: r["values"] for r in embedding.static_embed(df, table, dim, budget=budget).collect()}
        assert set(found) == set(wanted)
        assert all(np.allclose(found[i], wanted[i], atol=1e-12) for i in wanted)
    plan = embedding.static_embed(df, table, dim)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_windows_pad_as_reported(spark):
    from passim.operators.passages import length_buckets, padding_report

    rng = np.random.default_rng(7)
    rows = [(f"{s}-{i}", s, i, "x" * int(rng.integers(0, 300)) or None) for s in ("a", "b") for i in range(700)]
    df = spark.createDataFrame(rows, "id string, shard string, ord long, text string").repartition(5)

    def factory():
        return lambda texts: np.array([[max(map(len, texts)), len(t), len(texts)] for t in texts], dtype=np.float32)

    found = embedding.embed_windows(df, factory, "ord", window=256, slice_rows=64, batch=16).collect()
    assert {(r["id"], len(r["text"] or "")) for r in found} == {(i, len(t or "")) for i, _, _, t in rows}
    assert all(r["values"][1] == len(r["text"] or "") for r in found) and len(found) == 1400
    report = padding_report(length_buckets(df, "ord", F.length(F.coalesce("text", F.lit(""))), 256, 64, 16), 16).collect()
    assert {r["shard"]: r["sorted_length"] for r in report} == {s: sum(r["values"][0] for r in found if r["shard"] == s) for s in "ab"}


def test_a_block_sorts_only_what_it_offers(monkeypatch):
    """Lists of other queries are left alone, however many there are."""
    rng, sizes = np.random.default_rng(8), []
    queries, vectors = rng.normal(size=(2000, 4)), rng.normal(size=(500, 4))
    best = nearest.BestK(len(queries), 5)
    nearest.add_blocks(best, queries, np.arange(len(queries)), vectors[:400], np.arange(400))
    plain = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or plain(keys))
    nearest.add_blocks(best, queries, np.arange(20), vectors[400:], np.arange(400, 500))
    assert max(sizes, default=0) <= 20 * (5 + 100)
    rows, dist, names = best.found(0, 20)
    for q in range(20):
        exact = np.round(((vectors - queries[q]) ** 2).sum(axis=1), 9)
        assert names[rows == q].tolist() == plain((np.arange(500), exact))[:5].tolist()


def test_a_query_goes_once_to_a_block_of_cells(spark):
    """Not once for each of the cells that it probes there."""
    rng = np.random.default_rng(9)
    matrix = rng.normal(size=(120, 4))
    rows = frame(spark, matrix)
    model = frame(spark, matrix[:30], kind="int")
    probes = cells.probe_cells(rows, model, 30)
    held = cells.with_cells(rows, probes).collect()
    assert len(held) == 120 and all(len(r["cells"]) == 30 for r in held)
    hits = cells.ivf_search(rows, cells.assign_cells(rows, model), model, 5, 30, budget=2000)
    assert answer(hits) == brute(matrix, matrix, 5, range(120), range(120))


@pytest.mark.parametrize("pool", [40, 120, 5000])
def test_pools_are_measured_where_the_codes_are(spark, data, monkeypatch, pool):
    """No table of queries times pool is joined, and the answer is as with such joins."""
    rows = frame(spark, data[:200])
    books = codes.train_pq(rows, 2, 4, iterations=2)
    coded = codes.encode_pq(rows, books)
    joined = answer(codes.pq_search(rows, coded, books, 6, rescore=pool))

    def fail(*_):
        raise AssertionError("joined")

    monkeypatch.setattr(codes, "broadcast_within", fail)
    assert answer(codes.pq_search(rows, coded, books, 6, rescore=pool, budget=4000)) == joined


def test_codes_only_beyond_the_budget(spark, data):
    rows = frame(spark, data)
    books = codes.train_pq(rows, 2, 4, iterations=2)
    coded = codes.encode_pq(rows, books)
    hits = [codes.pq_search(rows, coded, books, 6, rescore=-1, budget=budget) for budget in (1 << 24, 4000)]
    assert answer(hits[0]) == answer(hits[1])


def test_static_vectors_tokenize_each_text_a_fixed_number_of_times(spark):
    """Not once for each block of a large token table."""
    df = spark.createDataFrame([(i, f"t{i} t{i + 1} other") for i in range(50)], "id int, text string")
    table = spark.createDataFrame([(f"t{i}", [float(i), 1.0]) for i in range(60)], "token string, vec array<double>")
    found = embedding.static_embed(df, table, 2, budget=200)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    same = {r["id"]: r["values"] for r in embedding.static_embed(df, table, 2).collect()}
    for row in found.collect():
        assert np.allclose(row["values"], same.pop(row["id"]), atol=1e-12)
    assert not same


def test_the_encoder_remembers_few_tokens(monkeypatch):
    from passim.registry import vectors as registered

    monkeypatch.setattr(registered, "_KNOWN_TOKENS", 10, raising=False)
    encode = registered.token_encoder()
    encode([" ".join(f"w{i}" for i in range(100))])
    inner = dict(zip(encode.__code__.co_freevars, encode.__closure__))["vec"].cell_contents
    known = dict(zip(inner.__code__.co_freevars, inner.__closure__))["known"].cell_contents
    assert len(known) <= 10


def test_blocks_hold_all_the_queries_of_their_cells():
    """A group of cells has the queries of all of them, not of the largest one."""
    groups = nearest._cell_groups({1: 10, 2: 10, 3: 500}, {1: 40, 2: 60, 3: 30}, 80, 20, 100)
    assert groups[1] == groups[2] == (0, 4, 1)
    assert groups[3][1:] == (2, 5)
