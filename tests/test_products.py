"""Products of blocks of vectors, and the blocks that are paired."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passim.operators import codes, nearest


@pytest.fixture
def partitioned(monkeypatch):
    """Cells that were partitioned, by call."""
    cells, plain = [], np.partition
    monkeypatch.setattr(np, "partition", lambda rows, *a, **b: cells.append(rows.size) or plain(rows, *a, **b))
    return cells


def nearest_rows(queries, vectors, k):
    exact = [np.round(((vectors - q) ** 2).sum(axis=1), 9) for q in queries]
    return [np.lexsort((np.arange(len(vectors)), d))[:k].tolist() for d in exact]


def lists(best):
    rows, _, names = best.found()
    return [names[rows == q].tolist() for q in range(len(best.bound))]


def test_a_bound_is_found_among_few_vectors(partitioned):
    """Not by going through the distances to all of them, and a product is of few vectors."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40_000, 6))
    best = nearest.BestK(30, 10)
    nearest.add_blocks(best, vectors[:30], np.arange(30), vectors, np.arange(40_000))
    assert sum(partitioned) <= 30 * 4096
    assert lists(best) == nearest_rows(vectors[:30], vectors, 10)


@pytest.mark.parametrize("shift, scale", [(1e4, 1.0), (0.0, 1e-20), (0.0, 1e18), (0.0, 1e25), (3e5, 1e-3)])
def test_single_precision_loses_no_neighbour(shift, scale):
    """Vectors far from 0 and near to each other, tiny ones, and such as only DOUBLE can hold."""
    rng = np.random.default_rng(2)
    vectors = shift + scale * rng.normal(size=(3000, 8))
    held, best = np.arange(3000), nearest.BestK(20, 7)
    nearest.add_blocks(best, vectors[:20], np.arange(20), vectors, held)
    for q, found in enumerate(lists(best)):
        exact = nearest.squared_distances(vectors[q : q + 1], vectors)[0]
        far = np.sort(exact)[6]
        # What DOUBLE itself cannot tell apart.
        unsure = 1e-14 * (vectors[q] ** 2).sum() * 8 + 2e-9
        assert len(found) == 7 and (exact[found] <= far + unsure).all()


def test_rows_without_a_number_are_never_found():
    vectors = np.random.default_rng(3).normal(size=(2500, 4))
    vectors[5, 1], vectors[2400, 0] = np.nan, np.nan
    best = nearest.BestK(3, 4)
    nearest.add_blocks(best, vectors[:3], np.arange(3), vectors, np.arange(2500))
    whole = np.delete(np.arange(2500), [5, 2400])
    assert lists(best) == [whole[found].tolist() for found in nearest_rows(vectors[:3], vectors[whole], 4)]


def test_a_whole_pool_measures_only_what_its_codes_leave_open(monkeypatch):
    """Two far groups with close codes: the other group's vectors are ruled out by code."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(12_000, 4)) * 0.1
    vectors[6000:] += 50.0
    books = np.stack([vectors[::100, :2], vectors[::100, 2:]])
    coded = codes.nearest_codes(vectors, books)
    cells, plain = [], nearest.NearVectors.cut

    def cut(self, queries):
        near = plain(self, queries)
        return lambda some, rows=slice(None): cells.append((self.vectors is vectors, near(some, rows)[0].size)) or near(some, rows)

    monkeypatch.setattr(nearest.NearVectors, "cut", cut)
    asked, best = vectors[[0, 1, 6000, 6001]], nearest.BestK(4, 5)
    codes._add_pooled(best, asked, asked, np.arange(4), vectors, vectors, coded, np.arange(12_000), books)
    assert sum(n for exact, n in cells if not exact) == 4 * 12_000
    # The queries of the first group; those of the second meet the first group while their lists are far.
    assert sum(n for exact, n in cells if exact) <= 2 * 7000 + 2 * 12_000
    assert lists(best) == nearest_rows(asked, vectors, 5)


def test_code_search_finds_its_bound_among_few_codes(partitioned):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20_000, 4))
    books = np.stack([vectors[:50, :2], vectors[:50, 2:]])
    coded = codes.nearest_codes(vectors, books)
    best = nearest.BestK(10, 20)
    codes.add_codes(best, vectors[:10], np.arange(10), coded, np.arange(20_000), books)
    assert sum(partitioned) <= 10 * 2 * 4096
    table = codes.sub_distances(vectors[:10], books)
    sums = [np.round(table[0][q, coded[:, 0]] + table[1][q, coded[:, 1]], 9) for q in range(10)]
    assert lists(best) == [np.lexsort((np.arange(20_000), d))[:20].tolist() for d in sums]


def test_many_vectors_are_copied_to_few_blocks_of_queries():
    """And few are cut until all cores have pairs."""
    rows = 615_384
    (group,) = set(nearest._sized_groups({0: rows}, {0: rows}, rows, nearest._block_queries(10), 116_508, 24).values())
    assert group[1] + group[2] <= 16 and group[1] * group[2] >= 24
    (small,) = set(nearest._sized_groups({0: 60_000}, {0: 60_000}, 60_000, nearest._block_queries(10), 116_508, 24).values())
    assert small[1] * small[2] >= 24
    assert nearest._block_queries(100) == nearest._LEAST_QUERIES


@pytest.mark.parametrize("count, parts", [(60, 60), (150, 40), (1, 1)])
def test_pairs_are_dealt_evenly(spark, count, parts):
    """No task has two pairs of blocks while another has none."""
    numbers = nearest.dealt_numbers(count, parts)
    assert len(set(numbers)) == count
    dealt = spark.createDataFrame([(n,) for n in numbers], "n int").repartition(parts, "n").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == parts and {r["count"] for r in dealt} <= {count // parts, -(-count // parts)}
