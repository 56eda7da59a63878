"""Whitening beside plain whole numbers and floats of high precision."""

import math

import numpy as np
import pytest

from passim.llm import whitening
from passim.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n string"


def plain(rows, scale=64, shift=1_000_000):
    width = len(rows[0])
    x = [[math.floor(scale * c) + shift for c in r] for r in rows]
    n, sums = len(x), [sum(r[d] for r in x) for d in range(width)]
    cross = [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    covariance = np.array([[c / n**2 for c in r] for r in cross])
    return x, sums, covariance


def check(found, rows, ids, count):
    x, sums, covariance = plain(rows)
    n, values = len(x), np.linalg.eigvalsh(covariance)[::-1]
    table = {}
    for r in found:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert set(table) == set(ids) and all(set(v) == set(range(1, count + 1)) for v in table.values())
    z = np.array([[table[i][c].whitened for c in range(1, count + 1)] for i in ids])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(count)).max() < 1e-9
    for i, own in zip(ids, x, strict=True):
        for c, r in table[i].items():
            assert r.n == n and int(r.deviation) == sum((n * v - s) ** 2 for v, s in zip(own, sums, strict=True))
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
    # A whitened component is the centred vector on one unit direction, over the root of its eigenvalue.
    centred = np.array(x, dtype=float) - np.array(sums) / n
    basis = np.linalg.lstsq(centred, z * np.sqrt(values[:count]), rcond=None)[0]
    assert np.allclose(basis.T @ basis, np.eye(count), atol=1e-6)
    assert np.allclose(covariance @ basis, basis * values[:count], atol=1e-6 * values[0])


def test_equals_plain_whole_numbers(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 6)) @ np.diag([9, 5, 3, 2, 1, 0.5])
    rows[:, 2] += 70_000
    rows = rows.astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, r.tolist(), "x") for i, r in enumerate(rows)], SCHEMA).repartition(5)
    model = whitening.fit_whitening(frame, components=4)
    check(whitening.whiten(frame, model).collect(), rows.tolist(), range(300), 4)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, -1.0]), (1, [0.5, -1.0]), (None, [2.0, 0.25]), (3, [-3.0, 1.0]), (4, [0.0, 0.0])]
    bad = [(5, None), (6, []), (7, [None, 1.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [-inf, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in good + bad], SCHEMA)
    model = whitening.fit_whitening(frame)
    found = whitening.whiten(frame, model).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == [(False, 1)] * 4 + [(False, 3)] * 2 + [(False, 4)] * 2 + [(True, 0)] * 2
    assert {r.n for r in found} == {5} and {r.component for r in found} == {1, 2}
    x, sums, _ = plain([v for _, v in good])
    assert {int(r.deviation) for r in found if r.vec_id == 3} == {sum((5 * v - s) ** 2 for v, s in zip(x[3], sums, strict=True))}


def test_without_rows_or_variance(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none, whitening.fit_whitening(none)).count() == 0
    alike = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(3)], SCHEMA)
    found = whitening.whiten(alike, whitening.fit_whitening(alike)).collect()
    assert {(r.component, r.whitened, r.explained, r.identity_error) for r in found} == {(1, 0, 0, 0), (2, 0, 0, 0)}


def test_huge_components_stay_exact(spark):
    rows = [[3.0e15, 1.0], [-3.0e15, 2.0], [1.0, 3.0]]
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n string")
    x, sums, _ = plain(rows)
    found = whitening.whiten(frame, whitening.fit_whitening(frame)).where("component = 1").collect()
    assert {r.vec_id: int(r.deviation) for r in found} == {i: sum((3 * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}


def test_planes_count_products():
    rng = np.random.default_rng(1)
    y = np.stack([rng.integers(0, 2**b, 777) for b in (1, 5, 9, 20)], axis=1)
    bits = [1, 5, 9, 20]
    found = {(i, j): t for i, j, t in whitening.weighted(whitening.plane_counts(whitening.bit_planes(y, bits)), bits)}
    assert found == {(i, j): int((y[:, i] * y[:, j]).sum()) for i in range(4) for j in range(i, 4)}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, folder).collect(), [list(r.embedding) for r in rows], [r.vec_id for r in rows], 32)
