"""Buckets, passes and rounds of the n-gram Jaccard join."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passim.llm import jaccard


def linked_sets(rng, n, plan):
    """Two sets of about ``n`` hashes, as far apart as a link allows."""
    a = np.unique(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
    for gone in range(n, -1, -1):
        new = rng.integers(0, gone + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, (1 << 64) - 1, new, dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and shared * plan.share.denominator >= (len(a) + len(b) - shared) * plan.share.numerator:
            return a, b
    raise AssertionError


@pytest.mark.parametrize("threshold", [0.9, 0.8])
def test_linked_sets_share_a_bucket(threshold):
    rng, plan = np.random.default_rng(1), jaccard.Plan(threshold)
    for n in [*range(5, 120), 200, 333, 500, 800, 1500, 4000]:
        for _ in range(4):
            a, b = linked_sets(rng, n, plan)
            assert len(a) == len(b) and (a == b).all() or np.intersect1d(jaccard.keys(a, plan), jaccard.keys(b, plan)).size


def test_few_parts_agree_by_chance():
    """Sets with a common passage, but no link, hardly ever share a bucket."""
    rng, plan = np.random.default_rng(2), jaccard.Plan()
    common = rng.integers(0, (1 << 64) - 1, 30, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, (1 << 64) - 1, 300, dtype=np.uint64)])) for _ in range(300)]
    every = np.concatenate([jaccard.keys(s, plan) for s in sets])
    assert len(every) - len(np.unique(every)) <= len(every) // 1000


@pytest.mark.parametrize("seed", range(6))
def test_runs_drop_buckets_of_one_node(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randint(0, 40), rng.randint(0, 3)) for _ in range(rng.randint(1, 150)))
    cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), 4)))
    batches = [
        pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], names=["k", "node"])
        for part in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True))
    ]
    found = [row for b in jaccard._runs(iter(batches)) for row in zip(*b.to_pydict().values(), strict=True)]
    nodes = {}
    for k, n in rows:
        nodes.setdefault(k, set()).add(n)
    edges = {rows[0][0], rows[-1][0]}
    assert found == sorted({(k, n) for k, n in rows if len(nodes[k]) > 1 or k in edges})


def test_more_candidates_come_forward_until_all_have(spark):
    """A bucket in which no set links with another is tried whole, in a few turns, and ends."""
    plan = jaccard.Plan()
    rows = [(0, 0, 0, i, i // 2, 100, [0] * jaccard.FOLD_WORDS) for i in range(74)]
    frame = spark.createDataFrame(rows, "k long, i long, j long, node long, comp long, n long, fold array<long>").coalesce(1)
    seen, turn, more = set(), 0, True
    while more:
        found = frame.mapInArrow(jaccard._compare(plan, turn), "a long, b long, more boolean").collect()
        new = {(min(r.a, r.b), max(r.a, r.b)) for r in found if not r.more}
        assert seen < new
        seen, more, turn = new, any(r.more for r in found), turn + 1
    assert seen == {(a, b) for a in range(74) for b in range(a + 1, 74) if a // 2 != b // 2} and turn == 4


def test_marks_let_all_wanted_nodes_pass(spark):
    nodes = [0, -1, 1, (1 << 63) - 1, -(1 << 63), 1 << 40, -(1 << 50)]
    bits = jaccard._marked(spark.createDataFrame([(n,) for n in nodes], "node long"))
    place = lambda n: (n & (1 << 64) - 1) >> (64 - jaccard.MARK_BITS)
    assert {int(p) for p in np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))} == {place(n) for n in nodes}


def test_copies_and_clashing_columns(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base), "x") for i in range(300)] + [(900 - i, " ".join(base[:-1] + [f"v{i}"]), None) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumns({"k": F.lit(1), "component": F.lit("c")}).repartition(7)
    found = jaccard.near_duplicates(frame).collect()
    assert len(found) == 500 and {r.component_id for r in found} == {0} and {r.n_shingles for r in found} == {58}
