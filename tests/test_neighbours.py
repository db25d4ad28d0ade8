"""The index of inverted lists against all pairs."""

import numpy as np
import pytest

from docstrata.operators import neighbours as neighbours_module
from docstrata.operators.neighbours import inverted_lists, neighbours
from docstrata.sources.shared import discard

SCHEMA = "vec_id long, embedding array<double>, rank int, list string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], 1, "z") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k):
    rows = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(n > 0, n, 1)
    sims = np.round(x @ x.T, 9) + 0.0
    out = []
    for a, (i, _) in enumerate(rows):
        best = sorted((-sims[a, b], j) for b, (j, _) in enumerate(rows) if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return out


def clusters(r, n, size, dims, spread):
    centres = r.standard_normal((n, dims))
    return [c + spread * r.standard_normal(dims) for c in centres for _ in range(size)]


def same(got, wanted):
    got, wanted = sorted(map(tuple, got)), sorted(wanted)
    assert [x[:3] for x in got] == [x[:3] for x in wanted]
    assert np.allclose([x[3] for x in got], [x[3] for x in wanted], rtol=0, atol=2e-9)


def test_clustered_vectors_meet_few(spark):
    rows = list(enumerate(clusters(np.random.default_rng(1), 40, 30, 16, 0.02)))
    found = neighbours(frame(spark, rows), k=5, limit=64)
    same(found.collect(), brute(rows, 5))
    assert found.comparisons.value < len(rows) ** 2 / 8
    discard(found)


@pytest.mark.parametrize("limit", [7, 64, 10_000])
def test_all_kinds_of_vectors(spark, limit):
    """Equal vectors in numbers that no centres part, zeros, spread ones, and rows that have no vector."""
    r = np.random.default_rng(2)
    vectors = [*clusters(r, 5, 12, 6, 0.1), *r.standard_normal((60, 6)), *[np.ones(6)] * 50, *[np.zeros(6)] * 9, *[2 * np.ones(6)] * 5]
    rows = list(enumerate(vectors)) + [(900, None), (901, []), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] * 6)]
    found = neighbours(frame(spark, rows), k=4, limit=limit)
    same(found.collect(), brute(rows, 4))
    assert neighbours(frame(spark, rows).limit(0), k=4).collect() == []
    assert neighbours(frame(spark, rows[:1]), k=4).collect() == []
    assert {x["vec_id"] for x in neighbours(frame(spark, rows[:3]), k=16).collect()} == {0, 1, 2}


def test_lists_are_short_where_they_can_be(spark):
    rows = list(enumerate(clusters(np.random.default_rng(3), 10, 100, 8, 0.2)))
    lists, limit = inverted_lists(frame(spark, rows), "vec_id", "embedding", 50)
    sizes = [x["count"] for x in lists.groupBy("list").count().collect()]
    assert limit == 50 and sum(sizes) == 1000 and max(sizes) <= 50
    assert {x["key"] for x in lists.collect()} == set(range(1000))


@pytest.mark.parametrize("least", [-np.inf, 0.2])
@pytest.mark.parametrize("n,k", [(640, 16), (700, 1), (50, 16), (200, 70)])
def test_the_greatest_are_found_without_ordering_all(monkeypatch, least, n, k):
    """A bound from groups of columns leaves out most similarities before any is rounded or ordered; ties and own keys as in a loop."""
    r = np.random.default_rng(n)
    sims, keys, others = r.standard_normal((20, n)).round(1), np.arange(20), r.permutation(n)
    sims[0], sims[1] = 0.5, -np.inf
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *p, **q: (sizes.append(a.shape[1]), partition(a, *p, **q))[1])
    row, other, sim = neighbours_module._ranked(keys, sims.copy(), others, k, np.full(20, least))
    wanted = []
    for i in range(20):
        ranked = sorted((-s, o) for s, o in zip(sims[i], others) if o != keys[i] and s >= least and np.isfinite(s))[:k]
        wanted += [(i, o, -s) for s, o in ranked]
    assert list(zip(row, other, sim)) == wanted and all(size <= 64 for size in sizes)
