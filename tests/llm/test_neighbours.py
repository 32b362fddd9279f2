"""Neighbours along curves where the vectors have structure."""

import numpy as np
import pytest

from lumengraph.llm import neighbours


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(400, 32))
    x = centres[rng.integers(0, 400, 20_000)] + 0.3 * rng.normal(size=(20_000, 32))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)


def test_windows_are_narrow_and_reach_the_recall(spark, clustered):
    x, rows = clustered
    vectors = neighbours.usable(rows)
    ranks = neighbours.ranked(vectors)
    width = neighbours.window_width(vectors, ranks, vectors.where("vec_id % 100 = 0"), 10)
    assert 2 * width * neighbours.CURVES < 0.2 * len(x)  # distances a query
    got = {}
    for r in neighbours.search(rows, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_each_length_is_a_space_of_its_own(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (100, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 3.0]), (200, [1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(rows, lambda i: i % 100 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (100, 1, 2, 10**0.5)]
