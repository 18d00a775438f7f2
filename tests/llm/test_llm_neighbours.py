"""Neighbours: hot lists, and queries that are a part of the rows."""

from collections import defaultdict

import numpy as np

from plumbline.llm import ann


def test_stated_queries_and_hot_lists(spark):
    """A third of the rows in one place: groups are split by rows and by queries, and what is found is near what is nearest."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[:500] = x[0] + 0.01 * rng.normal(size=(500, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(v, 5, every=10, group_rows=40, query_rows=30).collect():
        got[r["vec_id"]].append((r["rank"], r["neighbour_id"], r["distance"]))
    assert sorted(got) == list(range(0, 1500, 10)) and all(sorted(n for n, _, _ in g) == [1, 2, 3, 4, 5] for g in got.values())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.mean([len({n for _, n, _ in got[i]} & set(np.argsort(d[i])[:5].tolist())) / 5 for i in got]) >= 0.9
    assert all(np.isclose(dist, d[i, n], atol=1e-3) for i in got for _, n, dist in got[i])


def test_ties_go_by_id(spark):
    v = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(40)], "vec_id bigint, embedding array<float>")
    got = {(r["vec_id"], r["rank"]): (r["neighbour_id"], r["distance"]) for r in ann.neighbours(v, 4, every=10).collect()}
    assert [got[0, k] for k in range(1, 5)] == [(2, 0.0), (4, 0.0), (6, 0.0), (8, 0.0)]
    assert [got[10, k] for k in range(1, 5)] == [(0, 0.0), (2, 0.0), (4, 0.0), (6, 0.0)]
