"""Vertex programs on tiles: results over several tiles, and what a round shuffles."""

from __future__ import annotations

import numpy as np
import pytest

from targetloom.operators import graph as G


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(5)
    chain = [(f"x{i:03}", f"x{i + 1:03}", 1.0) for i in range(24)]
    web = [(f"y{a:02}", f"y{b:02}", float(w)) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(1, 9, 150))]
    return spark.createDataFrame([*chain, *web, ("z1", "z1", 2.0), ("z2", "z3", None)], "source string, target string, weight double")


def test_many_tiles_give_the_same_ranks_and_components(spark, edges, monkeypatch):
    monkeypatch.setattr(G._Tiled, "LEAST_BLOCKS", 5)
    lone = spark.createDataFrame([("a0",)], "v string")
    rows = [(r.source, r.target, r.weight or 0.0) for r in edges.collect()]
    names = sorted({v for s, t, _ in rows for v in (s, t)} | {"a0"})
    at = {v: i for i, v in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for s, t, x in rows:
        w[at[s], at[t]] += x
        w[at[t], at[s]] += x
    k = w.sum(axis=1)
    rank = np.full(len(names), 1 / len(names))
    for _ in range(2):
        share = np.divide(rank, k, out=np.zeros(len(k)), where=k > 0)
        rank = 0.15 / len(names) + 0.85 * (w @ share + rank[k == 0].sum() / len(names))
    got = {r["v"]: r["pagerank"] for r in G.page_rank(edges, lone, rounds=2, tol=None).collect()}
    assert sorted(got) == names and [got[v] for v in names] == pytest.approx(list(rank))

    label = {v: v for v in names}
    for _ in names:
        for s, t, _w in rows:
            label[s] = label[t] = min(label[s], label[t])
    assert {r["v"]: r["component"] for r in G.connected_components(edges, lone).collect()} == label


def test_a_round_does_not_shuffle_edges(spark, edges):
    graph = G._Tiled(edges, None, weighted=True)
    plan = graph.along_edges(graph.blocks, "size", "double", lambda a, b, cells: (a, b))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_no_edges(spark):
    none = spark.createDataFrame([], "source string, target string, weight double")
    assert G.page_rank(none).count() == G.connected_components(none).count() == 0
