"""Blocked factorisation: planted groups, falling loss, agreement with a dense version, edge cases."""

import numpy as np
import pytest

from targetloom.operators import expression as X
from targetloom.operators.factorise import nmf

SCHEMA = "sample string, gene string, value double"


def planted(spark, n=60, m=9, k=3):
    rng = np.random.default_rng(2)
    data = [(f"s{i:02d}", f"g{j}", float((8 if j * k // m == i * k // n else 0.5) + rng.random())) for i in range(n) for j in range(m)]
    return spark.createDataFrame(data, SCHEMA), data


def dense_loss(data, w, h):
    fitted = {(s, g): float(np.dot(a, b)) for s, a in w.items() for g, b in h.items()}
    given = {(s, g): v for s, g, v in data}
    return sum((given.get(key, 0.0) - v) ** 2 for key, v in fitted.items())


def test_planted_groups_in_small_blocks(spark):
    long, data = planted(spark)
    w, h, loss = nmf(long, 3, sample_block=17, gene_block=4)
    assert all(b <= a + 1e-9 * a for a, b in zip(loss, loss[1:]))
    factors = {r["sample"]: r["w"] for r in w.collect()}, {r["gene"]: r["h"] for r in h.collect()}
    assert len(factors[0]) == 60 and len(factors[1]) == 9 and min(min(v) for f in factors for v in f.values()) >= 0
    assert dense_loss(data, *factors) == pytest.approx(loss[-1], rel=1e-8)
    assert loss[-1] < 0.02 * sum(v * v for _, _, v in data)
    groups: dict[int, list[int]] = {}
    for r in X.nmf_clusters(w, 3).collect():
        groups.setdefault(r["cluster"], []).append(int(r["sample"][1:]) // 20)
    assert sum(max(map(g.count, set(g))) for g in groups.values()) == 60


def test_blocks_do_not_change_the_fit(spark):
    long, _ = planted(spark, 24, 6, 2)
    one, many = nmf(long, 2), nmf(long, 2, sample_block=5, gene_block=2)
    assert one[2] == pytest.approx(many[2], rel=1e-9)
    a, b = ({r["sample"]: r["w"] for r in fit[0].collect()} for fit in (one, many))
    assert all(np.allclose(a[s], b[s], atol=1e-9) for s in a)


def test_zero_rows_and_repeats(spark):
    rows = [("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 3.0), ("c", "x", 0.0), ("d", "y", None)]
    w, h, _ = nmf(spark.createDataFrame(rows, SCHEMA), 2)
    got = {r["sample"]: r["w"] for r in w.collect()}
    factor = {r["gene"]: r["h"] for r in h.collect()}
    assert got["c"] == [0.0, 0.0] and got["d"] == [0.0, 0.0]
    assert np.dot(got["a"], factor["x"]) == pytest.approx(3, abs=0.05) and np.dot(got["b"], factor["y"]) == pytest.approx(3, abs=0.05)


def test_errors_and_empty(spark):
    w, h, loss = nmf(spark.createDataFrame([], SCHEMA), 2)
    assert w.count() == 0 and h.count() == 0 and loss == []
    with pytest.raises(ValueError, match="3 components"):
        nmf(spark.createDataFrame([("a", "x", 1.0)], SCHEMA), 3)
    with pytest.raises(Exception, match="zero or more"):
        nmf(spark.createDataFrame([("a", "x", -1.0), ("b", "x", 1.0)], SCHEMA), 1)
    long, _ = planted(spark, 12, 6, 3)
    with pytest.raises(RuntimeError, match="not settled"):
        nmf(long, 3, max_rounds=2, tol=1e-15)


def test_gene_selection_modes(spark):
    long, data = planted(spark, 30, 9, 3)
    markers = spark.createDataFrame([(f"set{j // 3}", f"g{j}") for j in range(9) if j % 3 < 2], "marker_set string, gene string")
    for mode in ("marker_only", "highly_variable", "all"):
        out = X.subtype_run(long, markers, mode, k=3, top_n=6)
        best = {r["cluster"]: r["marker_set"] for r in out["enrichment"].where("best").collect()}
        label = {r["sample"]: best[r["cluster"]] for r in out["clusters"].collect()}
        assert label == {f"s{i:02d}": f"set{i // 10}" for i in range(30)}, mode
    constant = long.unionByName(spark.createDataFrame([(f"s{i:02d}", "flat", 5.0) for i in range(30)], SCHEMA))
    holes = constant.unionByName(spark.createDataFrame([("s00", "holes", 900.0)], SCHEMA))
    picked = X.subtype_run(holes, markers, "all", k=3)["clusters"].count()
    assert picked == 30
    with pytest.raises(ValueError, match="unknown gene selection"):
        X.subtype_run(long, markers, "some")
    with pytest.raises(ValueError, match="unknown rule"):
        X.subtype_run(long, markers, absent="mean")
