"""Boosted trees against a plain sequential version, and folds against a sequential greedy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from targetloom.operators import boosting as B, learning as L

SCHEMA = "id long, features array<double>, targets array<double>, weights array<double>, fold int"


def greedy_folds(sizes, folds):
    """(group, fold) by the definition: largest first, each to the lightest fold."""
    loads, out = [0] * min(folds, len(sizes)), {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[g], loads[f] = f, loads[f] + n
    return out


def test_dealing_equal_groups_is_greedy():
    rng = random.Random(0)
    for _ in range(500):
        k = rng.randint(1, 6)
        start = [rng.choice([0, 1, rng.randint(0, 9), rng.randint(0, 300)]) for _ in range(k)]
        size, count = rng.randint(1, 7), rng.randint(0, 120)
        loads, want = list(start), []
        for _ in range(count):
            f = loads.index(min(loads))
            want.append(f)
            loads[f] += size
        mine = list(start)
        phases = L.deal_equal_groups(mine, size, count)
        got = []
        for p in range(count):
            first, turn = [x for x in phases if x[0] <= p][-1]
            got.append(turn[(p - first) % len(turn)])
        assert got == want and mine == loads


@pytest.mark.parametrize("kind", ["equal", "giant", "mixed", "few"])
def test_folds_equal_sequential_greedy(spark, kind):
    rng = random.Random(kind)
    sizes = {
        "equal": {f"g{i:03}": 3 for i in range(101)}, "giant": {"big": 400, **{f"g{i:03}": 1 + i % 2 for i in range(200)}},
        "mixed": {f"g{i:03}": rng.choice([1, 1, 1, 2, 5, 40]) for i in range(150)}, "few": {"a": 5, "b": 1, "c": 1},
    }[kind]
    rows = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = {r.g: r.fold for r in L.balanced_group_folds(rows, "g", 5).collect()}
    assert got == greedy_folds(sizes, 5)


def plain_tree(x, r, w, depth, penalty):
    """Nested (feature, value, gain, left, right), or a leaf's mean residual."""
    whole = (w * r).sum() ** 2 / (w.sum() + penalty)
    best = None
    for f in range(x.shape[1]) if depth else ():
        for v in np.unique(x[:, f])[:-1]:
            go = x[:, f] <= v
            gain = sum((w[s] * r[s]).sum() ** 2 / (w[s].sum() + penalty) for s in (go, ~go)) - whole
            if gain > (best[2] if best else 0) * (1 + 1e-9) + 1e-12:
                best = (f, v, gain, go)
    if best is None:
        return (w * r).sum() / (w.sum() + penalty)
    f, v, gain, go = best
    return f, v, gain, plain_tree(x[go], r[go], w[go], depth - 1, penalty), plain_tree(x[~go], r[~go], w[~go], depth - 1, penalty)


def plain_score(tree, x):
    while isinstance(tree, tuple):
        tree = tree[3] if x[tree[0]] <= tree[1] else tree[4]
    return tree


def plain_splits(tree, node=0):
    if not isinstance(tree, tuple):
        return []
    return [(node, tree[0], tree[1], tree[2]), *plain_splits(tree[3], 2 * node + 1), *plain_splits(tree[4], 2 * node + 2)]


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_members_equal_plain_boosting(spark, monkeypatch, penalty):
    monkeypatch.setattr(B, "REWRITE", 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(4)
    n = 180
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 2, n), rng.integers(0, 30, n) / 3], axis=1).astype(float)
    y = np.stack([x[:, 0] * 0.3 + 2 * x[:, 1] + rng.normal(0, 0.3, n), np.sin(x[:, 2]) + rng.normal(0, 0.1, n)], axis=1)
    w = rng.integers(1, 4, (n, 2)).astype(float)
    fold = rng.integers(0, 3, n)
    gone = rng.random(n) < 0.1  # rows without the second target
    data = [(i, x[i].tolist(), [float(y[i, 0]), None if gone[i] else float(y[i, 1])], w[i].tolist(), int(fold[i])) for i in range(n)]
    rows = spark.createDataFrame(data, SCHEMA).repartition(3)
    members = [B.Member("a0", 0, 0), B.Member("a1", 0, 1, (0, 2)), B.Member("b", 1), B.Member("b2", 1, 2, (1, 2))]
    fitted = B.fit_trees(rows, members, ["p", "q", "r"], 2, trees=5, depth=3, rate=0.3, penalty=penalty)
    scores = {r.id: r.predictions for r in B.predict(rows, fitted).collect()}
    table = B.split_table(fitted)
    for m, member in enumerate(members):
        use = (fold != member.held_out) & ~(gone if member.target else np.zeros(n, bool))
        cols = list(member.features or range(3))
        t, weight = y[use, member.target], w[use, member.target]
        base = (t * weight).sum() / weight.sum()
        want, here = np.full(n, base), np.full(use.sum(), base)
        for k in range(5):
            tree = plain_tree(x[use][:, cols], t - here, weight, 3, penalty)
            mine = [(node, f, v, g) for name, at, node, f, v, g, _ in table if name == member.name and at == k]
            ours = [(node, ["p", "q", "r"][cols[f]], v, g) for node, f, v, g in sorted(plain_splits(tree))]
            assert [s[:3] for s in mine] == [s[:3] for s in ours]
            assert np.allclose([s[3] for s in mine], [s[3] for s in ours])  # the gains, recomputed
            here = here + 0.3 * np.array([plain_score(tree, r) for r in x[use][:, cols]])
            want = want + 0.3 * np.array([plain_score(tree, r) for r in x[:, cols]])
        assert np.allclose([scores[i][m] for i in range(n)], want)
        shares = dict(B.importances(fitted, m))
        gains = {f: sum(g for name, _, _, q, _, g, _ in table if name == member.name and q == f) for f in "pqr"}
        assert np.allclose([shares[f] for f in "pqr"], [gains[f] / sum(gains.values()) for f in "pqr"])


def test_equal_rows_may_be_collapsed(spark):
    rng = np.random.default_rng(5)
    raw = [([float(rng.integers(0, 4)), float(rng.integers(0, 3))], float(rng.normal())) for _ in range(120)]
    rows = spark.createDataFrame([(i, f, [y], [1.0], 0) for i, (f, y) in enumerate(raw)], SCHEMA)
    packed = rows.groupBy("features", "fold").agg(F.array(F.avg(F.get("targets", 0))).alias("targets"), F.array(F.count(F.lit(1)).cast("double")).alias("weights"))
    a, b = (B.fit_trees(d, [B.Member("m")], ["p", "q"], trees=3, depth=2) for d in (rows, packed))
    for x, y in zip(B.split_table(a), B.split_table(b), strict=True):
        assert x[:5] == y[:5] and x[6] == y[6] and abs(x[5] - y[5]) < 1e-9


def test_missing_features_and_refusals(spark):
    rows = spark.createDataFrame([(i, [None if i % 3 == 0 else float(i % 3), float("nan") if i % 2 else 1.0], [float(i % 3 == 0)], [1.0], i % 2) for i in range(30)], SCHEMA)
    fitted = B.fit_trees(rows, [B.Member("m")], ["p", "q"], trees=1, depth=1, rate=1.0)
    assert B.split_table(fitted)[0][3] == "p"
    with pytest.raises(ValueError, match="no rows"):
        B.fit_trees(rows.where("fold = 0"), [B.Member("m", 0, 0)], ["p", "q"], trees=1)
    many = spark.range(5000).select(F.col("id"), F.array((F.col("id") / 7).cast("double")).alias("features"))
    cuts = B.feature_cuts(many, "features", 1, 32)
    assert 30 <= len(cuts[0]) <= 31


def test_held_out_groups_do_not_leak(spark):
    """Changing the targets of fold 0 leaves the predictions of fold 0 as they were, with and without entity means."""
    rng = np.random.default_rng(6)
    data = [(f"l{i % 9}", f"g{i % 4}", float(rng.random()), float(rng.random())) for i in range(90)]
    df = spark.createDataFrame([(*r, 2 * r[2] + int(r[1][1]) + 0.0) for r in data], "line string, gene string, a double, b double, target double")
    folds = {r.line: r.fold for r in L.balanced_group_folds(df, "line", 3).collect()}
    other = df.withColumn("target", F.when(F.col("line").isin([g for g, f in folds.items() if f == 0]), -50.0).otherwise(F.col("target")))
    got = []
    for d in (df, other):
        pred, fitted = L.grouped_tree_models(d, ["a", "b"], "target", "line", 3, "gene", trees=12, rate=0.3)
        got.append({(r.line, r.gene, r.a): (r.prediction, r.prediction_entity) for r in pred.where("fold = 0").collect()})
        if d is df:
            assert L.regression_metrics(pred, "target", "prediction_entity").first()["r2"] > 0.8
            assert B.importances(fitted, len(fitted.members) - 1)[0][0] == "a"
    assert got[0] == got[1]
