from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from targetloom.functions.numeric import pearson_p_values
from targetloom.operators import cohort as C
from targetloom.operators import expression as X
from targetloom.operators import graph as G
from targetloom.operators import ranking as K
from targetloom.operators import survival as V
from targetloom.operators.prefix import average_ranks, exact_quantiles, row_positions


def test_published_p_values():
    # fixed values: r, n and p of five published pairs
    r = np.array([0.6657879376383085, 0.6368520861912949, 0.5951458919438839, -0.20658258006231262, 0.08347745969803484])
    p = np.array([1.0915856216068147e-20, 1.5010268211096436e-18, 7.713844101255105e-16, 0.010929402498945098, 0.3081821094614003])
    assert np.allclose(pearson_p_values(r, np.full(5, 151.0)), p, rtol=1e-10)


def test_hot_values_in_ranks_and_quantiles(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(600) < 0.4, 7.0, np.round(rng.normal(0, 10, 600), 1))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id int, x double")
    got = {r["id"]: r["rank"] for r in average_ranks(df, "x").collect()}
    import pandas as pd

    want = pd.Series(v).rank()
    assert all(got[i] == want[i] for i in range(600))
    q = {r["q"]: r["quantile"] for r in exact_quantiles(df, "x", [0.1, 0.5, 0.93]).collect()}
    assert all(q[k] == pytest.approx(np.quantile(v, k)) for k in q)
    pos = [r["pos"] for r in row_positions(df, "x", ["id"]).collect()]
    assert sorted(pos) == list(range(1, 601))


def test_benjamini_hochberg_with_ties(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.041, 0.06, 0.2, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p_value double")
    got = [r["q_value"] for r in K.benjamini_hochberg(df).orderBy("i").collect()]
    n, want, low = len(p), [0.0] * len(p), 1.0
    for i in reversed(range(n)):
        low = min(low, p[i] * n / (i + 1))
        want[i] = low
    assert got == pytest.approx(want)


def _brute_c(t, e, r):
    perm = conc = tied = 0
    for i in range(len(t)):
        for j in range(len(t)):
            if t[i] < t[j] and e[i]:
                perm += 1
                conc += r[i] > r[j]
                tied += r[i] == r[j]
    return perm, conc, tied


def test_concordance_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    t, e, r = rng.integers(1, 30, 150), rng.integers(0, 2, 150), rng.integers(0, 20, 150)
    r[:50] = 5
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r)], "time double, event int, risk double")
    got = V.concordance(df).first()
    assert (got["permissible"], got["concordant"], got["tied"]) == _brute_c(t, e, r)


@pytest.fixture(scope="module")
def survival_data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4))
    t = np.ceil(rng.exponential(1.0, 400) * np.exp(-(1.0 * x[:, 0] + 0.8 * x[:, 1])) * 200)
    c = np.ceil(rng.exponential(400, 400))
    data = [(str(i), float(min(a, b)), int(a <= b), *[float(v) for v in row]) for i, (a, b, row) in enumerate(zip(t, c, x))]
    return spark.createDataFrame(data, "id string, time double, event int, s1 double, s2 double, n1 double, n2 double").cache()


FEATS = ["s1", "s2", "n1", "n2"]


def _efron_gradient(beta, X_, t, e, ridge):
    grad, w = -2 * ridge * beta, np.exp(X_ @ beta)
    for u in np.unique(t[e == 1]):
        ev, rk = (t == u) & (e == 1), t >= u
        d = ev.sum()
        grad = grad + X_[ev].sum(0)
        for k in range(d):
            phi = w[rk].sum() - k / d * w[ev].sum()
            grad = grad - ((w[rk, None] * X_[rk]).sum(0) - k / d * (w[ev, None] * X_[ev]).sum(0)) / phi
    return grad


def test_ridge_cox(spark, survival_data):
    z = V.standardised(survival_data, FEATS)
    fit = V.fit_cox(z, FEATS, ridge=1.0)
    beta = fit.groups[()]["beta"]
    assert fit.groups[()]["converged"] and beta[0] > 0 and beta[1] > 0 and abs(beta[0]) > abs(beta[2]) and abs(beta[1]) > abs(beta[3])
    pdf = z.toPandas()
    grad = _efron_gradient(beta, pdf[FEATS].to_numpy(), pdf["time"].to_numpy(), pdf["event"].to_numpy(), 1.0)
    assert np.abs(grad).max() < 1e-5
    strong = V.fit_cox(z, FEATS, ridge=50.0).groups[()]["beta"]
    assert np.linalg.norm(strong) < np.linalg.norm(beta)
    assert V.concordance(V.predict_risk(z, fit, FEATS)).first()["c_index"] > 0.65
    imp = V.permutation_importance(z, "id", fit, FEATS, repeats=2).orderBy(F.desc("importance")).collect()
    assert {imp[0]["feature"], imp[1]["feature"]} == {"s1", "s2"}


def test_kaplan_meier_and_rmst(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (5.0, 1)], "time double, event int")
    km = V.kaplan_meier(df).orderBy("time").collect()
    assert [(r["n_at_risk"], r["n_events"]) for r in km] == [(5, 1), (4, 0), (3, 2), (1, 1)]
    assert [r["survival"] for r in km] == pytest.approx([0.8, 0.8, 0.8 / 3, 0.0])
    assert V.restricted_mean(df.withColumn("g", F.lit(1)), ["g"]).first()["rmst"] == pytest.approx(1 + 2 * 0.8 + 2 * 0.8 / 3)


def test_planted_logrank(spark, survival_data):
    expr = survival_data.select(F.col("id").alias("patient_id"), F.lit("g").alias("gene"), F.col("s1").alias("value"))
    clin = survival_data.select(F.col("id").alias("patient_id"), "time", "event")
    r = V.logrank_by_expression(clin, expr).first()
    assert r["logrank_p"] < 0.01 and r["rmst_diff"] < 0


TRIANGLES = [("EGFR", "ERBB2", 0.9), ("ERBB2", "ERBB4", 0.9), ("EGFR", "ERBB4", 0.9), ("JAK1", "JAK2", 0.9), ("JAK2", "TYK2", 0.9), ("JAK1", "TYK2", 0.9), ("ERBB2", "JAK1", 0.05)]


def test_louvain_two_triangles(spark):
    edges = spark.createDataFrame(TRIANGLES, "source string, target string, weight double")
    lone = spark.createDataFrame([("LONE",)], "v string")
    got = {r["v"]: r["community"] for r in G.louvain(edges, lone).collect()}
    assert got["EGFR"] == got["ERBB2"] == got["ERBB4"] and got["JAK1"] == got["JAK2"] == got["TYK2"]
    assert len({got["EGFR"], got["JAK1"], got["LONE"]}) == 3


def test_louvain_rises_every_round_and_finds_planted_groups(spark):
    """Four planted groups of 12 and a star whose arms would all swap at once: modularity, recomputed here, never falls and no single move is left."""
    rng = np.random.default_rng(5)
    rows = [(f"v{i:02}", f"v{j:02}", 1.0) for i in range(48) for j in range(i) if rng.random() < (0.7 if i // 12 == j // 12 else 0.04)]
    rows += [("hub", f"arm{i}", 1.0) for i in range(8)]
    edges = spark.createDataFrame(rows, "source string, target string, weight double")
    comm, path = G.settled_moves(G.both_ways(G.canonical_edges(edges)))
    assert path and all(b > a for a, b in zip(path, path[1:]))

    def quality(labels):
        m = len(rows)
        k = {}
        for a, b, _ in rows:
            for v in (a, b):
                k[labels[v]] = k.get(labels[v], 0) + 1
        return sum(labels[a] == labels[b] for a, b, _ in rows) / m - sum((x / (2 * m)) ** 2 for x in k.values())

    labels = {r["v"]: r["c"] for r in comm.collect()}
    assert path[-1] == pytest.approx(quality(labels))
    for v in labels:
        assert all(quality({**labels, v: c}) <= path[-1] + 1e-8 for c in set(labels.values()))
    found = G.louvain(edges)
    got = {r["v"]: r["community"] for r in found.collect()}
    assert {got[f"v{i:02}"] for i in range(48)} == {"v00", "v12", "v24", "v36"} and all(got[f"v{i:02}"] == f"v{i // 12 * 12:02}" for i in range(48))
    assert {got["hub"], *(got[f"arm{i}"] for i in range(8))} == {"arm0"}
    assert quality(got) >= path[-1] - 1e-12 and G.modularity(edges, found).first()[0] == pytest.approx(quality(got))
    with pytest.raises(RuntimeError):
        G.settled_moves(G.both_ways(G.canonical_edges(edges)), max_rounds=1)


def test_centralities_on_a_path(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)], "source string, target string, weight double")
    got = {r["v"]: r["betweenness"] for r in G.betweenness(edges).collect()}
    assert [got[v] for v in "abcde"] == pytest.approx([0, 0.5, 2 / 3, 0.5, 0])
    square = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "a", 1.0)], "source string, target string, weight double")
    assert [r["betweenness"] for r in G.betweenness(square).collect()] == pytest.approx([1 / 6] * 4)
    lone = spark.createDataFrame([("z",)], "v string")
    ranks = {r["v"]: r["pagerank"] for r in G.page_rank(edges, lone, rounds=15, tol=None).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks["b"] > ranks["a"] > ranks["z"]
    comp = {r["v"]: r["component"] for r in G.connected_components(edges, lone).collect()}
    assert {comp[v] for v in "abcde"} == {"a"} and comp["z"] == "z"


def test_betweenness_in_batches_equals_path_counting(spark):
    """Random weighted graph with ties, two parts and a lone vertex, three sources at a time, against all shortest paths."""
    rng = np.random.default_rng(3)
    names = [f"n{i}" for i in range(13)]
    pairs = {tuple(sorted(map(int, rng.choice(10, 2, replace=False)))) for _ in range(18)} | {(10, 11)}
    weight = {p: float(rng.integers(1, 4)) for p in pairs}
    edges = spark.createDataFrame([(names[a], names[b], w) for (a, b), w in weight.items()], "source string, target string, weight double")
    d = np.full((13, 13), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), w in weight.items():
        d[a, b] = d[b, a] = w
    for k in range(13):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    paths = np.zeros((13, 13))
    for s in range(13):
        for v in sorted(range(13), key=lambda v: d[s, v]):
            paths[s, v] = 1 if s == v else sum(paths[s, u] for u in range(13) if (min(u, v), max(u, v)) in weight and np.isfinite(d[s, u]) and d[s, u] + weight[min(u, v), max(u, v)] == d[s, v])
    want = np.zeros(13)
    for s, t, v in ((s, t, v) for s in range(13) for t in range(13) for v in range(13) if len({s, t, v}) == 3 and paths[s, t]):
        if d[s, v] + d[v, t] == d[s, t]:
            want[v] += paths[s, v] * paths[v, t] / paths[s, t]
    verts = spark.createDataFrame([(x,) for x in names], "v string")
    for batch in (3, 100):
        got = {r["v"]: r["betweenness"] for r in G.betweenness(edges, verts, batch_sources=batch).collect()}
        assert [got[x] for x in names] == pytest.approx(list(want / (12 * 11)))


def test_rewiring_keeps_degrees(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(map(int, rng.choice(12, 2, replace=False)))) for _ in range(30)}
    edges = spark.createDataFrame([(f"v{a}", f"v{b}", float(i)) for i, (a, b) in enumerate(sorted(pairs))], "source string, target string, weight double")
    out = G.rewired(edges, spark.range(3).select(F.col("id").cast("int").alias("replicate")), rounds=3).collect()
    for rep in range(3):
        rows = [r for r in out if r["replicate"] == rep]
        assert len({(r["source"], r["target"]) for r in rows}) == len(pairs) and all(r["source"] < r["target"] for r in rows)
        assert sorted(r["weight"] for r in rows) == [float(i) for i in range(len(pairs))]
        deg = {}
        for r in rows:
            for v in (r["source"], r["target"]):
                deg[v] = deg.get(v, 0) + 1
        true = {}
        for a, b in pairs:
            for v in (f"v{a}", f"v{b}"):
                true[v] = true.get(v, 0) + 1
        assert deg == true


def test_reverse_duplicate_edge(spark):
    rows = [("EGFR", "ERBB2", 0.92), ("ERBB2", "EGFR", 0.92), ("EGFR", "SRC", 0.55), ("EGFR", "OTHER", 0.9)]
    panel = spark.createDataFrame([("EGFR",), ("ERBB2",), ("SRC",)], "gene string")
    assert G.restricted_edges(spark.createDataFrame(rows, "source string, target string, weight double"), panel).count() == 2


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(4)
    data = [(f"s{i}", f"g{j}", float(rng.integers(0, 9))) for i in range(30) for j in range(5) if rng.random() > 0.15]
    long = spark.createDataFrame(data, "sample string, gene string, value double")
    genes = [f"g{j}" for j in range(5)]
    one = sorted(map(tuple, X.knn_impute(long, genes, 3).collect()))
    many = sorted(map(tuple, X.knn_impute(long, genes, 3, block_size=7).collect()))
    assert one == many and len(one) == 150 - len(data)


def test_funnel_of_four(spark):
    sub = [("TCGA-AA-0001-01A", "Basal"), ("TCGA-AA-0001-01B", "Basal"), ("TCGA-AA-0002-01A", "Basal"), ("TCGA-AA-0003-01A", "Basal"), ("TCGA-AA-0004-01A", "LumA"), ("TCGA-AA-0005-11A", "Basal")]
    maf = [("0001", "G1", "Missense_Mutation"), ("0001", "G2", "Nonsense_Mutation"), ("0002", "G1", "Missense_Mutation"), ("0002", "G2", "Silent"), ("0002", "G3", "Missense_Mutation"),
           ("0003", "G1", "Missense_Mutation"), ("0003", "G2", "Translation_Start_Site")]
    s = spark.createDataFrame(sub, "barcode string, subtype string")
    m = spark.createDataFrame([(g, c, f"TCGA-AA-{p}-01A") for p, g, c in maf], "Hugo_Symbol string, Variant_Classification string, Tumor_Sample_Barcode string")
    panel = spark.createDataFrame([("G1",), ("G2",), ("G3",)], "gene string")
    mapped = spark.createDataFrame([("G1",), ("G2",)], "gene string")
    n = {r["stage"]: r["n"] for r in C.funnel_counts(C.cohort_funnel(s, m, panel, mapped)).collect()}
    assert n == {0: 4, 1: 3, 2: 3, 3: 2}
