"""Values worked out by hand from the published formulas, and inputs that once went wrong."""

from __future__ import annotations

import math

import pytest

from targetloom.operators import graph as G, learning as L, variants as V


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id int, vector array<double>")


def test_kernel_mmd_by_hand(spark):
    """x = {0, 1}, y = {2, 4}: pooled positive squared distances are 1, 4, 16, 1, 9, 4 in both orders, median 4."""
    x, y = vectors(spark, [(1, [0.0]), (2, [1.0])]), vectors(spark, [(1, [2.0]), (2, [4.0])])
    row = L.rbf_mmd(x, y).first()
    k = lambda d2: math.exp(-d2 / 8.0)
    xx, yy, xy = (2 + 2 * k(1)) / 4, (2 + 2 * k(4)) / 4, (k(4) + k(16) + k(1) + k(9)) / 4
    assert row["bandwidth"] == pytest.approx(4.0) and row["mmd2"] == pytest.approx(xx + yy - 2 * xy)


def test_kernel_mmd_without_distances(spark):
    same = vectors(spark, [(1, [1.0]), (2, [1.0])])
    assert L.rbf_mmd(same, vectors(spark, [(1, [1.0])])).first()["bandwidth"] == 1.0


def test_tables_that_share_identifiers(spark):
    """Two clouds 3 apart are 2 x 3 - 0 - 0 apart, whatever their rows are called."""
    x, y = vectors(spark, [(1, [0.0]), (2, [0.0])]), vectors(spark, [(1, [3.0]), (2, [3.0])])
    assert L.energy_distance(x, y).first()[0] == pytest.approx(6.0)


def test_index_map_orders_bytes(spark):
    names = ["zzzz", "aéaa", "aeaa", "CHEMBL9", "CHEMBL10", "中", "", "ab"]
    got = dict(L.index_map(spark.createDataFrame([(n,) for n in names * 2], "name string"), "name").collect())
    assert got == {n: i for i, n in enumerate(sorted(names, key=str.encode))}


def test_vcf_repeated_keys_and_malformed_numbers(spark):
    lines = ["chr1\t10\t.\tA\tG\t50\tPASS\tGENE=A;GENE=B;DP=7;AF=0.1,0.2", "chr1\tx\t.\tA\tG\t50\tPASS\tGENE=A", "chr1\t11\t.\tA\tG\t50\tPASS\tSOMATIC;DP=many"]
    table = spark.createDataFrame([("f", v) for v in lines], "file string, value string")
    known = spark.createDataFrame([("B",)], "gene string")
    loci = spark.createDataFrame([("chr1", 100, 200, "C", 1)], "chrom string, start long, end long, gene string, ord int")
    got = {r["pos"]: (r["gene"], r["depth"], r["allele_freq"], r["is_kinase"]) for r in V.parse_vcf(table, known, loci).collect()}
    assert got == {10: ("B", 7, 0.0, True), 11: ("UNKNOWN", 0, 0.0, False)}


def test_shared_pathway_is_the_first_in_table_order(spark):
    affected = spark.createDataFrame([("p", "A"), ("p", "B")], "patient string, gene string")
    pathways = spark.createDataFrame([("A", "Zeta", 0), ("A", "Alpha", 1), ("B", "Zeta", 0), ("B", "Alpha", 1)], "gene string, pathway string, ord int")
    none = spark.createDataFrame([], "gene string, drug string, ord int, approved boolean")
    level = spark.createDataFrame([("A", "high"), ("B", "high")], "gene string, tnbc_relevance string")
    assert V.combination_suggestions(affected, pathways, level, none).first()["shared_pathway"] == "Zeta"


def test_betweenness_needs_positive_weights_and_keeps_light_edges_apart(spark):
    def edges(rows):
        return spark.createDataFrame(rows, "source string, target string, weight double")

    with pytest.raises(ValueError, match="above 0"):
        G.betweenness(edges([("a", "b", 0.0), ("b", "c", 1.0)]))
    path = edges([("a", "b", 1e-12), ("b", "c", 2e-12), ("a", "c", 4e-12)])
    got = {r["v"]: r["betweenness"] for r in G.betweenness(path).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_long_chain_is_one_component(spark):
    rows = [(f"v{i:04d}", f"v{i + 1:04d}", 1.0) for i in range(300)]
    got = {r["component"] for r in G.connected_components(spark.createDataFrame(rows, "source string, target string, weight double")).collect()}
    assert got == {"v0000"}


def test_page_rank_tells_when_it_has_not_settled(spark):
    star = spark.createDataFrame([("c", f"l{i}", 1.0) for i in range(6)], "source string, target string, weight double")
    with pytest.raises(RuntimeError, match="settled"):
        G.page_rank(star, rounds=2, tol=1e-12, every=1)
