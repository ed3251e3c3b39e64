"""Keyed bijections: every place is met once, draws are spread evenly, and the check text draws the same."""

from __future__ import annotations

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from targetloom.operators import graph as G, permutation as P, robustness as R


def images(spark, n, keys):
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("k"))
    got = rows.select("k", "id", P.shuffled_place(F.col("id"), n, P.round_keys(9, "k")).alias("to")).collect()
    out = collections.defaultdict(dict)
    for r in got:
        out[r.k][r.id] = r.to
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 11, 24, 97, 1000, 10_007])
def test_every_place_is_met_once(spark, n):
    for to in images(spark, n, 3).values():
        assert sorted(to) == sorted(to.values()) == list(range(n))


def test_grid_holds_all_places_with_few_to_spare():
    for n in [*range(1, 3000), 10**6 + 3, 10**9 + 7, 10**12 + 39]:
        a, b, spare = P.grid(n)
        assert a * b == n + spare and 0 <= spare < a and (n < 4 or b <= 3 * a)
    assert P.grid(10**9 + 7)[2] <= 10


@pytest.mark.parametrize("n", [5, 24])
def test_draws_are_spread_evenly(spark, n):
    """Each place goes anywhere about equally often, and so does each ordered pair of neighbours."""
    trials = 6000
    got = images(spark, n, trials).values()
    single = collections.Counter((i, to[i]) for to in got for i in to)
    expected = trials / n
    assert sum((single[i, j] - expected) ** 2 / expected for i in range(n) for j in range(n)) < n * n + 5 * (2 * n * n) ** 0.5
    pairs = collections.Counter((to[0], to[1]) for to in got)
    expected = trials / (n * (n - 1))
    cells = n * (n - 1)
    assert sum((pairs[i, j] - expected) ** 2 / expected for i in range(n) for j in range(n) if i != j) < cells + 5 * (2 * cells) ** 0.5


@pytest.mark.parametrize("n", [1, 6, 23, 500])
def test_check_text_draws_the_same(spark, n):
    want = images(spark, n, 4)
    keys = P.KEYS_SQL.format(parts="'9', CAST(range AS VARCHAR)")
    sql = f"""WITH base AS (SELECT range AS place FROM range({n})), reps AS (SELECT range AS k, {keys} AS ks FROM range(4)), dom AS {P.GRID_SQL.format(base='base')}
        SELECT k, place, {P.PLACE_SQL} AS dst FROM base CROSS JOIN reps CROSS JOIN dom"""
    assert {(k, i): to for k, i, to in duckdb.sql(sql).fetchall()} == {(k, i): to for k, m in want.items() for i, to in m.items()}


def test_permuted_column_keeps_keys_and_values(spark):
    rows = spark.range(200).select((F.col("id") % 20).alias("a"), F.col("id").cast("string").alias("b"), (F.col("id") * 2.0).alias("v"))
    reps = spark.range(5).select(F.col("id").cast("int").alias("replicate"))
    got = R.permuted_column(rows, "v", ["a", "b"], reps, 1).collect()
    for r in range(5):
        mine = [x for x in got if x.replicate == r]
        assert sorted(x.v for x in mine) == [2.0 * i for i in range(200)] and len({(x.a, x.b) for x in mine}) == 200
        assert sum(x.v == 2.0 * int(x.b) for x in mine) < 10
    assert R.permuted_column(rows.where("false"), "v", ["a", "b"], reps, 1).count() == 0


def test_rewired_keeps_degrees_weights_and_simple_edges(spark):
    edges = spark.createDataFrame([(f"v{i}", f"v{j}", float(100 * i + j)) for i in range(15) for j in range(i + 1, 15) if (i * j + i) % 3], "source string, target string, weight double")
    reps = spark.range(4).select(F.col("id").cast("int").alias("replicate"))
    true = edges.collect()
    degree = collections.Counter(v for e in true for v in (e.source, e.target))
    changed = 0
    got = G.rewired(edges, reps, rounds=4).collect()
    for r in range(4):
        mine = [e for e in got if e.replicate == r]
        assert collections.Counter(v for e in mine for v in (e.source, e.target)) == degree
        assert all(e.source < e.target for e in mine) and len({(e.source, e.target) for e in mine}) == len(true)
        assert sorted(e.weight for e in mine) == sorted(e.weight for e in true)
        changed += len({(e.source, e.target) for e in mine} - {(e.source, e.target) for e in true})
    assert changed > 20
