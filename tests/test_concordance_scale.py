"""Concordance in strips and permutation importance by places: rows that travel grow in step with the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from targetloom.operators import survival as V
from targetloom.operators.permutation import round_key_numbers, round_keys, shuffled_place, shuffled_places


def _brute(t, e, r):
    later = t[:, None] < t[None, :]
    asks = later & (e == 1)[:, None]
    return int(asks.sum()), int((asks & (r[:, None] > r[None, :])).sum()), int((asks & (r[:, None] == r[None, :])).sum())


def test_concordance_over_many_strips_and_groups(spark, monkeypatch):
    """Small strips, hot times and risks, a group of one row and rows without a risk."""
    monkeypatch.setattr(V, "STRIP_ROWS", 7)
    rng = np.random.default_rng(11)
    data, want = [], {}
    for g, (n, times, risks) in {"ties": (90, 6, 5), "free": (120, 10_000, 10_000), "hot": (100, 30, 1_000), "one": (1, 3, 3)}.items():
        t, e, r = rng.integers(1, times + 1, n).astype(float), rng.integers(0, 2, n), rng.integers(0, risks, n).astype(float)
        if g == "hot":
            t[:40], r[20:70] = 7.0, 3.0
        data += [(g, float(a), int(b), float(c)) for a, b, c in zip(t, e, r)]
        want[g] = _brute(t, e, r)
    data += [("free", 1.0, 1, None), ("free", 20_000.0, 1, None)]
    df = spark.createDataFrame(data, "g string, time double, event int, risk double")
    got = {x["g"]: (x["permissible"], x["concordant"], x["tied"]) for x in V.concordance(df, ["g"]).collect()}
    assert got == want
    assert V.concordance(df.where("g = 'hot'")).first()[:3] == want["hot"]


def test_rows_shuffled_by_concordance_do_not_grow_with_the_bits_of_a_rank(spark):
    n = 3000
    df = spark.range(n).select(F.xxhash64("id").cast("double").alias("risk"), (F.col("id") % 700).cast("double").alias("time"), F.lit(1).alias("event"))
    plan = V.concordance(df)._jdf.queryExecution().toString()
    assert "level" not in plan
    assert V.concordance(df).first()["permissible"] == sum((n - i - 1) for i in range(n)) - sum(k * (k - 1) // 2 for k in [5] * 200 + [4] * 500)


def test_places_of_arrays_are_those_of_columns(spark):
    for n in (1, 7, 997, 1000):
        got = spark.range(n).select(shuffled_place(F.col("id"), n, round_keys(42, F.lit("age"), 3)).alias("at"), "id").orderBy("id").collect()
        want = shuffled_places(np.arange(n), n, round_key_numbers(42, "age", 3))
        assert [x["at"] for x in got] == want.tolist() and sorted(want.tolist()) == list(range(n))


def test_permutation_importance_equals_shuffles_done_by_hand(spark):
    rng = np.random.default_rng(12)
    n, beta = 60, np.array([1.0, 0.2])
    x, t, e = rng.normal(size=(n, 2)), rng.integers(1, 40, n).astype(float), rng.integers(0, 2, n)
    ids = [f"p{i:02d}" for i in range(n)]
    df = spark.createDataFrame([(k, float(a), int(b), *map(float, v)) for k, a, b, v in zip(ids, t, e, x)], "id string, time double, event int, a double, b double")
    fit = V.CoxFit(spark, [], ["a", "b"], {(): {"beta": beta}})
    got = {r["feature"]: r["importance"] for r in V.permutation_importance(df, "id", fit, ["a", "b"], repeats=3).collect()}

    def c(risk):
        p, won, tied = _brute(t, e, np.round(risk, 9))
        return (won + tied / 2) / p

    for i, f in enumerate("ab"):
        drops = []
        for rep in range(3):
            other = np.empty(n)
            other[shuffled_places(np.arange(n), n, round_key_numbers(42, f, rep))] = x[:, i] * beta[i]
            drops.append(c(x @ beta) - c(x @ beta - x[:, i] * beta[i] + other))
        assert got[f] == pytest.approx(np.mean(drops), abs=1e-9)
