"""Searches and combinations rank inside a pool: no candidate reaches a shuffle."""

from __future__ import annotations

import itertools

import numpy as np

from targetloom.operators import regimen as R


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_pool_finds_the_best_sets_without_shuffling_states(spark):
    rng = np.random.default_rng(3)
    names = [f"d{i:02d}" for i in range(9)]
    pairs = {p: float(rng.integers(0, 8)) / 8 for p in itertools.combinations(names, 2)}
    cards = R.drug_cards(
        spark.createDataFrame([(n,) for n in names], "drug string"),
        spark.createDataFrame([(*p, s, 0, 0) for p, s in pairs.items()], "drug_a string, drug_b string, synergy double, tox int, known int"),
        spark.createDataFrame([(n, f"g{n}") for n in names[1:]], "drug string, gene string"),
    )
    pools = spark.createDataFrame([("p", names), ("q", names[:2]), ("r", [])], "patient string, drugs array<string>")
    got = R.beam_search(pools, cards, beam_width=1000, max_depth=3, top_k=5)
    assert "Window" not in _plan(got)
    rows = sorted(tuple(r) for r in got.collect())
    want = {s: sum(pairs[p] for p in itertools.combinations(s, 2)) / (n * (n - 1) / 2) + 0.05 * (n - 2) for n in (2, 3) for s in itertools.combinations(names, n)}
    top = sorted((round(v, 9) for v in want.values()), reverse=True)[:5]
    assert [r[2] for r in sorted(rows, key=lambda r: (r[0], r[4])) if r[0] == "p"] == top
    assert all(round(want[tuple(r[1].split(" + "))], 9) == r[2] for r in rows)
    assert [r[1:] for r in rows if r[0] == "q"] == [("d00 + d01", pairs["d00", "d01"], 2, 1)] and not [r for r in rows if r[0] == "r"]


def test_combinations_are_ranked_before_any_shuffle(spark):
    frame = spark.createDataFrame
    genes = frame([(p, g) for p, gs in (("p", "abc"), ("q", "ab"), ("r", "a")) for g in gs], "patient string, gene string")
    drugs = frame([("a", "x", 1), ("b", "y", 1), ("c", "y", 1)], "gene string, drug string, ord int")
    out = R.patient_combinations(
        genes, drugs, frame([("a", "w"), ("c", "w")], "gene string, pathway string"), frame([("a", "RTK"), ("b", "other"), ("c", "INTRA")], "gene string, gene_class string"),
        frame([("x", "heart"), ("y", "heart")], "drug string, category string"), frame([], "drug_a string, drug_b string, boost double"),
    )
    assert "Window" not in _plan(out)
    # the first gene pair of a combination counts, also where a later one scores higher
    assert sorted((r["patient"], r["combination"], r["gene_b"], r["score"], r["rank"], r["recommended_first_pilot"]) for r in out.collect()) == [
        ("p", "x + y", "b", 0.1, 1, False), ("q", "x + y", "b", 0.1, 1, False)
    ]
