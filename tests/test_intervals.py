"""Interval lookup against brute force, and its size when intervals overlap."""

from __future__ import annotations

import random

from targetloom.operators import variants as V


def test_lookup_equals_brute_force(spark):
    rnd = random.Random(5)
    spans = [(c, s, s + rnd.choice([0, 1, 7, 40, 300, -3]), f"g{i}", i) for i, (c, s) in enumerate((rnd.choice("12"), rnd.randrange(-200, 1000)) for _ in range(300))]
    rnd.shuffle(spans)
    points = [(c, p) for c in "123" for p in range(-220, 1100, 3)] + [("1", 5), (None, 5)]
    got = V.interval_lookup(
        spark.createDataFrame(points, "chrom string, pos long"), spark.createDataFrame(spans, "chrom string, start long, end long, gene string, ord int"), "chrom", "pos", 50
    ).collect()
    assert len(got) == len(points)
    for r in got:
        inside = [(o, g) for c, s, e, g, o in spans if c == r["chrom"] and s <= r["pos"] <= e]
        assert r["interval_gene"] == (min(inside)[1] if inside else None), r


def test_overlapping_intervals_do_not_multiply_positions(spark):
    n = 3000  # every interval holds every position
    spans = spark.range(n).selectExpr("'1' AS chrom", "id - 5000 AS start", "10000 + id AS end", "concat('g', id) AS gene", "id AS ord")
    points = spark.range(n).selectExpr("'1' AS chrom", "id AS pos")
    out = V.interval_lookup(points, spans, "chrom", "pos", 4096)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    joined = _rows_of_joins(plan)
    assert joined and max(joined) <= 20 * n


def _rows_of_joins(plan) -> list[int]:
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _rows_of_joins(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _rows_of_joins(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.getClass().getSimpleName() else []
    kids = plan.children()
    return own + [v for i in range(kids.size()) for v in _rows_of_joins(kids.apply(i))]
