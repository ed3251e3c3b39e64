"""The vector join copies blocks once per pair of stripes, in bounded rounds, and keeps two tables of vectors."""

import numpy as np
import pytest

from targetloom.llm import grid_order


def brute(rows, least):
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = x @ x.T >= least
    np.fill_diagonal(near, True)
    label = np.arange(len(x))
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            return [(i, int(near[i].sum()) - 1, int(low[i]), bool(low[i] == i)) for i in range(len(x))]
        label = low


@pytest.mark.parametrize("stripe_bytes, round_bytes, link_rows", [(64 << 20, 1 << 27, 1 << 20), (300, 1, 5)])
def test_links_do_not_depend_on_stripes_and_rounds(spark, monkeypatch, stripe_bytes, round_bytes, link_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 5))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 9] + rng.normal(size=5) * 0.25]) for i in range(90)]
    rows += [(90 + i, rows[i * 7][1]) for i in range(6)]
    written, cut = [], grid_order.cut_lineage
    monkeypatch.setattr(grid_order, "cut_lineage", lambda df: (written.append(df.columns), cut(df))[1])
    monkeypatch.setattr(grid_order, "STRIPE_BYTES", stripe_bytes)
    monkeypatch.setattr(grid_order, "ROUND_BYTES", round_bytes)
    monkeypatch.setattr(grid_order, "LINK_ROWS", link_rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # few tasks, so stripes of several blocks
    try:
        got = grid_order.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), least=0.97, block=7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == brute(rows, 0.97)
    assert len({r.component_id for r in got}) < 96
    assert len([c for c in written if "vec" in c or "vecs" in c]) == 2
    rounds = written.count(["u", "v", "n"])
    assert rounds == 1 if round_bytes > 1 else rounds > 3


def test_a_block_is_copied_once_per_unit(spark):
    pairs = spark.range(16).selectExpr("id AS a").crossJoin(spark.range(16).selectExpr("id AS b")).where("a <= b")
    units = grid_order._units(pairs, 4)
    assert units.count() == 10 * 8  # a copy for each end of a pair would be 272
    assert units.selectExpr("sum(coalesce(size(partners), 0))").first()[0] == 136
