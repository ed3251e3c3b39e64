"""Set distances shuffle stripes, whose number does not depend on the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from targetloom.operators import learning as L


def test_shuffled_rows_do_not_grow_with_the_blocks(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(60, 3))
    x = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "id long, vector array<double>")

    def count(d2, same):
        return pd.DataFrame({"s": [np.sqrt(d2).sum()], "n": [float(d2.size)]})

    tiles = L._tile_sums(x, x, count, "s double, n double", 2)
    assert tiles.agg(F.sum("n")).first()[0] == 3600.0
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "rows_a" not in plan
    want = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1)).mean()
    got = tiles.agg(F.sum("s") / F.sum("n")).first()[0]
    assert got == pytest.approx(want, abs=1e-6)
    d2 = ((data[:, None] - data[None]) ** 2).sum(-1)
    assert L.median_squared_distance(x, block_size=7, bins=16) == pytest.approx(np.median(d2[d2 > 0]), rel=1e-9)
