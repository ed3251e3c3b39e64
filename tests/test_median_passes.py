"""The median of distances: half the tiles, no pass for the largest, bins cut again until few distances are shuffled."""

import numpy as np
import pytest

from targetloom.operators import learning as L


def vectors(spark, data):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "id long, vector array<double>")


@pytest.mark.parametrize("kind", ["far", "copies", "one"])
def test_bins_are_cut_again(spark, monkeypatch, kind):
    """Far from the origin all distances fall into the first bin; copies stay in one bin however narrow."""
    rng = np.random.default_rng(4)
    data = {"far": rng.normal(size=(50, 3)) + 300, "copies": np.repeat(rng.integers(-9, 9, size=(2, 3)), 20, axis=0), "one": np.ones((1, 3))}[kind]
    tiles, passes = [], L._tile_sums

    def seen(*args, **named):
        out = passes(*args, **named)
        tiles.append(args[3])
        return out

    monkeypatch.setattr(L, "_tile_sums", seen)
    monkeypatch.setattr(L, "_BIN_VALUES", 100)
    got = L.median_squared_distance(vectors(spark, data), block_size=9, bins=64)
    d2 = ((data[:, None] - data[None]) ** 2).sum(-1)
    assert got == pytest.approx(np.median(d2[d2 > 1e-9]) if kind != "one" else 1.0, rel=1e-6)
    assert tiles.count("b int, c long") == {"far": 4, "copies": 4, "one": 1}[kind] and "m double" not in tiles


def test_half_of_the_tiles_sums_as_all(spark):
    rng = np.random.default_rng(6)
    z = vectors(spark, rng.normal(size=(64, 4)))

    def total(d2, same):
        return L.pd.DataFrame({"s": [d2.sum()], "n": [float(d2.size)], "t": [1.0]})

    every, half = ([sum(r[k] for r in L._tile_sums(z, z, total, "s double, n double, t double", 5, half=h).collect()) for k in range(3)] for h in (False, True))
    assert half[:2] == pytest.approx(every[:2]) and half[1] == 64 * 64
    assert half[2] < 0.75 * every[2]
