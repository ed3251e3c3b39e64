"""Non-negative factorisation of a long (sample, gene, value) table, blocked by samples and by genes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from targetloom.operators.prefix import dense_positions
from targetloom.session import cut_lineage

_PART = "block long, part array<double>"
_FACTOR = "block long, f array<double>, sums array<double>"


def _placed(long: DataFrame, key: str, size: int) -> DataFrame:
    """(key, block, place) of every distinct key; places are gapless, so every block but the last is full."""
    pos = F.col("pos") - 1
    names = dense_positions(long.select(key).distinct(), key)
    return names.select(key, F.floor(pos / size).alias("block"), (pos % size).cast("int").alias("place"))


def _tiles(long: DataFrame, samples: DataFrame, genes: DataFrame) -> DataFrame:
    """One row per (sample block, gene block) that holds a value: places and values of its cells, at most a block times a block."""
    cells = long.where(F.col("value").isNotNull() & (F.col("value") != 0))
    cells = cells.join(samples.select("sample", F.col("block").alias("sb"), F.col("place").alias("i")), "sample")
    cells = cells.join(genes.select("gene", F.col("block").alias("gb"), F.col("place").alias("j")), "gene")
    checked = F.when(F.col("value") < 0, F.raise_error("negative value: a factorisation needs values of zero or more").cast("double")).otherwise(F.col("value"))
    packed = cells.select("sb", "gb", F.struct("i", "j", checked.alias("v")).alias("cell")).groupBy("sb", "gb").agg(F.collect_list("cell").alias("cells"))
    return packed.select("sb", "gb", F.col("cells.i").alias("i"), F.col("cells.j").alias("j"), F.col("cells.v").alias("v"))


def _start(places: DataFrame, key: str, k: int, scale: float, seed: int) -> DataFrame:
    """Factor rows of keyed uniforms, so a rerun and a lost task draw the same numbers."""
    draw = [F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(key)), F.lit(1 << 30)) / float(1 << 30) * scale + 0.01 * scale for r in range(k)]
    ordered = F.array_sort(F.collect_list(F.struct("place", F.array(*draw).alias("f"))))
    rows = places.groupBy("block").agg(ordered.alias("rows")).select("block", F.flatten(F.col("rows.f")).alias("f"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(sums=[_block_sums(np.asarray(f).reshape(-1, k), 0.0) for f in pdf["f"]])

    return cut_lineage(rows.mapInPandas(summed, _FACTOR))


def _block_sums(rows: np.ndarray, fit: float) -> np.ndarray:
    return np.append((rows.T @ rows).ravel(), fit)


def _gram(factor: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """k x k sums of products over a whole factor, and the sum of its products with the data; blocks carry their own."""
    got = np.array(factor.agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k * k + 1)]).first(), dtype=float)
    return got[:-1].reshape(k, k), float(got[-1])


def _update(tiles: DataFrame, fixed: DataFrame, moving: DataFrame, k: int, along: str, gram: np.ndarray, sweeps: int) -> DataFrame:
    """The moving factor after ``sweeps`` rounds of coordinate descent against the fixed one.

    ``gram`` holds the sums of products of the fixed factor.  Tiles meet the fixed factor by its block; a task adds up its products per moving block, and only those sums are
    shuffled (at most one per task and block).  Spark ships the fixed factor whole only while it is small.
    """
    other, own, own_place, other_place = ("gb", "sb", "i", "j") if along == "sample" else ("sb", "gb", "j", "i")
    joined = tiles.join(fixed.select(F.col("block").alias(other), "f"), other).select(F.col(own).alias("block"), F.col(own_place).alias("p"), F.col(other_place).alias("q"), "v", "f")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, p, q, v, f in zip(pdf["block"], pdf["p"], pdf["q"], pdf["v"], pdf["f"]):
                rows = np.asarray(f).reshape(-1, k)[np.asarray(q)] * np.asarray(v)[:, None]
                places = np.asarray(p)
                got = np.stack([np.bincount(places, rows[:, r]) for r in range(k)], axis=1)
                had = sums.get(block)
                if had is not None and len(had) > len(got):
                    had[: len(got)] += got
                else:
                    sums[block] = got if had is None else np.vstack([had + got[: len(had)], got[len(had):]])
            if len(sums) > 64:
                yield pd.DataFrame({"block": list(sums), "part": [s.ravel() for s in sums.values()]})
                sums = {}
        if sums:
            yield pd.DataFrame({"block": list(sums), "part": [s.ravel() for s in sums.values()]})

    def descend(parts: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        now = np.array(state["f"].iloc[0], dtype=float).reshape(-1, k)
        xf = np.zeros_like(now)
        for part in parts["part"]:
            rows = np.asarray(part).reshape(-1, k)
            xf[: len(rows)] += rows
        for _ in range(sweeps):
            for r in range(k):
                if gram[r, r] > 0:
                    now[:, r] = np.maximum(now[:, r] + (xf[:, r] - now @ gram[:, r]) / gram[r, r], 0.0)
        return pd.DataFrame({"block": [state["block"].iloc[0]], "f": [now.ravel()], "sums": [_block_sums(now, float((now * xf).sum()))]})

    sums = joined.mapInPandas(products, _PART)
    return cut_lineage(sums.groupBy("block").cogroup(moving.groupBy("block")).applyInPandas(descend, _FACTOR))


def _unpacked(factor: DataFrame, places: DataFrame, key: str, k: int, out: str) -> DataFrame:
    cut = F.transform(F.sequence(F.lit(0), (F.size("f") / k).cast("int") - 1), lambda n: F.slice("f", n * k + 1, k))
    return factor.select("block", F.posexplode(cut).alias("place", out)).join(places, ["block", "place"]).select(key, out)


def nmf(
    long: DataFrame, k: int, max_rounds: int = 500, tol: float = 3e-5, seed: int = 42, sweeps: int = 8, sample_block: int = 1024, gene_block: int = 1024
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Factors of ``value`` by alternating coordinate descent: (sample, w), (gene, h) and the loss after each round.

    Cells without a row or a value count as zero, so do samples and genes without any; a negative or repeated value is
    an error of the caller's for the first (raised) and is added up for the second.  Both factors are tables of blocks;
    the driver sees k x k sums and the loss.  A round ends the fit when it lowers the squared loss by less than
    ``tol`` of the data's own sum of squares; a fit that has not settled after ``max_rounds`` is an error, and so are
    more components than samples.  An empty table gives empty factors.
    """
    long = cut_lineage(long.groupBy("sample", "gene").agg(F.sum(F.col("value").cast("double")).alias("value")))
    samples = cut_lineage(_placed(long, "sample", sample_block))
    genes = cut_lineage(_placed(long, "gene", gene_block))
    squares, total = long.agg(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)), F.coalesce(F.sum("value"), F.lit(0.0))).first()
    n, m = samples.count(), genes.count()
    if n and k > n:
        raise ValueError(f"{k} components for {n} samples")
    tiles = cut_lineage(_tiles(long, samples, genes))
    scale = 2 * float(np.sqrt(max(total, 0.0) / max(n * m, 1) / k))
    w = _start(samples, "sample", k, scale, seed)
    h = _start(genes, "gene", k, scale, seed + 1)
    losses: list[float] = []
    hh = _gram(h, k)[0]
    while squares > 0:
        w = _update(tiles, h, w, k, "sample", hh, sweeps)
        ww = _gram(w, k)[0]
        h = _update(tiles, w, h, k, "gene", ww, sweeps)
        hh, fit = _gram(h, k)
        losses.append(squares - 2 * fit + float((ww * hh).sum()))
        if len(losses) > 1 and losses[-2] - losses[-1] < tol * squares:
            break
        if len(losses) == max_rounds:
            raise RuntimeError(f"the factorisation has not settled within {max_rounds} rounds: {losses[-2:]} of {squares}")
    return _unpacked(w, samples, "sample", k, "w"), _unpacked(h, genes, "gene", k, "h"), losses
