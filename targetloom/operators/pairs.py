"""Pairs of entities without cross joins and without emitting every pair of every group.

``unordered_pairs`` enumerates all pairs of a panel as an equi-join on block pairs, so the work is spread evenly.
``pair_moments`` computes pairwise sums over shared samples (co-occurrence counts, correlations) as partial Gram
matrices per batch of samples: a sample contributes one row to the shuffle, not one row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def unordered_pairs(df: DataFrame, key: str, blocks: int | None = None, left: str = "_1", right: str = "_2") -> DataFrame:
    """Every pair of rows with key_left < key_right; columns get the two suffixes.

    A row is copied once per block; two rows meet only in the cell of their own two blocks.  There are at least as many
    cells as shuffle partitions unless ``blocks`` says otherwise.
    """
    blocks = blocks or max(8, math.isqrt(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1)
    cells = df.withColumn("_b", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    cells = cells.withColumn("_lo", F.least("_b", "_k")).withColumn("_hi", F.greatest("_b", "_k")).drop("_k")
    a = cells.select(*[F.col(c).alias(c + left) for c in df.columns], F.col("_b").alias("_ba"), "_lo", "_hi")
    b = cells.select(*[F.col(c).alias(c + right) for c in df.columns], F.col("_b").alias("_bb"), "_lo", "_hi")
    return (
        a.join(b, ["_lo", "_hi"], "inner")
        .where(F.col(key + left) < F.col(key + right))
        .where((F.col("_lo") == F.least("_ba", "_bb")) & (F.col("_hi") == F.greatest("_ba", "_bb")))
        .select(*[c + left for c in df.columns], *[c + right for c in df.columns])
    )


_MOMENT_SCHEMA = "item_a string, item_b string, n double, sx double, sy double, sxx double, syy double, sxy double"


def _batch_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lengths = pdf["items"].map(len).to_numpy()
        if lengths.sum() == 0:
            continue
        names, codes = np.unique(np.concatenate(pdf["items"].to_numpy()).astype(str), return_inverse=True)
        rows = np.repeat(np.arange(len(pdf)), lengths)
        x = np.zeros((len(pdf), len(names)))
        seen = np.zeros_like(x)
        x[rows, codes] = np.concatenate(pdf["values"].to_numpy())
        seen[rows, codes] = 1.0
        x2 = x * x
        i, j = np.triu_indices(len(names))
        n = (seen.T @ seen)[i, j]
        out = pd.DataFrame(
            {
                "item_a": names[i],
                "item_b": names[j],
                "n": n,
                "sx": (x.T @ seen)[i, j],
                "sy": (seen.T @ x)[i, j],
                "sxx": (x2.T @ seen)[i, j],
                "syy": (seen.T @ x2)[i, j],
                "sxy": (x.T @ x)[i, j],
            }
        )
        yield out[n > 0]


def pair_moments(long: DataFrame, sample: str | list[str], item: str, value: str | None = None, blocks: int = 1) -> DataFrame:
    """Pairwise-complete sums for item_a <= item_b over the samples that have both.

    ``long`` holds one row per (sample, item).  With ``value`` omitted only the co-occurrence count ``n`` matters.
    ``blocks`` splits a large panel: a sample row then carries at most two blocks of items, and a batch at most
    that many columns.
    """
    keys = [sample] if isinstance(sample, str) else list(sample)
    val = F.col(value).cast("double") if value else F.lit(1.0)
    rows = long.select(*keys, F.col(item).cast("string").alias("_i"), val.alias("_x")).where(F.col("_x").isNotNull())
    if blocks > 1:
        rows = rows.withColumn("_b", F.pmod(F.xxhash64("_i"), F.lit(blocks)).cast("int"))
        rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rows = rows.withColumn("_lo", F.least("_b", "_k")).withColumn("_hi", F.greatest("_b", "_k"))
        keys = [*keys, "_lo", "_hi"]
    packed = rows.groupBy(*keys).agg(F.collect_list("_i").alias("items"), F.collect_list("_x").alias("values"))
    if blocks > 1:
        # one batch holds one block pair when rows of a block pair are contiguous
        packed = packed.repartition("_lo", "_hi", F.pmod(F.xxhash64(*keys), F.lit(64))).sortWithinPartitions("_lo", "_hi")
        cols = ["_lo", "_hi", "items", "values"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for (lo, hi), part in pdf.groupby(["_lo", "_hi"], sort=False):
                    for out in _batch_moments(iter([part])):
                        yield out.assign(_lo=lo, _hi=hi)

        partial = packed.select(*cols).mapInPandas(run, _MOMENT_SCHEMA + ", _lo int, _hi int")
        ba = F.pmod(F.xxhash64("item_a"), F.lit(blocks)).cast("int")
        bb = F.pmod(F.xxhash64("item_b"), F.lit(blocks)).cast("int")
        partial = partial.where((F.col("_lo") == F.least(ba, bb)) & (F.col("_hi") == F.greatest(ba, bb)))
    else:
        partial = packed.select("items", "values").mapInPandas(_batch_moments, _MOMENT_SCHEMA)
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    return partial.groupBy("item_a", "item_b").agg(*[F.sum(s).alias(s) for s in sums])


def co_occurrence(long: DataFrame, sample: str | list[str], item: str, blocks: int = 1) -> DataFrame:
    """(item_a, item_b, n): samples holding both items, item_a < item_b."""
    m = pair_moments(long, sample, item, None, blocks)
    return m.where(F.col("item_a") < F.col("item_b")).select("item_a", "item_b", F.col("n").cast("long").alias("n"))


def pearson_pairs(long: DataFrame, sample: str, item: str, value: str, blocks: int = 1, centre: bool = True) -> DataFrame:
    """(item_a, item_b, pearson_r, n_samples) for item_a < item_b, pairwise complete.

    Values are centred per item first, so the sums lose no digits when means are large.
    """
    if centre:
        means = long.groupBy(item).agg(F.avg(value).alias("_mean"))
        long = long.join(means, item).withColumn("_c", F.col(value) - F.col("_mean"))
        value = "_c"
    m = pair_moments(long, sample, item, value, blocks).where(F.col("item_a") < F.col("item_b"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return m.select("item_a", "item_b", r.alias("pearson_r"), F.col("n").cast("long").alias("n_samples"))


def packed_blocks(df: DataFrame, key: str, block_size: int = 1000) -> tuple[DataFrame, int]:
    """Rows packed into blocks of about ``block_size``: (block, rows array).  Blocks are hash buckets of the key."""
    n = df.count()
    blocks = max(1, -(-n // block_size))
    packed = df.withColumn("block", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(blocks)).cast("int"))
    packed = packed.groupBy("block").agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    return packed, blocks


def block_tiles(left: DataFrame, right: DataFrame, right_blocks: int) -> DataFrame:
    """One row per (left block, right block): an equi-join on the right block id, spread over four tasks per shuffle partition."""
    a = left.select(F.col("block").alias("block_a"), F.col("rows").alias("rows_a"), F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1))).alias("block_b"))
    b = right.select(F.col("block").alias("block_b"), F.col("rows").alias("rows_b"))
    tiles = a.join(b, "block_b")
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(min(tasks, 4 * right_blocks * right_blocks), "block_a", "block_b") if right_blocks > 1 else tiles
