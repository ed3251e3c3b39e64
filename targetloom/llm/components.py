"""Connected components of an edge table, by alternating stars; nothing is gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from targetloom.session import cut_lineage


def smallest_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ends, smallest end of each one's component) of a bounded batch of edges."""
    ends, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(ends))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            return ends, ends[label]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a batch replaced by one from each end to its smallest: as many as ends at most."""
    for batch in batches:
        ends, low = smallest_labels(batch["u"].to_numpy(), batch["v"].to_numpy())
        yield pd.DataFrame({"u": ends[ends != low], "v": low[ends != low]})


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (u, v; longs): label is the smallest node of its component.

    Rounds of a large and a small star until nothing moves, so paths of any length are followed to their end.  Stars
    aggregate per node before the shuffle.  Loops are allowed; an empty table gives no rows.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    work = cut_lineage(edges.mapInPandas(_forests, "u long, v long").distinct())
    state = None
    while True:
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
        both = work.union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v")))
        work = cut_lineage(small.where("u <> v").distinct())
    ends = work.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.join(ends, nodes["node"] == ends["u"], "left").select("node", F.coalesce("label", "node").alias("label"))
