"""Gradient-boosted regression trees for many members at once: every target, fold and feature set grows in the same jobs.

A member is one model: a target, the fold it never sees and the features it may use.  Rows are cut into feature bins and
packed into blocks once.  Each level of each tree is one pass over the blocks that returns, per member, node, feature
and bin, the sum of the residuals and the number of rows; their size depends on the members, the depth and the bins,
never on the rows.  The driver holds the trees and picks the splits.  Blocks carry the members' predictions and are
written anew every ``REWRITE`` trees, so a pass replays a bounded number of trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from targetloom.session import cut_lineage

BLOCK_ROWS = 8192
REWRITE = 25
NO_SPLIT = 255  # a cut that every bin is below: all rows go left
BLOCK_SCHEMA = "bins binary, targets binary, weights binary, fold binary, scores binary"
BLOCK_COLUMNS = ["bins", "targets", "weights", "fold", "scores"]


@dataclass(frozen=True)
class Member:
    """A model of ``target`` (place in the target array) trained outside ``held_out`` (-1: on all rows) on ``features`` (all if empty)."""

    name: str
    target: int = 0
    held_out: int = -1
    features: tuple[int, ...] = ()


@dataclass
class Trees:
    """Fitted members; per tree and member a complete tree with children 2i + 1 and 2i + 2."""

    members: list[Member]
    feature_names: list[str]
    cuts: list[np.ndarray]
    depth: int
    base: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)  # one array (member, inner node) per tree
    cut: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)  # (member, leaf)


# --- rows to blocks -----------------------------------------------------------------------------------------------

def feature_cuts(rows: DataFrame, features: str, n_features: int, max_bins: int) -> list[np.ndarray]:
    """Upper bin edges of each feature: its distinct values but the last, or ``max_bins`` quantiles where it has more."""
    qs = [(i + 1) / max_bins for i in range(max_bins)]
    at = [F.get(features, i) for i in range(n_features)]
    found = rows.agg(*[F.percentile_approx(x, qs, 100 * max_bins).alias(f"q{i}") for i, x in enumerate(at)], *[F.approx_count_distinct(x, 0.02).alias(f"d{i}") for i, x in enumerate(at)]).first()
    few = [i for i in range(n_features) if found[f"d{i}"] <= 0.9 * max_bins]  # so these sets are bounded
    sets = rows.agg(F.lit(1), *[F.collect_set(at[i]).alias(f"s{i}") for i in few]).first()
    edges = [sets[f"s{i}"] if i in few else found[f"q{i}"] for i in range(n_features)]
    return [np.unique(np.array([v for v in e or [0.0] if v == v], dtype=float))[:-1] for e in edges]


def _binned(vectors: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of cuts below it; a missing value is in the lowest bin."""
    out = np.empty(vectors.shape, dtype=np.uint8)
    for j, edges in enumerate(cuts):
        out[:, j] = np.where(np.isnan(vectors[:, j]), 0, np.searchsorted(edges, vectors[:, j], side="left"))
    return out


def _dense(column: pd.Series, width: int) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in column], dtype=float).reshape(len(column), width)


def _pack(rows: DataFrame, cuts: list[np.ndarray], n_targets: int, base: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[at : at + BLOCK_ROWS]
                scores = np.tile(base, (len(part), 1))
                targets, weights = _dense(part["targets"], n_targets), np.nan_to_num(_dense(part["weights"], n_targets))
                weights[np.isnan(targets)] = 0.0
                bins = _binned(_dense(part["features"], len(cuts)), cuts)
                arrays = (bins, np.nan_to_num(targets), weights, part["fold"].to_numpy(np.int32), scores)
                yield pd.DataFrame([tuple(a.tobytes() for a in arrays)], columns=BLOCK_COLUMNS)

    return cut_lineage(rows.select("features", "targets", "weights", "fold").mapInPandas(run, BLOCK_SCHEMA))


# --- one pass -----------------------------------------------------------------------------------------------------

def _nodes(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes at depth ``levels`` of one tree."""
    node = np.zeros(len(bins), dtype=np.int64)
    every = np.arange(len(bins))
    for _ in range(levels):
        node = 2 * node + 1 + (bins[every, feature[node]] > cut[node])
    return node - (2**levels - 1)


def _replay(bins: np.ndarray, scores: np.ndarray, trees: Trees, start: int) -> np.ndarray:
    for t in range(start, len(trees.value)):
        for m in range(len(trees.members)):
            scores[:, m] += trees.value[t][m][_nodes(bins, trees.feature[t][m], trees.cut[t][m], trees.depth)]
    return scores


def _unpack(batch: pa.RecordBatch, trees: Trees, start: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch, as they are and as (bins, targets, weights, fold, scores so far)."""
    for block in batch.to_pylist():
        fold = np.frombuffer(block["fold"], np.int32)
        bins = np.frombuffer(block["bins"], np.uint8).reshape(len(fold), len(trees.cuts))
        targets, weights = (np.frombuffer(block[c], float).reshape(len(fold), -1) for c in ("targets", "weights"))
        scores = np.frombuffer(block["scores"], float).reshape(len(fold), len(trees.members)).copy()
        yield block, bins, targets, weights, fold, _replay(bins, scores, trees, start)


def _rewritten(blocks: DataFrame, trees: Trees, start: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *_, scores in _unpack(batch, trees, start):
                yield pa.RecordBatch.from_pylist([{**block, "scores": scores.tobytes()}])

    return cut_lineage(blocks.mapInArrow(run, BLOCK_SCHEMA))


def _histograms(blocks: DataFrame, wide: int, trees: Trees, start: int, level: int, feature: np.ndarray, cut: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(member, node of the level, flat bin, residual sum and count) over all training rows of each member."""
    members, width, nodes = trees.members, int(offsets[-1]), 2**level
    shape = (len(members), nodes, width, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for _, bins, targets, weights, fold, scores in _unpack(batch, trees, start):
                flat = bins + offsets[:-1]
                for m, member in enumerate(members):
                    use = (fold != member.held_out) & (weights[:, member.target] > 0)
                    weight = weights[use, member.target]
                    residual = weight * (targets[use, member.target] - scores[use, m])
                    code = ((_nodes(bins[use], feature[m], cut[m], level) * width)[:, None] + flat[use]).ravel()
                    for i, values in enumerate((residual, weight)):
                        total[m, :, :, i] += np.bincount(code, np.repeat(values, len(trees.cuts)), nodes * width).reshape(nodes, width)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, float).reshape(shape)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    parts = blocks.mapInArrow(run, "sums binary")
    if wide > 64:  # as in a tree aggregation: the driver adds a few dozen arrays, not one for each task
        parts = parts.repartition(int(wide**0.5) + 1).mapInArrow(add, "sums binary")
    total = np.zeros(shape)
    for row in parts.collect():
        total += np.frombuffer(row.sums, float).reshape(shape)
    return total


# --- splits -------------------------------------------------------------------------------------------------------

def best_splits(hist: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, penalty: float, min_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat bin, gain, sums left of each bin's cut) for each member's nodes; a gain of zero stands for no split.

    ``hist`` is (member, node, flat bin, 2) and ``allowed`` (member, flat bin).  Ties go to the first feature and cut, where
    gains within a billionth are ties: sums added in another order must not change a tree.
    """
    starts = np.repeat(offsets[:-1], np.diff(offsets))
    left = np.cumsum(hist, axis=2)
    before = np.concatenate([np.zeros_like(left[:, :, :1]), left], axis=2)
    left = left - before[:, :, starts]
    total = before[:, :, offsets[1]][:, :, None] - before[:, :, 0][:, :, None]
    right = total - left
    fits = (left[..., 1] >= min_rows) & (right[..., 1] >= min_rows) & allowed[:, None, :]

    def part(x: np.ndarray) -> np.ndarray:
        return x[..., 0] ** 2 / np.maximum(x[..., 1] + penalty, 1e-300)

    whole = part(total)
    gain = np.where(fits, part(left) + part(right) - whole, 0.0)
    best = gain.max(axis=2, keepdims=True)
    at = np.argmax(gain >= best * (1 - 1e-9), axis=2)
    won = best[..., 0]
    return at, np.where(won > 1e-12 * np.maximum(1.0, whole[..., 0]), won, 0.0), left


def _grow(blocks: DataFrame, wide: int, trees: Trees, start: int, offsets: np.ndarray, rate: float, penalty: float, min_rows: int) -> None:
    """Add one tree to every member; ``depth`` passes."""
    members, inner = trees.members, 2**trees.depth - 1
    feature, cut = np.zeros((len(members), inner), dtype=np.int64), np.full((len(members), inner), NO_SPLIT, dtype=np.int64)
    gain, rows = np.zeros((len(members), inner)), np.zeros((len(members), inner))
    value = np.zeros((len(members), inner + 1))
    owner = np.repeat(np.arange(len(trees.cuts)), np.diff(offsets))  # feature of each flat bin
    allowed = np.array([np.isin(owner, m.features) if m.features else np.ones(len(owner), bool) for m in members])
    for level in range(trees.depth):
        hist = _histograms(blocks, wide, trees, start, level, feature, cut, offsets)
        at, won, left = best_splits(hist, offsets, allowed, penalty, min_rows)
        here = slice(2**level - 1, 2 ** (level + 1) - 1)
        total = hist[:, :, : offsets[1]].sum(axis=2)
        feature[:, here], gain[:, here], rows[:, here] = np.where(won > 0, owner[at], 0), won, total[..., 1]
        cut[:, here] = np.where(won > 0, at - offsets[owner[at]], NO_SPLIT)
        if level == trees.depth - 1:
            low = np.where((won > 0)[..., None], np.take_along_axis(left, at[..., None, None], axis=2)[:, :, 0], total)
            for side, got in enumerate((low, total - low)):
                value[:, side::2] = np.where(got[..., 1] > 0, rate * got[..., 0] / np.maximum(got[..., 1] + penalty, 1e-300), 0.0)
    for name, got in (("feature", feature), ("cut", cut), ("gain", gain), ("rows", rows), ("value", value)):
        getattr(trees, name).append(got)


def fit_trees(
    rows: DataFrame, members: Sequence[Member], feature_names: Sequence[str], n_targets: int = 1, trees: int = 150, depth: int = 3, rate: float = 0.05,
    penalty: float = 0.0, min_rows: int = 1, max_bins: int = 128,
) -> Trees:
    """Fit all members on ``rows`` (features array<double>, targets array<double>, weights array<double>, fold int).

    A row stands for ``weights`` rows with these targets on average (one weight per target), so rows with equal features
    may be collapsed before without changing a tree.  Squared loss, start at the mean, leaves hold the mean residual (shrunk by ``penalty`` as a count of zero residuals).
    A feature splits at its distinct values, or at ``max_bins`` quantiles where it has more; quantiles are taken over
    all rows, targets only over a member's own.  A null or NaN feature counts as the lowest value; rows without a target
    train no member of that target.  A member without training rows raises.
    """
    if max_bins > 255:
        raise ValueError("at most 255 bins")
    cuts = feature_cuts(rows, "features", len(feature_names), max_bins)
    offsets = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts]))).astype(np.int64)
    sums = []
    for t in range(n_targets):
        weight = F.when(F.get("targets", t).isNotNull(), F.get("weights", t))
        sums += [F.sum(weight * F.get("targets", t)).alias(f"s{t}"), F.sum(weight).alias(f"n{t}")]
    by_fold = rows.groupBy("fold").agg(*sums).collect()
    base = []
    for m in members:
        own = [r for r in by_fold if r["fold"] != m.held_out and r[f"n{m.target}"]]
        if not own:
            raise ValueError(f"member {m.name} has no rows to train on")
        base.append(sum(r[f"s{m.target}"] for r in own) / sum(r[f"n{m.target}"] for r in own))
    fitted = Trees(list(members), list(feature_names), cuts, depth, np.array(base))
    blocks, start = _pack(rows, cuts, n_targets, fitted.base).persist(), 0  # a written table, kept in memory as far as it fits
    wide = blocks.rdd.getNumPartitions()
    for t in range(trees):
        if t - start == REWRITE:
            old, blocks, start = blocks, _rewritten(blocks, fitted, start).persist(), t
            old.unpersist()
        _grow(blocks, wide, fitted, start, offsets, rate, penalty, min_rows)
    blocks.unpersist()
    return fitted


# --- results ------------------------------------------------------------------------------------------------------

def predict(rows: DataFrame, fitted: Trees, out: str = "predictions") -> DataFrame:
    """``rows`` (features, ...) with one prediction per member, in the order of the members."""
    @F.pandas_udf("array<double>")
    def score(features: pd.Series) -> pd.Series:
        bins = _binned(_dense(features, len(fitted.cuts)), fitted.cuts)
        return pd.Series(list(_replay(bins, np.tile(fitted.base, (len(features), 1)), fitted, 0)))

    return rows.withColumn(out, score("features"))


def importances(fitted: Trees, member: int) -> list[tuple[str, float]]:
    """Share of each feature in the member's total gain, largest first."""
    won = np.zeros(len(fitted.cuts))
    for feature, gain in zip(fitted.feature, fitted.gain):
        np.add.at(won, feature[member], gain[member])
    total = won.sum() or 1.0
    return sorted(zip(fitted.feature_names, (won / total).tolist()), key=lambda x: (-x[1], x[0]))


def split_table(fitted: Trees) -> list[tuple]:
    """(member, tree, node, feature, threshold, gain, rows) of every split; rows with a value up to the threshold go left."""
    out = []
    for t, (feature, cut, gain, rows) in enumerate(zip(fitted.feature, fitted.cut, fitted.gain, fitted.rows)):
        for m, member in enumerate(fitted.members):
            for node in range(feature.shape[1]):
                if gain[m, node] > 0:
                    f = int(feature[m, node])
                    out.append((member.name, t, node, fitted.feature_names[f], float(fitted.cuts[f][cut[m, node]]), float(gain[m, node]), int(rows[m, node])))
    return out
