"""Feature tables, splits, baselines, tree models and prediction metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from targetloom.functions.numeric import keyed_uniform
from targetloom.operators.boosting import Member, Trees, fit_trees, predict
from targetloom.operators.permutation import numbered, round_keys, shuffled_place
from targetloom.operators.prefix import exact_quantiles, medians, running_sums
from targetloom.session import cut_lineage


# --- features -----------------------------------------------------------------------------------------------------

def multi_omic_features(target: DataFrame, tables: Sequence[DataFrame], features: Sequence[str], keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join feature tables on ``keys``, drop rows without a target, fill each feature with its median."""
    out = target.where(F.col("target").isNotNull())
    for t in tables:
        out = out.join(t, list(keys), how)
    out = cut_lineage(out)
    for f in features:
        out = out.withColumn("_med", medians(out, f).scalar()).withColumn(f, F.coalesce(f, "_med")).drop("_med")
    return out


def panel_profiles(long: DataFrame, line: str, entity: str, value: str, entities: DataFrame) -> DataFrame:
    """Per line the panel values in entity order, holes filled with the entity median (0 when it has none), and the mask."""
    med = medians(long, value, [entity], "_med")
    grid = long.select(line).distinct().withColumn("_e", entities.agg(F.array_sort(F.collect_set(entity)).alias("e")).scalar())
    grid = grid.select(line, F.explode("_e").alias(entity))
    full = grid.join(long.select(line, entity, value), [line, entity], "left").join(med, entity, "left")
    cell = F.struct(F.col(entity), F.coalesce(F.col(value), F.col("_med"), F.lit(0.0)).alias("v"), F.col(value).isNotNull().alias("seen"))
    packed = full.groupBy(line).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return packed.select(line, F.transform("c", lambda s: s.getField("v")).alias("profile"), F.transform("c", lambda s: s.getField("seen")).alias("mask"))


def pooled_array_features(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Cut a flat array into atoms of ``width`` numbers; element-wise mean and max over the atoms."""
    n = (F.size(vector) / width).cast("int")
    atoms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(vector), i * width + 1, F.lit(width)))
    out = df.withColumn("_a", atoms)
    mean = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate("_a", F.lit(0.0), lambda acc, a: acc + F.get(a, j).cast("double")) / F.size("_a"))
    top = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.array_max(F.transform("_a", lambda a: F.get(a, j).cast("double"))))
    return out.withColumn("pooled", F.concat(mean, top)).drop("_a")


def pair_features(pairs: DataFrame, drugs: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    """(drug_row, drug_col, cell_line_name, features): both drugs' pooled vectors, then one place per cell line.

    ``drugs`` is (drug, pooled) with ``width`` numbers each; pairs with an unknown drug are left out.  Lines are placed in
    byte order; their number is the width of the one-hot part.
    """
    lines = cut_lineage(index_map(pairs, "cell_line_name", "_line"))
    n = lines.count()
    hot = F.transform(F.sequence(F.lit(0), F.lit(max(0, n - 1))), lambda i: (i == F.col("_line")).cast("double"))
    out = pairs.join(lines, "cell_line_name")
    for side in ("drug_row", "drug_col"):
        out = out.join(drugs.select(F.col("drug").alias(side), F.col("pooled").alias(f"_{side}")), side)
    out = out.select("drug_row", "drug_col", "cell_line_name", F.concat("_drug_row", "_drug_col", hot).alias("features"))
    names = [f"{side}_{i}" for side in ("row", "col") for i in range(width)] + [f"line_{i}" for i in range(n)]
    return out, names


def index_map(df: DataFrame, col: str, out: str = "index") -> DataFrame:
    """0-based index of each distinct text in byte order: ranges of texts, numbered inside and offset by the earlier ranges' counts."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(df.select(col).distinct().repartitionByRange(parts, col).withColumn("_p", F.spark_partition_id()))
    counts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))  # one row per range
    starts = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(col)) - 1
    return d.withColumn("_w", within).join(starts, "_p").select(col, (F.col("_s") + F.col("_w")).cast("long").alias(out))


def target_mask(df: DataFrame, targets: str, entities: DataFrame, entity: str) -> DataFrame:
    """Multi-hot array over the sorted entity list; all true when a row has no target in it."""
    out = df.withColumn("_e", entities.agg(F.array_sort(F.collect_set(entity)).alias("e")).scalar())
    none = F.coalesce(F.size(F.array_intersect("_e", targets)) == 0, F.lit(True))
    return out.withColumn("mask", F.transform("_e", lambda e: none | F.array_contains(F.col(targets), e))).drop("_e")


# --- splits -------------------------------------------------------------------------------------------------------

def _cut_labels(groups: DataFrame, key: str, val: float, test: float, seed: int) -> DataFrame:
    """Distinct groups ordered by a keyed draw and cut by rounded counts, at least one group in val and in test."""
    g = groups.select(key).distinct().withColumn("_u", keyed_uniform(seed, key))
    n = g.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = running_sums(g.groupBy("_u").agg(F.count(F.lit(1)).alias("n_at")), "_u", ["n_at"]).select("_u", (F.col("cum_n_at") - F.col("n_at")).alias("_s"))
    pos = g.join(counts, "_u").withColumn("_p", F.col("_s") + F.row_number().over(Window.partitionBy("_u").orderBy(key))).withColumn("_n", n)
    n_test = F.greatest(F.round(F.col("_n") * test), F.lit(1))
    n_val = F.greatest(F.round(F.col("_n") * val), F.lit(1))
    return pos.select(key, F.when(F.col("_p") <= n_test, "test").when(F.col("_p") <= n_test + n_val, "val").otherwise("train").alias("split"))


def group_split(df: DataFrame, key: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Unseen-group split: all rows of a group get the group's label."""
    return df.join(_cut_labels(df, key, val, test, seed), key)


def row_split(df: DataFrame, key: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Independent rows with exactly the rounded counts in test and val: rows are numbered by their unique key and dealt
    out by a keyed bijection of the places, so nothing is sorted by a draw."""
    rows = numbered(df, [key])
    n = rows.count()
    n_test, n_val = round(n * test), round(n * val)
    at = shuffled_place(F.col("_place"), n, round_keys(seed))
    out = rows.withColumn("_at", at)
    return out.withColumn("split", F.when(F.col("_at") < n_test, "test").when(F.col("_at") < n_test + n_val, "val").otherwise("train")).drop("_place", "_at")


def unseen_both_split(df: DataFrame, a: str, b: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows whose two groups carry the same label; mixed rows are dropped.  A split without rows is an error."""
    la = _cut_labels(df, a, val, test, seed).withColumnRenamed("split", "_sa")
    lb = _cut_labels(df, b, val, test, seed + 1).withColumnRenamed("split", "_sb")
    out = cut_lineage(df.join(la, a).join(lb, b).where(F.col("_sa") == F.col("_sb")).withColumn("split", F.col("_sa")).drop("_sa", "_sb"))
    if out.select("split").distinct().count() < 3:
        raise ValueError("a split has no rows: more groups or other shares are needed")
    return out


def candidate_sample(rows: DataFrame, keys: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """Distinct candidates of the test split in keyed-draw order, cut to ``size`` (all where there are fewer)."""
    pool = rows.where("split = 'test'").select(*keys).distinct()
    return pool.orderBy(keyed_uniform(seed, *keys), *keys).limit(size)


def unseen_drug_split(df: DataFrame, a: str = "drug_row", b: str = "drug_col", val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """One label per drug over both columns; pairs with two labels are dropped."""
    drugs = df.select(F.explode(F.array_distinct(F.array(a, b))).alias("drug")).distinct()
    lab = cut_lineage(_cut_labels(drugs, "drug", val, test, seed))
    out = df.join(lab.select(F.col("drug").alias(a), F.col("split").alias("_sa")), a).join(lab.select(F.col("drug").alias(b), F.col("split").alias("_sb")), b)
    return out.where(F.col("_sa") == F.col("_sb")).withColumn("split", F.col("_sa")).drop("_sa", "_sb")


def deal_equal_groups(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Deal ``count`` groups of ``size`` rows to the lightest fold each (the first of equally light ones); ``loads`` is updated.

    Returns phases (first group, folds in turn): a fold joins the turn when the others have filled up to it, and from
    then on the folds in turn differ by one group at most, so they take groups in a fixed order.
    """
    phases, done = [], 0
    waiting = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    turn: list[int] = []
    while done < count:
        turn = sorted([*turn, waiting.pop(0)], key=lambda f: (loads[f], f))
        until = count - done
        if waiting:
            mark = waiting[0]
            until = min(until, sum(-((loads[f] - loads[mark]) // size) + (f < mark and (loads[mark] - loads[f]) % size == 0) for f in turn if (loads[f], f) < (loads[mark], mark)))
        phases.append((done, list(turn)))
        for i, f in enumerate(turn):
            loads[f] += size * (until // len(turn) + (i < until % len(turn)))
        done += until
    return phases


def balanced_group_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """(key, fold): groups from the largest down, each to the fold with the fewest rows so far; equal groups in order of key.

    Groups of one size are dealt as a whole, so the driver sees one row per distinct size, of which there are at most
    the square root of twice the rows.  Fewer groups than folds give as many folds as groups.
    """
    sizes = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    classes = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect()
    loads = [0] * max(1, min(folds, sum(r.c for r in classes)))
    plan = [(r.n, deal_equal_groups(loads, r.n, r.c)) for r in classes]
    phases = df.sparkSession.createDataFrame(plan, "n long, phases array<struct<first:long,turn:array<int>>>")
    place = running_sums(sizes.withColumn("_one", F.lit(1)), key, ["_one"], ["n"]).withColumn("_p", F.col("cum__one") - 1).join(phases, "n")
    now = F.element_at(F.filter("phases", lambda x: x.first <= F.col("_p")), -1)
    picked = place.withColumn("_now", now).withColumn("_i", (F.col("_p") - F.col("_now.first")) % F.size("_now.turn"))
    return picked.select(key, F.get("_now.turn", F.col("_i").cast("int")).alias("fold"))


# --- normalisation and baselines ----------------------------------------------------------------------------------

def train_normaliser(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: mean and sd per metric from the training rows; an sd below 1e-6 counts as 1."""
    train = df.where(F.col("split") == "train")
    aggs = []
    for m in metrics:
        sd = F.stddev_pop(m)
        aggs += [F.avg(m).alias(f"mean_{m}"), F.when(sd < 1e-6, 1.0).otherwise(sd).alias(f"sd_{m}")]
    return train.agg(*aggs)


def normalise(df: DataFrame, stats: DataFrame, metrics: Sequence[str], back: bool = False) -> DataFrame:
    out = df.withColumn("_n", stats.select(F.struct(*stats.columns).alias("s")).scalar())
    for m in metrics:
        mean, sd = F.col(f"_n.mean_{m}"), F.col(f"_n.sd_{m}")
        out = out.withColumn(m, F.col(m) * sd + mean if back else (F.col(m) - mean) / sd)
    return out.drop("_n")


def out_of_fold_means(df: DataFrame, entity: str, target: str, fold: str = "fold") -> DataFrame:
    """Per row the mean of its entity over the other folds, else the mean of all rows in the other folds.

    A leave-fold-out mean is (total - fold) / (n - n_fold): three small aggregates, no loop over folds.
    """
    ef = df.groupBy(entity, fold).agg(F.sum(target).alias("_sf"), F.count(target).alias("_nf"))
    e = ef.groupBy(entity).agg(F.sum("_sf").alias("_s"), F.sum("_nf").alias("_n"))
    f = ef.groupBy(fold).agg(F.sum("_sf").alias("_fs"), F.sum("_nf").alias("_fn"))
    total = f.agg(F.struct(F.sum("_fs").alias("s"), F.sum("_fn").alias("n")).alias("t")).scalar()
    look = ef.join(e, entity).join(f.withColumn("_t", total), fold)
    own = F.when(F.col("_n") > F.col("_nf"), (F.col("_s") - F.col("_sf")) / (F.col("_n") - F.col("_nf")))
    rest = (F.col("_t.s") - F.col("_fs")) / (F.col("_t.n") - F.col("_fn"))
    return df.join(look.select(entity, fold, F.coalesce(own, rest).alias("baseline")), [entity, fold])


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """n, R2, MAE, MSE, RMSE and Pearson (0 when one side is constant)."""
    err = F.col(y) - F.col(yhat)
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(y).alias("_v"), F.stddev_pop(yhat).alias("_s"), F.corr(y, yhat).alias("_c")
    )
    r2 = F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v"))
    pearson = F.when((F.col("_v") > 1e-18) & (F.col("_s") > 1e-9), F.col("_c")).otherwise(0.0)
    return agg.select(*by, "n", r2.alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"), pearson.alias("pearson"))


def other_fold_means(rows: DataFrame, entity: str, target: str, folds: int) -> DataFrame:
    """``rows`` with ``_means``: per fold k the mean target of the row's entity outside k, else of all rows outside k.

    A model that holds out fold k may use place k for its training and its held-out rows alike: no target of k is in it.
    """
    cells = rows.groupBy(entity, "fold").agg(F.sum(target).alias("s"), F.count(target).alias("n"))

    def sums(by: list[str]) -> DataFrame:
        aggs = [F.array(*[F.sum(F.when(F.col("fold") != k, F.col(c))) for k in range(folds)]).alias(f"_{c}{len(by)}") for c in ("s", "n")]
        return cells.groupBy(*by).agg(*aggs)

    every = sums([]).select(F.struct("_s0", "_n0").alias("a")).scalar()
    out = rows.join(sums([entity]), entity).withColumn("_all", every)
    means = [F.coalesce(F.try_divide(F.get("_s1", k), F.get("_n1", k)), F.try_divide(F.get("_all._s0", k), F.get("_all._n0", k))) for k in range(folds)]
    return out.withColumn("_means", F.array(*means)).drop("_s1", "_n1", "_all")


def grouped_tree_models(
    df: DataFrame, features: Sequence[str], target: str, group: str, folds: int = 5, entity: str | None = None, trees: int = 150, depth: int = 3, rate: float = 0.05
) -> tuple[DataFrame, Trees]:
    """Boosted trees with whole groups held out: ``df`` with fold and out-of-fold predictions, and the fitted members.

    ``prediction`` is that of the model on ``features``; with ``entity``, ``prediction_entity`` is that of the model that
    may also use the entity's mean target outside the fold.  The last member, "all", is fitted on all rows.  All
    members grow together.  Rows without a target are predicted but train nothing.
    """
    lab = cut_lineage(balanced_group_folds(df, group, folds))
    folds = lab.agg(F.max("fold")).first()[0] + 1
    rows = df.join(lab, group)
    names, own = list(features), tuple(range(len(features)))
    vector = F.array(*[F.col(f).cast("double") for f in features])
    members = [Member(f"fold {k}", 0, k, own) for k in range(folds)]
    if entity:
        rows = other_fold_means(rows, entity, target, folds)
        vector = F.concat(vector, F.col("_means"))
        members += [Member(f"fold {k} with {entity}", 0, k, (*own, len(own) + k)) for k in range(folds)]
        names += [f"{entity} outside {k}" for k in range(folds)]
    members.append(Member("all", 0, -1, own))
    ready = cut_lineage(rows.select(*df.columns, "fold", vector.alias("features"), F.array(F.col(target).cast("double")).alias("targets"), F.array(F.lit(1.0)).alias("weights")))
    fitted = fit_trees(ready, members, names, trees=trees, depth=depth, rate=rate)
    scored = predict(ready, fitted, "_scores")
    out = scored.withColumn("prediction", F.get("_scores", F.col("fold")))
    if entity:
        out = out.withColumn("prediction_entity", F.get("_scores", F.col("fold") + folds))
    return out.drop("features", "targets", "weights", "_scores"), fitted


# --- set distances ------------------------------------------------------------------------------------------------

_STRIPE_ROWS = 100_000  # a task holds two stripes of vectors
_BIN_VALUES = 1 << 23  # distances of one bin that are shuffled by value


def _tile_sums(left: DataFrame, right: DataFrame, fn, schema: str, block_size: int, half: bool = False) -> DataFrame:
    """``fn`` over every tile of the distance matrix.

    Both tables are cut into stripes and a task takes one pair of stripes, tile by tile.  Up to ``_STRIPE_ROWS`` rows a
    stripe their number depends on the shuffle partitions only, so the rows shuffled grow in step with the tables.
    ``half``, of one table with itself: a tile and its mirror image are one, whose sums (s, n, c) count twice.
    """
    one_table = left is right
    tasks = (8 if half else 4) * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(math.isqrt(tasks) + 1, -(-left.count() // _STRIPE_ROWS), -(-right.count() // _STRIPE_ROWS))

    def cells(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
        # names of their own: a cogroup of one table with itself mixes up equal columns
        stripe = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(stripes)).cast("int")
        low, high = (stripe if half and own == "row" else F.lit(0)), (stripe if half and own == "column" else F.lit(stripes - 1))
        keyed = df.select(F.col("id").alias(f"id_{side}"), F.col("vector").alias(f"vector_{side}"), stripe.alias(f"{own}_{side}"), F.explode(F.sequence(low, high)).alias(f"{other}_{side}"))
        return keyed.groupBy(f"row_{side}", f"column_{side}")

    def run(pa: pd.DataFrame, pb: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        mirrored = half and len(pa) and len(pb) and pa["row_a"].iloc[0] == pa["column_a"].iloc[0]
        if mirrored:
            pb = pa.rename(columns={"id_a": "id_b", "vector_a": "vector_b"})  # in one order: tiles above the diagonal are mirrored
        codes, _ = pd.factorize(pd.concat([pa["id_a"], pb["id_b"]]))
        if pa["id_a"].dtype != object:  # a missing number equals nothing, not even itself
            codes = np.where(codes < 0, -1 - np.arange(len(codes)), codes)
        ids_a, ids_b = codes[: len(pa)], codes[len(pa) :]
        for i in range(0, len(pa), block_size):
            a, ids = np.stack(pa["vector_a"].iloc[i : i + block_size].to_numpy()), ids_a[i : i + block_size]
            for j in range(i if mirrored else 0, len(pb), block_size):
                b = np.stack(pb["vector_b"].iloc[j : j + block_size].to_numpy())
                d2 = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)
                # a row is at distance 0 from itself; two tables may use the same identifiers for different rows
                same = ids[:, None] == ids_b[None, j : j + block_size] if one_table else np.zeros(d2.shape, dtype=bool)
                d2[same] = 0.0
                part = fn(d2, same)
                if half and not (mirrored and i == j):
                    part = part.assign(**{c: 2 * part[c] for c in ("s", "n", "c") if c in part})
                out.append(part)
            if out and "c" in out[0]:  # counts per value: merged as they come
                merged = pd.concat(out)
                out = [merged.groupby([c for c in merged.columns if c != "c"], as_index=False)["c"].sum()]
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])

    return cells(left, "a", "row", "column").cogroup(cells(right, "b", "column", "row")).applyInPandas(run, schema)


def energy_distance(x: DataFrame, y: DataFrame, block_size: int = 1000) -> DataFrame:
    """2 E|x-y| - E|x-x'| - E|y-y'| of two vector tables (id, vector); tiles emit one sum each."""
    def total(d2: np.ndarray, same: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"s": [np.sqrt(d2).sum()], "n": [float(d2.size)]})

    def mean(a: DataFrame, b: DataFrame) -> Column:
        return _tile_sums(a, b, total, "s double, n double", block_size).agg((F.sum("s") / F.sum("n")).alias("m")).scalar()

    one = x.sparkSession.range(1)
    cols = one.select(mean(x, y).alias("xy"), mean(x, x).alias("xx"), mean(y, y).alias("yy"))
    return cols.select((2 * F.col("xy") - F.col("xx") - F.col("yy")).alias("energy_distance"))


def median_squared_distance(z: DataFrame, block_size: int = 1000, bins: int = 4096) -> float:
    """Exact median of the positive squared distances, 1 if there is none.

    A histogram finds the bin it lies in; a bin that holds more than ``_BIN_VALUES`` is cut into bins again, and a last
    pass reads the values of that bin.  No distance is above four times the largest squared norm.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda total, v: total + v * v)
    top = z.agg(4 * F.max(square)).first()[0]
    steps: list[tuple[float, float, int]] = []  # (low end, width, bin) from the whole range down
    low, width = 0.0, top / bins if top else 1.0

    def bin_of(v: np.ndarray, low: float, width: float) -> np.ndarray:
        return np.clip((v - low) / width, 0, bins - 1).astype(int)

    def left(d2: np.ndarray, steps: list[tuple[float, float, int]]) -> np.ndarray:
        v = d2[d2 > 0]
        for low, width, one in steps:
            v = v[bin_of(v, low, width) == one]
        return v

    before, n = 0, None
    while True:
        # this round's values, whatever the loop makes of the names later
        def hist(d2: np.ndarray, same: np.ndarray, steps: list = list(steps), low: float = low, width: float = width) -> pd.DataFrame:
            c = np.bincount(bin_of(left(d2, steps), low, width), minlength=bins)
            b = np.flatnonzero(c)
            return pd.DataFrame({"b": b.astype("int32"), "c": c[b].astype("int64")})

        h = _tile_sums(z, z, hist, "b int, c long", block_size, half=True).groupBy("b").agg(F.sum("c").alias("c")).toPandas().sort_values("b")
        if n is None:
            n = int(h["c"].sum())
            if n == 0:
                return 1.0
            lo, hi = (n - 1) // 2, n // 2
        cum = before + h["c"].cumsum().to_numpy()
        wanted = sorted({int(h["b"].to_numpy()[np.searchsorted(cum, p, side="right")]) for p in (lo, hi)})
        before += int(h.loc[h["b"] < wanted[0], "c"].sum())
        held = int(h.loc[h["b"].isin(wanted), "c"].sum())
        if held <= _BIN_VALUES or len(wanted) > 1 or len(steps) == 3:
            break
        steps.append((low, width, wanted[0]))
        low, width = low + wanted[0] * width, width / bins

    def inside(d2: np.ndarray, same: np.ndarray) -> pd.DataFrame:
        v = left(d2, steps)
        u, c = np.unique(v[np.isin(bin_of(v, low, width), wanted)], return_counts=True)
        return pd.DataFrame({"v": u, "c": c.astype("int64")})

    vals = cut_lineage(_tile_sums(z, z, inside, "v double, c long", block_size, half=True).groupBy("v").agg(F.sum("c").alias("c")))
    vals = running_sums(vals, "v", ["c"])
    got = [vals.where((F.col("cum_c") > p - before) & (F.col("cum_c") - F.col("c") <= p - before)).first()["v"] for p in (lo, hi)]
    return (got[0] + got[1]) / 2


def rbf_mmd(x: DataFrame, y: DataFrame, block_size: int = 1000) -> DataFrame:
    """Squared MMD with the kernel exp(-d2 / (2 x bandwidth)); the bandwidth is the median positive squared distance of the pooled rows."""
    pooled = x.select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"), "vector").unionByName(y.select(F.concat(F.lit("y"), F.col("id").cast("string")).alias("id"), "vector"))
    band = median_squared_distance(cut_lineage(pooled), block_size)

    def kernel(d2: np.ndarray, same: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"s": [np.exp(-d2 / (2 * band)).sum()], "n": [float(d2.size)]})

    def mean(a: DataFrame, b: DataFrame) -> Column:
        return _tile_sums(a, b, kernel, "s double, n double", block_size, half=a is b).agg((F.sum("s") / F.sum("n")).alias("m")).scalar()

    cols = x.sparkSession.range(1).select(mean(x, y).alias("xy"), mean(x, x).alias("xx"), mean(y, y).alias("yy"), F.lit(band).alias("bandwidth"))
    return cols.select((F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("mmd2"), "bandwidth")


def differential_effects(df: DataFrame, k: int = 20) -> DataFrame:
    """Per-gene mean true and predicted effect, overlap of the top-k by size, sign agreement on their union.

    ``df``: (gene, observed, predicted) effects.
    """
    g = cut_lineage(df.groupBy("gene").agg(F.round(F.avg("observed"), 9).alias("t"), F.round(F.avg("predicted"), 9).alias("p")))
    a = g.orderBy(F.desc(F.abs("t")), "gene").limit(k).select("gene", F.lit(1).alias("in_t"))
    b = g.orderBy(F.desc(F.abs("p")), "gene").limit(k).select("gene", F.lit(1).alias("in_p"))
    u = g.join(a.join(b, "gene", "full"), "gene")
    agree = F.avg((F.signum("t") == F.signum("p")).cast("double"))
    return u.agg((F.count_if(F.col("in_t").isNotNull() & F.col("in_p").isNotNull()) / F.lit(float(k))).alias("top_overlap"), agree.alias("sign_agreement"))


# --- repeated predictions -----------------------------------------------------------------------------------------

def ensemble_ranking(pred: DataFrame, top_k: int = 10, conservative: float = 1.0) -> DataFrame:
    """Mean, sd, 95 % interval, mean - k sd, and the share of samples that rank the candidate in the top k.

    ``pred``: (sample, candidate, metric, pred).  A (metric, sample) ranking is cut with a window over that group;
    Catalyst turns the rank filter into a group limit before the shuffle, so only k rows per task and group move.
    """
    stats = pred.groupBy("metric", "candidate").agg(F.avg("pred").alias("mean"), F.stddev_samp("pred").alias("sd"), F.count(F.lit(1)).alias("n_samples"))
    place = F.row_number().over(Window.partitionBy("metric", "sample").orderBy(F.desc("pred"), "candidate"))
    top = pred.withColumn("_p", place).where(F.col("_p") <= top_k).groupBy("metric", "candidate").agg(F.count(F.lit(1)).alias("_k"))
    samples = pred.groupBy("metric").agg(F.countDistinct("sample").alias("_m"))
    out = stats.join(top, ["metric", "candidate"], "left").join(samples, "metric")
    sd = F.coalesce("sd", F.lit(0.0))
    return out.select(
        "metric", "candidate", "n_samples", "mean", sd.alias("sd"), (F.col("mean") - 1.96 * sd).alias("ci_low"), (F.col("mean") + 1.96 * sd).alias("ci_high"),
        (F.col("mean") - conservative * sd).alias("conservative"), (F.coalesce("_k", F.lit(0)) / F.col("_m")).alias("top_k_probability"),
    )


def gaussian_nll(df: DataFrame, y: str, mean: str, log_var: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(y) - F.col(mean)
    return df.groupBy(*by).agg(F.avg(0.5 * (F.exp(-F.col(log_var)) * d * d + F.col(log_var))).alias("nll"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts; values on the upper edge belong to the last bin."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_statistics(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    q = exact_quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    names = {0.0: "min_value", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max_value"}
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("q") == k, F.col("quantile"))).alias(v) for k, v in names.items()])
