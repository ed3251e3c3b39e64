"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are rotated to leading principal dimensions, sorted by their cells in a grid of epsilon there, and cut into
blocks of consecutive vectors.  Pairs of sequence intervals are joined recursively, from the whole sequence down to
blocks; an interval keeps the box around its vectors, and a pair of boxes farther apart than epsilon is left out, for no
vector of one can reach one of the other.  What remains is compared in blocks by cosine in double precision.

Equal vectors are one class before the join.  Pairs of blocks are dealt in units of two stripes of consecutive blocks,
so that a block is copied once per unit, not once per pair; units go in rounds of bounded copies, whose shuffles are
dropped.  A unit reports a count and a smallest neighbour per class, never a row per pair.  The rotation is fitted on a bounded sample (``FIT_NUMBERS`` vector components); it only decides
how much is left out, not what is found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm.components import component_labels, smallest_labels
from targetloom.llm.registry import query, table
from targetloom.session import cut_lineage

LEAST_COSINE = 0.95
BLOCK = 4096
LEADING = 8
FIT_NUMBERS = 1 << 20
FAN = 8  # intervals of one level that make one of the next
STRIPE_BYTES = 64 << 20  # of vectors that a task of the join holds
ROUND_BYTES = 128 << 20  # of copied blocks in a round of the join, or as many as all blocks have where that is more
LINK_ROWS = 1 << 20


def _rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions of the vectors of each length met in a bounded sample."""
    longest = classes.agg(F.max("dim")).first()[0] or 1
    sample = classes.orderBy(F.xxhash64("key"), "key").select("dim", "vec").limit(max(256, FIT_NUMBERS // longest)).toLocalIterator()
    by_dim: dict[int, list[np.ndarray]] = {}
    for row in sample:
        by_dim.setdefault(row.dim, []).append(_unit(np.frombuffer(row.vec, dtype="<f4")[None, :])[0])
    return {dim: np.linalg.svd(np.stack(rows) - np.mean(rows, axis=0), full_matrices=False)[2][:LEADING].T for dim, rows in by_dim.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add key, dim and packed vector; all null where the vector links with nothing."""
    for batch in batches:
        keys, dims, packed = [], [], []
        for value in batch.column("vec"):
            x = None if not value.is_valid or value.values.null_count else value.values.to_numpy(zero_copy_only=False).astype("<f4")
            good = x is not None and len(x) and np.isfinite(x).all() and x.any()
            raw = x.tobytes() if good else None
            keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            dims.append(len(x) if good else None)
            packed.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "key", "dim", "vec"])


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    Two vectors of one length are linked when their cosine is ``least`` or more; ``n_links`` counts the other rows that a
    row is linked with, copies included; the component is the smallest identifier that links reach, and its row is kept.
    A vector that is null, empty, zero or holds a null or non-finite component is linked with nothing.  Null identifiers
    take the smallest of their component, null if there is none; rows that repeat an identifier are linked as any others;
    an empty table gives no rows; other columns are not read.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine lies above 0 and not above 1")
    id_type = vectors.schema[id_col].dataType.simpleString()
    read = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vec")).mapInArrow(_usable, f"vec_id {id_type}, key binary, dim int, vec binary")
    rows = cut_lineage(read.select("vec_id", "key"))  # the vectors are read again: two tables of them, classes and blocks, are enough
    grouped = read.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = cut_lineage(grouped.withColumn("class", F.monotonically_increasing_id()))
    pairs, blocks = _block_pairs(classes, least, block)
    links = _linked(pairs, blocks, least)
    labels = component_labels(links.select("u", "v"))
    named = classes.select("key", "class", "rep", "copies").join(labels, F.col("class") == F.col("node"), "left")
    counts = links.groupBy("u").agg(F.sum("n").alias("n"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("low")).where("label is not null")
    final = named.join(lowest, "label", "left").join(counts, F.col("class") == F.col("u"), "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id")
    )
    out = rows.select("vec_id", "key").join(final, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _block_pairs(classes: DataFrame, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of block numbers that may hold links, packed blocks in epsilon grid order)."""
    epsilon = math.sqrt(2 - 2 * least) or 1e-6
    turns = classes.sparkSession.sparkContext.broadcast(_rotations(classes))  # LEADING x vector length numbers
    parts = max(1, min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // block)))

    def leading(dim: int, x: np.ndarray) -> np.ndarray:
        turn = turns.value.get(dim)
        out = np.zeros((len(x), LEADING))
        got = _unit(x) @ (turn if turn is not None else np.eye(dim, LEADING))
        out[:, : got.shape[1]] = got
        return out

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                x = leading(int(dim), np.stack([np.frombuffer(v, dtype="<f4") for v in some["vec"]]))
                grid = np.floor(x / epsilon).astype(int) + (1 << 20)  # every coordinate of a unit vector is a few cells at most
                yield some.assign(cell=[" ".join(f"{c:07d}" for c in g) for g in grid.tolist()])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for dim, some in batch.groupby("dim", sort=False):
                if held and held[0]["dim"].iloc[0] != dim:
                    yield one(pd.concat(held))
                    held = []
                held.append(some)
                while sum(map(len, held)) >= block:
                    all_of = pd.concat(held)
                    yield one(all_of.iloc[:block])
                    held = [all_of.iloc[block:]] if len(all_of) > block else []
        if held:
            yield one(pd.concat(held))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        raw = b"".join(rows["vec"])
        x = leading(dim, np.frombuffer(raw, dtype="<f4").reshape(-1, dim))
        return pd.DataFrame({
            "first": [rows["cell"].iloc[0]], "dim": [dim], "ids": [rows["class"].to_numpy().astype("<i8").tobytes()], "copies": [rows["copies"].to_numpy().astype("<i8").tobytes()], "vecs": [raw],
            "low": [x.min(axis=0).tolist()], "high": [x.max(axis=0).tolist()],
        })

    celled = classes.select("class", "copies", "dim", "vec").mapInPandas(cells, "class long, copies long, dim int, vec binary, cell string")
    ordered = celled.repartitionByRange(parts, "dim", "cell", "class").sortWithinPartitions("dim", "cell", "class")
    packed = ordered.mapInPandas(pack, "first string, dim int, ids binary, copies binary, vecs binary, low array<double>, high array<double>")
    blocks = cut_lineage(packed.withColumn("place", F.monotonically_increasing_id()))
    # places are gapped numbers in sequence order: number the blocks through, partition by partition
    sizes = blocks.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()  # a row per partition
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["part"], before))
        before += row["count"]
    starts = classes.sparkSession.createDataFrame(offsets, "part long, start long")
    blocks = blocks.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(starts), "part").withColumn("s", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1))
    blocks = blocks.select("s", "dim", "ids", "copies", "vecs", "low", "high")
    return _joined_intervals(cut_lineage(blocks.select("s", "dim", "low", "high")), before, epsilon), blocks


def _joined_intervals(blocks: DataFrame, count: int, epsilon: float) -> DataFrame:
    """Pairs (a <= b) of blocks whose boxes come within epsilon, by recursion over intervals of the sequence.

    The boxes, a row per block at most, are broadcast: pairs are shuffled without them.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = [blocks.select("s", "dim", F.col("dim").alias("last_dim"), "low", "high")]
    while count > 1:
        corner = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(LEADING)]
        grown = levels[-1].groupBy(F.floor(F.col("s") / FAN).alias("s")).agg(F.min("dim").alias("dim"), F.max("last_dim").alias("last_dim"), *corner)
        levels.append(cut_lineage(grown.select("s", "dim", "last_dim", *[F.array(*[f"{c}{i}" for i in range(LEADING)]).alias(c) for c in ("low", "high")])))
        count = -(-count // FAN)
    pairs = levels[-1].select(F.col("s").alias("a"), F.col("s").alias("b"))
    for level in levels[-2::-1]:
        children = [F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c) for c in ("a", "b")]
        down = pairs.select(children[0], "b").select("a", children[1]).where("a <= b")
        left, right = ([F.col(c).alias(f"{side}_{c}") for c in ("s", "dim", "last_dim", "low", "high")] for side in ("a", "b"))
        spread = down.repartition(parts, "a", "b")
        met = spread.join(F.broadcast(level.select(*left)), F.col("a") == F.col("a_s")).join(F.broadcast(level.select(*right)), F.col("b") == F.col("b_s"))
        gaps = [F.greatest(F.lit(0.0), F.col("b_low")[i] - F.col("a_high")[i], F.col("a_low")[i] - F.col("b_high")[i]) for i in range(LEADING)]
        near = sum(g * g for g in gaps) <= epsilon**2 * (1 + 1e-9) + 1e-12
        pairs = cut_lineage(met.where((F.col("a_dim") <= F.col("b_last_dim")) & (F.col("b_dim") <= F.col("a_last_dim")) & near).select("a", "b"))
    return pairs


def _units(pairs: DataFrame, stripe: int) -> DataFrame:
    """(s, row_stripe, column_stripe, side, partners) of the blocks that a pair of stripes needs: its rows a are side 0,
    its columns b side 1 with the a of their pairs."""
    units = pairs.select("a", "b", F.floor(F.col("a") / stripe).alias("row_stripe"), F.floor(F.col("b") / stripe).alias("column_stripe"))
    by = ["row_stripe", "column_stripe"]
    rows = units.groupBy(F.col("a").alias("s"), *by).agg(F.lit(0).alias("side"), F.lit(None).cast("array<long>").alias("partners"))
    return rows.unionByName(units.groupBy(F.col("b").alias("s"), *by).agg(F.lit(1).alias("side"), F.collect_list("a").alias("partners")))


def _linked(pairs: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """(u, v, n) per class and unit: the smallest class that links reach from it there, and the rows linked directly."""

    def compare(row_a: dict, row_b: dict, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (ids_a, n_a, x), (ids_b, n_b, y) = (
            (np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["copies"], "<i8"), _unit(np.frombuffer(r["vecs"], "<f4").reshape(-1, r["dim"]))) for r in (row_a, row_b)
        )
        found_a, found_b = [], []
        for i in range(0, len(x), 1024):
            cosine = x[i : i + 1024] @ y.T
            a, b = np.nonzero(cosine >= least)
            a = a + i
            keep = a != b if same else np.ones(len(a), dtype=bool)
            found_a.append(a[keep])
            found_b.append(b[keep])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        count_a = np.bincount(a, n_b[b], minlength=len(x))
        count_b = np.zeros(len(y)) if same else np.bincount(b, n_a[a], minlength=len(y))
        low_a, low_b = ids_a.copy(), ids_b.copy()
        np.minimum.at(low_a, a, ids_b[b])
        np.minimum.at(low_b, b, low_a[a])
        ids, low, count = np.concatenate([ids_a, ids_b]), np.concatenate([low_a, low_b]), np.concatenate([count_a, count_b])
        # each link's ends share a label or are joined through it: u - low(u), and u - low of its neighbours
        extra = np.unique(np.stack([low_a[a], low_b[b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
        some = count > 0 if not same else np.concatenate([count_a > 0, np.zeros(len(y), dtype=bool)])
        back = np.flatnonzero(np.concatenate([np.zeros(len(x), dtype=bool), np.bincount(b, minlength=len(y)) > 0])) if same else np.zeros(0, dtype=np.int64)
        u = np.concatenate([ids[some], ids[back], extra[:, 0]])
        v = np.concatenate([low[some], low[back], extra[:, 1]])
        return u, v, np.concatenate([count[some].astype(np.int64), np.zeros(len(back) + len(extra), dtype=np.int64)])

    def merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, n = (np.concatenate(x) for x in zip(*found))
        ends, low = smallest_labels(u, v)
        total = np.zeros(len(ends), dtype=np.int64)
        np.add.at(total, np.searchsorted(ends, u), n)
        return ends, low, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        found: list[tuple[np.ndarray, ...]] = []
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (unit := (row["row_stripe"], row["column_stripe"])) != last:
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(found)], ["u", "v", "n"])
                    held, found, last = {}, [], unit
                if row["side"] == 0:
                    held[row["s"]] = row
                for a in row["partners"] or ():
                    if held[a]["dim"] == row["dim"]:
                        found.append(compare(held[a], row, a == row["s"]))
                        if sum(len(x[0]) for x in found) > LINK_ROWS:
                            found = [merged(found)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(found)], ["u", "v", "n"])

    spark = pairs.sparkSession
    tasks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    count, widest, total = blocks.agg(F.count(F.lit(1)), F.max(F.length("vecs")), F.sum(F.length("vecs"))).first()
    stripe = max(1, min(count // math.isqrt(2 * tasks), STRIPE_BYTES // max(1, widest or 0)))
    needed = cut_lineage(_units(pairs, stripe))
    rounds = math.ceil(needed.count() * (total or 0) / max(1, count) / max(total or 0, ROUND_BYTES))
    out = spark.createDataFrame([], "u long, v long, n long")
    for turn in range(rounds):
        now = needed.where(F.pmod(F.xxhash64("row_stripe", "column_stripe"), F.lit(rounds)) == turn)
        copies = blocks.select("s", "dim", "ids", "copies", "vecs").join(F.broadcast(now), "s")  # ``now`` has no vectors: stripes and places of as many rows as a round copies
        dealt = copies.repartition(tasks, "row_stripe", "column_stripe").sortWithinPartitions("row_stripe", "column_stripe", "side", "s")
        out = out.union(cut_lineage(dealt.mapInArrow(run, "u long, v long, n long")))
    return out


@query("op8_grid_order")
def op8_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
